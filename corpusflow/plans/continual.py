"""Chat logs to the conversation store, and the selected conversations back to training sets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.labels import conversation_key
from corpusflow.functions.text import norm_text, strip, text_of
from corpusflow.operators.pairs import training_rows
from corpusflow.operators.sampling import head_per_file
from corpusflow.session import settle
from corpusflow.sources.store import (
    StoreWords, conversation_score, conversation_table, headers_from_pairs, merge_messages,
    messages_from_pairs, select_conversations,
)

ID_COLUMNS = ["conversation_id", "session_id", "trace_id", "request_id"]


@dataclass(frozen=True)
class ContinualPolicy:
    min_score: float = 0.70
    select_min_score: float = 0.75
    select_limit: int = 5000
    seed_rows_per_file: int = 3000
    words: StoreWords = field(default_factory=StoreWords)
    style_words: tuple = ("ton", "style")


def pairs_from_events(events: DataFrame, now: Column | None = None) -> DataFrame:
    """Exchanges of a chat log; ``row_idx`` counts its lines from 1."""
    now = F.current_timestamp().cast("string") if now is None else now
    ids = [F.col(c) for c in ID_COLUMNS if c in events.columns]
    user = F.col("user_id").cast("string") if "user_id" in events.columns else F.lit(None).cast("string")
    out = events.select(
        conversation_key(ids, F.col("row_idx")).alias("conv_id"), F.col("row_idx").alias("line"),
        F.coalesce(F.nullif(text_of("timestamp"), F.lit("")), now).alias("ts"),
        F.coalesce(F.nullif(user, F.lit("")), F.lit("unknown")).alias("user_id"),
        strip("user_text").alias("user_text"), strip("assistant_text").alias("assistant_text"),
    )
    return out.filter((F.col("user_text") != "") & (F.col("assistant_text") != ""))


def seed_pairs(rows: DataFrame, most: int, now: Column) -> DataFrame:
    """Training rows as one-exchange conversations, the first ``most`` rows of each dataset."""
    head = head_per_file(rows, most, ["dataset"])
    return head.select(
        F.concat_ws("_", F.lit("csv"), "dataset", (F.col("row_idx") + 1).cast("string")).alias("conv_id"),
        (F.col("row_idx") + 1).alias("line"), now.alias("ts"), F.lit("seed_csv").alias("user_id"),
        strip("instruction").alias("user_text"), strip("response").alias("assistant_text"),
        strip("history").alias("history"),
    ).filter((F.col("user_text") != "") & (F.col("assistant_text") != ""))


def history_messages(pairs: DataFrame) -> DataFrame:
    """A seed row's history becomes a leading user message."""
    return pairs.filter(F.col("history") != "").select(
        "conv_id", F.concat(F.col("conv_id"), F.lit("_history_0")).alias("id"), F.lit("user").alias("role"),
        F.col("history").alias("content"), F.col("ts").alias("created_at"),
        (F.col("line") * 2 - 1).alias("seq"), F.lit(True).alias("is_technical"),
        F.lit(True).alias("is_in_domain"), F.lit(False).alias("has_error"),
        F.lit(0.75).alias("quality_score"), F.lit("summary").alias("intent"),
        F.lit("plain").alias("structure_type"),
    )


def ingest(headers: DataFrame | None, messages: DataFrame | None, pairs: DataFrame,
           words: StoreWords = StoreWords()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New headers, merged messages, and the messages added per conversation."""
    new_headers, new_messages = headers_from_pairs(pairs, words), messages_from_pairs(pairs, words)
    if "history" in pairs.columns:
        new_messages = new_messages.unionByName(history_messages(pairs))
    if headers is None or messages is None:
        headers, messages = new_headers.limit(0), new_messages.limit(0)
    merged, added = merge_messages(messages, new_messages)
    return conversation_table(headers, new_headers), merged, added


def score_and_select(headers: DataFrame, messages: DataFrame, policy: ContinualPolicy) -> DataFrame:
    """Every conversation with messages gets its score; the best filtered ones are selected."""
    scores = conversation_score(messages, policy.min_score).select(
        "conv_id", F.col("quality_score").alias("_q"), F.col("status").alias("_s"))
    rows = headers.join(scores, "conv_id", "left")
    rows = rows.withColumns({
        "quality_score": F.coalesce("_q", "quality_score"), "status": F.coalesce("_s", "status"),
    }).drop("_q", "_s")
    return select_conversations(rows, policy.select_limit, policy.select_min_score)


def export_rows(headers: DataFrame, messages: DataFrame, policy: ContinualPolicy) -> DataFrame:
    """Training rows of the selected conversations with the dataset they belong to."""
    chosen = headers.filter(F.col("status") == "selected").select("conv_id")
    told = settle(messages.join(chosen, "conv_id", "left_semi").select(
        "conv_id", "seq", "role", F.col("content").alias("text"), "intent", "structure_type"))
    rows = training_rows(told, "conv_id", "seq", source="continual_db_selected",
                         extra=["intent", "structure_type"])
    asked = norm_text("instruction")
    styled = asked.contains(policy.style_words[0])
    for w in policy.style_words[1:]:
        styled = styled | asked.contains(w)
    route = (
        F.when((F.col("structure_type") == "json") | (F.col("intent") == "workflow"), "agent_actions")
        .when(F.col("intent") == "summary", "context_memory")
        .when(styled, "style_signature").otherwise("core_qa")
    )
    return rows.withColumn("dataset", route)


def continual_conversations(pairs: DataFrame, policy: ContinualPolicy = ContinualPolicy(),
                            headers: DataFrame | None = None, messages: DataFrame | None = None,
                            seeds: DataFrame | None = None) -> dict[str, DataFrame]:
    """Ingest, score, select, export. Seed rows are read only when the log had nothing."""
    if seeds is not None and pairs.isEmpty():
        pairs = seed_pairs(seeds, policy.seed_rows_per_file, F.current_timestamp().cast("string"))
    table, merged, added = ingest(headers, messages, settle(pairs), policy.words)
    merged = settle(merged)
    table = settle(score_and_select(table, merged, policy))
    rows = export_rows(table, merged, policy)
    out = {"conversations": table, "messages": merged, "added": added, "rows": rows}
    for name in ("core_qa", "agent_actions", "context_memory", "style_signature"):
        out[name] = rows.filter(F.col("dataset") == name).select(
            "instruction", F.col("history").alias("input"), F.col("response").alias("output"))
    report = table.agg(
        F.count(F.lit(1)).alias("conversations"), F.count_if(F.col("status") != "raw").alias("filtered"),
        F.count_if(F.col("status") == "selected").alias("selected"))
    out["report"] = report
    return out
