"""The conversation store: a header row per conversation and a row per message.

Messages stay flat, so neither a merge nor a scan ever gathers a conversation in one cell."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.labels import message_flags, message_score, pair_intent, tags_topic
from corpusflow.functions.text import norm_text, strip, structure_type, text_of
from corpusflow.operators.sampling import select_best
from corpusflow.operators.scan import digest, keep_first

STATUSES = ["raw", "filtered", "selected"]
MESSAGE_DEFAULTS = {
    "is_technical": False, "is_in_domain": False, "has_error": False, "quality_score": 0.0,
    "intent": "question", "structure_type": "plain",
}
MIGRATIONS = ["001_create_indexes", "002_backfill_status", "003_backfill_message_fields"]


@dataclass(frozen=True)
class StoreWords:
    """Lexicons of tagging and scoring; None means the shipped lists."""

    flags: dict = field(default_factory=dict)
    score: dict = field(default_factory=dict)
    tags: list[str] | None = None
    intents: list | None = None


def messages_from_pairs(pairs: DataFrame, words: StoreWords = StoreWords()) -> DataFrame:
    """Two scored messages per exchange.

    ``pairs(conv_id, line, ts, user_text, assistant_text)``; the message id holds the line
    number, so reading the same log again adds nothing."""
    both = pairs.select(
        "conv_id", "line", "ts", pair_intent("user_text", "assistant_text", words.intents).alias("intent"),
        F.posexplode(F.array(
            F.struct(F.lit("user").alias("role"), strip("user_text").alias("content")),
            F.struct(F.lit("assistant").alias("role"), strip("assistant_text").alias("content")),
        )).alias("slot", "m"),
    ).select("conv_id", "line", "ts", "intent", "slot", "m.role", "m.content")
    both = both.withColumn("_f", message_flags("content", **words.flags))
    return both.select(
        "conv_id",
        F.concat_ws("_", "conv_id", F.col("line").cast("string"), "role", F.col("slot").cast("string")).alias("id"),
        "role", "content", F.col("ts").alias("created_at"), (F.col("line") * 2 + F.col("slot")).alias("seq"),
        "_f.is_technical", "_f.is_in_domain", "_f.has_error",
        message_score(F.col("role"), "content", F.col("_f.is_in_domain"), F.col("_f.is_technical"),
                      F.col("_f.has_error"), **words.score).alias("quality_score"),
        "intent", structure_type("content").alias("structure_type"),
    )


def headers_from_pairs(pairs: DataFrame, words: StoreWords = StoreWords()) -> DataFrame:
    """One header per conversation; scalars come from the last line read."""
    t = tags_topic("user_text", "assistant_text", lexicon=words.tags)
    rows = pairs.select("conv_id", "user_id", "line", "ts", t.alias("_t"))
    last = F.struct("user_id", "ts", "_t")
    return rows.groupBy("conv_id").agg(
        F.max_by(last, "line").alias("_l"), F.min_by("ts", "line").alias("started_at"),
    ).select(
        "conv_id", F.col("_l.user_id").alias("user_id"), "started_at", F.col("_l.ts").alias("ended_at"),
        F.col("_l._t.topic").alias("topic"), F.array_join("_l._t.tags", ",").alias("tags"),
        F.lit(0.0).alias("quality_score"), F.lit("raw").alias("status"),
    )


def merge_messages(existing: DataFrame, incoming: DataFrame, key: str = "conv_id",
                   order: list[str] = ("seq",)) -> tuple[DataFrame, DataFrame]:
    """Union by message id, existing rows win, blank ids drop; and how many were added."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(
        incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True
    ).filter(text_of("id") != "")
    merged = keep_first(both, [F.col(key).cast("string"), F.col("id")], ["_new", *order])
    added = merged.groupBy(key).agg(F.sum("_new").alias("added"))
    return merged.drop("_new"), added


def conversation_table(existing: DataFrame, incoming: DataFrame, key: str = "conv_id") -> DataFrame:
    """Upsert headers: incoming scalars replace, ``started_at`` stays, status and score reset.

    Untouched conversations keep their row."""
    old = existing.withColumn("_new", F.lit(0))
    new = incoming.withColumn("_new", F.lit(1))
    rows = old.unionByName(new, allowMissingColumns=True)
    scalars = [c for c in existing.columns if c not in (key, "started_at")]
    out = rows.groupBy(key).agg(
        F.max_by(F.struct(*scalars), "_new").alias("_s"), F.min_by("started_at", "_new").alias("started_at"),
        F.max("_new").alias("_touched"),
    )
    fresh = F.col("_touched") == 1
    values = {"status": F.when(fresh, F.lit("raw")).otherwise(F.col("_s.status")),
              "quality_score": F.when(fresh, F.lit(0.0)).otherwise(F.col("_s.quality_score"))}
    return out.select(*[
        F.col(key) if c == key else F.col("started_at") if c == "started_at"
        else values.get(c, F.col(f"_s.{c}")).alias(c) for c in existing.columns
    ])


def conversation_score(messages: DataFrame, min_score: float, key: str = "conv_id") -> DataFrame:
    """Weighted mean quality per conversation and the status that follows.

    Two distinct assistant answers exist exactly when the smallest and largest digest differ."""
    answer = F.when(F.col("role") == "assistant", digest(norm_text("content")))
    per = messages.groupBy(key).agg(
        F.avg("quality_score").alias("q"), F.avg(F.col("is_in_domain").cast("int")).alias("d"),
        F.avg(F.col("has_error").cast("int")).alias("e"), F.min(answer).alias("lo"), F.max(answer).alias("hi"),
    )
    penalty = F.when(F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)), F.lit(0.05)).otherwise(F.lit(0.0))
    raw = F.col("q") * 0.75 + F.col("d") * 0.20 + (F.lit(1.0) - F.col("e")) * 0.05
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw - penalty))
    # rounding keeps the threshold independent of the order of summation
    return per.select(key, F.round(score, 9).alias("quality_score")).withColumn(
        "status", F.when(F.col("quality_score") >= min_score, "filtered").otherwise("raw"))


def mark_selected(convs: DataFrame, ids: DataFrame, key: str = "conv_id") -> DataFrame:
    """Selected ids get the status; the earlier selection is released unless nothing qualifies."""
    found = ids.agg((F.count(F.lit(1)) > 0).alias("_any")).scalar()
    chosen = ids.select(key).distinct().withColumn("_chosen", F.lit(True))
    rows = convs.join(chosen, key, "left")
    status = (
        F.when(F.col("_chosen"), "selected")
        .when(found & (F.col("status") == "selected"), "filtered").otherwise(F.col("status"))
    )
    return rows.withColumn("status", status).drop("_chosen")


def select_conversations(convs: DataFrame, n: int, min_score: float) -> DataFrame:
    return mark_selected(convs, select_best(convs, n, min_score))


def backfill_defaults(docs: DataFrame, applied: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Run the migrations the ledger does not list yet; each runs once.

    ``docs`` has ``status``, ``quality_score`` and a ``messages`` array of structs;
    the ledger is ``(id, name, description, applied_at, result)``."""
    now = F.current_timestamp().cast("string") if now is None else now
    done = {r["id"] for r in applied.filter(F.col("id").isin(MIGRATIONS)).select("id").collect()}
    out = docs
    todo = [m for m in MIGRATIONS if m not in done]
    if "002_backfill_status" in todo:
        missing = F.col("status").isNull()
        out = out.withColumns({
            "quality_score": F.when(missing, F.lit(0.0)).otherwise(F.col("quality_score")),
            "status": F.coalesce("status", F.lit("raw")),
        })
    if "003_backfill_message_fields" in todo:
        def reset(m: Column) -> Column:
            for name, value in MESSAGE_DEFAULTS.items():
                m = m.withField(name, F.lit(value))
            return m
        out = out.withColumn("messages", F.transform("messages", reset))
    spark = docs.sparkSession
    if not todo:
        return out, applied
    schema = "id string, name string, description string, result string"
    fresh = spark.createDataFrame([(m, m[4:], None, "done") for m in todo], schema).withColumn("applied_at", now)
    return out, applied.unionByName(fresh, allowMissingColumns=True)


def save_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Write a new version beside the old one and swap, so a lost job leaves the table readable."""
    spark: SparkSession = df.sparkSession
    staging, old = path.rstrip("/") + "__new", path.rstrip("/") + "__old"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(staging)
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jvm.Path(old), True)
    if fs.exists(jvm.Path(path)):
        fs.rename(jvm.Path(path), jvm.Path(old))
    fs.rename(jvm.Path(staging), jvm.Path(path))
