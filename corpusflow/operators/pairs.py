"""Turns to pairs, rows with history, and the lookups around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.text import (
    mask_placeholders, strip, text_of, unmask,
)
from corpusflow.operators.scan import chunk_of, digest, with_neighbours

HISTORY_SEPARATOR = " ||| "
SPEAKER = {"user": "Utilisateur: ", "assistant": "Assistant: "}


def adjacent_pairs(turns: DataFrame, conv: str = "conv_id", pos: str = "turn", text: str = "text",
                   max_chars: int | None = 300, extra: list[str] = ()) -> DataFrame:
    """Each turn with the next one, whatever the roles; ``turn_index`` is the first turn.

    Blank or NULL turns take part in the pairing, the pairs they touch are dropped afterwards."""
    cols = [text, *extra]
    src = turns.withColumn("_chunk", chunk_of(pos))
    both = with_neighbours(src, [conv], [pos], cols, "_chunk", following="_next")
    out = both.select(
        conv, F.col(pos).alias("turn_index"),
        F.col(text).alias("prompt"), F.col(f"_next.{text}").alias("response"),
        *[F.col(c).alias(f"prompt_{c}") for c in extra],
        *[F.col(f"_next.{c}").alias(f"response_{c}") for c in extra],
    ).filter((strip("prompt") != "") & (strip("response") != ""))
    if max_chars is not None:
        out = out.filter((F.length("prompt") <= max_chars) & (F.length("response") <= max_chars))
    return out


def training_rows(messages: DataFrame, conv: str = "conv_id", pos: str = "turn", role: str = "role",
                  text: str = "text", limit: int = 1400, source: str = "conversations",
                  extra: list[str] = ()) -> DataFrame:
    """User/assistant rows with the history before the question, cut at ``limit`` characters.

    An assistant turn counts when a user turn stands right before it. The history is a prefix
    of the conversation, so its first turns up to ``limit`` characters serve every row."""
    said = messages.select(conv, pos, role, strip(text).alias(text), *extra).filter(
        F.col(role).isin("user", "assistant") & (F.col(text) != "")
    ).withColumn("_chunk", chunk_of(pos))
    seen = with_neighbours(said, [conv], [pos], [role, text, pos], "_chunk", previous="_prev")
    # a history entry takes at least 17 characters with its separator
    most = limit // 17 + 1
    first = F.row_number().over(Window.partitionBy(conv).orderBy(pos))
    line = F.concat(
        F.when(F.col(role) == "user", SPEAKER["user"]).otherwise(SPEAKER["assistant"]),
        F.substring(text, 1, limit),
    )
    turns = with_neighbours(said.select(conv, pos, role, "_chunk", line.alias("line")), [conv], [pos], [role],
                            "_chunk", previous="_prev")
    heads = (
        turns.filter((F.col(role) == "user") | (F.col(f"_prev.{role}") == "user")).withColumn("_r", first)
        .filter(F.col("_r") <= most).groupBy(conv)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("at"), "line"))).alias("_head"))
    )
    chunks = said.select(conv, "_chunk").distinct()
    heads = chunks.join(heads, conv)
    rows = seen.filter((F.col(role) == "assistant") & (F.col(f"_prev.{role}") == "user"))
    rows = rows.join(heads, [conv, "_chunk"])
    asked = F.col(f"_prev.{pos}")
    before = F.transform(F.filter("_head", lambda h: h["at"] < asked), lambda h: h["line"])
    return rows.select(
        conv, F.col(pos).alias("turn"), F.col(f"_prev.{text}").alias("instruction"),
        F.col(text).alias("response"),
        F.substring(F.array_join(before, HISTORY_SEPARATOR), 1, limit).alias("history"),
        F.lit(source).alias("source"), *extra,
    )


def role_pairs(messages: DataFrame, conv: str = "conv_id", pos: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """Adjacent user and assistant turns, stripped, without history."""
    both = adjacent_pairs(messages, conv, pos, text, None, [role])
    return both.filter((F.col("prompt_role") == "user") & (F.col("response_role") == "assistant")).select(
        conv, F.col("turn_index").alias("turn"), strip("prompt").alias("user_text"),
        strip("response").alias("assistant_text"),
    )


def resolve_utterances(conversations: DataFrame, lines: DataFrame, max_chars: int | None = 300) -> DataFrame:
    """Line ids to texts; a missing line removes both pairs it touches.

    ``conversations(conversation_id, line_ids)``, ``lines(line_id, text, ...)``."""
    ids = conversations.select("conversation_id", F.posexplode("line_ids").alias("pos", "line_id"))
    extra = [c for c in lines.columns if c not in ("line_id", "text")]
    found = ids.join(lines, "line_id", "left")
    return adjacent_pairs(found, "conversation_id", "pos", "text", max_chars, ["line_id", *extra])


def attach_metadata(pairs: DataFrame, movies: DataFrame, characters: DataFrame) -> DataFrame:
    """Left lookups with defaults: unknown gender ``?``, unknown name from the line itself."""
    speaker = characters.select(
        F.col("character_id").alias("prompt_character_id"), F.col("character_name").alias("_s_name"),
        F.col("character_gender").alias("_s_gender"))
    listener = characters.select(
        F.col("character_id").alias("response_character_id"), F.col("character_name").alias("_l_name"),
        F.col("character_gender").alias("_l_gender"))
    film = movies.select(F.col("movie_id").alias("prompt_movie_id"), "movie_title", "movie_year", "genres")
    out = (
        pairs.join(film, "prompt_movie_id", "left")
        .join(speaker, "prompt_character_id", "left")
        .join(listener, "response_character_id", "left")
    )
    blank = F.lit("")
    return out.select(
        "conversation_id", "turn_index", F.col("prompt_movie_id").alias("movie_id"),
        F.coalesce("movie_title", blank).alias("movie_title"),
        F.coalesce("movie_year", blank).alias("movie_year"),
        F.coalesce("genres", blank).alias("genres"),
        F.col("prompt_character_id").alias("speaker_id"),
        F.coalesce("_s_name", "prompt_character_name").alias("speaker_name"),
        F.coalesce("_s_gender", F.lit("?")).alias("speaker_gender"),
        F.col("response_character_id").alias("listener_id"),
        F.coalesce("_l_name", "response_character_name").alias("listener_name"),
        F.coalesce("_l_gender", F.lit("?")).alias("listener_gender"),
        F.col("prompt").alias("prompt_en"), F.col("response").alias("response_en"),
    )


def translation_cache(pairs: DataFrame, cache: DataFrame, prefix: str = "en|fr::",
                      prompt: str = "prompt_en", response: str = "response_en",
                      done: str = "is_pretranslated_fr") -> tuple[DataFrame, DataFrame]:
    """Templates still to translate, and the pairs with whatever the cache already knows.

    ``cache(key, translated)``; an empty translation counts as missing. Texts are cut to
    distinct templates before the lookup; untranslated texts stay as they are."""
    known = cache.filter(text_of("translated") != "").select("key", "translated")
    open_rows = pairs.filter(~F.coalesce(F.col(done), F.lit(False)))
    texts = (
        open_rows.select(F.explode(F.array(prompt, response)).alias("text"))
        .filter(text_of("text") != "").distinct()
        .withColumn("_m", mask_placeholders("text"))
        .select("text", F.col("_m.template").alias("template"), F.col("_m.values").alias("values"),
                F.concat(F.lit(prefix), F.col("_m.template")).alias("key"))
    )
    todo = texts.join(known, "key", "left_anti").select("template").distinct()
    ready = texts.join(known, "key").select(
        digest("text").alias("_k"), unmask(F.col("translated"), F.col("values")).alias("_t")
    )
    out = pairs.withColumn("_done", F.coalesce(F.col(done), F.lit(False)))
    for col, name in ((prompt, "prompt_fr"), (response, "response_fr")):
        side = ready.withColumnRenamed("_t", f"_t_{name}")
        key = F.when(~F.col("_done"), digest(col))
        out = out.withColumn("_k", key).join(side, "_k", "left").drop("_k").withColumn(
            name, F.coalesce(F.col(f"_t_{name}"), F.col(col))
        ).drop(f"_t_{name}")
    return todo, out.drop("_done")
