"""Dialogue corpus job: pairs from all sources, first copy wins, translated from a cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.dedupe import first_wins_dedupe, pair_key
from corpusflow.operators.pairs import attach_metadata, resolve_utterances, translation_cache
from corpusflow.operators.scan import take_first
from corpusflow.sources.files import PAIR_COLUMNS, discover_pair_sources, read_delimited_corpus

ROW_WIDTH = 1_000_000


def movie_pairs(corpus: dict[str, DataFrame], max_chars: int | None = 300) -> DataFrame:
    """Resolved neighbouring utterances with film and speaker data, one row per text pair."""
    convs = corpus["conversations"]
    pairs = resolve_utterances(convs, corpus["lines"], max_chars)
    rows = attach_metadata(pairs, corpus["titles"], corpus["characters"])
    numbered = rows.join(convs.select("conversation_id", "line_no"), "conversation_id")
    numbered = numbered.withColumn("row_idx", F.col("line_no") * ROW_WIDTH + F.col("turn_index")).drop("line_no")
    return first_wins_dedupe(numbered, pair_key("lower", "prompt_en", "response_en"), ["row_idx"])


def merge_pairs(movies: DataFrame, extra: DataFrame | None, movie_source: str = "movie_dialogs") -> DataFrame:
    base = movies.withColumns({
        "source_dataset": F.lit(movie_source), "is_pretranslated_fr": F.lit(False), "src_rank": F.lit(0),
    })
    if extra is None:
        return base
    filled = extra
    for c in PAIR_COLUMNS:
        if c not in filled.columns:
            filled = filled.withColumn(c, F.lit("?" if c.endswith("gender") else ""))
    # dialog tables have several pairs per row
    filled = filled.withColumn("row_idx", F.col("row_idx") * ROW_WIDTH + F.col("turn_index"))
    rows = base.unionByName(filled.select(*base.columns))
    return first_wins_dedupe(rows, pair_key("lower", "prompt_en", "response_en"))


def training_view(fr: DataFrame) -> DataFrame:
    return fr.select(
        F.col("prompt_fr").alias("instruction"), F.col("response_fr").alias("response"),
        F.col("source_dataset").alias("source"), "conversation_id", "movie_title", "genres",
    )


def build_pair_corpus(spark: SparkSession, root: str, cache: DataFrame, max_translate: int | None = None,
                      prefer_native: bool = True, movie_source: str = "movie_dialogs"
                      ) -> dict[str, DataFrame]:
    """English pairs, French pairs, training rows, work list and a report."""
    movies = movie_pairs(read_delimited_corpus(spark, root))
    extra, counts = discover_pair_sources(spark, root, prefer_native)
    en = merge_pairs(movies, extra, movie_source)
    chosen = en
    if max_translate is not None:
        position = F.col("src_rank").cast("bigint") * F.lit(2 ** 52) + F.col("row_idx")
        coarse = F.col("src_rank").cast("bigint") * 100_000 + F.least(
            F.floor(F.col("row_idx") / ROW_WIDTH / 1000), F.lit(99_999))
        chosen = take_first(en, max_translate, [position], coarse)
    todo, fr = translation_cache(chosen, cache)
    fr = fr.withColumn("language", F.lit("fr"))
    report = en.agg(
        F.count(F.lit(1)).alias("total_pairs_en"),
        F.count_if(F.col("src_rank") == 0).alias("movie_pairs_kept"),
    )
    out = {"en": en, "fr": fr, "train": training_view(fr), "todo": todo, "report": report}
    if counts is not None:
        out["source_counts"] = counts
    return out
