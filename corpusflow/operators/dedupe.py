"""Duplicate handling and set operations. The first row in source order wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import norm_text, strip, text_of
from corpusflow.operators.scan import digest, keep_first

ORDER = ["src_rank", "row_idx"]


def pair_key(kind: str, instruction: str = "instruction", response: str = "response") -> list[Column]:
    """``exact`` (stripped), ``lower``, ``normalized`` pair keys; ``question`` alone."""
    if kind == "question":
        return [norm_text(instruction)]
    make = {"exact": strip, "lower": lambda c: F.lower(text_of(c)), "normalized": norm_text}[kind]
    return [make(instruction), make(response)]


def first_wins_dedupe(df: DataFrame, keys: list[Column], order: list[str] | None = None) -> DataFrame:
    return keep_first(df, keys, order or ORDER)


def dominant_response(df: DataFrame, question: str = "instruction", response: str = "response",
                      order: list[str] | None = None, scope: list[str] = ()) -> DataFrame:
    """Rows of the most frequent response variant per question; ties go to the first seen."""
    order = order or ORDER
    src = df.withColumn("_q", digest(*scope, norm_text(question))).withColumn(
        "_rk", digest(norm_text(response))
    )
    variants = src.groupBy("_q", "_rk").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first")
    )
    best = variants.groupBy("_q").agg(
        F.min_by("_rk", F.struct((-F.col("_n")).alias("n"), F.col("_first"))).alias("_rk")
    )
    return src.join(best, ["_q", "_rk"], "left_semi").drop("_q", "_rk")


def dominant_counts(df: DataFrame, question: str = "instruction", response: str = "response") -> DataFrame:
    """Rows kept and removed by ``dominant_response``, from the variant counts alone."""
    variants = df.groupBy(digest(norm_text(question)).alias("_q"),
                          digest(norm_text(response)).alias("_rk")).count()
    per = variants.groupBy("_q").agg(F.sum("count").alias("n"), F.max("count").alias("top"))
    return per.agg(
        F.coalesce(F.sum("top"), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.col("n") - F.col("top")), F.lit(0)).alias("removed"),
    )


def cross_dataset_owner(df: DataFrame, question: str = "instruction", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Rows whose dataset owns their question, and the questions found in several datasets.

    A dataset owns a question when it is the first, by ``src_rank``, to have it."""
    src = df.withColumn("_q", digest(norm_text(question)))
    held = src.groupBy("_q", "src_rank").agg(
        F.first(norm_text(question)).alias("question"), F.first(source).alias("_source")
    )
    owners = held.groupBy("_q").agg(
        F.min("src_rank").alias("owner_rank"),
        F.first("question").alias("question"),
        F.array_sort(F.collect_list(F.struct("src_rank", "_source"))).alias("_all"),
    )
    kept = src.join(owners.select("_q", F.col("owner_rank").alias("src_rank")), ["_q", "src_rank"], "left_semi")
    dupes = owners.filter(F.size("_all") > 1).select(
        "question", F.transform("_all", lambda x: x["_source"]).alias("datasets")
    )
    return kept.drop("_q").select(*df.columns), dupes


def union_groups(groups: list[DataFrame], dedupe: str | None = None) -> DataFrame:
    """Concatenate in list order; ``src_rank`` is the position of the group."""
    ranked = [g.drop("src_rank").withColumn("src_rank", F.lit(i)) for i, g in enumerate(groups)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return first_wins_dedupe(out, pair_key(dedupe)) if dedupe else out


def distinct_texts(pairs: DataFrame, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """Every filled prompt or response once."""
    both = pairs.select(F.explode(F.array(prompt, response)).alias("text"))
    return both.filter(text_of("text") != "").distinct()


def token_set_ops(a: Column, b: Column) -> Column:
    """Sizes of intersection and union and the share of ``a`` found in ``b``."""
    inter = F.size(F.array_intersect(a, b))
    return F.struct(
        inter.alias("inter"),
        F.size(F.array_union(a, b)).alias("union"),
        (inter / F.greatest(F.lit(1), F.size(F.array_distinct(a)))).alias("share"),
    )
