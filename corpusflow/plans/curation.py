"""Dataset validation and signature selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import norm_text, strip, text_of, words
from corpusflow.operators.dedupe import first_wins_dedupe, pair_key
from corpusflow.operators.sampling import core_tail_select
from corpusflow.operators.scan import digest


def validate_series(rows: DataFrame, order: str = "row_idx") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean rows, a report per dataset and the questions held by several datasets.

    ``rows(dataset, src_rank, row_idx, instruction, response)``. Empty questions drop silently;
    then pair duplicates, question duplicates, and questions an earlier dataset has. Within a
    dataset the first row of a question stays, so copies are counted per response variant and no
    group of copies is ever sorted."""
    cols = rows.columns
    src = rows.withColumns({"_qn": norm_text("instruction"), "_rn": norm_text("response")})
    filled = src.filter((F.col("_qn") != "") & (F.col("_rn") != ""))
    variants = filled.groupBy(
        "dataset", "src_rank", digest("_qn").alias("_q"), digest("_rn").alias("_r")
    ).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*cols, "_qn"), order).alias("row"))
    first = F.struct(F.col(f"row.{order}"))
    questions = variants.groupBy("dataset", "src_rank", "_q").agg(
        F.sum("n").alias("n"), F.min_by("n", first).alias("same"), F.min_by("row", first).alias("row"))
    owners = questions.groupBy("_q").agg(
        F.min("src_rank").alias("_owner"), F.first("row._qn").alias("question"),
        F.array_sort(F.collect_list(F.struct("src_rank", "dataset"))).alias("_held"),
    )
    judged = questions.join(owners.select("_q", "_owner"), "_q")
    own = F.col("src_rank") == F.col("_owner")
    clean = judged.filter(own).select(*[F.col(f"row.{c}").alias(c) for c in cols])
    per = judged.groupBy("dataset").agg(
        F.sum(F.col("same") - 1).alias("removed_duplicate_qr_within"),
        F.sum(F.col("n") - F.col("same")).alias("removed_duplicate_question_within"),
        F.count_if(~own).alias("removed_duplicate_question_cross_dataset"),
        F.count_if(own).alias("after_rows"),
    )
    totals = src.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("before_rows"),
        F.count_if((F.col("_qn") != "") & (F.col("_rn") == "")).alias("removed_empty_response"),
    )
    zero = [c for c in per.columns if c != "dataset"]
    report = totals.join(per, "dataset", "left").na.fill(0, zero)
    dupes = owners.filter(F.size("_held") > 1).select(
        "question", F.transform("_held", lambda x: x["dataset"]).alias("datasets"))
    return clean, report, dupes


def duplicate_sample(dupes: DataFrame, n: int = 30) -> DataFrame:
    """A readable excerpt of the cross-dataset duplicates."""
    return dupes.orderBy("question").limit(n)


# --- signature rows --------------------------------------------------------
def opening(c: Column | str) -> Column:
    """First two words, lower-cased."""
    return F.array_join(F.slice(words(F.lower(text_of(c))), 1, 2), " ")


def opening_frequency(rows: DataFrame, response: str = "response") -> DataFrame:
    return rows.groupBy(opening(response).alias("opening")).agg(F.count(F.lit(1)).alias("freq"))


def is_complex(c: Column | str) -> Column:
    text = strip(c)
    marks = F.length(text) - F.length(F.translate(text, ",;:()-", ""))
    return (F.size(words(text)) >= 18) | (marks >= 2)


def signature_score(freq: Column, instruction="instruction", response="response", source="source") -> Column:
    asked, told = F.size(words(instruction)), F.size(words(response))
    def gain(cond: Column, points: float) -> Column:
        return F.when(cond, F.lit(points)).otherwise(F.lit(0.0))
    score = (
        F.least(told, F.lit(40)) * 0.08 + F.least(asked, F.lit(30)) * 0.05
        + gain(is_complex(response), 1.2) + gain(is_complex(instruction), 0.8)
        + gain(F.contains(text_of(instruction), F.lit("?")), 0.4) - gain(told <= 8, 1.2)
        - F.least(freq / F.lit(1200.0), F.lit(2.0))
        - gain(F.contains(F.lower(text_of(source)), F.lit("synthetic")), 0.15)
    )
    blank = (strip(instruction) == "") | (strip(response) == "")
    return F.when(blank, F.lit(-1e9)).otherwise(score)


def score_signature(rows: DataFrame) -> DataFrame:
    """Exact duplicates out, then a score per row; frequent openings lower it."""
    once = first_wins_dedupe(rows, pair_key("exact")).withColumn("_open", opening("response"))
    freq = once.groupBy(F.col("_open")).agg(F.count(F.lit(1)).alias("_freq"))
    return once.join(freq, "_open").withColumn("score", signature_score(F.col("_freq"))).drop("_open", "_freq")


def select_signature(rows: DataFrame, n: int = 10000, seed: int = 42, key: str = "row_idx") -> DataFrame:
    return core_tail_select(score_signature(rows), n, seed, F.col(key).cast("string")).drop("score")
