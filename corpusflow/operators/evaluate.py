"""Answer scoring, metric summaries, alerts and promotion decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import lexicons as lx
from corpusflow.functions.text import let, norm_text, strip, text_of, words
from corpusflow.operators.fold import ordered_fold


def keyword_coverage(answers: DataFrame, cases: DataFrame, case: str = "case_id", answer: str = "answer",
                     keywords: str = "keywords", collapse_space: bool = True) -> DataFrame:
    """Matched keywords, hits and share per case."""
    wanted = F.filter(F.transform(keywords, lambda k: F.lower(strip(k))), lambda k: k != "")
    if keywords in cases.columns:
        rows = answers.join(cases.withColumn("_want", wanted), case)
    else:
        rows = answers.join(cases, case).withColumn("_want", wanted)
    low = norm_text(answer) if collapse_space else strip(F.lower(text_of(answer)))
    out = rows.withColumn("_low", low)
    # a filter on a score names the text below; bound here, it isn't normalised again for every keyword
    out = out.withColumn("matched", let(F.col("_low"), lambda x: F.filter("_want", lambda k: F.contains(x, k))))
    total = F.size("_want")
    share = F.when(total > 0, F.size("matched") / total).otherwise(F.lit(0.0))
    return out.withColumns({
        "hits": F.size("matched"), "total": total, "coverage": share,
    }).drop("_want").withColumnRenamed("_low", "answer_low")


def score_benchmark(answers: DataFrame, cases: DataFrame, variant: str = "offline", case: str = "case_id",
                    answer: str = "answer", keywords: str = "keywords",
                    bad_markers: list[str] | None = None) -> DataFrame:
    """.70 coverage + .20 no bad marker + .10 length 80..1200; passed at .60 before rounding.

    The ``live`` variant does not collapse whitespace before matching."""
    bad_markers = lx.BAD_MARKERS if bad_markers is None else bad_markers
    rows = keyword_coverage(answers, cases, case, answer, keywords, variant != "live")
    low = F.col("answer_low")
    marker = F.coalesce(*[F.when(low.contains(m), F.lit(m)) for m in bad_markers], F.lit(""))
    length_ok = F.length(strip(answer)).between(80, 1200)
    rows = rows.withColumns({"bad_marker": marker, "length_ok": length_ok.cast("int")})
    final = (
        F.col("coverage") * 0.70
        + F.when(F.col("bad_marker") == "", F.lit(0.20)).otherwise(F.lit(0.0))
        + F.col("length_ok") * 0.10
    )
    return rows.withColumn("_final", final).withColumns({
        "bad_marker_hit": (F.col("bad_marker") != "").cast("int"),
        "keyword_coverage": F.round("coverage", 4),
        "score": F.round("_final", 4),
        "passed": (F.col("_final") >= 0.60).cast("int"),
        "length_chars": F.length(text_of(answer)),
    }).drop("_final", "answer_low", "coverage")


def business_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("cases"),
        F.round(F.avg("score"), 4).alias("score_mean"),
        F.round(F.avg("keyword_coverage"), 4).alias("keyword_coverage_mean"),
        F.round(F.avg("passed"), 4).alias("pass_rate"),
        F.coalesce(F.sum("bad_marker_hit"), F.lit(0)).alias("bad_marker_count"),
    )


def alert_check(summary: DataFrame, threshold: float) -> DataFrame:
    """Status of a one-row summary and the line that goes with it."""
    rate = F.coalesce("pass_rate", F.lit(0.0))
    status = F.when(rate >= threshold, "OK").otherwise("ALERT")
    return summary.withColumn("status", status).withColumn("line", F.concat(
        F.lit("status="), F.col("status"),
        F.format_string(" pass_rate=%.4f threshold=%.4f cases=%d", rate, F.lit(float(threshold)), F.col("cases")),
    ))


def failures(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("passed") == 0)


def scenario_recall(checks: DataFrame, scenario: str = "scenario", ok: str = "ok") -> DataFrame:
    """Mean over scenarios of the mean of their checks; a scenario without checks counts 0."""
    per = checks.groupBy(scenario).agg(F.coalesce(F.avg(F.col(ok).cast("double")), F.lit(0.0)).alias("m"))
    return per.agg(F.count(F.lit(1)).alias("scenarios"),
                   F.round(F.coalesce(F.avg("m"), F.lit(0.0)), 4).alias("memory_recall_rate"))


def all_tokens_present(answer: Column | str, expected: Column) -> Column:
    low = F.lower(text_of(answer))
    return F.forall(expected, lambda t: F.contains(low, F.lower(t))).cast("int")


def text_match(rows: DataFrame, row_id: str, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """Token multiset F1 and case-insensitive exact match per row.

    Tokens of both sides meet in one aggregation by (row, token)."""
    sides = rows.select(
        row_id, words(F.lower(text_of(prediction))).alias("_p"), words(F.lower(text_of(reference))).alias("_r"),
        (strip(F.lower(text_of(prediction))) == strip(F.lower(text_of(reference)))).cast("double").alias("exact_match"),
    )
    tagged = F.concat(F.transform("_p", lambda t: F.struct(t.alias("t"), F.lit(1).alias("p"))),
                      F.transform("_r", lambda t: F.struct(t.alias("t"), F.lit(0).alias("p"))))
    common = (
        sides.select(row_id, F.explode(tagged).alias("x"))
        .groupBy(row_id, F.col("x.t").alias("t"))
        .agg(F.least(F.sum("x.p"), F.sum(1 - F.col("x.p"))).alias("both"))
        .groupBy(row_id).agg(F.sum("both").alias("overlap"))
    )
    out = sides.select(row_id, F.size("_p").alias("np"), F.size("_r").alias("nr"), "exact_match").join(
        common, row_id, "left")
    overlap = F.coalesce("overlap", F.lit(0))
    # 2pr/(p+r) with p = o/np and r = o/nr
    f1 = F.when(overlap > 0, F.lit(2.0) * overlap / (F.col("np") + F.col("nr"))).otherwise(F.lit(0.0))
    return out.select(row_id, f1.alias("token_f1"), "exact_match")


def text_match_metrics(rows: DataFrame, row_id: str, prediction: str = "prediction",
                       reference: str = "reference") -> DataFrame:
    return text_match(rows, row_id, prediction, reference).agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg("token_f1"), 4).alias("token_f1_mean"),
        F.round(F.avg("exact_match"), 4).alias("exact_match_rate"),
    )


def recognition(answer: Column | str, hints: list[str] | None = None) -> Column:
    """``struct(score, recognized, hits)``; the threshold is applied before rounding."""
    hints = lx.POSITIVE_HINTS if hints is None else hints
    p = norm_text(answer)
    hits = sum((p.contains(h).cast("int") for h in hints), F.lit(0))
    score = F.greatest(
        F.lit(0.0),
        F.least(F.lit(1.0), hits / F.lit(3.0)) * 0.75
        + F.when(F.length(p) >= 35, F.lit(0.25)).otherwise(F.lit(0.0))
        - F.when(p == "", F.lit(0.5)).otherwise(F.lit(0.0)),
    )
    return F.struct(F.round(score, 4).alias("score"), (score >= 0.60).cast("int").alias("recognized"),
                    hits.alias("hits"))


def recognition_summary(rows: DataFrame, answer: str, hints: list[str] | None = None) -> DataFrame:
    r = recognition(answer, hints)
    return rows.select(r.alias("r")).agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg("r.score"), 4).alias("recognition_score_mean"),
        F.round(F.avg("r.recognized"), 4).alias("recognition_rate"),
    )


# --- promotion -------------------------------------------------------------
@dataclass(frozen=True)
class PromotionPolicy:
    primary: str = "composite"
    min_improvement: float = 0.002
    allow_memory_regression: bool = False
    max_score_regression: float = 0.005
    max_pass_rate_regression: float = 0.02
    min_question_rate: float = 0.0
    max_question_regression: float = 0.05
    eps: float = 1e-9


METRICS = ["token_f1_mean", "exact_match_rate", "score_mean", "pass_rate", "keyword_coverage_mean",
           "memory_recall_rate", "question_recognition_rate"]


def composite_score() -> Column:
    return (F.col("score_mean") * 0.40 + F.col("pass_rate") * 0.20 + F.col("token_f1_mean") * 0.25
            + F.col("keyword_coverage_mean") * 0.10 + F.col("exact_match_rate") * 0.05)


@dataclass(frozen=True)
class Guard:
    """A metric that a run may not lose to the best one: by more than ``slack`` (a policy field), in one
    lane or in all, unless a policy flag waives it."""

    reason: str
    metric: str
    slack: str | None = None
    lane: str | None = None
    waived_by: str | None = None


#: Reasons and their order.
GUARDS = (
    Guard("memory_regression", "memory_recall_rate", waived_by="allow_memory_regression"),
    Guard("score_regression_too_high", "score_mean", "max_score_regression", "global"),
    Guard("pass_rate_regression_too_high", "pass_rate", "max_pass_rate_regression", "global"),
    Guard("question_recognition_regression_too_high", "question_recognition_rate", "max_question_regression"),
)


def promotion_history(runs: DataFrame, policy: PromotionPolicy = PromotionPolicy(), lane: str = "lane",
                      at: str = "run_at") -> DataFrame:
    """Decision per evaluation run against the last accepted run of its lane.

    The comparison partner depends on earlier decisions, so each lane is a fold in time; its
    state is one row of metrics."""
    p = policy
    src = runs.select(F.col(lane).alias("lane"), F.col(at).alias("run_at"),
                      *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in METRICS])
    src = src.withColumn("composite", composite_score())

    guards = [g for g in GUARDS if not (g.waived_by and getattr(p, g.waived_by))]

    def lost(guard: Guard, best, row) -> bool:
        slack = getattr(p, guard.slack) if guard.slack else 0.0
        return guard.lane in (None, row.lane) and getattr(row, guard.metric) + slack + p.eps < getattr(best, guard.metric)

    def decide(best, row) -> str:
        if row.question_recognition_rate + p.eps < p.min_question_rate:
            return "question_recognition_below_min_threshold"
        if best is None:
            return "first_best"
        better = getattr(row, p.primary) > getattr(best, p.primary) + p.min_improvement
        verdict = f"{p.primary}_improved" if better else "no_significant_improvement"
        return next((g.reason for g in guards if lost(g, best, row)), verdict)

    def step(best, row):
        reason = decide(best, row)
        accepted = reason == "first_best" or reason.endswith("_improved")
        made = (row.lane, row.run_at, round(row.composite, 6), accepted, reason)
        return (row if accepted else best), made

    schema = "lane string, run_at string, composite_score double, accepted boolean, reason string"
    src = src.withColumn("run_at", F.col("run_at").cast("string"))
    return ordered_fold(src, ["lane"], ["run_at"], lambda: None, step, schema)
