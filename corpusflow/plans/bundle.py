"""Weekly feeding bundle: feedback rows plus five cleaned groups mixed to fixed shares."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import norm_text, strip
from corpusflow.operators.dedupe import first_wins_dedupe, pair_key
from corpusflow.operators.policy import (
    CleaningPolicy, FeedbackPolicy, domain_filter, feedback_filter, policy_waterfall,
)
from corpusflow.operators.sampling import DEFAULT_RATIOS, quota_plan, ratio_quota, seeded_sample
from corpusflow.session import settle
from corpusflow.sources.files import exists, file_stem, read_pairs_csv

GROUPS = ["core", "ml_deep", "signature", "agent", "memory"]


@dataclass(frozen=True)
class BundlePolicy:
    cleaning: CleaningPolicy = field(default_factory=CleaningPolicy)
    feedback: FeedbackPolicy = field(default_factory=FeedbackPolicy)
    caps: dict = field(default_factory=lambda: {
        "core": 15000, "ml_deep": 12000, "signature": 15000, "agent": 12000, "memory": 10000})
    max_feedback: int = 30000
    total: int = 10000
    ratios: dict = field(default_factory=lambda: dict(DEFAULT_RATIOS))
    strict_domain: bool = False
    domain_words: list[str] | None = None
    dedupe: bool = False
    seed: int = 42
    allow_empty: bool = False


def row_key() -> Column:
    """Sampling key of a training row."""
    return F.concat_ws("|", norm_text("instruction"), norm_text("response"), "source")


def prepare_rows(df: DataFrame, source_name: Column) -> DataFrame:
    """Stripped texts, source filled from the dataset name, rows without both texts dropped."""
    out = df
    for c in ("instruction", "response", "history", "source"):
        out = out.withColumn(c, strip(c) if c in df.columns else F.lit(""))
    out = out.withColumn("source", F.coalesce(F.nullif("source", F.lit("")), source_name))
    return out.filter((F.col("instruction") != "") & (F.col("response") != ""))


def read_groups(spark: SparkSession, paths: dict[str, list[str]]) -> DataFrame:
    """All group files as one table with ``group``, ``dataset``, ``src_rank``, ``row_idx``."""
    parts = []
    for group in GROUPS:
        for path in dict.fromkeys(paths.get(group, [])):
            if not exists(spark, path):
                continue
            stem = file_stem(path).strip().lower() or "extra_dataset"
            rows = prepare_rows(read_pairs_csv(spark, path), F.lit(stem)).select(
                "instruction", "response", "history", "source", "row_idx")
            parts.append(rows.withColumns({
                "group": F.lit(group), "dataset": F.lit(stem), "src_rank": F.lit(len(parts))}))
    if not parts:
        return spark.createDataFrame(
            [], "instruction string, response string, history string, source string, row_idx bigint, "
            "group string, dataset string, src_rank int")
    return reduce(lambda a, b: a.unionByName(b), parts)


def cap_files(rows: DataFrame, policy: BundlePolicy) -> DataFrame:
    """At most the group's cap of rows per file."""
    caps = F.create_map(*[x for g, n in policy.caps.items() for x in (F.lit(g), F.lit(max(1, n)))])
    sized = rows.withColumn("_cap", F.coalesce(F.try_element_at(caps, F.col("group")), F.lit(1)))
    most = max([1, *policy.caps.values()])
    picked = seeded_sample(sized, F.col("_cap"), policy.seed, row_key(), ["group", "dataset"], most)
    return picked.drop("_cap")


def mix_groups(rows: DataFrame, policy: BundlePolicy) -> tuple[DataFrame, DataFrame]:
    """Cleaned rows sampled to their group quota, and the cleaning counts."""
    clean, counts = policy_waterfall(rows, policy.cleaning, "group", settled=True)
    if policy.strict_domain:
        clean = domain_filter(clean, policy.domain_words, "group")
    return ratio_quota(clean, max(1, policy.total), policy.ratios, policy.seed, row_key()), counts


def build_feeding_bundle(events: DataFrame, rows: DataFrame, policy: BundlePolicy = BundlePolicy()
                         ) -> dict[str, DataFrame]:
    """``feedback``, ``bundle``, ``cleaning`` and ``feedback_counts``.

    Bundle order: groups in their order, then feedback (``src_rank``)."""
    feedback, feedback_counts = feedback_filter(settle(events), policy.feedback)
    feedback = seeded_sample(feedback, max(1, policy.max_feedback), policy.seed, row_key())
    mixed, cleaning = mix_groups(cap_files(rows, policy), policy)
    place = F.create_map(*[x for i, g in enumerate(GROUPS) for x in (F.lit(g), F.lit(i))])
    mixed = mixed.withColumn("_g", F.try_element_at(place, F.col("group")))
    bundle = mixed.select(
        "instruction", "response", "history", "source", "group",
        (F.col("_g") * 1_000_000 + F.col("src_rank")).cast("bigint").alias("src_rank"), "row_idx",
    ).unionByName(feedback.select(
        "instruction", "response", "history", "source", F.lit("feedback").alias("group"),
        F.lit(len(GROUPS) * 1_000_000).cast("bigint").alias("src_rank"), "row_idx"))
    # at most the bundle target and the feedback cap; every further count reads this copy
    bundle = settle(bundle)
    if policy.dedupe:
        bundle = first_wins_dedupe(bundle, pair_key("normalized"))
    return {"feedback": feedback, "bundle": bundle, "cleaning": cleaning, "feedback_counts": feedback_counts}


def check_not_empty(bundle: DataFrame, policy: BundlePolicy) -> None:
    if not policy.allow_empty and bundle.isEmpty():
        raise RuntimeError("no rows generated for the training bundle")


def run_report(result: dict[str, DataFrame], policy: BundlePolicy, inputs: dict | None = None) -> DataFrame:
    """One nested row: inputs, counts per group, counts per rule, targets and the policy."""
    groups = result["bundle"].groupBy("group").agg(F.count(F.lit(1)).alias("rows"))
    def entries(df: DataFrame, key: Column, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct(key.alias("key"), F.col("rows").alias("value"))))
        return df.agg(F.map_from_entries(pairs).alias(name))
    cleaning = entries(result["cleaning"], F.concat_ws(".", "group", "reason"), "cleaning_filter")
    feedback = entries(result["feedback_counts"], F.col("reason"), "feedback_filter")
    counts = entries(groups, F.col("group"), "counts")
    plan = quota_plan(max(1, policy.total), policy.ratios)
    targets = F.create_map(*[x for k, n in plan.items() for x in (F.lit(k), F.lit(n))])
    echo = {k: v for k, v in asdict(policy).items() if k not in ("cleaning", "feedback")}
    return counts.select(
        F.lit(str(inputs or {})).alias("inputs"), "counts", cleaning.scalar().alias("cleaning_filter"),
        feedback.scalar().alias("feedback_filter"),
        targets.alias("targets"), F.lit(str(echo)).alias("policy"),
    )
