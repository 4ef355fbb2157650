"""The plans read only what they need and do not rank or join where an aggregate will do."""

from pyspark.sql import functions as F

from corpusflow.catalog import QUERIES
from corpusflow.catalog.base import documents
from corpusflow.catalog.relations import TEST_POLICY, _policy_rows
from corpusflow.operators import dedupe, policy, sampling


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_read_two_columns(spark, root):
    assert "ReadSchema: struct<lang:string,source:string>" in plan(QUERIES["a03_source_counts"](spark, root))


def test_filters_reach_the_scan(spark, root):
    p = plan(documents(spark, root).filter("lang = 'en'").groupBy("source").count())
    assert "EqualTo(lang,en)" in p and "text:string" not in p


def test_dedupe_collapses_before_the_shuffle(spark, root):
    p = plan(dedupe.first_wins_dedupe(documents(spark, root), [F.col("text")], ["doc_id"]))
    assert "partial_min_by" in p and "Window" not in p


def test_waterfall_evaluates_rules_once(spark, root):
    p = plan(policy.policy_waterfall(_policy_rows(spark, root), TEST_POLICY)[0])
    assert "Window [row_number" not in p
    assert not [line for line in p.splitlines() if "Filter" in line and "removed_generalist" in line]


def test_sample_has_no_global_sort(spark, root):
    p = plan(sampling.seeded_sample(documents(spark, root), 50, 1, F.col("doc_id").cast("string")))
    assert "TakeOrderedAndProject" in p and "rangepartitioning" not in p


def test_no_cartesian_products(spark, root):
    for name in ("c12_contamination_report", "c06_search", "j04_domain_allowlist", "c08_synthesize_templates", "j10_mark_selected"):
        p = plan(QUERIES[name](spark, root))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
