"""Cases that gave wrong results before: off-type fields, open bounds, missing providers, long plans."""

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.labels import first_block
from corpusflow.operators import sampling, telemetry
from corpusflow.session import scratch_path
from corpusflow.sources import files


def test_off_type_fields_keep_the_line(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"k": 1, "s": "a"}\n{"k": "x", "s": "b"}\n{"k": 2.5, "s": "c"}\n{"k": \n[1]\n\n')
    got = files.read_jsonl(spark, str(p), "k bigint, s string").collect()
    assert sorted((r.s, r.k) for r in got) == [("a", 1), ("b", None), ("c", None)]
    kept = files.read_jsonl(spark, str(p), "k bigint, s string", "keep").collect()
    assert sorted(r._corrupt_record for r in kept if r._corrupt_record) == ["[1]", '{"k": ']


def test_sample_size_from_a_column(spark):
    df = spark.range(100).select("id", (F.col("id") % 4).alias("g"), F.lit(5).alias("n"))
    got = sampling.seeded_sample(df, F.col("n"), 1, F.col("id").cast("string"), ["g"])
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {0: 5, 1: 5, 2: 5, 3: 5}
    with pytest.raises(ValueError):
        sampling.seeded_sample(df, F.col("n"), 1, F.col("id").cast("string"))


def test_recent_rows_have_no_hidden_cap(spark):
    df = spark.range(700).select("id")
    assert sampling.recent_n(df, 500, "id", "id").count() == 500
    assert sampling.recent_n(df, 500, "id", "id", most=200).count() == 200


def test_missing_provider_is_not_the_total(spark):
    calls = spark.createDataFrame([(None, 1, True, 5.0, 1), ("a", 2, False, 6.0, 2)],
                                  "provider string, ts long, ok boolean, latency_ms double, seq long")
    got = {(r.scope, r.provider): r.total for r in telemetry.provider_metrics(calls).collect()}
    assert got == {("all", None): 2, ("provider", None): 1, ("provider", "a"): 1}


def test_plans_without_events_are_whole(spark):
    tasks = spark.createDataFrame([("a", ["s"] * 25), ("b", ["s"] * 25)], "task_id string, steps array<string>")
    events = spark.createDataFrame([("b", 1, 1, "s", "", False)],
                                   "task_id string, ts long, seq long, done_step string, error string, mark_done boolean")
    got = {r.task_id: r.planned for r in telemetry.task_progress(tasks, events).collect()}
    assert got == {"a": 25, "b": 20}
    assert {r.planned for r in telemetry.task_progress(tasks, events, None).collect()} == {25}


def test_scratch_folder_is_new(spark):
    assert scratch_path(spark) != scratch_path(spark)


def test_first_block_closes(spark):
    cases = {"a {b} c": "{b}", "{a{b}}{": "{a{b}}", "}{x": None, "x": None, "{{}": None, "} {é{}é} }": "{é{}é}", "{}": "{}"}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string").select("t", first_block(F.col("t")).alias("b"))
    assert {r.t: r.b for r in df.collect()} == {**cases, None: None}
