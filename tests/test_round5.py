"""Faults of the fifth round, each with a case that shows it."""

import re

from pyspark.sql import functions as F

from corpusflow.catalog import streams
from corpusflow.functions import labels, text
from corpusflow.operators import evaluate, overlap, policy
from corpusflow.operators.scan import digest
from corpusflow.streaming.ordered import ordered_stream


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString().lower()


def test_keys_and_plans_name_a_text_once(spark):
    assert str(digest(F.upper("a"), F.lower("b"))).count("upper") == 1
    assert str(labels.action_plan("a")).count("parse_json") == 1


def test_strip_takes_every_blank_off(spark):
    blanks = [c for c in map(chr, range(0x3100)) if re.fullmatch(r"\s", c) and not 0x1c <= ord(c) <= 0x1f]
    rows = spark.createDataFrame([(f"{b}{b}a {b} b{b}\n", f"a {b} b") for b in blanks] + [(None, ""), (" \n", ""), ("\x1ca​", "\x1ca​")], "t string, want string")
    made = rows.select(text.strip("t").alias("got"), F.regexp_replace(F.coalesce("t", F.lit("")), r"(?U)^\s+|\s+$", "").alias("was"), "want")
    assert len(blanks) == 25 and made.filter("got <> want OR got <> was").count() == 0
    assert "regexp" not in plan(made.select("got"))


def test_counts_of_feedback_are_not_sorted(spark):
    row = lambda i, user, low: (user, "an answer " * 30, True, low, False, [], True, "0.9", "s", i)
    events = spark.createDataFrame(
        [row(3, "Hello  there", False), row(1, " hello there", False), row(2, "other", False), row(4, "x", True), row(5, "", False)],
        "user_text string, assistant_text string, in_domain boolean, is_low_quality boolean, corrected_by_verifier boolean, verifier_issues array<string>, has_quality boolean, quality_text string, summary string, row_idx bigint")
    rows, counts = policy.feedback_filter(events)
    assert sorted(map(tuple, counts.collect())) == [("filtered_duplicate", 1), ("filtered_empty", 1), ("filtered_low_quality", 1), ("kept", 2)]
    assert sorted((r.row_idx, r.instruction) for r in rows.collect()) == [(1, "hello there"), (2, "other")]
    assert "min_by" not in plan(counts, "optimizedPlan") and "max(reason" not in plan(counts, "optimizedPlan")


def test_a_filter_on_coverage_normalises_an_answer_once(spark):
    answers = spark.createDataFrame([(0, "A  B"), (0, "c")], "case_id int, answer string")
    cases = spark.createDataFrame([(0, [" a b", "zz"])], "case_id int, keywords array<string>")
    got = evaluate.keyword_coverage(answers, cases).filter("coverage > 0.4")
    assert [(r.answer, r.matched) for r in got.collect()] == [("A  B", ["a b"])]
    assert "contains(trim(" not in plan(got, "optimizedPlan")


def test_exact_overlap_is_the_same_for_few_and_many_prompts(spark, monkeypatch):
    train = spark.createDataFrame([("One, two!",), ("three",), (" ",), ("one two",)], "text string")
    asked = spark.createDataFrame([(0, "one two"), (1, "four"), (2, "THREE."), (3, ""), (2, "THREE.")], "prompt_id int, prompt string")
    for few in (10, 0):
        monkeypatch.setattr(overlap, "FEW_PROMPTS", few)
        assert sorted(r.prompt_id for r in overlap.exact_overlap(asked, train).collect()) == [0, 2, 2]


def test_keys_of_a_bucket_and_equal_rows(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "key string, ts timestamp, seq bigint"
    files = [[("a", 0, 0), ("b", 0, 0), (None, 1, 0), ("a", 5, 1), ("a", 5, 1)], [("b", 9, 1), ("a", 7, 2)], [("~", 99_999, 0)]]
    for rows in files:
        spark.createDataFrame(rows, "key string, at bigint, seq bigint").select("key", F.timestamp_seconds(F.col("at") + 1000).alias("ts"), "seq").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = streams.finish(ordered_stream(stream, ["key"], ["seq"], ["seq"], "n bigint", lambda: (0,), lambda s, r: ((s[0] + 1,), (r.seq, s[0] + 1)),
                                        "seq bigint, n bigint", delay="1 second", buckets=1))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [("a", 0, 1), ("a", 1, 2), ("a", 1, 3), ("a", 2, 4), ("b", 0, 1), ("b", 1, 2), (None, 0, 1)]))


def test_a_slice_has_several_files_and_all_rows(spark, monkeypatch):
    monkeypatch.setattr(streams, "SPLIT_ROWS", 10)
    rows = spark.range(500).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    got = streams.finish(streams.late_files(rows, "id", {"id": -1})[0])
    assert sorted(r.id for r in got.collect()) == list(range(-1, 500))
