"""Readers on hand-written files."""

from pyspark.sql import functions as F

from corpusflow.plans.corpus import build_pair_corpus
from corpusflow.session import scratch_path
from corpusflow.sources import files, store


def test_jsonl_bad_lines(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"a": 1}\n\n  {"a": 2}\n[1]\n7\n{"a": \nnull\n{"b": 3}\n', encoding="utf-8")
    got = files.read_jsonl(spark, str(p), "a bigint")
    assert sorted((r.a for r in got.collect()), key=str) == [1, 2, None]
    kept = files.read_jsonl(spark, str(p), "a bigint", "keep")
    assert kept.filter(F.col("_corrupt_record").isNotNull()).count() == 4
    assert files.read_jsonl(spark, str(tmp_path / "none"), "a bigint").count() == 0


def test_csv_quotes_and_missing(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('instruction,response\n"a, ""b""\nc",1\nd,2\n', encoding="utf-8")
    got = files.read_pairs_csv(spark, str(p)).orderBy("row_idx").collect()
    assert [(r.instruction, r.response, r.row_idx) for r in got] == [('a, "b"\nc', "1", 0), ("d", "2", 1)]
    assert files.read_pairs_csv(spark, str(tmp_path / "none.csv")).count() == 0


def test_row_index_follows_the_file_over_splits(spark, tmp_path):
    p = tmp_path / "big.txt"
    p.write_text("\n".join(f"{i:06d}" for i in range(20_000)), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = spark.read.text(str(p))
        assert df.rdd.getNumPartitions() > 3
        assert files.with_row_index(df).filter("cast(value as bigint) <> row_idx").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_lines_and_comments(spark, tmp_path):
    p = tmp_path / "l.txt"
    p.write_text(" a \n\n# no\nb\n", encoding="utf-8")
    assert [r.line for r in files.read_lines(spark, str(p)).orderBy("row_idx").collect()] == ["a", "b"]
    assert files.read_lines(spark, str(p), False).count() == 3


def test_corpus_end_to_end(spark, tmp_path):
    d = files.DELIMITER
    (tmp_path / "movie_titles_metadata.txt").write_text(d.join(["m0", "the film", "1999", "7", "10", "['comedy', 'war']"]) + "\n")
    (tmp_path / "movie_characters_metadata.txt").write_text(d.join(["u0", "ANN", "m0", "the film", "f", "1"]) + "\nshort\n")
    (tmp_path / "movie_lines.txt").write_text("\n".join(
        d.join([f"L{i}", f"u{i % 2}", "m0", f"N{i % 2}", t]) for i, t in enumerate(["Hi .", "Hello", "ORD-7 ready", "", "Bye", "Hi.", "HELLO"]) if i != 4))
    (tmp_path / "movie_conversations.txt").write_text(
        d.join(["u0", "u1", "m0", "['L0', 'L1', 'L2', 'L3', 'L4', 'L5']"]) + "\nbroken\n" + d.join(["u0", "u1", "m0", "['L5', 'L6']"]) + "\n")
    (tmp_path / "a_fr.csv").write_text("question,answer\nOui ?,Non\n\"\",x\n")
    (tmp_path / "d.csv").write_text('dialog\n"[\'one\' \'two\' \'three\']"\n')
    (tmp_path / "input1.csv").write_text("id,text\n1,in a\n2,in b\n")
    (tmp_path / "target1.csv").write_text("id,other\n1,out a\n")
    cache = spark.createDataFrame([("en|fr::ZZPH0ZZ ready", "ZZPH0ZZ pret"), ("en|fr::Hello", "")], "key string, translated string")
    out = build_pair_corpus(spark, str(tmp_path), cache)
    en = {(r.prompt_en, r.response_en): r for r in out["en"].collect()}
    assert set(en) == {("Hi.", "Hello"), ("Hello", "ORD-7 ready"), ("Oui?", "Non"), ("one", "two"), ("two", "three"), ("in a", "out a")}
    first = en[("Hi.", "Hello")]
    assert (first.genres, first.speaker_name, first.speaker_gender, first.listener_name, first.listener_gender) == ("comedy, war", "ANN", "f", "N1", "?")
    train = {r.instruction: r.response for r in out["train"].collect()}
    assert train["Hello"] == "ORD-7 pret" and train["Oui?"] == "Non"
    assert {r.template for r in out["todo"].collect()} == {"Hi.", "Hello", "one", "two", "three", "in a", "out a"}
    assert {r.source_dataset: r.rows for r in out["source_counts"].collect()} == {
        "qa_csv:a_fr.csv": 1, "dialog_csv:d.csv": 2, "input_target_csv:input1.csv+target1.csv": 1}


def test_backfill_runs_once(spark):
    docs = spark.createDataFrame([("a", None, None)], "id string, status string, quality_score double").withColumn(
        "messages", F.array(F.struct(F.lit("x").alias("content"), F.lit("z").alias("intent"))))
    ledger = spark.createDataFrame([], "id string, name string, description string, result string, applied_at string")
    out, ledger = store.backfill_defaults(docs, ledger)
    assert out.first().status == "raw" and out.first().messages[0].intent == "question" and ledger.count() == 3
    again, same = store.backfill_defaults(docs, ledger)
    assert again.first().status is None and same.count() == 3


def test_nothing_selected_keeps_selection(spark):
    convs = spark.createDataFrame([("a", "selected"), ("b", "filtered")], "conv_id string, status string")
    none = spark.createDataFrame([], "conv_id string")
    one = spark.createDataFrame([("b",)], "conv_id string")
    assert {r.conv_id: r.status for r in store.mark_selected(convs, none).collect()} == {"a": "selected", "b": "filtered"}
    assert {r.conv_id: r.status for r in store.mark_selected(convs, one).collect()} == {"a": "filtered", "b": "selected"}


def test_table_swap(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        store.save_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n


def test_scratch_follows_the_cluster():
    class Named:
        conf = {"spark.checkpoint.dir": "/shared/x/"}
    assert scratch_path(Named).startswith("/shared/x/run-")


def test_csv_with_quoted_breaks_is_read_by_its_splits(spark, tmp_path, monkeypatch):
    import csv
    import random

    from corpusflow.sources import files
    rng = random.Random(8)
    bits = ["plain", "a,b", 'say ""', "two\nlines", "\n\nx", "é", "", "end\n", '"', " "]
    rows = [["".join(rng.choice(bits) for _ in range(rng.randint(0, 4))) for _ in range(3)] for _ in range(1500)]
    rows = [[c or "z" for c in r] for r in rows]
    for k in range(2):
        with open(tmp_path / f"part{k}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(["instruction", "response", "note"])
            w.writerows(rows[k * 700:700 if k == 0 else None])
    monkeypatch.setattr(files, "LINES_PER_CHUNK", 97)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.read_pairs_csv(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert [tuple(r) for r in got.orderBy("row_idx").collect()] == [(*r, i) for i, r in enumerate(rows)]
        opts = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
        one_task = sorted(map(repr, spark.read.options(**opts).csv(str(tmp_path)).collect()))
        assert sorted(map(repr, got.drop("row_idx").collect())) == one_task
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
