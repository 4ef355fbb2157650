"""Faults of the fourth round, each with a case that shows it."""

import random


def test_overlap_candidates_share_rare_tokens(spark, monkeypatch):
    from corpusflow.operators import overlap
    written, settle = [], overlap.settle

    def watched(df):
        out = settle(df)
        if {"pid", "sid"} <= set(out.columns):
            written.append(out.count())
        return out

    monkeypatch.setattr(overlap, "settle", watched)
    common = " ".join(f"common{i}" for i in range(7))
    train = [(f"{common} own{i} twin{i // 2} more{i // 2}",) for i in range(300)]
    rnd = random.Random(4)
    asked = [(i, f"{common} own{i} twin{i // 2} other{rnd.random()}".replace(".", "")) for i in range(300)]
    got = overlap.jaccard_overlap(spark.createDataFrame(asked, "prompt_id int, prompt string"), spark.createDataFrame(train, "text string"), 0.8)
    want = []
    sets = [set(t.split()) for t, in train]
    for i, t in asked:
        p = set(t.split())
        if any(len(p & s) / len(p | s) >= 0.8 for s in sets):
            want.append(i)
    assert sorted(r.prompt_id for r in got.collect()) == want
    assert 0 < sum(written) <= 4 * 300


def test_overlap_is_the_same_in_turns(spark, monkeypatch):
    from corpusflow.operators import overlap
    monkeypatch.setattr(overlap, "FETCHED", 5)
    train = spark.createDataFrame([(f"a b c d e f{i} g{i}",) for i in range(20)], "text string")
    asked = spark.createDataFrame([(i, f"a b c d e f{i} g{i} h") for i in range(0, 40, 2)], "prompt_id int, prompt string")
    assert sorted(r.prompt_id for r in overlap.jaccard_overlap(asked, train, 0.8).collect()) == list(range(0, 20, 2))


def test_scores_are_dealt_by_their_number(spark, monkeypatch):
    from corpusflow.operators import search
    monkeypatch.setattr(search, "TASK_SCORES", 100, raising=False)
    docs = spark.createDataFrame([(i, f"alpha w{i % 17}") for i in range(400)], "doc_id bigint, text string")
    queries = spark.createDataFrame([(q, f"alpha w{q}") for q in range(10)], "query_id bigint, query string")
    scored = search.tfidf_join(queries, docs, "knowledge")
    assert scored.rdd.getNumPartitions() >= 40
    assert scored.count() == 4000
