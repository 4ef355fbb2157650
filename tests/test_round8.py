"""Faults of the eighth round, each with a case that shows it."""

import random


def test_overlap_compares_the_nearest_pair_first(spark, monkeypatch):
    """Every prompt is like all texts of its family: one pair of it is kept, not all. Some miss by a little."""
    from corpusflow.operators import overlap
    monkeypatch.setattr(overlap, "FETCHED", 50)
    written, settle = [], overlap.settle

    def watched(df):
        out = settle(df)
        if {"pid", "sid"} <= set(out.columns):
            written.append(out.count())
        return out

    monkeypatch.setattr(overlap, "settle", watched)
    rnd = random.Random(9)
    family = [[f"w{f}x{i}" for i in range(30)] for f in range(4)]
    train = [(" ".join([*w, f"own{rnd.random()}".replace(".", "")]),) for w in family for _ in range(40)]
    asked = []
    for i in range(160):
        w = list(family[i % 4])
        for at in rnd.sample(range(30), i % 9):
            w[at] = f"new{rnd.random()}".replace(".", "")
        asked.append((i, " ".join(w)))
    sets = [set(t.split()) for t, in train]
    want = [i for i, t in asked if any(len(set(t.split()) & s) / len(set(t.split()) | s) >= 0.7 for s in sets)]
    for few in (10, 200_000):
        monkeypatch.setattr(overlap, "FEW_PROMPTS", few)
        written.clear()
        got = overlap.jaccard_overlap(spark.createDataFrame(asked, "prompt_id int, prompt string"), spark.createDataFrame(train, "text string"), 0.7)
        assert sorted(r.prompt_id for r in got.collect()) == want and 20 < len(want) < 150
        assert sum(written) < 160 * 40 / 2


def test_parities_rule_out_no_similar_pair(spark):
    from corpusflow.operators import overlap
    rnd = random.Random(12)
    train, asked = [], []
    for i in range(150):
        w = [f"t{rnd.randrange(10**6)}" for _ in range(rnd.choice((1, 2, 5, 40, 400)))]
        train.append((" ".join(w),))
        drop = int(len(w) * rnd.uniform(0, 0.4))
        asked.append((i, " ".join(w[drop:] + [f"o{rnd.randrange(10**6)}" for _ in range(int(len(w) * rnd.uniform(0, 0.15)))])))
    sets = [set(t.split()) for t, in train]
    want = [i for i, t in asked if any(len(set(t.split()) & s) / len(set(t.split()) | s) >= 0.7 for s in sets)]
    got = overlap.jaccard_overlap(spark.createDataFrame(asked, "prompt_id int, prompt string"), spark.createDataFrame(train, "text string"), 0.7)
    assert sorted(r.prompt_id for r in got.collect()) == want and len(want) > 50


def test_files_of_the_curated_stream_hold_no_texts(spark, root, monkeypatch):
    """Many events share the texts of an exchange: the files have its number, and the texts join the stream."""
    from corpusflow.catalog import streams
    made, passed = [], []

    def watched(df, key, flush, ts="ts", make=streams.late_files):
        made.append(df)
        return make(df, key, flush, ts)

    monkeypatch.setattr(streams, "late_files", watched)
    monkeypatch.setattr(streams, "finish", lambda df: df)
    monkeypatch.setattr(streams.so, "curate_stream", lambda rows, policy, delay: passed.append(rows) or spark.createDataFrame([], "row_idx long, instruction string, response string, source string"))
    streams.curate_stream(spark, root)
    assert not {"user_text", "assistant_text", "summary"} & set(made[0].columns)
    names = ["row_idx", "user_text", "assistant_text", "k"]
    query = passed[0].select(*names).writeStream.format("memory").queryName("curated").trigger(availableNow=True).start()
    query.awaitTermination()
    want = streams.chat_events(spark, root).select(*names)
    got = spark.table("curated").filter("row_idx >= 0")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and want.count()
