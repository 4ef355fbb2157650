"""Work that a query owes to every row: rows without an id, labels beyond one shard."""

import random

import numpy as np

from corpusflow.llm import simhash, toxicity


def test_keep_one_takes_rows_without_an_id(spark):
    """A row without a doc_id goes if it copies or resembles another; it stays if it comes first of its own kind."""
    one, two, three = (" ".join(f"{c}{k}" for k in range(80)) for c in "xyz")
    rows = [(None, one, "a"), (4, "other " + one, "b"), (9, one, "c"), (None, two, "d"), (None, "more " + two, "e"),
            (None, three, "f"), (None, three, "f"), (7, "own", "g"), (None, None, "h"), (8, " ", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = simhash.keep_one(docs).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == [(4, "other " + one), (7, "own"), (8, " ")]
    alone = [r.text for r in got if r.doc_id is None]
    assert len(alone) == 2 and three in alone and ({two, "more " + two} & set(alone))


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t, "en") for i, (t, _) in enumerate(rows)], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, 0, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")


def test_toxicity_trains_on_texts_of_any_length(spark):
    """Only texts of over 20,000 words are toxic."""
    rng = random.Random(3)
    plain = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    rows = [(" ".join([*plain(20_000), "venom", "venom"]), 1) for _ in range(8)] + [(" ".join(plain(12)), 0) for _ in range(60)]
    docs, labels = labelled(spark, rows)
    model = toxicity.train(docs, labels)
    asked = spark.createDataFrame([(1, "w1 w2 venom venom w3", "en"), (2, "w1 w2 w4 w5 w3", "en")], "doc_id long, text string, lang string")
    score = {r.doc_id: r.toxic_score for r in toxicity.score(asked, model).collect()}
    assert score[1] > score[2] + 0.05


def test_toxicity_trains_on_every_shard(spark, monkeypatch):
    """Each toxic word is in a few texts only, so that a sample would miss some; rows in any layout give the same model."""
    rng = random.Random(4)
    bad = [f"venom{k}" for k in range(12)]
    rows = []
    for k in range(400):
        words = [f"w{rng.randrange(200)}" for _ in range(10)]
        if k % 4 == 0:
            words[rng.randrange(10)] = bad[k // 4 % 12]
        rows.append((" ".join(words), int(k % 4 == 0)))
    docs, labels = labelled(spark, rows)
    monkeypatch.setattr(toxicity, "SHARD_DOCS", 110)
    model = toxicity.train(docs, labels)
    asked = docs.limit(0).unionByName(spark.createDataFrame([(k, f"w1 w2 {w} w3", "en") for k, w in enumerate([*bad, "w4", "w5"])], docs.schema))
    score = {r.doc_id: r.toxic_score for r in toxicity.score(asked, model).collect()}
    assert min(score[k] for k in range(12)) > max(score[12], score[13])
    monkeypatch.setattr(toxicity, "FEW_LABELS", 10)
    again = toxicity.train(docs.repartition(5, "text"), labels.repartition(3))
    assert (again.tables == model.tables).all() and again.shift == model.shift and again.thresholds == model.thresholds


def test_peaks_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    m, _ = toxicity._fresh(rng)
    size = np.array([1, 40, 2, 15, 16, 17, 90])
    doc, edge = np.repeat(np.arange(len(size)), size), np.concatenate(([0], np.cumsum(size)))
    slots = rng.integers(0, toxicity.BUCKETS, (2, len(doc)))
    whole = toxicity._peaks(m, doc, slots, edge)
    monkeypatch.setattr(toxicity, "PIECE", 16)
    for a, b in zip(whole, toxicity._peaks(m, doc, slots, edge)):
        assert np.allclose(a, b, atol=1e-6)
