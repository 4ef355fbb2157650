"""The dedup stage of the pipeline compares the texts that the fingerprints link."""

import random

from corpusflow.llm import simhash


def test_keep_one_takes_the_links_of_the_fingerprints(spark, monkeypatch):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(6):
        base = [rnd.choice(words) for _ in range(400)]
        for changes in (0, 0, 2, 3, 40):
            other = list(base)
            for at in rnd.sample(range(400), changes):
                other[at] = rnd.choice(words)
            texts.append(other)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    fps = [r.fp & (1 << 64) - 1 for r in simhash.fingerprints(docs).orderBy("doc_id").collect()]
    near = {(j, i) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4}
    taken, made = [], simhash.near_fingerprints

    def watched(distinct):
        low = {r.sig: r.low.doc_id for r in distinct.collect()}
        out = made(distinct)
        taken.extend((min(low[r.a], low[r.b]), max(low[r.a], low[r.b])) for r in out.collect())
        return out

    monkeypatch.setattr(simhash, "near_fingerprints", watched)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert taken and set(taken) <= near
    firsts = {i for i in range(len(texts)) if not any(texts[j] == texts[i] for j in range(i))}
    reach = {i: i for i in firsts}
    for a, b in sorted(taken) * 3:
        reach[b] = reach[a] = min(reach[a], reach[b])
    assert all(reach[a] == reach[b] for a, b in near if a in firsts and b in firsts)
    assert kept == {i for i in range(len(texts)) if i % 5 in (0, 4)}
