"""Memory of a worker: batches and runs of the pieces are bounded by bytes, with the same ids."""

import numpy as np
import pyarrow as pa
import pytest

from corpusflow.llm import pieces

spm = pytest.importorskip("sentencepiece")


def test_unseen_hashes():
    rng = np.random.default_rng(3)
    seen, known = np.zeros(0, np.uint64), set()
    for n in (0, 5, 40, 40, 1):
        h = np.unique(rng.integers(0, 60, n).astype(np.uint64))
        h[-1:] = np.uint64(2**64 - 1)
        new, seen = pieces._unseen(seen, h)
        assert new.tolist() == [x not in known for x in h.tolist()]
        known |= set(h.tolist())
        assert seen.tolist() == sorted(known)


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(pieces, "SHARD_BYTES", 64 << 10)
    monkeypatch.setattr(pieces, "RUN_BYTES", 8 << 10)
    texts = {i: " ".join(f"word{(i * 7 + k) % 911} Ünit{k % 13}" for k in range(200)) for i in range(120)}
    texts |= {120: None, 121: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    before = spark.conf.get(pieces.BATCH_BYTES, None)
    spark.conf.unset(pieces.BATCH_BYTES)
    try:
        rows = pieces.decode(pieces.encode(docs)).collect()
        sizes = docs.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in bs), "n long").collect()
    finally:
        spark.conf.unset(pieces.BATCH_BYTES) if before is None else spark.conf.set(pieces.BATCH_BYTES, before)
    assert max(r.n for r in sizes) < 80 << 10  # one batch of some 390 KB before
    sp = spm.SentencePieceProcessor(model_file=pieces.MODEL)
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.ids) == (sp.encode(texts[r.doc_id]) if texts[r.doc_id] else [])
        assert r.text == (texts[r.doc_id] or "")


def test_decoded_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(pieces, "DECODED", 3)
    docs = spark.createDataFrame([(i, f"row {i}" * (i % 4)) for i in range(20)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()}
    assert got == {i: f"row {i}" * (i % 4) for i in range(20)}
