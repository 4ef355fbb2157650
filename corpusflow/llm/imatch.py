"""I-Match fingerprints: terms within a band of inverse document frequency, hashed per random lexicon.

The lexicon holds the terms whose document frequency, counted over all texts, lies in the band. Its size
is proven: terms seen in at least ``low`` documents number at most (sum of all frequencies) / ``low``, and
``low`` is raised until that is within ``max_terms``. A fingerprint holds the hash of the sorted distinct
terms of a text that are in the lexicon, and for each of several random orders of the terms the hash of
those that a part of the lexicon keeps: the parts halve from step to step, and the smallest one that still
keeps a term of the text is taken, so texts of any length have a hash of few terms in every order."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import chunks, mixed, prefix_sums, range_hash, spread, word_bounds
from corpusflow.session import settle

REPEATS = 24
SUBSETS = 1 + REPEATS
_SALTS = mixed(np.arange(1, REPEATS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
LAST = -(1 << 63)
BUCKET_BYTES = 6 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.ones(256, bool)
_GAP[128:] = False
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _GAP[_lo:_hi] = False


def _terms(buf: np.ndarray, offsets: np.ndarray):
    """Distinct (text, term hash), sorted; terms are runs of letters and digits in lower case."""
    starts, ends, doc = word_bounds(buf, offsets, _GAP)
    h = range_hash(prefix_sums(_LOWER[buf]), starts, ends)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df) over all texts; a task counts its own terms before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush():
            term, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([p[1] for p in parts]), minlength=len(term)).astype(np.int64)
            return term, n

        for batch in batches:
            for _, _, buf, offsets in chunks(batch, "text"):
                term, n = np.unique(_terms(buf, offsets)[1], return_counts=True)
                parts.append((term, n))
                held += len(term)
                if held > 1_500_000:
                    parts[:] = [flush()]
                    held = len(parts[0][0])
                    if held > 750_000:
                        yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], names=["term", "n"])
                        parts.clear()
                        held = 0
        if parts:
            term, n = flush()
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def band_lexicon(docs: DataFrame, low: float = 5e-4, high: float = 0.2, max_terms: int = 500_000) -> np.ndarray:
    """Sorted hashes of the terms in the band, at most ``max_terms``."""
    n = docs.count()
    seen = settle(document_frequency(docs).filter("df >= 2"))
    total = seen.agg(F.sum("df")).first()[0] or 0
    least = max(2, math.ceil(low * n), math.ceil(total / max_terms))
    rows = seen.filter((F.col("df") >= least) & (F.col("df") <= max(2, math.floor(high * n)))).select("term").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def subset_hashes(texts: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """Texts x SUBSETS hashes of 24 bits; all 0 where a text has no terms.

    A text of which no term is in the band is fingerprinted over all its terms."""
    out = np.zeros((len(texts), SUBSETS), np.uint32)
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    for lo, hi, buf, offsets in chunks(batch, "text", 2 << 20):
        doc, h = _terms(buf, offsets)
        if not len(h):
            continue
        if len(lexicon):
            at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
            known = lexicon[at] == h
        else:
            known = np.zeros(len(h), bool)
        use = known | (np.bincount(doc[known], minlength=hi - lo) == 0)[doc]
        doc, h = doc[use], h[use]
        cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        size = np.diff(np.append(cut, len(doc)))
        rows = lo + doc[cut]
        # terms are sorted within a text; the sum of their spread hashes is the hash of that list
        out[rows, 0] = _short(np.add.reduceat(mixed(h), cut))
        for repeat, salt in enumerate(_SALTS, 1):
            g = mixed(h ^ salt)
            # lexicon number e keeps the terms with g below 2^e: the smallest one that keeps any is hashed
            e = np.minimum(np.frexp(np.minimum.reduceat(g, cut).astype(np.float64))[1], 63).astype(np.uint64)
            inside = (g >> np.repeat(e, size)) == 0
            inside |= np.repeat(e == 63, size)
            sums = np.add.reduceat(np.where(inside, mixed(g), np.uint64(0)), cut)
            out[rows, repeat] = _short(sums ^ e)
    return out


def _short(x: np.ndarray) -> np.ndarray:
    return (mixed(x) % np.uint64((1 << 24) - 1) + np.uint64(1)).astype(np.uint32)


def as_text(row: np.ndarray) -> str:
    return "".join(f"{x:06x}" for x in row.tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes."""
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame, low: float = 5e-4, high: float = 0.2, max_terms: int = 500_000) -> DataFrame:
    """doc_id and fingerprint of every text (null: empty)."""
    lexicon = docs.sparkSession.sparkContext.broadcast(band_lexicon(docs, low, high, max_terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = subset_hashes(batch.column(1), lexicon.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_text(x) for x in made])], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, make, schema: str, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Apply ``make(table)`` to runs of documents in descending doc_id, each run with the document after it.

    The table has doc, crc, border, text; border is true for the one row that follows the run (after the
    last run: the first document of all). Runs are cut at quantiles of doc_id; only the head of each run is
    copied to the run before. A null doc_id is the smallest; equal ids are in the order of a text checksum."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.crc32(text).alias("crc"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = max(4 * spread(docs), math.ceil(total / bucket_bytes))
    cuts = rows.agg(F.percentile_approx("doc", [k / runs for k in range(1, runs)], 100 * runs)).first()[0] if runs > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= F.col("doc"))) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", bucket.cast("long"))
    heads = rows.groupBy("bucket").agg(F.max("doc").alias("head"))
    order = Window.orderBy("bucket")
    heads = heads.select("head", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("to"))
    border = (rows.join(F.broadcast(heads), rows["doc"] == heads["head"])  # one row per run
              .select("doc", "crc", "text", F.col("to").alias("bucket"), F.lit(True).alias("border")))
    every = rows.withColumn("border", F.lit(False)).unionByName(border)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("border", "ascending"), ("doc", "descending"), ("crc", "ascending")])
        own = len(table) - int(np.count_nonzero(table.column("border").to_numpy(zero_copy_only=False)))
        return make(table.slice(0, own + 1).combine_chunks())

    return every.groupBy("bucket").applyInArrow(run, schema)


def edited_fingerprints(docs: DataFrame, low: float = 5e-4, high: float = 0.2, max_terms: int = 500_000) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how like they are.

    Edited: the last third of the code points gives way to the first as many of the next document in
    descending doc_id (the last is followed by the first). near_next compares with that document itself.
    Texts without terms have equal fingerprints."""
    lexicon = docs.sparkSession.sparkContext.broadcast(band_lexicon(docs, low, high, max_terms))

    def make(table: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        ids = table.column("doc").to_numpy()[:len(texts) - 1]
        n = [len(t) for t in texts[:-1]]
        edited = [t[:k - k // 3] + after[:k // 3] for t, after, k in zip(texts, texts[1:], n)]
        own = subset_hashes(pa.array(texts, pa.string()), lexicon.value)
        new = subset_hashes(pa.array(edited, pa.string()), lexicon.value)
        return pa.table({
            "doc_id": pa.array(ids, mask=ids == LAST), "n_chars": pa.array(n, pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": pa.array([as_text(x) for x in own[:-1]], pa.string()),
            "edited_fingerprint": pa.array([as_text(x) for x in new], pa.string()),
            "near_edited": likeness(own[:-1], new), "near_next": likeness(own[:-1], own[1:])})

    return with_next(docs, make, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                     "edited_fingerprint string, near_edited double, near_next double")
