"""Repeated word windows by super-k-mer partitioning.

Every window of ``window`` words has a minimiser, its smallest run of ``GRAM`` words under a hash; of
single words or pairs the frequent ones would draw a large share of all windows into one bucket.
Consecutive windows with the same minimiser travel as one packed string (a super-k-mer) to the bucket of
the minimiser, so equal windows meet whatever surrounds them. A bucket sorts the windows of its strings
and marks all but the earliest of each. Equal strings of a map task collapse before the shuffle, so a
passage with any number of copies reaches its bucket about once per task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import (
    chunks, integers, join_words, merged_runs, mixed, prefix_sums, range_hash, sliding_min, spread, word_bounds)

NO_ID = (1 << 63) - 1
BUCKET_BYTES = 24 << 20
FLUSH_BYTES = 16 << 20
GRAM = 3
META = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("start", "<i8"), ("n", "<i4"), ("text", "?")])


def keyed(docs: DataFrame) -> DataFrame:
    """doc, tag, text: a document is told by its id (none: after all others) and a checksum of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.crc32(text).alias("tag"), text.alias("text"))


def super_kmers(buf: np.ndarray, offsets: np.ndarray, window: int):
    """Runs of windows with one minimiser: text number, first word in the text, windows, byte range, minimiser."""
    starts, ends, doc = word_bounds(buf, offsets)
    none = np.zeros(0, np.int64)
    if len(starts) < window:
        return none, none, none, none, none, np.zeros(0, np.uint64)
    h = range_hash(prefix_sums(buf), starts, ends)
    gram = min(GRAM, window)
    first = np.arange(len(h) - gram + 1)
    low = sliding_min(range_hash(prefix_sums(h), first, first + gram), window - gram + 1)
    ok = doc[:len(low)] == doc[window - 1:]
    at = np.flatnonzero(ok)
    if not len(at):
        return none, none, none, none, none, np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (low[at[1:]] != low[at[:-1]])
    first = at[new]
    n = np.diff(np.append(np.flatnonzero(new), len(at)))
    word0 = np.searchsorted(doc, np.arange(len(offsets) - 1))
    return doc[first], first - word0[doc[first]], n, starts[first], ends[first + n + window - 2], low[first]


def repeated_windows(docs: DataFrame, window: int = 20, buckets: int | None = None) -> DataFrame:
    """Word ranges (doc, tag, lo, hi) covered by windows that also start earlier."""
    if buckets is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(4 * spread(docs), math.ceil(total * 3 / BUCKET_BYTES))

    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        doc, tag, start, n, low = (np.concatenate([p[k] for p in parts]) for k in range(5))
        texts = [t for p in parts for t in p[5]]
        parts.clear()
        bucket = (low % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((start, tag, doc, bucket))
        cut = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1])))
        pack = zstandard.ZstdCompressor(level=3)
        rows = [[], [], []]
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
            seen: dict[bytes, tuple] = {}
            kept, meta = [], []
            for i in order[a:b].tolist():
                key, t = (int(doc[i]), int(tag[i]), int(start[i])), texts[i]
                earlier = seen.setdefault(t, key)
                if earlier is key:
                    kept.append(t)
                    meta.append((*key, int(n[i]), True))
                elif earlier != key:  # the same string of an earlier place: all its windows repeat
                    meta.append((*key, int(n[i]), False))
            rows[0].append(int(bucket[order[a]]))
            rows[1].append(pack.compress(b" ".join(kept)))
            rows[2].append(pack.compress(np.array(meta, META).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())],
            names=["bucket", "words", "places"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids, tags = integers(batch, "doc", NO_ID), integers(batch, "tag", 0)
            for lo, _, buf, offsets in chunks(batch, "text"):
                doc, start, n, x, y, low = super_kmers(buf, offsets, window)
                if not len(doc):
                    continue
                raw = buf.tobytes()
                parts.append((ids[lo + doc], tags[lo + doc], start, n, low,
                              [raw[i:j] for i, j in zip(x.tolist(), y.tolist())]))
                held += int((y - x).sum())
                if held >= FLUSH_BYTES:
                    yield from flush(parts)
                    held = 0
        yield from flush(parts)

    def count(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        found, known = [], []
        for words, places in zip(table.column("words"), table.column("places")):
            meta = np.frombuffer(unpack.decompress(places.as_py(), max_output_size=1 << 31), META)
            buf = np.frombuffer(unpack.decompress(words.as_py(), max_output_size=1 << 31), np.uint8)
            again = meta[~meta["text"]]
            known.append((again["doc"], again["tag"], again["start"], again["start"] + again["n"] + window - 1))
            meta = meta[meta["text"]]
            starts, ends, _ = word_bounds(buf, np.array([0, len(buf)]))
            h = range_hash(prefix_sums(buf), starts, ends)
            n = meta["n"].astype(np.int64)
            word0 = np.concatenate(([0], np.cumsum(n + window - 1)))[:-1]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(word0, n) + inner
            one, two = (range_hash(prefix_sums(x), at, at + window) for x in (h, mixed(h)))
            found.append((one, two, np.repeat(meta["doc"], n), np.repeat(meta["tag"], n), np.repeat(meta["start"], n) + inner))
        one, two, doc, tag, start = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(one)
        same = one[order][1:] == one[order][:-1]
        many = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        many = many[np.lexsort((start[many], tag[many], doc[many], two[many], one[many]))]
        m = [x[many] for x in (one, two, doc, tag, start)]
        lead = np.ones(len(many), bool)
        lead[1:] = (m[0][1:] != m[0][:-1]) | (m[1][1:] != m[1][:-1])
        first = np.maximum.accumulate(np.where(lead, np.arange(len(many)), 0))
        late = np.logical_or.reduce([x != x[first] for x in m[2:]])  # the earliest place itself stays
        known.append((m[2][late], m[3][late], m[4][late], m[4][late] + window))
        doc, tag, lo, hi = (np.concatenate(x) for x in zip(*known))
        (doc, tag), lo, hi = merged_runs([doc, tag], lo, hi)
        return pa.table({"doc": doc, "tag": tag, "lo": lo, "hi": hi})

    return (docs.mapInArrow(cut, "bucket long, words binary, places binary")
            .groupBy("bucket").applyInArrow(count, "doc long, tag long, lo long, hi long"))


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc, tag, text and the list ``cut`` of its ranges; only the short side is held in memory."""
    lists = ranges.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("cut"))
    return docs.join(lists.hint("shuffle_hash"), ["doc", "tag"], "left")


def range_lists(batch: pa.RecordBatch):
    """Row number, lo and hi of all ranges of a batch."""
    col = batch.column(batch.schema.get_field_index("cut"))
    n = np.diff(np.concatenate(([0], np.cumsum([len(x) if x.is_valid else 0 for x in col]))))
    flat = col.flatten()
    lo, hi = (flat.field(k).cast(pa.int64()).to_numpy(zero_copy_only=False) for k in (0, 1))
    return np.repeat(np.arange(len(col)), n), lo, hi


def remove_repeats(docs: DataFrame, window: int = 20, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of every text, joined by one blank, as ``kept``.

    A word goes if a window of ``window`` words that covers it also starts earlier: in a document with a
    smaller doc_id, or before in the same one. Null and empty texts have no words; a text with fewer
    words than a window loses none. A null doc_id is after all others. Rows that share a doc_id are
    ordered by a checksum of their texts; rows equal in both are one place and lose nothing to each other."""
    keys = keyed(docs)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            row, los, his = range_lists(batch)
            for lo, hi, buf, offsets in chunks(batch, "text"):
                starts, ends, doc = word_bounds(buf, offsets)
                count = np.bincount(doc, minlength=hi - lo)
                word0 = np.concatenate(([0], np.cumsum(count)))
                mine = (row >= lo) & (row < hi)
                step = np.zeros(len(starts) + 1, np.int64)
                np.add.at(step, word0[row[mine] - lo] + los[mine], 1)
                np.add.at(step, word0[row[mine] - lo] + his[mine], -1)
                stays = np.cumsum(step)[:-1] == 0
                joined, at = join_words(buf, starts[stays], ends[stays])
                left = np.bincount(doc[stays], minlength=hi - lo)
                edge = at[np.concatenate(([0], np.cumsum(left)))]
                raw = joined.tobytes()
                texts = [raw[a:max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi], mask=ids[lo:hi] == NO_ID), pa.array(count), pa.array(count - left),
                     pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return with_ranges(keys, repeated_windows(keys, window, buckets)).mapInArrow(
        strip, "doc_id long, n_words long, n_removed long, kept string")


