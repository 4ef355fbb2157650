"""Byte strings that occur more than once, with a logarithmic family of sparse suffix arrays.

Indexing every suffix of a corpus is too much; a repeated string needs one common entry point only. From
the first ``reach`` starts inside every string of ``length`` bytes the suffix with the smallest hash is
sampled. The choice depends on the string alone, so two copies sample the same suffix and agree on at
least ``length - reach + 1`` bytes after it. The samples are dealt by that content. Within a bucket they
arrive batch by batch: a batch gets its suffix array (samples sorted by their first four bytes and a
fingerprint of the agreed bytes), the array is merge-scanned against every level of the family for
matches, and becomes a level itself; levels of like size are merged, so there are logarithmically many.

Only the stretches around matched samples travel as text. There all windows of ``length`` bytes are
sorted and counted exactly. Equal stretches of a map task collapse before each shuffle, so a passage with
any number of copies reaches a bucket about once per task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import chunks, integers, merged_runs, mixed, prefix_sums, range_hash, sliding_min, spread
from corpusflow.llm.superkmer import NO_ID, keyed, range_lists, with_ranges

BUCKET_BYTES = 8 << 20
FLUSH_BYTES = 8 << 20
PIECE = 1 << 20
PLACE_BITS = 21
GRAM = 24
SAMPLE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("at", "<i8"), ("hit", "?"), ("known", "?")])
META = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("at", "<i8"), ("n", "<i8"), ("hit", "?"), ("text", "?")])
_SECOND = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


class SuffixLevels:
    """Sorted runs of sample keys whose sizes grow geometrically."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Index one batch (distinct keys); returns the places, old and new, that a match was found for."""
        if not len(keys):
            return np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        run = keys[order], places[order]
        hits = []
        for level, where in self.levels:
            at = np.minimum(np.searchsorted(level, run[0]), len(level) - 1)
            same = level[at] == run[0]
            hits += [where[at[same]], run[1][same]]
        self.levels.append(run)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(-2), self.levels.pop()
            into = np.searchsorted(a, b)
            self.levels.append((np.insert(a, into, b), np.insert(x, into, y)))
        return np.concatenate(hits) if hits else np.zeros(0, np.int64)


def stretches(buf: np.ndarray, offsets: np.ndarray, length: int, reach: int):
    """Runs of windows that sample one suffix: text number, first start in the text, windows, key, byte range,
    and whether the run repeats itself: periodic text samples a suffix with the same content again and again,
    and such neighbours are one run."""
    n_texts, made = len(offsets) - 1, []
    for base in range(0, max(len(buf), 1), PIECE if n_texts == 1 else max(len(buf), 1)):
        part = buf[base:base + PIECE + length - 1] if n_texts == 1 else buf
        offs = np.array([0, len(part)]) if n_texts == 1 else offsets
        n = len(part) - length + 1
        if n <= 0:
            continue
        stop = np.repeat(offs[1:], np.diff(offs))
        starts = np.flatnonzero(np.arange(n) + length <= stop[:n])
        if not len(starts):
            continue
        sums = prefix_sums(part)
        i = np.arange(len(part) - GRAM + 1)
        h = range_hash(sums, i, i + GRAM)
        low = np.uint64((1 << PLACE_BITS) - 1)
        sample = (sliding_min((h & ~low) | i.astype(np.uint64), reach)[starts] & low).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (sample[1:] != sample[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        at = sample[first]
        head = (part[at].astype(np.uint64) << np.uint64(24) | part[at + 1].astype(np.uint64) << np.uint64(16)
                | part[at + 2].astype(np.uint64) << np.uint64(8) | part[at + 3].astype(np.uint64))
        key = head << np.uint64(32) | range_hash(sums, at, at + length - reach + 1) >> np.uint64(32)
        keep = np.ones(len(first), bool)
        keep[1:] = (key[1:] != key[:-1]) | (starts[first[1:]] != starts[first[1:] - 1] + 1)
        again = np.diff(np.append(np.flatnonzero(keep), len(first))) > 1
        first, key = first[keep], key[keep]
        n_windows = np.diff(np.append(first, len(starts)))
        lo = starts[first]
        text = np.searchsorted(offs, lo, "right") - 1
        made.append((text, lo - offs[text] + base, n_windows, key, lo + base, lo + base + n_windows + length - 1, again))
    if not made:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), none, none, np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*made))


def _packed(buckets: np.ndarray, rows: np.ndarray, texts: list | None, pack) -> pa.RecordBatch:
    """One compressed blob per bucket; rows and texts are sorted by bucket."""
    cut = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    out = [[], [], []]
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(buckets)]):
        out[0].append(int(buckets[a]))
        out[1].append(pack.compress(rows[a:b].tobytes()))
        out[2].append(pack.compress(b"".join(texts[a:b])) if texts is not None else b"")
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                                      names=["bucket", "places", "bytes"])


def matched_samples(docs: DataFrame, length: int, reach: int, buckets: int) -> DataFrame:
    """Stretches (doc, tag, lo = first start, hi = key) whose sampled suffix has a match anywhere else."""
    def flush(parts: list, pack) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        rows = np.concatenate(parts)
        parts.clear()
        rows = rows[np.lexsort((rows["at"], rows["tag"], rows["doc"], rows["key"]))]
        lead = np.ones(len(rows), bool)
        lead[1:] = rows["key"][1:] != rows["key"][:-1]
        first = np.maximum.accumulate(np.where(lead, np.arange(len(rows)), 0))
        other = np.logical_or.reduce([rows[c] != rows[c][first] for c in ("doc", "tag", "at")])
        rows["known"] = other          # matched within the task already: only carried on
        rows["hit"][first[other]] = True
        rows = rows[lead | other]
        bucket = np.where(rows["known"], mixed(rows["doc"].astype(np.uint64) ^ rows["at"].astype(np.uint64) << np.uint64(32)),
                          mixed(rows["key"])) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        yield _packed(bucket[order].astype(np.int64), rows[order], None, pack)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, parts, held = zstandard.ZstdCompressor(level=3), [], 0
        for batch in batches:
            ids, tags = integers(batch, "doc", NO_ID), integers(batch, "tag", 0)
            for lo, _, buf, offsets in chunks(batch, "text", PIECE):
                text, at, _, key, _, _, again = stretches(buf, offsets, length, reach)
                rows = np.zeros(len(text), SAMPLE)
                rows["key"], rows["doc"], rows["tag"], rows["at"] = key, ids[lo + text], tags[lo + text], at
                rows["hit"] = again
                parts.append(rows)
                held += len(rows)
                if held > 500_000:
                    yield from flush(parts, pack)
                    held = 0
        yield from flush(parts, pack)

    def match(table: pa.Table) -> pa.Table:
        unpack, family = zstandard.ZstdDecompressor(), SuffixLevels()
        batches = [np.frombuffer(unpack.decompress(x.as_py(), max_output_size=1 << 31), SAMPLE) for x in table.column("places")]
        rows = np.concatenate(batches)
        hit = rows["hit"] | rows["known"]
        base = 0
        for batch in batches:
            own = np.flatnonzero(~batch["known"])
            hit[family.add(batch["key"][own], base + own)] = True
            base += len(batch)
        rows = rows[hit]
        return pa.table({"doc": rows["doc"], "tag": rows["tag"], "lo": rows["at"], "hi": rows["key"].view(np.int64)})

    return (docs.mapInArrow(sample, "bucket long, places binary, bytes binary")
            .groupBy("bucket").applyInArrow(match, "doc long, tag long, lo long, hi long"))


def repeated_bytes(docs: DataFrame, length: int = 400, reach: int = 256, buckets: int | None = None) -> DataFrame:
    """Byte ranges (doc, tag, lo, hi) covered by strings of ``length`` bytes that also start elsewhere."""
    if not 0 < reach <= length - GRAM + 1:
        raise ValueError("reach must leave the sampled bytes inside the string")
    if buckets is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(4 * spread(docs), math.ceil(total * 4 / BUCKET_BYTES))

    def flush(parts: list, pack) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        rows = np.concatenate([p[0] for p in parts])
        bucket = np.concatenate([p[1] for p in parts])
        texts = [t for p in parts for t in p[2]]
        parts.clear()
        order = np.lexsort((rows["at"], rows["tag"], rows["doc"], bucket))
        rows, bucket = rows[order], bucket[order]
        seen: dict[bytes, int] = {}
        sent: list[bytes] = [b""] * len(rows)
        drop = np.zeros(len(rows), bool)
        for new, old in enumerate(order.tolist()):
            first = seen.setdefault(texts[old], new)
            if first == new:
                rows["text"][new], sent[new] = True, texts[old]
            elif rows[["doc", "tag", "at"]][first] == rows[["doc", "tag", "at"]][new]:
                drop[new] = True
            else:
                rows["hit"][[first, new]] = True
        keep = np.flatnonzero(~drop)
        yield _packed(bucket[keep], rows[keep], [sent[k] for k in keep.tolist()], pack)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, parts, held = zstandard.ZstdCompressor(level=3), [], 0
        for batch in batches:
            listed = np.array([x.is_valid for x in batch.column(batch.schema.get_field_index("cut"))], bool)
            if not listed.any():
                continue
            batch = batch.filter(pa.array(listed))
            ids, tags = integers(batch, "doc", NO_ID), integers(batch, "tag", 0)
            row, at, _ = range_lists(batch)
            for lo, hi, buf, offsets in chunks(batch, "text", PIECE):
                text, start, n, key, x, y, _ = stretches(buf, offsets, length, reach)
                mine = (row >= lo) & (row < hi)
                wide = int(offsets.max()) + 1
                ok = np.isin(text * wide + start, (row[mine] - lo) * wide + at[mine])
                text, start, n, key, x, y = (v[ok] for v in (text, start, n, key, x, y))
                rows = np.zeros(len(text), META)
                rows["doc"], rows["tag"], rows["at"], rows["n"] = ids[lo + text], tags[lo + text], start, n
                raw = buf.tobytes()
                parts.append((rows, (mixed(key) % np.uint64(buckets)).astype(np.int64),
                              [raw[i:j] for i, j in zip(x.tolist(), y.tolist())]))
                held += int((y - x).sum())
                if held >= FLUSH_BYTES:
                    yield from flush(parts, pack)
                    held = 0
        yield from flush(parts, pack)

    def windows(places, raw, unpack, mark: np.ndarray | None = None):
        """Of a blob: its whole stretches, a first hash of every window, and of the marked ones all that tells them."""
        meta = np.frombuffer(unpack.decompress(places.as_py(), max_output_size=1 << 31), META)
        buf = np.frombuffer(unpack.decompress(raw.as_py(), max_output_size=1 << 31), np.uint8)
        text = meta[meta["text"]]
        n = text["n"]
        of = np.repeat(np.arange(len(text), dtype=np.int32), n)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum(n + length - 1) - (n + length - 1), n) + inner
        if mark is None:
            return meta[meta["hit"]], range_hash(prefix_sums(buf), at, at + length)
        of, inner, at = of[mark], inner[mark], at[mark]
        one, two = (range_hash(prefix_sums(v), at, at + length) for v in (buf, _SECOND[buf]))
        return one, two, text["doc"][of], text["tag"][of], text["at"][of] + inner

    def count(table: pa.Table) -> pa.Table:
        unpack, blobs = zstandard.ZstdDecompressor(), list(zip(table.column("places"), table.column("bytes")))
        first, known = [], []
        for places, raw in blobs:
            whole, one = windows(places, raw, unpack)
            known.append((whole["doc"], whole["tag"], whole["at"], whole["at"] + whole["n"] + length - 1))
            first.append(one)
        edge = np.concatenate(([0], np.cumsum([len(x) for x in first]))).tolist()
        one = np.concatenate(first)
        first.clear()
        order = np.argsort(one)
        one = one[order]
        same = one[1:] == one[:-1]
        often = np.zeros(len(one), bool)  # windows whose first hash another one has
        often[order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(one) else order] = True
        del one, order, same
        parts = [windows(*blob, unpack, often[lo:hi]) for blob, lo, hi in zip(blobs, edge, edge[1:]) if often[lo:hi].any()]
        m = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3
        many = np.lexsort((m[4], m[3], m[2], m[1], m[0]))
        m = [v[many] for v in m]
        lead = np.ones(len(many), bool)
        lead[1:] = (m[0][1:] != m[0][:-1]) | (m[1][1:] != m[1][:-1])
        first = np.maximum.accumulate(np.where(lead, np.arange(len(many)), 0))
        hit = np.logical_or.reduce([v != v[first] for v in m[2:]])
        hit[first[hit]] = True
        known.append((m[2][hit], m[3][hit], m[4][hit], m[4][hit] + length))
        doc, tag, lo, hi = (np.concatenate(v) for v in zip(*known))
        (doc, tag), lo, hi = merged_runs([doc, tag], lo, hi)
        return pa.table({"doc": doc, "tag": tag, "lo": lo, "hi": hi})

    near = with_ranges(docs, matched_samples(docs, length, reach, buckets))
    return (near.mapInArrow(cut, "bucket long, places binary, bytes binary")
            .groupBy("bucket").applyInArrow(count, "doc long, tag long, lo long, hi long"))


def remove_repeats(docs: DataFrame, length: int = 400, reach: int = 256, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining UTF-8 bytes ``kept`` of every text.

    A byte goes if a string of ``length`` bytes that covers it starts at any other place, in the same
    document or another. Null and short texts lose nothing. Rows equal in doc_id and text are one
    document; a null doc_id is an id like others."""
    keys = keyed(docs)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            row, los, his = range_lists(batch)
            for lo, hi, buf, offsets in chunks(batch, "text"):
                mine = (row >= lo) & (row < hi)
                r, a, b = row[mine] - lo, los[mine], his[mine]
                (r,), a, b = merged_runs([r], a, b)
                spans = np.bincount(r, minlength=hi - lo)
                gone = np.bincount(r, weights=b - a, minlength=hi - lo).astype(np.int64)
                step = np.zeros(len(buf) + 1, np.int8)
                np.add.at(step, offsets[r] + a, 1)
                np.add.at(step, offsets[r] + b, -1)
                stays = np.cumsum(step[:-1], dtype=np.int8) == 0
                size = np.diff(offsets)
                edge = np.concatenate(([0], np.cumsum(size - gone)))
                raw = buf[stays].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi], mask=ids[lo:hi] == NO_ID), pa.array(size), pa.array(gone), pa.array(spans),
                     pa.array([raw[x:y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return with_ranges(keys, repeated_bytes(keys, length, reach, buckets)).mapInArrow(
        strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
