"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint is embedded as the bit counts of its segments. Every differing bit changes one count by
one at most, so the Manhattan distance of two embeddings never exceeds the Hamming distance. The
segments are cut into ``blocks``; if the whole distance is at most ``most``, it is at most
``most // blocks`` in one block. So every distinct fingerprint lies in one grid cell per block and
looks into the cells within that range; what meets in a cell is filtered by the distance over all
segments and verified on the fingerprints. A cell returns a spanning set of its links, never its pairs.

The pipeline's rule is a similarity of shingle sets, which no narrow radius of fingerprints covers: its stage
(``keep_one``) takes the links of the fingerprints and a join of the texts on the shingles that similar texts must
share, and verifies the sets of both."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import chunks, join_words, mixed, prefix_sums, range_hash, spread, word_bounds
from corpusflow.session import settle

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and the 64-bit SimHash of every text (null: empty, fingerprint 0) as ``fp``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros(batch.num_rows, np.uint64)
            for lo, hi, buf, offsets in chunks(batch, "text", 1 << 20):
                made[lo:hi] = _simhash(buf, offsets, words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _simhash(buf: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    starts, ends, doc = word_bounds(buf, offsets)
    n_docs = len(offsets) - 1
    out = np.zeros(n_docs, np.uint64)
    if not len(starts):
        return out
    joined, at = join_words(buf, starts, ends)
    joined = _LOWER[joined].tobytes()
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    shingles = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    rows = np.flatnonzero(shingles)
    total = int(shingles.sum())
    base = np.concatenate(([0], np.cumsum(shingles)[:-1]))
    i = np.arange(total) - np.repeat(base[rows], shingles[rows]) + np.repeat(first[rows], shingles[rows])
    last = np.minimum(i + words, np.repeat(first[rows] + count[rows], shingles[rows])) - 1
    h64 = xxhash.xxh64_intdigest
    h = np.fromiter((h64(joined[a:b], 42) for a, b in zip(at[i].tolist(), (at[last + 1] - 1).tolist())), np.uint64, total)
    for lo in range(0, len(rows), 256):  # bounded width of the bit table
        part = rows[lo:lo + 256]
        a, b = int(base[part[0]]), int(base[part[-1]] + shingles[part[-1]])
        bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, base[part] - a, axis=0, dtype=np.int64)
        out[part] = np.packbits(ones * 2 > shingles[part][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _embedding(fp: np.ndarray, segments: int) -> np.ndarray:
    width = 64 // segments
    mask = np.uint64((1 << width) - 1)
    return np.stack([np.bitwise_count((fp >> np.uint64(width * s)) & mask) for s in range(segments)], axis=1).astype(np.int8)


def _block_bounds(segments: int, blocks: int) -> list[tuple[int, int]]:
    return [(segments * b // blocks, segments * (b + 1) // blocks) for b in range(blocks)]


def _offsets(dims: int, reach: int) -> np.ndarray:
    """Steps of Manhattan length up to ``reach`` whose first non-zero part is positive: one of each pair
    x, -x, as the other end of a link takes the opposite step."""
    if reach == 1:
        return np.eye(dims, dtype=np.int64)
    if (2 * reach + 1) ** dims > 5_000_000:
        raise ValueError("too many grid steps; take more blocks or fewer segments")
    made = [x for x in product(range(-reach, reach + 1), repeat=dims)
            if 0 < sum(map(abs, x)) <= reach and next(v for v in x if v) > 0]
    return np.array(made, np.int64).reshape(-1, dims)


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (smallest members) after the links a - b are added to a forest."""
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _linked(points: np.ndarray, homes: int, most: int) -> np.ndarray:
    """Roots of the points of a cell over all pairs within ``most`` bits of which one is at home."""
    coarse = _embedding(points, 4)
    root = np.arange(len(points))
    wide = max(1, (1 << 20) // len(points))
    for s in range(0, homes, wide):
        e = min(homes, s + wide)
        bound = np.zeros((e - s, len(points)), np.int8)
        for d in range(coarse.shape[1]):
            bound += np.abs(coarse[s:e, d, None] - coarse[None, :, d])
        i, j = np.nonzero(bound <= most)
        i += s
        ok = (i < j) & (np.bitwise_count(points[i] ^ points[j]) <= most)
        root = _joined(root, i[ok], j[ok])
    return root


def links(distinct: DataFrame, most: int = 4, segments: int = 32, blocks: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose closure is that of all pairs within ``most`` bits."""
    reach = most // blocks
    bounds = _block_bounds(segments, blocks)
    steps = [_offsets(hi - lo, reach) if reach else np.zeros((0, hi - lo), np.int64) for lo, hi in bounds]
    base = 64 // segments + 2 * reach + 1

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(every), 2048):
                fp = every[lo:lo + 2048]
                emb = _embedding(fp, segments).astype(np.int64)
                for k, (x, y) in enumerate(bounds):
                    place = base ** np.arange(y - x, dtype=np.int64)
                    home = (emb[:, x:y] + reach) @ place
                    cell = np.concatenate([home[:, None], home[:, None] + (steps[k] @ place)[None, :]], axis=1)
                    n = cell.shape[1]
                    valid = np.ones(cell.shape, bool)  # a count outside 0..width is nobody's home
                    moved = emb[:, None, x:y] + steps[k][None]
                    valid[:, 1:] = ((moved >= 0) & (moved <= 64 // segments)).all(axis=2)
                    looks = np.broadcast_to(np.arange(n) > 0, cell.shape)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(int(valid.sum()), k, np.int8)), pa.array(cell[valid]),
                        pa.array(np.repeat(fp, n).view(np.int64).reshape(cell.shape)[valid]), pa.array(looks[valid])],
                        names=["block", "cell", "fp", "looks"])

    def meet(table: pa.Table) -> pa.Table:
        # a row group holds the cells of one bucket of the grid
        key = table.column("cell").to_numpy()
        block = table.column("block").to_numpy()
        fp = table.column("fp").to_numpy().view(np.uint64)
        looks = table.column("looks").to_numpy(zero_copy_only=False)
        order = np.lexsort((fp, looks, key, block))
        key, block, fp, looks = key[order], block[order], fp[order], looks[order]
        cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
        left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(key)]):
            n = hi - lo
            homes = n - int(looks[lo:hi].sum())
            if n < 2 or not homes:
                continue
            points = fp[lo:hi]
            root = _linked(points, homes, most)
            of = np.flatnonzero(root != np.arange(n))
            left.append(points[root[of]])
            right.append(points[of])
        a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        ok = a != b
        return pa.table({"a": a[ok], "b": b[ok]})

    dealt = distinct.select("fp").mapInArrow(cells, "block byte, cell long, fp long, looks boolean")
    return (dealt.withColumn("bucket", F.pmod(F.xxhash64("block", "cell"), F.lit(16 * spread(distinct))))
            .groupBy("bucket").applyInArrow(meet, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable over the links (a, b), by alternating large and small stars.

    Each round keeps at most as many links as before; rounds grow with the logarithm of the longest chain."""
    now = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        step = settle(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        same = step.join(now, ["u", "v"], "left_anti").isEmpty() and now.join(step, ["u", "v"], "left_anti").isEmpty()
        now = step
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4, segments: int = 32, blocks: int = 3) -> DataFrame:
    """doc_id, fp, component_id: one row per document with the smallest doc_id that links reach.

    Equal fingerprints link too; a text without words has fingerprint 0. A null doc_id is kept and is
    the smallest of its component only if no other is there. Rows that share a doc_id stay rows."""
    rows = settle(fingerprints(docs, words))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(distinct, most, segments, blocks))
    of = settle(distinct.join(roots, distinct["fp"] == roots["node"], "left")
                .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    ids = of.groupBy("root").agg(F.min("low").alias("component_id"))
    label = of.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return rows.join(label, "fp").select("doc_id", "fp", "component_id")


def _sets(buf: np.ndarray, offsets: np.ndarray, words: int):
    """The distinct shingles of every text as 64-bit hashes, sorted within a text: hashes, text of each, their
    number and a 64-bit digest per text. A text of fewer words is one shingle; one without words has none."""
    starts, ends, doc = word_bounds(buf, offsets)
    n_docs = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n_docs, np.int64), np.zeros(n_docs, np.uint64)
    joined, at = join_words(buf, starts, ends)
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    shingles = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    of = np.repeat(np.arange(n_docs), shingles)
    i = np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[of]
    last = np.minimum(i + words, first[of] + count[of]) - 1
    h = range_hash(prefix_sums(_LOWER[joined]), at[i], at[last + 1] - 1)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    n = np.bincount(of, minlength=n_docs)
    digest = np.zeros(n_docs, np.uint64)
    digest[n > 0] = np.add.reduceat(mixed(h), np.flatnonzero(np.diff(of, prepend=-1)))
    return h, of, n, mixed(digest ^ n.astype(np.uint64))


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values.view(np.int64)))


def _frequent(docs: DataFrame, words: int, most: int = 500_000) -> np.ndarray:
    """Shingles that many documents hold, by a sixteenth of the documents. They only set an order: any set is right."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in chunks(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(_sets(buf, offsets, words)[0].view(np.int64))], names=["h"])

    part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0).select("text")
    seen = settle(part.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 2"))
    left, least = most, 1 << 62
    for r in seen.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("of")).orderBy(F.desc("n")).collect():
        left -= r["of"]
        if left < 0:
            break
        least = r["n"]
    found = seen.filter(F.col("n") >= least).select("h").toArrow().column("h").to_numpy().view(np.uint64)
    return np.sort(found)


def shingle_keys(docs: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """Columns of ``docs`` but the text, and digest ``sig``, number ``n`` and ``keys`` of its shingles; of equal
    texts in a task only the first has its keys, the others null. ``fp`` is the SimHash of the text.

    In an order that all texts share, two texts of similarity p / q have a shingle in common among the first
    n - ceil(n * p / q) + 1 of each. These are the keys; frequent shingles come last in the order."""
    frequent = _frequent(docs, words)
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            rest = batch.select(others)
            for lo, hi, buf, offsets in chunks(batch, "text", 1 << 20):
                h, of, n, sig = _sets(buf, offsets, words)
                late = np.zeros(len(h), bool)
                if len(frequent):
                    late = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
                h = h[np.lexsort((h, late, of))]
                pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                length = np.where(n > 0, n - -(-n * p // q) + 1, 0)
                again = np.array([x in met or met.add(x) is not None for x in sig.tolist()], bool)
                length[again] = 0
                keys = _lists(h[pos < length[of]], length)
                keys = pa.ListArray.from_arrays(keys.offsets, keys.values, mask=pa.array(again))
                yield pa.RecordBatch.from_arrays(
                    [*rest.slice(lo, hi - lo).columns, pa.array(sig.view(np.int64)), pa.array(n.astype(np.int32)), keys,
                     pa.array(_simhash(buf, offsets, 4).view(np.int64))],
                    names=[*others, "sig", "n", "keys", "fp"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.select(*others, "text").mapInArrow(run, f"{schema}, sig long, n int, keys array<long>, fp long")


#: Texts of one key up to which all pairs are candidates at once. Larger keys first yield some pairs a text, and
#: later only pairs that are still in different components.
SMALL = 8
#: Texts of a larger key that all others of it are compared with first.
HUBS = 2


def _meet(table: pa.Table, p: int, q: int, small: int, later: bool) -> pa.Table:
    """Candidates (a, b) of the keys of a bucket: same key, and neither sizes nor places rule the similarity out.

    A key of many texts yields few pairs at first and its own name as (key, null). Later it yields all pairs
    whose ends lie in different components (``root``)."""
    get = lambda c: table.column(c).to_numpy()
    h, n, pos, sig = get("h"), get("n").astype(np.int64), get("pos").astype(np.int64), get("sig")
    root = get("root") if later else sig
    order = np.lexsort((sig, n, h))
    order = order[np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (sig[order][1:] != sig[order][:-1])))[:len(order)]]  # copies of other tasks
    h, n, pos, sig, root = h[order], n[order], pos[order], sig[order], root[order]
    cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    size = np.diff(np.append(cut, len(h)))
    many = np.repeat(size > small, size)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        fits = ((p + q) * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= p * (n[i] + n[j])) & (root[i] != root[j])
        i, j = i[fits], j[fits]
        left.append(np.minimum(sig[i], sig[j]))
        right.append(np.maximum(sig[i], sig[j]))

    if later:
        for lo, m in zip(cut.tolist(), size.tolist()):
            roots, of = np.unique(root[lo:lo + m], return_inverse=True)
            most = np.bincount(of, minlength=len(roots)).argmax()
            for i in (lo + np.flatnonzero(of != most)).tolist():
                # a pair outside the largest component is seen from its first end only
                other = np.arange(lo, lo + m)
                other = other[(of == most) | (other > i)]
                add(np.full(len(other), i), other)
    else:
        i = np.flatnonzero(np.repeat(size > 1, size))
        for step in range(1, small):
            i = i[i + step < len(h)]
            i = i[(h[i] == h[i + step]) & (~many[i] | (step < 4))]
            if not len(i):
                break
            add(i, i + step)
        for lo, m in zip(cut[size > small].tolist(), size[size > small].tolist()):
            # a text with few shingles in front of a common one has few of its own: most others are near to it
            for hub in (np.lexsort((mixed(sig[lo:lo + m].view(np.uint64)), pos[lo:lo + m]))[:HUBS] + lo).tolist():
                add(np.full(m, hub), np.arange(lo, lo + m))
    names = h[cut[size > small]] if not later else np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    return pa.table({"a": pa.array(np.concatenate((a, names))),
                     "b": pa.array(np.concatenate((b, names)), mask=np.arange(len(a) + len(names)) >= len(a))})


def near_fingerprints(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of digests ``sig`` that the fingerprints link: the smallest digest of a fingerprint with its
    others, and with those of the fingerprints that ``links`` yields within 4 bits."""
    first = settle(distinct.groupBy("fp").agg(F.min("sig").alias("low")))
    near = links(first.select("fp"))
    ends = lambda c, d: first.select(F.col("fp").alias(c), F.col("low").alias(d))
    pairs = near.join(ends("a", "x"), "a").join(ends("b", "y"), "b").select("x", "y")
    same = distinct.select("fp", "sig").join(first, "fp").filter("sig <> low").select(F.col("low").alias("x"), F.col("sig").alias("y"))
    return pairs.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar(docs: DataFrame, keyed: DataFrame, distinct: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """(node, root): components of the digests ``sig`` over all pairs of similarity p / q or more.

    Candidates are the pairs that the fingerprints link, and those that share a key, as no narrow radius of
    fingerprints covers the similarity. All are verified.

    ``keyed`` has the keys of each digest at least once, ``distinct`` a document ``low`` of each, whose text is that
    of its doc_id in ``docs``. No doc_id is null."""
    rows = keyed.filter("keys IS NOT NULL").select("sig", "n", F.posexplode("keys").alias("pos", "h"))
    small = SMALL
    buckets = F.pmod(F.xxhash64("h"), F.lit(16 * spread(docs))).alias("bucket")

    def candidates(rows: DataFrame, later: bool) -> DataFrame:
        return settle(rows.withColumn("bucket", buckets).groupBy("bucket")
                      .applyInArrow(lambda t: _meet(t, p, q, small, later), "a long, b long").distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for _, _, buf, offsets in chunks(batch, "text", 1 << 20):
                h, _, n, sig = _sets(buf, offsets, words)
                made = pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), _lists(h, n)], names=["sig", "held"])
                yield made.filter(pa.array([not (x in met or met.add(x) is not None) for x in sig.tolist()], pa.bool_()))

    def linked(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        ids = settle(distinct.select("sig", F.col("low.doc_id").alias("doc_id")).join(ends, "sig", "left_semi"))
        texts = docs.join(ids.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi").select("text")
        # other texts under these ids take no part below; a text that one id has in two tasks only repeats its pairs
        held = settle(texts.mapInArrow(sets, "sig long, held array<long>"))
        both = (pairs.join(held.select(F.col("sig").alias("a"), F.col("held").alias("x")), "a")
                .join(held.select(F.col("sig").alias("b"), F.col("held").alias("y")), "b"))
        common = F.size(F.array_intersect("x", "y"))
        return settle(both.filter(common * (p + q) >= p * (F.size("x") + F.size("y"))).select("a", "b"))

    found = candidates(rows, False)
    edges = linked(settle(near_fingerprints(distinct).unionByName(found.filter("b IS NOT NULL")).distinct()))
    roots = components(edges)
    large = found.filter("b IS NULL").select(F.col("a").alias("h")).distinct()
    if large.isEmpty():
        return roots
    open_ = (rows.join(large, "h", "left_semi").join(roots.withColumnRenamed("node", "sig"), "sig", "left")
             .withColumn("root", F.coalesce("root", "sig")))
    return components(edges.unionByName(linked(candidates(open_, True))))


def keep_one(docs: DataFrame, words: int = 5, least: str = "0.8") -> DataFrame:
    """The documents that come first in their component, by doc_id and a hash of the row; all columns of ``docs`` stay.

    Texts are linked whose sets of shingles have a Jaccard similarity of ``least`` or more; texts without words
    are alike. Near fingerprints and common shingles name the pairs that are compared. Rows without a doc_id take
    part like the others, known by the hash of the row, and come last in their component. Rows that share a doc_id
    collapse only if they are equal or linked. Columns may have any names."""
    p, q = Fraction(least).as_integer_ratio()
    whole = F.xxhash64(*docs.columns)
    known = F.col("doc_id").cast("long")
    ids = [known.isNull().alias("none"), F.coalesce(known, whole).alias("doc_id"), whole.alias("_row")]
    names = ["none", "doc_id", "_row"]
    part = docs.select(*ids, "text")
    rows = settle(shingle_keys(part, words, p, q)).withColumn("id", F.struct(*names))
    distinct = settle(rows.groupBy("sig").agg(F.min("id").alias("low"), F.min("fp").alias("fp")))
    of = settle(distinct.join(similar(part, rows, distinct, words, p, q).withColumnRenamed("node", "sig"), "sig", "left")
                .select("sig", "low", F.coalesce("root", "sig").alias("root")))
    keep = settle(rows.groupBy("id").agg(F.count("*").alias("_rows"))
                  .join(of.groupBy("root").agg(F.min("low").alias("id")).select("id"), "id", "left_semi")
                  .select(*[f"id.{n}" for n in names], "_rows"))
    kept = docs.select(F.struct("*").alias("row"), *ids).join(keep.select(*names).hint("shuffle_hash"), names, "left_semi")
    if not keep.filter("_rows > 1").isEmpty():
        kept = kept.dropDuplicates(names)
    return kept.select("row.*")
