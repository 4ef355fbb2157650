"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is looked up in two hashed tables; filters of one, two and three words run over the text, each
keeps its largest response, and a logistic layer gives the score. The model is fitted on all labelled
documents outside the held-out fold, in shards: every shard takes an epoch from the same model, and the
models are averaged before the next. Its size is fixed. Thresholds are calibrated per language on labelled
documents that the fit did not see. Texts are trained on and scored whole, in pieces of bounded size."""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import chunks, mixed, prefix_sums, range_hash, word_bounds
from corpusflow.llm.imatch import _GAP, _LOWER
from corpusflow.session import settle

BUCKETS = 1 << 16
DIMS = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Labelled rows, and bytes of their texts, of a shard; more rows make more shards. One shard is fitted without averaging.
SHARD_DOCS = 10_000
SHARD_BYTES = 32 << 20
#: Labels up to which they go to the documents; of more, both sides are shuffled.
FEW_LABELS = 1_000_000
#: Words whose responses are held at once.
PIECE = 1 << 17


@dataclass
class Model:
    """Embedding tables, filters and logistic layer; thresholds by language, '' for all others."""

    tables: np.ndarray
    filters: np.ndarray  # one matrix per position of each width, side by side
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: float = 1.0
    thresholds: dict[str, float] = field(default_factory=lambda: {"": 0.5})


def word_slots(buf: np.ndarray, offsets: np.ndarray):
    """Text number and the two table rows of every word; words are runs of letters and digits, A-Z lowered."""
    starts, ends, doc = word_bounds(buf, offsets, _GAP)
    h = range_hash(prefix_sums(_LOWER[buf]), starts, ends)
    return doc, np.stack([h % np.uint64(BUCKETS), (h >> np.uint64(32)) % np.uint64(BUCKETS)]).astype(np.int32)


def _responses(m: Model, doc: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Words x filters; a filter that would reach into the next text sees nothing there."""
    x = m.tables[0][slots[0]] + m.tables[1][slots[1]]
    y = x @ m.filters
    parts, at = [], 0
    for width in WIDTHS:
        z = y[:, at:at + FILTERS].copy()
        at += FILTERS
        for step in range(1, width):
            more = y[step:, at:at + FILTERS]
            z[:-step] += np.where((doc[step:] == doc[:-step])[:, None], more, 0) if len(more) else 0
            at += FILTERS
        parts.append(z)
    return np.concatenate(parts, axis=1) + m.bias


def pooled(m: Model, doc: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
    """Largest response of every filter in each of n texts, at least 0."""
    out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
    for lo in range(0, len(doc), 1 << 16):  # two words more, for filters that start in this piece
        part = slice(lo, min(lo + (1 << 16) + max(WIDTHS) - 1, len(doc)))
        z = _responses(m, doc[part], slots[:, part])[:1 << 16]
        d = doc[lo:lo + (1 << 16)]
        cut = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        rows = d[cut]
        out[rows] = np.maximum(out[rows], np.maximum.reduceat(z, cut, axis=0))
    return out


def logits(m: Model, pool: np.ndarray) -> np.ndarray:
    return (pool @ m.out + m.shift) * m.scale


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fresh(rng: np.random.Generator) -> tuple[Model, list[np.ndarray]]:
    """A model before its first step, and the squared gradients so far of tables, filters, bias, out and shift."""
    n_filters = len(WIDTHS) * FILTERS
    m = Model(rng.normal(0, 0.1, (2, BUCKETS, DIMS)).astype(np.float32),
              rng.normal(0, 0.4, (DIMS, sum(WIDTHS) * FILTERS)).astype(np.float32),
              np.full(n_filters, -0.1, np.float32), np.abs(rng.normal(0, 0.3, n_filters)).astype(np.float32), -1.0)
    return m, [*(np.full(x.shape, 1e-6, np.float32) for x in (m.tables, m.filters, m.bias, m.out)), np.full(1, 1e-6)]


def _constant(m: Model, share: float) -> Model:
    """The model where all labels are alike, or there are none."""
    m.out[:] = 0
    m.shift = 30.0 if share == 1 else -30.0
    return m


def _epochs(n: int) -> int:
    return min(40, max(8, 60_000 // max(n, 1)))


def _peaks(m: Model, doc: np.ndarray, slots: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of every filter in each text, texts of any length, and the word where it starts."""
    n_filters = len(WIDTHS) * FILTERS
    best, where = np.full((len(edge) - 1, n_filters), -np.inf, np.float32), np.zeros((len(edge) - 1, n_filters), np.int64)
    for lo in range(0, len(doc), PIECE):  # as in pooled
        part = slice(lo, min(lo + PIECE + max(WIDTHS) - 1, len(doc)))
        z = _responses(m, doc[part], slots[:, part])[:PIECE]
        for k in range(doc[lo], doc[lo + len(z) - 1] + 1):
            a, b = max(edge[k] - lo, 0), min(edge[k + 1] - lo, len(z))
            at = z[a:b].argmax(axis=0)
            top = z[a + at, np.arange(n_filters)]
            more = top > best[k]
            best[k], where[k] = np.where(more, top, best[k]), np.where(more, lo + a + at, where[k])
    return best, where


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int | None = None, seed: int = 7, rate: float = 0.05) -> Model:
    """Train on texts given as 2 x words table rows; adaptive steps, rare class weighted up."""
    rng = np.random.default_rng(seed)
    m, acc = _fresh(rng)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return _constant(m, share)
    for _ in range(epochs or _epochs(len(texts))):
        _epoch(m, acc, texts, labels, share, rng, rate)
    return m


def _epoch(m: Model, acc: list[np.ndarray], texts: list[np.ndarray], labels: np.ndarray, share: float,
           rng: np.random.Generator, rate: float) -> None:
    """One pass over the texts; ``m`` and ``acc`` move. ``share`` of all labels is 1."""
    n_filters = len(WIDTHS) * FILTERS
    starts, at = [], 0
    for width in WIDTHS:
        starts.append(at)
        at += width * FILTERS

    def step(param, memory, grad):
        memory += grad * grad
        param -= rate * grad / np.sqrt(memory)

    order = rng.permutation(len(texts))
    for lo in range(0, len(order), 32):
        pick = [i for i in order[lo:lo + 32].tolist() if texts[i].shape[1]]
        if not pick:
            continue
        slots = np.concatenate([texts[i] for i in pick], axis=1)
        size = np.array([texts[i].shape[1] for i in pick])
        doc = np.repeat(np.arange(len(pick)), size)
        edge = np.concatenate(([0], np.cumsum(size)))
        top, where = _peaks(m, doc, slots, edge)
        pool = np.maximum(top, 0)
        keep = (rng.random(pool.shape) > 0.2).astype(np.float32) / 0.8  # so that no filter decides alone
        p = _sigmoid((pool * keep) @ m.out + m.shift)
        y = labels[pick]
        d = ((p - y) * np.where(y > 0, min(0.5 / share, 4.0), 1.0) / len(pick)).astype(np.float32)
        d_pool = d[:, None] * m.out[None, :] * keep * (pool > 0)
        g_out = (pool * keep).T @ d
        g_filters, g_tables_at, g_tables = np.zeros_like(m.filters), [], []
        for w, width in enumerate(WIDTHS):
            f = slice(w * FILTERS, (w + 1) * FILTERS)
            grad = d_pool[:, f]
            for off in range(width):
                pos = where[:, f] + off
                inside = pos < edge[1:, None]
                pos = np.minimum(pos, len(doc) - 1)
                g = np.where(inside, grad, 0)
                cols = np.arange(starts[w] + off * FILTERS, starts[w] + (off + 1) * FILTERS)
                x = m.tables[0][slots[0, pos]] + m.tables[1][slots[1, pos]]
                g_filters[:, cols] += np.einsum("bfd,bf->df", x, g)
                g_tables_at.append(pos.ravel())
                g_tables.append((g[:, :, None] * m.filters[:, cols].T[None]).reshape(-1, DIMS))
        at_, gt = np.concatenate(g_tables_at), np.concatenate(g_tables)
        some = np.abs(gt).sum(axis=1) > 0
        for t in range(2):
            rows, back = np.unique(slots[t, at_[some]], return_inverse=True)
            grad = np.zeros((len(rows), DIMS), np.float32)
            np.add.at(grad, back, gt[some])
            acc[0][t, rows] += grad * grad
            m.tables[t, rows] -= rate * grad / np.sqrt(acc[0][t, rows])
        step(m.filters, acc[1], g_filters + 1e-5 * m.filters)
        step(m.bias, acc[2], d_pool.sum(axis=0))
        step(m.out, acc[3], g_out + 1e-5 * m.out)
        acc[4][0] += float(d.sum()) ** 2
        m.shift -= rate * float(d.sum()) / float(acc[4][0])**0.5


def calibrate(m: Model, raw: np.ndarray, labels: np.ndarray, langs: list, least: int = 15) -> None:
    """Set the logistic scale, and per language the threshold with the best F1 in the middle of its gap; ``raw`` are
    the unscaled logits of documents.

    No threshold lies below the score of the highest hundredth of the clean documents. A language with
    fewer than ``least`` documents of either label takes the threshold of all; with fewer in all, the
    model stays as it was fitted."""
    def best(score: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-score, kind="stable")
        s, t = score[order], y[order]
        hits = np.cumsum(t)
        f1 = 2 * hits / (np.arange(1, len(t) + 1) + t.sum())
        f1[:-1][s[:-1] == s[1:]] = -1  # no threshold between equal scores
        k = int(np.argmax(f1))
        at = float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] - 0.5)
        return max(at, float(np.quantile(score[y == 0], 0.99)))

    if min(labels.sum(), (1 - labels).sum()) < least:
        return
    middle = best(raw, labels)
    m.shift -= middle
    raw = raw - middle
    m.scale = float(4 / max(np.median(np.abs(raw)), 1e-3))
    m.thresholds = {"": 0.5}
    known, code = np.unique(np.array([x or "" for x in langs]), return_inverse=True)
    for k, lang in enumerate(known.tolist()):
        own = code == k
        if lang and min(labels[own].sum(), (1 - labels[own]).sum()) >= least:
            m.thresholds[lang] = float(np.clip(_sigmoid(best(raw[own], labels[own]) * m.scale), 0.02, 0.98))


def _held_out(c) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(5)) == 0


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, list]]:
    """Number, texts as table rows, labels and languages of each shard."""
    for k in range(batch.num_rows):
        shard, sizes, toxic, langs, words = (batch.column(c)[k] for c in ("shard", "sizes", "toxic", "langs", "words"))
        cut = 2 * np.concatenate(([0], np.cumsum(np.frombuffer(sizes.as_buffer(), np.int64))))
        held = np.frombuffer(words.as_buffer(), np.uint16)
        texts = [held[a:b].reshape(2, -1) for a, b in zip(cut.tolist(), cut[1:].tolist())]
        yield shard.as_py(), texts, np.frombuffer(toxic.as_buffer(), np.int8).astype(np.float32), langs.as_py()


def _checked(n: int) -> np.ndarray:
    """The rows of a shard that are kept for calibration."""
    return np.arange(n) % 5 == 4


def _logits_of(m: Model, texts: list[np.ndarray]) -> np.ndarray:
    doc = np.repeat(np.arange(len(texts)), [t.shape[1] for t in texts])
    return pooled(m, doc, np.concatenate(texts, axis=1), len(texts)) @ m.out + m.shift


def _averaged(packs: DataFrame, m: Model, acc: list[np.ndarray], share: float, number: int, slices: int, seed: int, rate: float = 0.05) -> None:
    """Moves ``m`` and ``acc`` by the mean step of an epoch of every shard from here; a table row by the mean over the shards that
    moved it. Shards are summed up in the order of their numbers, table rows by slices."""
    shared = packs.sparkSession.sparkContext.broadcast((m, acc))
    dense = lambda m, acc: [m.filters, m.bias, m.out, np.array([m.shift]), *acc[1:]]
    flat = lambda parts: np.concatenate([x.ravel().astype(np.float64) for x in parts])
    table = lambda m, acc: np.concatenate([m.tables.reshape(-1, DIMS), acc[0].reshape(-1, DIMS)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m0, acc0 = shared.value
        base, base_flat = table(m0, acc0), flat(dense(m0, acc0))
        for batch in batches:
            for shard, texts, label, _ in _unpacked(batch):
                fit_ = np.flatnonzero(~_checked(len(texts)))
                m1, acc1 = copy.deepcopy((m0, acc0))
                _epoch(m1, acc1, [texts[i] for i in fit_], label[fit_], share, np.random.default_rng([seed, number, shard]), rate)
                step = table(m1, acc1) - base
                rows = np.flatnonzero((step[:, DIMS:] != 0).any(axis=1)).astype(np.int32)
                parts = [rows[rows % slices == k] for k in range(slices)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(-1, slices), pa.int32()), pa.array(np.full(slices + 1, shard), pa.int32()),
                     pa.array([b"", *(x.tobytes() for x in parts)], pa.binary()),
                     pa.array([(flat(dense(m1, acc1)) - base_flat).tobytes(), *(step[x].tobytes() for x in parts)], pa.binary())],
                    names=["slice", "shard", "rows", "step"])

    def mean(moved: pa.Table) -> pa.Table:
        moved = moved.sort_by("shard").combine_chunks()
        slice_ = moved.column("slice")[0].as_py()
        if slice_ < 0:
            steps = [np.frombuffer(x.as_buffer(), np.float64) for x in moved.column("step")]
            return pa.table({"slice": pa.array([slice_], pa.int32()), "rows": [b""], "step": [(sum(steps) / len(steps)).tobytes()]})
        total, count = np.zeros((2 * BUCKETS // slices + 1, 2 * DIMS)), np.zeros(2 * BUCKETS // slices + 1, np.int64)
        for rows, step in zip(moved.column("rows"), moved.column("step")):
            at = np.frombuffer(rows.as_buffer(), np.int32) // slices
            total[at] += np.frombuffer(step.as_buffer(), np.float32).reshape(-1, 2 * DIMS)
            count[at] += 1
        at = np.flatnonzero(count)
        return pa.table({"slice": pa.array([slice_], pa.int32()), "rows": [(at * slices + slice_).astype(np.int32).tobytes()],
                         "step": [(total[at] / count[at, None]).astype(np.float32).tobytes()]})

    moved = packs.mapInArrow(run, "slice int, shard int, rows binary, step binary")
    steps = moved.groupBy("slice").applyInArrow(mean, "slice int, rows binary, step binary").toArrow()
    for slice_, rows, step in zip(*(steps.column(c).to_pylist() for c in ("slice", "rows", "step"))):
        if slice_ < 0:
            parts = np.split(np.frombuffer(step, np.float64), np.cumsum([x.size for x in dense(m, acc)])[:-1])
            m.shift += float(parts.pop(3)[0])
            for x, part in zip((m.filters, m.bias, m.out, *acc[1:]), parts):
                x += part.reshape(x.shape).astype(x.dtype)
        else:
            rows, step = np.frombuffer(rows, np.int32), np.frombuffer(step, np.float32).reshape(-1, 2 * DIMS)
            m.tables.reshape(-1, DIMS)[rows] += step[:, :DIMS]
            acc[0].reshape(-1, DIMS)[rows] += step[:, DIMS:]
    shared.destroy()


def train(docs: DataFrame, labels: DataFrame, seed: int = 7) -> Model:
    """Fit and calibrate on all labelled rows outside the held-out fold.

    Rows of the fold crc32(doc_id) mod 5 = 0 and rows without a label are never read. Rows are dealt to shards of a
    bounded size by a hash; one row in five of a shard is kept for calibration. Up to the size of one shard the rows are
    fitted at once; more shards are trained side by side and averaged after every epoch. The number and content of the
    shards follow from the rows alone."""
    y = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out("doc_id"))
         .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in chunks(batch, "text", 1 << 20):
                doc, at = word_slots(buf, offsets)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                rows = [at[:, a:b].astype(np.uint16).tobytes() for a, b in zip(cut, cut[1:])]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(rows, pa.binary())],
                                                 names=["doc_id", "lang", "toxic", "words"])

    def pack(shard: pa.Table) -> pa.Table:
        rows = shard.select(["doc_id", "lang", "toxic", "words"]).to_pylist()
        rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["words"], r["lang"] or ""))
        toxic = np.array([r["toxic"] > 0 for r in rows], np.int8)
        fit_ = ~_checked(len(rows))
        return pa.table({
            "shard": pa.array([shard.column("shard")[0].as_py()], pa.int32()), "n": [int(fit_.sum())], "hits": [int(toxic[fit_].sum())],
            "sizes": [np.array([len(r["words"]) // 4 for r in rows], np.int64).tobytes()], "toxic": [toxic.tobytes()],
            "langs": pa.array([[r["lang"] for r in rows]], pa.list_(pa.string())), "words": [b"".join(r["words"] for r in rows)]})

    y = F.broadcast(y) if y.limit(FEW_LABELS + 1).count() <= FEW_LABELS else y
    key = F.col("doc_id").cast("long").alias("doc_id")
    n, size = docs.select(key, F.octet_length("text").alias("size")).join(y, "doc_id").agg(F.count(F.lit(1)), F.sum("size")).first()
    picked = docs.select(key, lang.alias("lang"), "text").join(y, "doc_id")
    shards = max(-(-n // SHARD_DOCS), -(-(size or 0) // SHARD_BYTES), 1)
    words = picked.select("doc_id", "lang", "toxic", "text").mapInArrow(slots, "doc_id long, lang string, toxic int, words binary")
    packs = (words.withColumn("shard", F.pmod(F.xxhash64("doc_id", "words", F.lit(seed)), F.lit(shards)).cast("int")).groupBy("shard")
             .applyInArrow(pack, "shard int, n long, hits long, sizes binary, toxic binary, langs array<string>, words binary"))
    if shards == 1:
        held = (x for batch in packs.toArrow().to_batches() for x in _unpacked(batch))
        _, texts, every, of = next(held, (0, [], np.zeros(0, np.float32), []))
        check = _checked(len(texts))
        m = fit([t for t, c in zip(texts, check) if not c], every[~check], seed=seed)
        some = np.flatnonzero(check).tolist()
        raw, label, langs = _logits_of(m, [texts[i] for i in some]) if some else [], every[some], [of[i] for i in some]
    else:
        packs = settle(packs)
        rows, hits = packs.agg(F.sum("n"), F.sum("hits")).first()
        m, acc = _fresh(np.random.default_rng(seed))
        share = hits / max(rows, 1)
        if not 0 < share < 1:
            m = _constant(m, share)
        else:
            for number in range(_epochs(rows // shards)):
                _averaged(packs, m, acc, share, number, max(16, shards), seed)
        raw, label, langs = _judged(packs, m)
    if len(raw):
        calibrate(m, raw, label, langs)
    return m


def _judged(packs: DataFrame, m: Model) -> tuple[np.ndarray, np.ndarray, list]:
    """Logit, label and language of the rows kept for calibration."""
    shared = packs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts, label, langs in _unpacked(batch):
                some = np.flatnonzero(_checked(len(texts))).tolist()
                if some:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_logits_of(shared.value, [texts[i] for i in some]).astype(np.float32)), pa.array(label[some]),
                         pa.array([langs[i] for i in some], pa.string())], names=["raw", "label", "lang"])

    t = packs.mapInArrow(run, "raw float, label float, lang string").toArrow()
    return t.column("raw").to_numpy(), t.column("label").to_numpy(), t.column("lang").to_pylist()


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("toxic_score", "toxic_reject")) -> DataFrame:
    """All columns of ``docs``, and under ``names`` a score (0 to 1) and whether it is at the threshold of the
    row's language or above. Null and empty texts are scored like a text without words. ``names`` must not be
    columns of ``docs``."""
    if set(names) & set(docs.columns):
        raise ValueError(f"columns {names} are taken; pass other names")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields]).add(names[0], "double").add(names[1], "boolean")
    at = docs.columns.index("text")
    lang_at = docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            made = np.zeros(batch.num_rows)
            alone = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            for lo, hi, buf, offsets in chunks(alone, "text", 1 << 20):
                doc, slots = word_slots(buf, offsets)
                made[lo:hi] = _sigmoid(logits(m, pooled(m, doc, slots, hi - lo)))
            bar = np.full(batch.num_rows, m.thresholds[""])
            if lang_at is not None:
                bar = np.array([m.thresholds.get(x, m.thresholds[""]) for x in batch.column(lang_at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made), pa.array(made >= bar)], names=schema.names)

    return docs.mapInArrow(run, schema)
