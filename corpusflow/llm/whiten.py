"""Whitening of vectors by the leading components of their covariance.

Counts and sums are exact integers. A second pass centres every vector, exactly, before it multiplies, and
adds outer products per task; Spark sums the cells. The matrix has the width of a vector, whatever the number
of rows: the driver reduces it to tridiagonal form by Householder reflections, bounds the leading eigenvalues
by bisection on Sturm counts, and finds their vectors by inverse iteration, with those of a cluster of close
eigenvalues kept orthogonal. The projection is broadcast; a third pass measures the covariance of the result."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import settle

SCALE, SHIFT = 64, 1_000_000
ROWS = 4096
_LONG = 1 << 63


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, subdiagonal and reflections u (I - 2uu') that bring a symmetric matrix to tridiagonal form."""
    a, n, turns = v.copy(), len(v), []
    for k in range(n - 2):
        u = a[k + 1:, k].copy()
        norm = np.linalg.norm(u)
        if norm == 0 or norm == abs(u[0]):
            turns.append(np.zeros(n - k - 1))
            continue
        u[0] += np.copysign(norm, u[0])
        u /= np.linalg.norm(u)
        rest = a[k + 1:, k + 1:]
        p = rest @ u
        w = 2 * (p - (u @ p) * u)
        a[k + 1:, k + 1:] = rest - np.outer(u, w) - np.outer(w, u)
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(norm, u[0])  # u[0] has the sign of the entry
        turns.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), turns


def sturm_counts(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each x: negative terms of the Sturm sequence."""
    tiny = np.finfo(float).tiny ** 0.5
    q = np.full(len(x), 1.0)
    below = np.zeros(len(x), np.int64)
    for k in range(len(d)):
        q = d[k] - x - (e[k - 1] ** 2 / q if k else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_values(d: np.ndarray, e: np.ndarray, m: int) -> np.ndarray:
    """The m largest eigenvalues, falling, each bisected until its interval has no number inside."""
    n = len(d)
    spread = np.concatenate((np.abs(e), [0])) + np.concatenate(([0], np.abs(e)))
    lo, hi = np.full(m, (d - spread).min()), np.full(m, (d + spread).max())
    pad = np.finfo(float).eps * max(abs(lo[0]), abs(hi[0])) * n + np.finfo(float).tiny
    lo, hi = lo - pad, hi + pad
    rank = n - 1 - np.arange(m)  # eigenvalues below the wanted one
    while True:
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            return mid
        low = sturm_counts(d, e, mid) <= rank
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)


def _solve(d: np.ndarray, e: np.ndarray, shift: float, floor: float):
    """A solver of (T - shift) x = y by elimination with row exchanges."""
    n = len(d)
    up, over, lower, swap = d - shift, np.zeros(n), np.zeros(n), np.zeros(n, bool)
    next_ = np.append(e, 0.0)
    for k in range(n - 1):
        below, diagonal, beyond = e[k], up[k + 1], e[k + 1] if k + 2 < n else 0.0
        if abs(below) > abs(up[k]):
            swap[k] = True
            ratio = up[k] / below
            up[k], next_[k], over[k], up[k + 1], next_[k + 1] = below, diagonal, beyond, next_[k] - ratio * diagonal, -ratio * beyond
        else:
            if abs(up[k]) < floor:
                up[k] = floor
            ratio = below / up[k]
            up[k + 1] = diagonal - ratio * next_[k]
        lower[k] = ratio
    up[n - 1] = up[n - 1] if abs(up[n - 1]) >= floor else floor

    def solve(y: np.ndarray) -> np.ndarray:
        x = y.copy()
        for k in range(n - 1):
            if swap[k]:
                x[k], x[k + 1] = x[k + 1], x[k] - lower[k] * x[k + 1]
            else:
                x[k + 1] -= lower[k] * x[k]
        for k in range(n - 1, -1, -1):
            if k + 1 < n:
                x[k] -= next_[k] * x[k + 1]
            if k + 2 < n:
                x[k] -= over[k] * x[k + 2]
            x[k] /= up[k]
            big = abs(x[k])
            if big > 1e150:
                x /= big
        return x

    return solve


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, one a row, of falling eigenvalues; those of a cluster are orthogonalised again."""
    n, norm = len(d), float(np.abs(d).max() + (2 * np.abs(e).max() if len(e) else 0))
    floor = max(np.finfo(float).eps * norm, np.finfo(float).tiny)
    rng, out, used, start = np.random.default_rng(0), np.zeros((len(values), n)), np.inf, 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            start = k
        used = value if not k or used - value > 10 * floor else used - 10 * floor  # equal shifts give equal vectors
        solve, x = _solve(d, e, used, floor), rng.standard_normal(n)
        for _ in range(6):
            x = solve(x)
            for _ in range(2):
                x /= np.linalg.norm(x)
                x -= out[start:k].T @ (out[start:k] @ x)
            x /= np.linalg.norm(x)
        out[k] = x
    return out


def leading_components(v: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m largest eigenvalues of a symmetric matrix, falling, and their unit vectors, one a row."""
    scale = float(np.abs(v).max()) or 1.0
    d, e, turns = tridiagonal(v / scale)
    values = leading_values(d, e, m)
    vectors = leading_vectors(d, e, values)
    for k in range(len(turns) - 1, -1, -1):
        u = turns[k]
        vectors[:, k + 1:] -= 2 * np.outer(vectors[:, k + 1:] @ u, u)
    return values * scale, vectors


def vectors_of(rows: DataFrame) -> DataFrame:
    """vec_id and ``x``, the entries as integers, of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    good = F.col("embedding").isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    wide = F.raise_error(F.lit("an entry of a vector is beyond the integers of 64 bits")).cast("long")
    x = F.transform(e, lambda c: F.when(F.abs(c) < 2.0 ** 56, F.floor(c * SCALE) + F.lit(SHIFT).cast("long")).otherwise(wide))
    return rows.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrix(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and integers of runs of rows of a batch."""
    for lo in range(0, batch.num_rows, ROWS):
        part = batch.column(1).slice(lo, ROWS)
        yield lo, part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _summed(rows: DataFrame, partial, cells: str) -> dict[tuple[int, int], float]:
    """Sums of the cells (i, j, value) that the tasks report; as many rows as the matrix has cells."""
    made = rows.mapInArrow(partial, cells).groupBy("i", "j").agg(F.sum("value").alias("value"))
    return {(r["i"], r["j"]): r["value"] for r in made.collect()}


def _report(cells: np.ndarray, first: int = 0) -> pa.RecordBatch:
    i, j = np.indices(cells.shape).reshape(2, -1)
    return pa.RecordBatch.from_arrays([pa.array((i + first).astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(cells.ravel())], names=["i", "j", "value"])


def whiten(rows: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every row that takes
    part and each of its leading components.

    Rows whose vector is null or empty or holds a null or non-finite entry take no part; nor do vectors of
    another length than most have (of equally frequent lengths the greater counts). Repeated rows and null ids
    are rows like others. A component along which the vectors don't vary, beyond rounding, has no scale and no
    rows: a single vector, or equal ones, give none. ``deviation`` is exact, a decimal. An entry, or n times the
    distance of one from its mean, beyond 64 bits is an error. Other columns are not read."""
    spark = rows.sparkSession
    held = settle(vectors_of(rows))
    lengths = [(r["count"], r["n"]) for r in held.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()]
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], schema)
    n, dims = lengths[0]
    held = held.filter(F.size("x") == dims)
    sums = held.select(F.posexplode("x").alias("j", "x")).groupBy("j").agg(
        F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    s = [0] * dims
    reach = 0
    for r in sums:
        s[r["j"]] = int(r["s"])
        reach = max(reach, abs(n * r["low"] - int(r["s"])), abs(n * r["high"] - int(r["s"])))
    if reach >= _LONG:
        raise OverflowError(f"{n} times the distance of an entry from its mean reaches {reach}, beyond 64 bits")
    narrow = dims * reach * reach < _LONG
    # n * x - S is exact even where n * x and S wrap, as the difference does not reach 64 bits
    total = np.array([x % (1 << 64) for x in s], np.uint64).view(np.int64)

    def covariance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((dims, dims))
        for batch in batches:
            for _, x in _matrix(batch, dims):
                z = (x * n - total) / n
                cells += z.T @ z
        yield _report(cells)

    found = _summed(held, covariance, "i int, j int, value double")
    v = np.array([[found[i, j] for j in range(dims)] for i in range(dims)]) / n
    v = (v + v.T) / 2
    values, vectors = leading_components(v, min(components, dims))
    m = int((values > max(dims, 64) * np.finfo(float).eps * max(values[0], 0.0)).sum())
    if not m:
        return spark.createDataFrame([], schema)
    explained = values[:m] / np.trace(v)
    project = spark.sparkContext.broadcast((vectors[:m] / np.sqrt(values[:m])[:, None]).T)  # dims x 32 at most

    def identity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per task: number and mean, and products centred on that mean; the parts combine exactly
        count, mean, cells = 0, np.zeros(m), np.zeros((m, m))
        for batch in batches:
            for _, x in _matrix(batch, dims):
                w = ((x * n - total) / n) @ project.value
                k, own = len(w), w.mean(axis=0)
                step, both = own - mean, count + k
                cells += (w - own).T @ (w - own) + np.outer(step, step) * (count * k / both)
                mean, count = mean + step * (k / both), both
        yield _report(np.vstack((cells + count * np.outer(mean, mean), count * mean)))

    found = _summed(held, identity, "i int, j int, value double")
    mean = np.array([found[m, j] for j in range(m)]) / n
    own = np.array([[found[i, j] for j in range(m)] for i in range(m)]) / n - np.outer(mean, mean)
    error = float(np.abs(own - np.eye(m)).max())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, x in _matrix(batch, dims):
                d = x * n - total
                w = (d / n) @ project.value
                square = (d * d).sum(axis=1) if narrow else [Decimal(y) for y in (d.astype(object) ** 2).sum(axis=1)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, len(d)), pa.array(square).cast(pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * m), pa.array(w.ravel()))], names=["vec_id", "deviation", "w"])

    rows = held.mapInArrow(out, "vec_id long, deviation decimal(38,0), w array<double>")
    shares = F.array(*[F.lit(float(x)) for x in explained])
    return rows.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
