"""Exact inner-product top-k by a vector-approximation file.

Components are integers, floor(256 x). The file holds for every vector the number of the cell of each
component, so the inner product with a query lies between two sums of cell ends. Queries and vectors are
dealt in blocks. A first scan reads cells only: the k-th best lower bound of a block is a score that k
vectors reach, and the largest of these over all blocks is the query's bar. The second scan drops what
cannot reach the bar and reads exact vectors in the order of their upper bounds, until the k-th result of
the block is above the next bound. The k best of every block make the result."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import settle

CELLS = 16
BLOCK = 16384
QUERY_BLOCK = 2048


def integer_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and the integer vector ``v`` of the rows whose components are all finite numbers.

    Null and empty-handed rows go: a null vec_id, a null vector, a null, NaN or infinite component."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v")))


def _matrix(table: pa.Table, name: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), np.int64).reshape(-1, dims)


def build(vectors: DataFrame, cells: int = CELLS, block: int = BLOCK) -> tuple[DataFrame, int, int, int, int]:
    """The file (vec_id, block, cell, exact), and lowest component, cell width, dimensions, blocks."""
    v = settle(integer_vectors(vectors))
    n, low, high, dims = v.agg(F.count("*"), F.min(F.array_min("v")), F.max(F.array_max("v")), F.max(F.size("v"))).first()
    low, high, dims = low or 0, high or 0, max(dims or 0, 1)
    width = max(1, math.ceil((high - low + 1) / cells))
    blocks = max(1, math.ceil(n / block))

    def code(batches):
        for batch in batches:
            col = batch.column(1)
            size = np.diff(np.asarray(col.offsets))
            exact = np.zeros((len(col), dims), np.int64)  # shorter vectors end in zeros
            exact[np.arange(dims)[None, :] < size[:, None]] = col.flatten().to_numpy()
            cell = (np.clip(exact, low, high) - low) // width
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() for x in cell.astype(np.uint8)], pa.binary()),
                 pa.array([x.tobytes() for x in exact], pa.binary())], names=["vec_id", "cell", "exact"])

    made = v.mapInArrow(code, "vec_id long, cell binary, exact binary")
    return settle(made.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))), low, width, dims, blocks


def _bounds(q: np.ndarray, cell: np.ndarray, low: int, width: int):
    """Lower and upper bound of every inner product; sums of integers, exact in doubles below 2^53."""
    a = (low + cell.astype(np.float64) * width)
    b = a + (width - 1)
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    return up @ a.T + down @ b.T, up @ b.T + down @ a.T


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; a query's own id is no candidate. Fewer
    candidates give fewer rows, an empty table none. Vectors of unequal length are compared as if the
    shorter ended in zeros. A query id that repeats is asked once, with its smallest vector; other rows
    that share a vec_id are candidates of their own."""
    file, low, width, dims, blocks = build(vectors, block=block)
    asked = file.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("exact").alias("q"))
    asked = settle(asked.withColumnRenamed("vec_id", "query_id"))
    n_asked = asked.count()
    q_blocks = max(1, math.ceil(n_asked / query_block))
    asked = asked.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)))

    def numbered(df: DataFrame, name: str, n: int) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

    def dealt(queries: DataFrame, columns: list[str]):
        left = numbered(file.select("block", *columns), "q_block", q_blocks).groupBy("block", "q_block")
        return left.cogroup(numbered(queries, "block", blocks).groupBy("block", "q_block"))

    def parts(vectors_: pa.Table, queries: pa.Table):
        ids = vectors_.column("vec_id").to_numpy()
        cell = np.frombuffer(b"".join(x.as_py() for x in vectors_.column("cell")), np.uint8).reshape(-1, dims)
        asked_ids, q = queries.column("query_id").to_numpy(), _matrix(queries, "q", dims)
        step = max(1, (2 << 20) // max(len(ids), 1))
        for s in range(0, len(asked_ids), step):
            yield ids, asked_ids[s:s + step], q[s:s + step], cell, s

    def bars(vectors_: pa.Table, queries: pa.Table) -> pa.Table:
        out_id, out_bar = [], []
        if len(vectors_) and len(queries):
            for ids, own, q, cell, _ in parts(vectors_, queries):
                lower = _bounds(q, cell, low, width)[0]
                lower[own[:, None] == ids[None, :]] = -np.inf
                if lower.shape[1] >= k:
                    kth = np.partition(lower, lower.shape[1] - k, axis=1)[:, -k]
                    real = np.isfinite(kth)
                    out_id.append(own[real])
                    out_bar.append(kth[real].astype(np.int64))
        none = np.zeros(0, np.int64)
        return pa.table({"query_id": np.concatenate([*out_id, none]), "bar": np.concatenate([*out_bar, none])})

    def best(vectors_: pa.Table, queries: pa.Table) -> pa.Table:
        found = [np.zeros((0, 3), np.int64)]
        if len(vectors_) and len(queries):
            exact = _matrix(vectors_, "exact", dims)
            limit = queries.column("bar").fill_null(-(1 << 62)).to_numpy()
            for ids, own, q, cell, s in parts(vectors_, queries):
                upper = _bounds(q, cell, low, width)[1]
                for r in range(len(own)):
                    may = np.flatnonzero((upper[r] >= limit[s + r]) & (ids != own[r]))
                    may = may[np.lexsort((ids[may], -upper[r][may]))]
                    top: list[tuple[int, int]] = []
                    at, size = 0, 64
                    while at < len(may):
                        if len(top) == k and upper[r][may[at]] < -top[-1][0]:
                            break
                        some = may[at:at + size]
                        score = exact[some] @ q[r]
                        if len(top) == k:
                            keep = score >= -top[-1][0]
                            some, score = some[keep], score[keep]
                        first = np.lexsort((ids[some], -score))[:k]
                        top = sorted(top + [(-int(score[i]), int(ids[some[i]])) for i in first])[:k]
                        at, size = at + size, min(size * 2, 8192)
                    if top:
                        found.append(np.array([(own[r], i, -m) for m, i in top], np.int64))
        rows = np.concatenate(found)
        return pa.table({"query_id": rows[:, 0], "vec_id": rows[:, 1], "score": rows[:, 2]})

    bar = (dealt(asked, ["vec_id", "cell"]).applyInArrow(bars, "query_id long, bar long")
           .groupBy("query_id").agg(F.max("bar").alias("bar")))
    with_bar = settle(asked.join(bar, "query_id", "left"))
    each = dealt(with_bar, ["vec_id", "cell", "exact"]).applyInArrow(best, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
