"""Mixing sources to target weights by pivotal dependent rounding.

A document is expected ``target / size of its source`` times. The whole part of that is certain; the
fractions of a source are settled in pairs: words move at random from one document of a pair to the
other until one of them is taken whole or not at all, so the expected words of the source never change
and every document keeps its probability. What a bucket leaves over, one fraction at most, meets the
leftovers of other buckets in a tree of fixed fan-in; only the last one of a source is rounded alone."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import word_count
from corpusflow.session import settle

BUCKET_ROWS = 4096
FAN_IN = 64


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Target words of every source: source, source_size, n_docs, target.

    Sources by code point, null last, take the weights in turn. A target stops at ``most`` times the
    size of its source, and the excess goes to the others by weight: with the sources in the order of
    size per weight, the capped ones are a prefix, found by running sums over one row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    named = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    s = by_source.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(most))
    order = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    s = s.select("*", F.sum("source_size").over(everything).alias("_total"), F.sum("_w").over(everything).alias("_weight"),
                 F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_caps"),
                 F.coalesce(F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_ws"))
    # the level that the sources from here on would share if all before were capped
    s = s.withColumn("_level", (F.col("_total") - F.col("_caps")) / (F.col("_weight") - F.col("_ws")))
    s = s.withColumn("_free", F.col("_level") * F.col("_w") <= F.col("_cap"))
    level = F.min(F.when(F.col("_free"), F.struct((F.col("_cap") / F.col("_w")).alias("at"), "_level"))).over(everything)["_level"]
    # none is free only where a cap below one size leaves words over; then all stand at their caps
    target = F.least("_cap", F.coalesce(level * F.col("_w"), F.col("_cap")))
    return s.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _draw(seed: int, *names: int) -> float:
    """A number in [0, 1) that depends on the seed and the pair only."""
    data = ",".join(map(str, (seed, *names))).encode()
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big") / 2**64


def settle_fractions(key: np.ndarray, size: np.ndarray, part: np.ndarray, seed: int):
    """Pairwise rounding of the fractions ``part`` with the words ``size`` conserved.

    Returns the taken extra copies (0 or 1), and the place and fraction of the one left over (-1: none)."""
    taken = np.zeros(len(part), np.int64)
    order = np.lexsort((key, -size))
    held, p = -1, 0.0
    for i in order.tolist():
        q, s = float(part[i]), int(size[i])
        if q <= 0.0 or s == 0:
            continue
        if held < 0:
            held, p = i, q
            continue
        a, b = p * size[held], q * s                      # words each is expected to give
        up, down = min(size[held] - a, b), min(a, s - b)  # words that may move to the held one, or away
        if _draw(seed, int(key[held]), int(key[i])) * (up + down) < down:
            a, b, moved_all = a + up, b - up, up == b
            one_full, other_left = not moved_all, moved_all
            if moved_all:                                  # i gives everything: 0 copies
                p = a / size[held]
            else:                                          # the held one is full
                taken[held], held, p = 1, i, b / s
        else:
            a, b = a - down, b + down
            if down == s - (b - down):                     # i is full
                taken[i] = 1
                p = a / size[held]
            else:                                          # the held one is empty
                held, p = i, b / s
        if p <= 1e-12 or p >= 1 - 1e-12:
            taken[held] = int(p > 0.5)
            held, p = -1, 0.0
    return taken, held, p


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 17,
        bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Copies of every document in the mix: doc_id, source, size, source_size, target, copies, taken.

    Null texts and texts without words have size 0 and are taken 0 times (``copies`` is the whole part).
    Rows that share a doc_id are mixed each by itself; a null doc_id and a null source are values like
    others. The same rows and seed give the same mix on any partitioning. The buckets of a source
    follow from its number of rows, so a source of any share of the table is spread over many tasks."""
    sizes = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size"),
                               F.xxhash64(F.col("doc_id").cast("long"), "source", "text").alias("_key")))
    targets = settle(source_targets(sizes, weights, most))
    rows = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"]), "left").drop(targets["source"])
    per_doc = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a ratio within rounding error of a whole number is that number
    per_doc = F.when(F.abs(per_doc - F.round(per_doc)) < 1e-9, F.round(per_doc)).otherwise(per_doc)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / bucket_rows)).cast("long")
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "_key",
                       F.floor(per_doc).cast("long").alias("_whole"), (per_doc - F.floor(per_doc)).alias("_part"),
                       F.pmod(F.xxhash64("_key", F.lit(seed)), buckets).alias("_bucket"))

    def level(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["_key", "doc_id"], kind="stable").reset_index(drop=True)
        taken, held, p = settle_fractions(df["_key"].to_numpy(), df["size"].to_numpy(), df["_part"].to_numpy(), seed)
        df["_taken"], df["_part"] = taken, 0.0
        if held >= 0:
            df.loc[held, "_part"] = p
        df["doc_id"] = df["doc_id"].astype("Int64")
        return df

    schema = ("doc_id long, source string, size long, source_size long, target double, _key long, "
              "_whole long, _part double, _bucket long, _taken long")
    made = settle(rows.groupBy("source", "_bucket").applyInPandas(level, schema))
    done, left = [made.filter("_part = 0")], made.filter("_part > 0").drop("_taken")
    n = targets.agg(F.max("n_docs")).first()[0] or 0
    width = max(1, math.ceil(n / bucket_rows))
    while width > 1:
        width = math.ceil(width / FAN_IN)
        step = settle(left.withColumn("_bucket", F.pmod("_bucket", F.lit(width)))
                      .groupBy("source", "_bucket").applyInPandas(level, schema))
        done.append(step.filter("_part = 0"))
        left = step.filter("_part > 0").drop("_taken")
    # the one fraction that a source has left goes to the nearer side, as its words are all that is off the target
    done.append(left.withColumn("_taken", (F.col("_part") >= 0.5).cast("long")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.when(F.col("size") > 0, F.col("_whole") + F.col("_taken")).otherwise(F.col("_whole"))
    return out.select("doc_id", "source", "size", "source_size", "target", "_key", copies.alias("copies"),
                      (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it; all columns stay, whatever their names.

    Equal rows are drawn each by itself and repeat by the sum of their copies."""
    taken = settle(mix(docs, weights, most, seed).groupBy("_key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), "source", "text").alias("_key"))
    if not taken.filter("_rows > 1").isEmpty():
        rows = rows.dropDuplicates(["_key"])
    kept = rows.join(taken.filter("_copies > 0").select("_key", "_copies").hint("shuffle_hash"), "_key")
    return kept.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("row.*")
