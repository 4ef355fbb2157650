"""Building blocks that stay parallel when one key holds a large share of the rows.

* ``keep_first`` is an aggregation, so copies collapse on the map side.
* Ordered scans run over ``(key, chunk)``; ``chunk`` grows with the order column, and what
  has to cross a chunk border is carried by one summary row per chunk.
* ``take_first`` finds the border of a top-n from a histogram, so the rows that are
  certainly in or out are never ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import settle

CHUNK_ROWS = 50_000


def digest(*cols: Column | str) -> Column:
    """Unambiguous 256-bit key of several texts; each text is named once, so it is computed once."""
    parts = [F.sha2(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")), 256) for c in cols]
    key = parts[0] if len(parts) == 1 else F.sha2(F.concat(*parts), 256)
    # never null, so joins need no filter that computes it again
    return F.coalesce(F.unhex(key), F.lit(b""))


def keep_first(df: DataFrame, keys: list[Column], order: list[str], copies: str | None = None) -> DataFrame:
    """The first row of each key by ``order`` (unique); optionally with the group size."""
    aggs = [F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")]
    if copies:
        aggs.append(F.count(F.lit(1)).alias("_copies"))
    out = df.groupBy(digest(*keys).alias("_key")).agg(*aggs)
    extra = [F.col("_copies").alias(copies)] if copies else []
    return out.select("_row.*", *extra)


def chunk_of(order: Column | str, width: int = CHUNK_ROWS) -> Column:
    """Chunk number of a dense integer order."""
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(width)).cast("bigint")


def time_chunk(ts: Column | str, seconds: int = 86_400) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def _windows(keys: list[str], chunk: str, order: list[str]):
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(chunk)
    return inside, across


def with_neighbours(df: DataFrame, keys: list[str], order: list[str], cols: list[str], chunk: str,
                    previous: str | None = None, following: str | None = None) -> DataFrame:
    """Add the previous and/or following row of the key as a struct of ``cols``."""
    inside, across = _windows(keys, chunk, order)
    row = F.struct(*cols)
    at = F.struct(*order)
    aggs, carried = [], []
    if previous:
        aggs.append(F.max_by(row, at).alias("_last"))
        carried.append(F.lag("_last").over(across).alias("_carry_prev"))
    if following:
        aggs.append(F.min_by(row, at).alias("_first"))
        carried.append(F.lead("_first").over(across).alias("_carry_next"))
    edges = df.groupBy(*keys, chunk).agg(*aggs).select(*keys, chunk, *carried)
    out = df
    if previous:
        out = out.withColumn("_local_prev", F.lag(row).over(inside))
    if following:
        out = out.withColumn("_local_next", F.lead(row).over(inside))
    out = out.join(edges, [*keys, chunk], "left")
    if previous:
        out = out.withColumn(previous, F.coalesce("_local_prev", "_carry_prev"))
    if following:
        out = out.withColumn(following, F.coalesce("_local_next", "_carry_next"))
    return out.drop("_local_prev", "_local_next", "_carry_prev", "_carry_next")


def scan_features(df: DataFrame, keys: list[str], order: list[str], chunk: str,
                  sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
                  tails: dict[str, tuple[Column, int]] | None = None) -> DataFrame:
    """Running features of an ordered key in one pass.

    ``sums``: inclusive running sums; ``lasts``: latest non-NULL value so far; ``tails``: array of
    an expression over the k rows before. The last row of a chunk holds the chunk's totals, so the
    carried row comes from the same partitioning as the windows themselves."""
    sums, lasts, tails = sums or {}, lasts or {}, tails or {}
    inside, across = _windows(keys, chunk, order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    src = df.select(
        "*", *[v.cast("bigint").alias(f"_s_{n}") for n, v in sums.items()],
        *[v.alias(f"_l_{n}") for n, v in lasts.items()], *[v.alias(f"_t_{n}") for n, (v, _) in tails.items()])
    here = src.select(
        *df.columns,
        *[F.sum(f"_s_{n}").over(upto).alias(f"_s_{n}") for n in sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(upto).alias(f"_l_{n}") for n in lasts],
        *[F.col(f"_t_{n}") for n in tails],
        *[F.collect_list(f"_t_{n}").over(inside.rowsBetween(-k, -1)).alias(f"_b_{n}")
          for n, (_, k) in tails.items()],
    )
    made = [f"_s_{n}" for n in sums] + [f"_l_{n}" for n in lasts] + [f"_{x}_{n}" for n in tails for x in "tb"]
    ends = here.groupBy(*keys, chunk).agg(F.max_by(F.struct(*made), F.struct(*order)).alias("_e"))

    def tail_of(n: str, k: int) -> Column:
        told = F.concat(F.col(f"_e._b_{n}"), F.array(F.col(f"_e._t_{n}")))
        return F.slice(told, F.greatest(F.size(told) - k, F.lit(0)) + 1, F.lit(k))

    ends = ends.select(*keys, chunk, "_e", *[tail_of(n, k).alias(f"_k_{n}") for n, (_, k) in tails.items()]).select(
        *keys, chunk,
        *[F.sum(f"_e._s_{n}").over(before).alias(f"_cs_{n}") for n in sums],
        *[F.last(f"_e._l_{n}", ignorenulls=True).over(before).alias(f"_cl_{n}") for n in lasts],
        # every chunk holds a row, so k earlier chunks are enough
        *[F.flatten(F.collect_list(f"_k_{n}").over(across.rowsBetween(-k, -1))).alias(f"_ct_{n}")
          for n, (_, k) in tails.items()],
    )
    both = here.join(ends, [*keys, chunk], "left").withColumns({
        f"_j_{n}": F.concat(F.coalesce(F.col(f"_ct_{n}"), F.slice(F.col(f"_b_{n}"), 1, 0)), F.col(f"_b_{n}"))
        for n in tails}) if tails else here.join(ends, [*keys, chunk], "left")
    return both.select(
        *df.columns,
        *[(F.col(f"_s_{n}") + F.coalesce(F.col(f"_cs_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(f"_l_{n}", f"_cl_{n}").alias(n) for n in lasts],
        *[F.slice(f"_j_{n}", F.greatest(F.size(f"_j_{n}") - k, F.lit(0)) + 1, F.lit(k)).alias(n)
          for n, (_, k) in tails.items()],
    )


def running_last(df: DataFrame, keys: list[str], order: list[str], chunk: str, values: dict[str, Column]) -> DataFrame:
    """Latest non-NULL value of each expression so far."""
    return scan_features(df, keys, order, chunk, lasts=values)


def running_sum(df: DataFrame, keys: list[str], order: list[str], chunk: str, value: Column, name: str) -> DataFrame:
    """Inclusive running sum of an integer expression."""
    return scan_features(df, keys, order, chunk, sums={name: value})


def last_rows(df: DataFrame, keys: list[str], order: list[str], chunk: str, item: Column, k: int, name: str) -> DataFrame:
    """Array of ``item`` over the ``k`` rows before each row."""
    return scan_features(df, keys, order, chunk, tails={name: (item, k)})


# --- top-n -----------------------------------------------------------------
def hash_order(seed: int | str, key: Column) -> Column:
    """Sampling order that does not depend on partitions."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def hash_bucket(hashed: Column) -> Column:
    return F.conv(F.substring(hashed, 1, 4), 16, 10).cast("bigint")


def take_first(df: DataFrame, n: int | Column, order: list[Column], bucket: Column,
               group: list[str] = (), most: int | None = None) -> DataFrame:
    """First ``n`` rows per group by ``order``.

    ``bucket`` is a coarse version of the leading order column (smaller comes first, at most
    some 10^5 values). A histogram tells which bucket holds the n-th row; later buckets drop out
    during the scan, rows of earlier ones are in without a rank. Without a group and for an ``n`` beyond
    ``SMALL_BORDER`` the border bucket is split by ranges of the order until what is left to rank is small.
    With groups the border bucket is decided by rank; groups need an order whose buckets stay small, such as a
    hash or a position. ``n`` may be a column of ``df`` that is constant per group, ``most`` then is its upper
    bound."""
    group = list(group)
    size = F.lit(n) if isinstance(n, int) else n
    bound = n if isinstance(n, int) else most
    if bound is None and not group:
        raise ValueError("a column n without a group needs its upper bound ``most``")
    src = df.select("*", bucket.alias("_b"), size.cast("bigint").alias("_n"))
    hist = src.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_q"))
    # one row per bucket and group
    earlier = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cut = hist.withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).filter(
        F.col("_before") < F.col("_q"))
    if not group and bound <= SMALL_BORDER:
        last = cut.agg(F.max("_b").alias("_cut"))
        return src.filter(F.col("_b") <= last.scalar()).orderBy(*order).limit(bound).select(*df.columns)
    if not group:
        last = cut.agg(F.max("_b").alias("b"), F.max_by(F.least("_q", F.lit(bound)) - F.col("_before"), "_b").alias("need")).first()
        if last["b"] is None:
            return df.limit(0)
        sure, border = src.filter(F.col("_b") < last["b"]), src.filter(F.col("_b") == last["b"])
        return sure.select(*df.columns).unionByName(_first_of(border.select(*df.columns), order, last["need"]))
    cut = cut.groupBy(*group).agg(
        F.max("_b").alias("_cut"), F.max_by(F.col("_q") - F.col("_before"), "_b").alias("_need"))
    near = src.join(cut, group).filter(F.col("_b") <= F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order))
    out = near.withColumn("_r", rank)
    if bound is not None:
        out = out.filter(F.col("_r") <= bound)
    inside = (F.col("_b") < F.col("_cut")) | (F.col("_r") <= F.col("_need"))
    return out.filter(inside).select(*df.columns)


#: Rows that one task may order.
SMALL_BORDER = 100_000


def _first_of(df: DataFrame, order: list[Column], need: int, small: int | None = None) -> DataFrame:
    """First ``need`` rows: whole ranges of the order, and what is left out of one range, split again while large."""
    small = small or SMALL_BORDER
    parts, out = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), None
    while need > small:
        # the written copy fixes which row lies in which range
        dealt = settle(df.repartitionByRange(max(2, parts), *order).withColumn("_range", F.spark_partition_id()))
        seen, last = 0, None
        for r in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect():
            if seen + r["n"] > need:
                last = r["_range"]
                break
            seen += r["n"]
        inside = dealt.filter(F.col("_range") < last) if last is not None else dealt
        inside = inside.drop("_range")
        out = inside if out is None else out.unionByName(inside)
        if last is None or seen == need:
            return out
        border = dealt.filter(F.col("_range") == last).drop("_range")
        if not seen and last == 0 and dealt.filter("_range > 0").isEmpty():
            break  # ranges can't split it: rows that are equal in the order
        df, need = border, need - seen
    rest = df.orderBy(*order).limit(need)
    return rest if out is None else out.unionByName(rest)


def bounded_broadcast(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only after counting rows and bytes; else leave the join to Spark."""
    width = F.length(F.to_json(F.struct(*df.columns)))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df
