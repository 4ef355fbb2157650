"""Samples, quotas, splits and heads; every choice is a function of the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.scan import hash_bucket, hash_order, take_first
from corpusflow.session import settle

DEFAULT_RATIOS = {"core": 0.40, "ml_deep": 0.20, "signature": 0.20, "agent": 0.10, "memory": 0.10}


def seeded_sample(df: DataFrame, n: int | Column, seed: int, key: Column, group: list[str] = (),
                  most: int | None = None) -> DataFrame:
    """At most ``n`` rows (per group), chosen by the md5 of seed and key."""
    h = hash_order(seed, key)
    return take_first(df, n, [h, key], hash_bucket(h), group, most)


def quota_plan(total: int, ratios: dict[str, float]) -> dict[str, int]:
    """Rows per group: the ratios are normalised, the rounding rest goes out in group order."""
    shares = {k: max(0.0, r) for k, r in ratios.items()}
    if sum(shares.values()) <= 0.0:
        shares = dict(DEFAULT_RATIOS)
    whole = sum(shares.values())
    plan = {k: int(total * (r / whole)) for k, r in shares.items()}
    rest = total - sum(plan.values())
    for k in list(plan)[:max(0, rest)]:
        plan[k] += 1
    return plan


def ratio_quota(df: DataFrame, total: int, ratios: dict[str, float], seed: int, key: Column,
                group: str = "group") -> DataFrame:
    """Sample each group down to its quota; unknown groups get none."""
    plan = quota_plan(total, ratios)
    quota = F.create_map(*[x for k, n in plan.items() for x in (F.lit(k), F.lit(n))])
    marked = df.withColumn("_quota", F.coalesce(F.try_element_at(quota, F.col(group)), F.lit(0)))
    picked = seeded_sample(marked.filter("_quota > 0"), F.col("_quota"), seed, key, [group], total)
    return picked.drop("_quota")


def select_best(convs: DataFrame, n: int, min_score: float, conv: str = "conv_id") -> DataFrame:
    """Best filtered conversations: score and end time descending."""
    good = convs.filter((F.col("status") == "filtered") & (F.col("quality_score") >= min_score))
    order = [F.col("quality_score").desc(), F.col("ended_at").desc(), F.col(conv)]
    bucket = -F.floor(F.col("quality_score") * 10_000)
    return take_first(good, n, order, bucket).select(conv)


def core_tail_select(scored: DataFrame, n: int, seed: int, key: Column, score: str = "score") -> DataFrame:
    """80 % of ``n`` from the best rows (twice that many compete), the rest from the tail.

    Scores are compared at six decimals; ties are ordered by the sampling hash."""
    scored = settle(scored)
    total = scored.count()
    target = min(n, total)
    core = int(target * 0.8)
    rounded = F.round(F.col(score), 6)
    h = hash_order(seed, key)
    src = scored.withColumn("_key", key).withColumn("_s", rounded)
    order = [F.col("_s").desc(), h, F.col("_key")]
    best = settle(take_first(src, core * 2, order, -F.floor(F.col("_s") * 1000)))
    pool = best.select("_key")
    tail = src.join(pool, "_key", "left_anti")
    picked = seeded_sample(best, core, seed, F.col("_key")).unionByName(
        seeded_sample(tail, target - core, seed, F.col("_key"))
    )
    return picked.drop("_key", "_s")


def head_per_file(df: DataFrame, n: int, group: list[str], order: str = "row_idx") -> DataFrame:
    """First ``n`` rows of each source by a non-negative integer position.

    Positions are counted in steps of their logarithm: some 16,000 at most, whatever the length of a source, and
    the one that holds the border spans a few thousandths of the rows before it."""
    bucket = F.floor(F.log2(F.col(order) + F.lit(1.0)) * 256)
    return take_first(df, n, [F.col(order)], bucket, group)


def recent_n(df: DataFrame, n: int, ts: str, tie: str, parsed: Column | None = None,
             most: int | None = None) -> DataFrame:
    """Last ``n`` log rows, at least 1 and at most ``most``; unreadable ones are dropped after the cut."""
    n = max(1, n if most is None else min(n, most))
    tail = df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)
    return tail if parsed is None else tail.filter(parsed.isNotNull())


def split_share(seed: int, key: Column) -> Column:
    """Position of a row in [0, 1) that only depends on seed and key."""
    return F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("bigint") / F.lit(2.0 ** 32)


def hash_split(df: DataFrame, ratio: float, seed: int, key: Column, max_train: int | None = None,
               max_eval: int | None = None) -> tuple[DataFrame, DataFrame]:
    held_out = split_share(seed, key) < ratio
    train, evaluation = df.filter(~held_out), df.filter(held_out)
    if max_train is not None:
        train = seeded_sample(train, max_train, seed, key)
    if max_eval is not None:
        evaluation = seeded_sample(evaluation, max_eval, seed, key)
    return train, evaluation
