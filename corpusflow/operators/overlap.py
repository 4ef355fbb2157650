"""Train/test overlap: exact and token-set similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.labels import any_hint
from corpusflow.functions.text import norm_soft, strip
from corpusflow.functions import lexicons as lx
from corpusflow.operators.scan import digest
from corpusflow.session import settle


#: Prompts whose keys, 32 bytes each, go to every task.
FEW_PROMPTS = 200_000


def exact_overlap(prompts: DataFrame, train: DataFrame, prompt: str = "prompt", text: str = "text") -> DataFrame:
    """Prompts whose normalised form occurs in the training texts."""
    known = train.filter(strip(text) != "").select(digest(norm_soft(text)).alias("_k"))
    asked = prompts.withColumn("_k", digest(norm_soft(prompt)))
    if prompts.limit(FEW_PROMPTS + 1).count() <= FEW_PROMPTS:
        known = known.join(F.broadcast(asked.select("_k").distinct()), "_k", "left_semi")
    return asked.join(known.distinct(), "_k", "left_semi").drop("_k")


def token_set(c: Column | str) -> Column:
    return F.sort_array(F.array_distinct(F.array_remove(F.split(norm_soft(c), " "), "")))


#: Tokens whose number of texts sets the order of an index, rare ones first; any set of them is right.
COUNTED = 500_000
#: Turns in which the index is joined, each with a part of the tokens, and sets are fetched: a shuffle takes a part of the
#: disk. Prompts of fewer than FETCHED tokens a turn take fewer turns.
TURNS, FETCHED = 4, 1_000_000


def _counted(sets: DataFrame, tokens: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent tokens and the number of sets that hold each, by hash."""
    often = sets.select(F.explode(tokens).alias("token")).groupBy(F.xxhash64("token").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    t = often.filter("n > 1").orderBy(F.desc("n"), "h").limit(COUNTED).toArrow()
    h, n = t.column("h").to_numpy(), t.column("n").to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


def _prefixes(sets: DataFrame, key: str, tokens: str, counted: tuple[np.ndarray, np.ndarray], threshold: float, turn: int, turns: int) -> DataFrame:
    """(key, size, h, s0, s1): the hashes of the first tokens of every set, in one order of all tokens, of which sets
    that are similar enough share one; of them those of a turn. ``size`` has the size of the set and the place.

    s0 and s1 are the parities of the numbers of tokens that fall on each of 128 places: a token that only one of
    two sets holds turns one of them."""
    known, count = counted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            h, n = held.flatten().to_numpy(), held.value_lengths().to_numpy()
            if not len(h):
                continue
            first = np.cumsum(n) - n
            of = np.repeat(np.arange(len(n)), n)
            place = h.view(np.uint64)
            bit = np.uint64(1) << (place & np.uint64(63))
            side = (place & np.uint64(64)) > 0
            parity = [np.bitwise_xor.reduceat(np.where(side == k, bit, np.uint64(0)), first).view(np.int64) for k in (False, True)]
            rank = np.zeros(len(h), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rank = np.where(known[at] == h, count[at], 0)
            h = h[np.lexsort((h, rank, of))]
            pos = np.arange(len(h)) - first[of]
            take = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
            keep = (pos < take[of]) & ((h.view(np.uint64) >> np.uint64(32)) % np.uint64(turns) == turn)
            of = of[keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), pa.array(n[of].astype(np.int64) << 32 | pos[keep]), pa.array(h[keep]),
                 *(pa.array(x[of]) for x in parity)], names=[key, "size", "h", "s0", "s1"])

    hashed = sets.filter(F.size(tokens) > 0).select(key, F.transform(tokens, lambda x: F.xxhash64(x)).alias("held"))
    return hashed.mapInArrow(run, f"{key} long, size long, h long, s0 long, s1 long")


def jaccard_overlap(prompts: DataFrame, train: DataFrame, threshold: float = 0.70,
                    prompt_id: str = "prompt_id", prompt: str = "prompt", text: str = "text") -> DataFrame:
    """Prompts for which some training text has a token-set Jaccard of at least ``threshold``.

    Equal sets are one entry on both sides, and a prompt whose set is there is done. Of the others, both sides are
    indexed by their first tokens in one order, rare ones first; sizes, places of a common token and parities of the
    tokens rule most pairs out. Of each prompt the pair with the nearest parities is compared first, the others
    only if it is not similar enough. Pairs are row numbers until each fetches its two sets. The index is joined, and sets
    are fetched, in turns that bound the disk. An empty prompt matches an empty text."""
    # sets are shuffled as one string, which is smaller than an array
    joined = lambda c: F.array_join(token_set(c), " ")
    split = lambda c: F.array_remove(F.split(c, " "), "")
    sets = train.filter(strip(text) != "").select(joined(text).alias("t"))
    sets = settle(sets.groupBy(digest("t").alias("key")).agg(F.first("t").alias("t"))
                  .select("key", split("t").alias("t"), F.monotonically_increasing_id().alias("sid")))
    asked = prompts.select(prompt_id, joined(prompt).alias("p")).withColumn("key", digest("p"))
    wanted = asked.groupBy("key").agg(F.first("p").alias("p"))
    left = settle(wanted.join(sets.select("key"), "key", "left_anti")
                  .select("key", split("p").alias("p"), F.monotonically_increasing_id().alias("pid")))
    counted = _counted(sets, "t")
    every = int(left.agg(F.coalesce(F.sum(F.size("p")), F.lit(0))).first()[0])
    turns = min(TURNS, 1 + every // FETCHED)

    def near(left: DataFrame, turn: int) -> DataFrame:
        """(pid, sid, n, far): pairs that the index leaves, some more than once."""
        x = _prefixes(left, "pid", "p", counted, threshold, turn, turns).alias("x")
        y = _prefixes(sets, "sid", "t", counted, threshold, turn, turns).alias("y")
        size = lambda c: F.shiftright(c, 32)
        place = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
        a, b = size("x.size"), size("y.size")
        reach = F.least(a - place("x.size"), b - place("y.size"))  # tokens that both may still share
        far = F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))) + F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1")))  # tokens that one side has, at least
        fits = ((b >= a * F.lit(threshold) - 1e-9) & (a >= b * F.lit(threshold) - 1e-9) & (reach * F.lit(1 + threshold) >= (a + b) * F.lit(threshold) - 1e-9)
                & (far * F.lit(1 + threshold) <= (a + b) * F.lit(1 - threshold) + 1e-9))
        return x.join(y, F.col("x.h") == F.col("y.h")).filter(fits).select("pid", "sid", a.alias("n"), (far / (a + b)).alias("far"))

    inter = F.size(F.array_intersect(split("p"), split("t")))
    alike = inter / (F.size(split("p")) + F.size(split("t")) - inter) >= threshold

    def union(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    def part(c: str, k: int, of: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(of)) == k

    def similar(pairs: DataFrame, p: DataFrame, t: DataFrame) -> DataFrame:
        """The pids of the pairs that are similar enough."""
        return settle(pairs.join(p, "pid").join(t, "sid").filter(alike).select("pid").distinct())

    p, t = left.select("pid", F.array_join("p", " ").alias("p")), sets.select("sid", F.array_join("t", " ").alias("t"))
    nearest = F.min(F.struct("far", "sid")).alias("best")
    best = union([settle(near(left, k).groupBy("pid").agg(nearest).select("pid", "best.*")) for k in range(turns)])
    first = settle(best.groupBy("pid").agg(nearest).select("pid", "best.sid"))
    # first the prompts' sets are fetched, by parts of the prompts, then those of the texts, by parts of the texts
    held = union([settle(first.filter(part("pid", k, turns)).join(p.filter(part("pid", k, turns)), "pid")) for k in range(turns)])
    hits = union([settle(held.filter(part("sid", k, turns)).join(t.filter(part("sid", k, turns)), "sid").filter(alike).select("pid").distinct())
                  for k in range(turns)])
    # the others that have a pair at all have all of theirs compared
    ids = settle(first.select("pid").join(hits, "pid", "left_anti"))
    if not ids.isEmpty():
        open_ = union([settle(left.select("pid", "p").filter(part("pid", k, turns)).join(ids.filter(part("pid", k, turns)), "pid", "left_semi")) for k in range(turns)])
        rest = union([settle(near(open_, k).groupBy("pid", "sid").agg(F.first("n").alias("n"))) for k in range(turns)])
        if rest.limit(FEW_PROMPTS + 1).count() <= FEW_PROMPTS:
            only = lambda x, c: x.join(F.broadcast(rest.select(c).distinct()), c, "left_semi")
            hits = hits.unionByName(similar(rest, only(p, "pid"), only(t, "sid")))
        else:
            more = 1 + int(rest.agg(F.sum("n")).first()[0]) // max(every // TURNS, FETCHED)
            hits = hits.unionByName(union([similar(rest.filter(part("pid", k, more)), p, t) for k in range(more)]))
    missed = left.join(hits, "pid", "left_anti").select("key")
    return asked.select(prompt_id, "key").join(missed, "key", "left_anti").select(prompt_id)


def contamination_report(prompts: DataFrame, train: DataFrame, threshold: float = 0.70,
                         prompt_id: str = "prompt_id", prompt: str = "prompt", text: str = "text") -> DataFrame:
    """One row: prompts, exact and near overlap, both rates."""
    # counted before the sets are written, so that its shuffles do not lie beside them
    exact = settle(exact_overlap(prompts, train, prompt, text).agg(F.count(F.lit(1)).alias("exact_norm_overlap")))
    near = jaccard_overlap(prompts, train, threshold, prompt_id, prompt, text).agg(
        F.count(F.lit(1)).alias("high_jaccard_overlap"))
    total = prompts.agg(F.count(F.lit(1)).alias("prompts"))
    safe = F.greatest(F.lit(1), F.col("prompts"))
    counted = total.select(
        "prompts", exact.scalar().alias("exact_norm_overlap"), near.scalar().alias("high_jaccard_overlap"))
    return counted.select(
        "prompts", "exact_norm_overlap", "high_jaccard_overlap",
        F.round(F.col("exact_norm_overlap") / safe, 4).alias("exact_norm_overlap_rate"),
        F.round(F.col("high_jaccard_overlap") / safe, 4).alias("high_jaccard_overlap_rate"),
    )


def forbidden_rows(df: DataFrame, hints: list[str] | None = None, source: str = "source",
                   head: int | None = None, order: str = "row_idx") -> DataFrame:
    """Rows of a forbidden source, over the whole table; ``head`` restricts to the first rows."""
    hints = lx.FORBIDDEN_SOURCES if hints is None else hints
    rows = df.orderBy(order).limit(head) if head else df
    return rows.filter(any_hint(F.col(source), hints))


def source_guard(df: DataFrame, hints: list[str] | None = None, path: str | None = None,
                 path_hints: list[str] | None = None, source: str = "source", head: int | None = None) -> None:
    """Raise when a training set comes from a forbidden path or source."""
    path_hints = lx.FORBIDDEN_PATHS if path_hints is None else path_hints
    if path and any(h in path.replace("\\", "/").lower() for h in path_hints):
        raise ValueError(f"forbidden dataset for training: {path}")
    bad = forbidden_rows(df, hints, source, head).select(source).limit(1).collect()
    if bad:
        raise ValueError(f"forbidden source in dataset: {bad[0][0]}")
