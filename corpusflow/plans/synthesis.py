"""Rows from templates and slot catalogues, and rows that repair failed benchmark cases."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import collapse, strip
from corpusflow.operators.dedupe import first_wins_dedupe
from corpusflow.operators.sampling import seeded_sample
from corpusflow.operators.scan import bounded_broadcast, hash_order, take_first
from corpusflow.session import settle


def fill(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` placeholders of a template."""
    parts = re.split(r"\{(\w+)\}", template)
    made = [F.lit(p) if i % 2 == 0 else values[p] for i, p in enumerate(parts) if p or i % 2]
    return F.concat(*made) if made else F.lit("")


def permuted(x: Column, half: int, seed: int) -> Column:
    """A keyed permutation of the numbers below 4 ** half: four Feistel rounds over their halves."""
    mask = (1 << half) - 1
    left, right = F.shiftright(x, half), x.bitwiseAND(F.lit(mask))
    for i in range(4):
        mixed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(i)), right.cast("string"))), 1, 8), 16, 10)
        left, right = right, left.bitwiseXOR(mixed.cast("bigint").bitwiseAND(F.lit(mask)))
    return F.shiftleft(left, half).bitwiseOR(right)


def combine_slots(rows: DataFrame, slots: dict[str, DataFrame], sizes: dict[str, int], cycle: bool = False) -> DataFrame:
    """``rows`` with a value of every slot, ``(idx, value)`` with ``idx`` from 0.

    ``row_idx`` is a number of the product of the slots, decoded to one index per slot, or with ``cycle`` taken
    modulo the size of each; each slot is an equi join on its index."""
    out, step = rows, 1
    for name, df in slots.items():
        at = F.col("row_idx") % sizes[name] if cycle else F.floor(F.col("row_idx") / step).cast("bigint") % sizes[name]
        side = bounded_broadcast(df.select(F.col("idx").cast("bigint").alias("_i"), F.col("value").alias(name)))
        out = out.withColumn("_i", at).join(side, "_i").drop("_i")
        step *= max(1, sizes[name])
    return out


def synthesize_templates(spark: SparkSession, slots: dict[str, DataFrame], instruction: str, response: str,
                         n: int, seed: int, source: str = "template", history: str = "",
                         pad: bool = False) -> DataFrame:
    """``n`` distinct rows of the product of the slots, in the order of a keyed permutation of it; ``pad`` tops
    up with cycled rows that may repeat.

    The product is never made: some 2n numbers of the permutation are decoded and rendered, and more only if
    equal texts leave too few."""
    values = {name: F.col(name).cast("string") for name in slots}
    sizes = {name: df.count() for name, df in slots.items()}
    total = math.prod(sizes.values())
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    domain = 4 ** half

    def render(df: DataFrame, order: str) -> DataFrame:
        return df.select(fill(instruction, values).alias("instruction"), fill(response, values).alias("response"),
                         F.lit(history).alias("history"), F.lit(source).alias("source"), F.col(order).alias("row_idx"))

    upto = min(domain, 64 + 2 * n * domain // max(1, total))
    while True:
        drawn = spark.range(upto).select(F.col("id").alias("at"), permuted(F.col("id"), half, seed).alias("row_idx")).filter(F.col("row_idx") < total)
        made = first_wins_dedupe(render(combine_slots(drawn, slots, sizes), "at"), [F.lower("instruction"), F.lower("response")], ["row_idx"])
        made = settle(made)
        found = made.count()
        if found >= n or upto == domain:
            break
        upto = min(domain, 4 * upto)
    out = take_first(made, n, [F.col("row_idx")], F.floor(F.col("row_idx") / F.lit(max(1, domain // 65_536))))
    if not pad or found >= n or not total:
        return out
    extra = combine_slots(spark.range(n - found).withColumnRenamed("id", "row_idx"), slots, sizes, True)
    return out.unionByName(render(extra, "row_idx").withColumn("row_idx", F.col("row_idx") + F.lit(domain)))


NOISE = [("pourquoi", "pq"), ("comment", "comt"), ("probabilites", "probas"), ("modele", "model"),
         ("evaluation", "eval")]


def noisy_variant(question: Column, seed: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """Chat-style spelling; each change is decided by its own hash of the seed."""
    def chance(tag: str, share: float) -> Column:
        bits = F.conv(F.substring(hash_order(tag, seed), 1, 8), 16, 10).cast("bigint")
        return bits / F.lit(2.0 ** 32) < share
    out = question
    for i, (old, new) in enumerate(NOISE if rules is None else rules):
        out = F.when(chance(f"r{i}", 0.25), F.replace(out, F.lit(old), F.lit(new))).otherwise(out)
    out = F.when(chance("join", 0.30) & (F.length(out) < 28), F.replace(out, F.lit(" "), F.lit(""))).otherwise(out)
    return F.when(chance("lower", 0.40), F.lower(out)).otherwise(out)


def question_variants(rows: DataFrame, question: str, seed: str, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """One noisy instruction per row, distinct after normalising, in text order."""
    made = rows.withColumn("instruction", collapse(noisy_variant(F.col(question), F.col(seed).cast("string"), rules)))
    return first_wins_dedupe(made, [collapse(F.lower("instruction"))], [seed]).orderBy("instruction")


def remediation_from_failures(spark: SparkSession, scored: DataFrame, frames: DataFrame, response: str, n: int,
                              seed: int, question: str = "question", keywords: str = "keywords",
                              source: str = "remediation", history: str = "") -> DataFrame:
    """Rows for failed cases: question and frame as instruction, keywords spelled out in the answer.

    ``frames(idx, value)`` are the style, context and profile suffixes; the failed cases are
    the slot that grows, so cases and frames meet by frame number."""
    wanted = F.filter(F.transform(keywords, strip), lambda k: k != "")
    failed = scored.filter(F.col("passed") == 0).select(
        strip(question).alias("question"), F.array_join(wanted, ", ").alias("keywords"))
    failed = failed.filter((F.col("question") != "") & (F.col("keywords") != "")).distinct()
    size = frames.count()
    spread = failed.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(max(0, size - 1))))).join(
        bounded_broadcast(frames.select(F.col("idx").cast("int").alias("_i"), F.col("value").alias("frame"))), "_i")
    values = {"question": F.col("question"), "keywords": F.col("keywords")}
    rows = spread.select(
        F.concat_ws(" ", "question", "frame").alias("instruction"), fill(response, values).alias("response"),
        F.lit(history).alias("history"), F.lit(source).alias("source"))
    return seeded_sample(rows, n, seed, F.concat_ws("|", F.lower("instruction"), F.lower("response")))
