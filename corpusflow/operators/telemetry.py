"""Traffic, provider, job and task metrics; quotas and streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.text import strip, text_of
from corpusflow.operators.circuit import circuit_intervals, circuit_step  # noqa: F401  the breaker belongs to the metrics
from corpusflow.operators.scan import time_chunk


def traffic_metrics(events: DataFrame, intent: str = "intent") -> DataFrame:
    """``(metric, value)``: totals, flags and one line per intent."""
    off = ~F.coalesce("in_domain", F.lit(True))
    totals = events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce("corrected_by_verifier", F.lit(False))).alias("corrected_by_verifier"),
        F.count_if(F.coalesce("used_rule_reply", F.lit(False))).alias("rule_reply"),
        F.count_if(off).alias("out_of_domain"),
    ).select(F.expr(
        "stack(4, 'total', total, 'corrected_by_verifier', corrected_by_verifier, "
        "'rule_reply', rule_reply, 'out_of_domain', out_of_domain) AS (metric, value)"
    ))
    name = F.coalesce(F.col(intent), F.lit("unknown"))
    by_intent = events.groupBy(F.concat(F.lit("intent_"), name).alias("metric")).agg(
        F.count(F.lit(1)).alias("value"))
    return totals.unionByName(by_intent)


def provider_metrics(calls: DataFrame) -> DataFrame:
    """Counts per provider, last latency of a success, and a totals line.

    ``scope`` tells the totals (all) from a provider, NULL included.

    ``calls(provider, ts, ok, latency_ms, seq)``."""
    good = F.when(F.col("ok"), F.struct("ts", "seq"))
    return calls.rollup("provider").agg(
        F.when(F.grouping("provider") == 1, "all").otherwise("provider").alias("scope"),
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("success"),
        F.count_if(~F.col("ok")).alias("error"),
        F.coalesce(F.max_by("latency_ms", good), F.lit(0)).alias("last_latency_ms"),
        F.max("ts").alias("updated_at"),
    )


def job_counters(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count_if(F.col("status") == "queued").alias("queued"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if(F.col("status").isin("done", "error")).alias("finished"),
    ).withColumn("total", F.col("queued") + F.col("running") + F.col("finished"))


def pending_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin("queued", "running")).groupBy("principal").agg(
        F.count(F.lit(1)).alias("pending"))


def iso_seconds(c: Column | str) -> Column:
    """Epoch seconds of an ISO time, a trailing Z allowed; NULL for junk."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(F.try_to_timestamp(c.cast("string"))) / F.lit(1_000_000.0)


def expire_jobs(jobs: DataFrame, ttl_seconds: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """Split into kept and removed: finished jobs older than the TTL (60 s at least)."""
    ttl = max(60, int(ttl_seconds))
    finished = F.coalesce(F.nullif(iso_seconds("finished_at"), F.lit(0.0)), iso_seconds("created_at"))
    stale = (
        ~F.coalesce(F.col("status"), F.lit("")).isin("queued", "running")
        & F.coalesce(finished != 0, F.lit(False)) & F.coalesce(now - finished > ttl, F.lit(False))
    )
    marked = jobs.withColumn("_stale", stale)
    return marked.filter(~F.col("_stale")).drop("_stale"), marked.filter("_stale").drop("_stale")


def task_progress(tasks: DataFrame, events: DataFrame, most: int | None = 20) -> DataFrame:
    """Progress per task. ``tasks(task_id, steps)``, ``events(task_id, ts, seq, done_step, error,
    mark_done)``; the latest event decides on an explicit close. Plans of tasks with events count up
    to ``most`` steps (None: all); a task without events keeps its whole plan."""
    step = F.nullif(strip("done_step"), F.lit(""))
    seen = events.groupBy("task_id").agg(
        F.countDistinct(step).alias("done_count"),
        F.count_if(text_of("error") != "").alias("errors"),
        F.max_by(F.coalesce("mark_done", F.lit(False)), F.struct("ts", "seq")).alias("closed"),
    )
    steps = F.size(F.filter("steps", lambda s: strip(s) != ""))
    out = tasks.select("task_id", steps.alias("_steps")).join(seen, "task_id", "left")
    planned = F.col("_steps") if most is None else F.when(
        F.col("done_count").isNotNull(), F.least(F.lit(most), F.col("_steps"))).otherwise(F.col("_steps"))
    out = out.withColumn("planned", planned)
    done = F.coalesce("done_count", F.lit(0))
    errors = F.coalesce("errors", F.lit(0))
    finished = F.coalesce("closed", F.lit(False)) | ((F.col("planned") > 0) & (done >= F.col("planned")))
    return out.select(
        "task_id", "planned", done.alias("done_count"),
        F.greatest(F.lit(0), F.col("planned") - done).alias("remaining_steps"), errors.alias("errors"),
        F.when(finished, "done").when(errors > 0, "blocked").otherwise("active").alias("status"),
    )


# --- quotas ----------------------------------------------------------------
ROLE_LIMITS = {"basic": (30, 800), "advanced": (120, 5000), "admin": (300, 20000)}


def _limit(role: Column, limits: dict[str, tuple[int, int]], i: int) -> Column:
    table = F.create_map(*[x for r, v in limits.items() for x in (F.lit(r), F.lit(v[i]))])
    return F.coalesce(F.try_element_at(table, role), F.lit(limits["basic"][i]))


def _by_levels(df: DataFrame, limit: str, levels: list[int], counts) -> DataFrame:
    """Mark as ``_in`` the rows that a counter admits which each row compares with a limit of its own.

    The first ``levels[0]`` rows are in, whatever their limit; of the rows after them whose limit is higher the
    next ``levels[1] - levels[0]``, and so on. ``counts(df, flag)`` adds the running number ``_c`` of flagged rows."""
    df, floor = df.withColumn("_in", F.lit(False)), 0
    for level in levels:
        open_ = ~F.col("_in") & (F.col(limit) > floor)
        df = counts(df, open_).withColumn("_in", F.col("_in") | (open_ & (F.col("_c") <= level - floor))).drop("_c")
        floor = level
    return df


def rate_quota(requests: DataFrame, limits: dict[str, tuple[int, int]] | None = None,
               minute_seconds: int = 60, order: list[str] = ("ts", "seq")) -> DataFrame:
    """Decision per request: ``admitted``, ``minute_limit`` or ``day_quota``. A principal may change its role.

    Requests are counted inside their minute. A count over the day needs no second order of the requests: it is
    the count in the minute plus what the earlier minutes of the day hold, a sum over one row per minute."""
    limits = limits or ROLE_LIMITS
    src = requests.withColumns({
        "_minute": F.floor(F.unix_micros("ts") / F.lit(minute_seconds * 1_000_000)).cast("bigint"),
        "_day": F.floor(F.unix_micros("ts") / F.lit(86_400_000_000)).cast("bigint"),
        "_per_minute": _limit(F.col("role"), limits, 0), "_per_day": _limit(F.col("role"), limits, 1),
    })
    cell = ["principal", "_day", "_minute"]
    upto = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    day = Window.partitionBy("principal", "_day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)

    def in_minute(df: DataFrame, flag: Column) -> DataFrame:
        return df.withColumn("_c", F.sum(flag.cast("bigint")).over(upto))

    def in_day(df: DataFrame, flag: Column) -> DataFrame:
        here = in_minute(df, F.col("_let") & flag)
        before = here.groupBy(*cell).agg(F.max("_c").alias("_c")).select(*cell, F.coalesce(F.sum("_c").over(day), F.lit(0)).alias("_before"))
        return here.join(before, cell, "left").withColumn("_c", F.col("_c") + F.col("_before")).drop("_before")

    let = _by_levels(src, "_per_minute", sorted({v[0] for v in limits.values()}), in_minute).withColumnRenamed("_in", "_let")
    out = _by_levels(let, "_per_day", sorted({v[1] for v in limits.values()}), in_day)
    decision = F.when(~F.col("_let"), "minute_limit").when(F.col("_in"), "admitted").otherwise("day_quota")
    return out.withColumn("decision", decision).select(*requests.columns, "decision")


# --- failures --------------------------------------------------------------
def failure_streak(calls: DataFrame, chunk_seconds: int = 86_400) -> DataFrame:
    """Errors in a row up to each call, reset by a success.

    The streak is the errors so far minus the errors up to the last success; both are counted
    inside time chunks and shifted by one summary row per chunk."""
    keys = ["provider", "_chunk"]
    src = calls.withColumn("_chunk", time_chunk("ts", chunk_seconds))
    inside = Window.partitionBy(*keys).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    here = src.withColumn("_errors", F.sum((~F.col("ok")).cast("bigint")).over(inside))
    here = here.withColumn("_base", F.last(F.when(F.col("ok"), F.col("_errors")), ignorenulls=True).over(inside))
    before = Window.partitionBy("provider").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # both counters only grow inside a chunk
    ends = here.groupBy(*keys).agg(F.max("_errors").alias("_e"), F.max("_base").alias("_b"))
    ends = ends.withColumn("_ein", F.coalesce(F.sum("_e").over(before), F.lit(0)))
    ends = ends.withColumn("_bin", F.coalesce(F.last(F.col("_ein") + F.col("_b"), ignorenulls=True).over(before), F.lit(0)))
    both = here.join(ends.select(*keys, "_ein", "_bin"), keys, "left")
    streak = F.col("_ein") + F.col("_errors") - F.coalesce(F.col("_ein") + F.col("_base"), F.col("_bin"))
    return both.withColumn("streak", streak).select(*calls.columns, "streak")
