"""Circuit breaking over call logs, in parallel over time chunks of every provider.

A refused call does not count, so what a call does depends on all calls before it. But within a chunk the
outcome depends on very little of the past: how many errors a closed circuit holds (below the limit), or at
which call an open one lets the next call through. Each chunk tabulates its end state for every such entry, from
its last call backwards; the tables, a few rows per chunk, are composed in order; then all chunks run forward
from their known entry state at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.fold import ordered_fold
from corpusflow.operators.scan import time_chunk

START = (0, 0.0, True)


def circuit_step(state: tuple, ts: float, ok: bool, first_attempt: bool, k: int, secs: float) -> tuple:
    """One call against ``(failures, open_until, let_through)``; returns the new state, refusal
    and whether an alert starts. Retries follow the decision on their call's first attempt."""
    failures, until, through = state
    if first_attempt:
        through = until <= ts
    if not through:
        return (failures, until, False), True, False
    if ok:
        return (0, 0.0, True), False, False
    failures += 1
    alert = failures >= k and until <= ts
    return (failures, ts + secs if failures >= k else until, True), False, alert


def transfer_table(at: np.ndarray, ok: np.ndarray, first: np.ndarray, k: int, secs: float, before: float) -> list[tuple]:
    """End states of a chunk for every entry: (kind, from, absolute, failures, until, through).

    ``kind`` 0 and 2 are closed circuits that hold ``from`` errors; 1 is an open circuit whose first call let
    through is the first at or after ``from``, in order of time; 3 is an open one. 2 and 3 begin with retries
    of a call that was let through. An end state that is not absolute adds its errors to those of the entry.
    Open circuits end before ``before``, so later entries aren't tabulated."""
    starts = np.flatnonzero(first)
    times, m = at[starts], len(starts)
    edges = np.append(starts, len(at)).tolist()

    def let_through(lo: int, hi: int, errors: int, known: bool) -> tuple[bool, int, float]:
        """A call and its retries from ``errors``; of an open circuit only the errors added are known."""
        until = 0.0
        for r in range(lo, hi):
            if ok[r]:
                errors, known, until = 0, True, 0.0
            else:
                errors += 1
                if not known or errors >= k:
                    until = float(at[r]) + secs
        return known, errors, until

    opened: list[tuple] = [()] * m
    closed: list[list[tuple]] = [[()] * k for _ in range(m)] + [[(True, f, 0.0, True) for f in range(k)]]

    def ending(i: int, known: bool, errors: int, until: float) -> tuple:
        """End state behind the calls up to ``i``."""
        if known and errors < k:
            return closed[i + 1][errors]
        n = int(np.searchsorted(times, until))
        if n >= m:
            return known, errors, until, i == m - 1
        after = opened[n]
        return after if after[0] else (known, errors + after[1], after[2], after[3])

    for i in range(m - 1, -1, -1):
        opened[i] = ending(i, *let_through(edges[i], edges[i + 1], 0, False))
        for f in range(k):
            closed[i][f] = ending(i, *let_through(edges[i], edges[i + 1], f, True))
    table = [(0, float(f), *closed[0][f]) for f in range(k)] if m else []
    last = min(m - 1, int(np.searchsorted(times, before)))
    for i in range(last + 1):
        if i < last and opened[i] == opened[i + 1]:
            continue  # the same end for entries up to the next call
        table.append((1, float(times[i]), *opened[i]))
    if edges[0] > 0:
        table += [(2, float(f), *ending(-1, *let_through(0, edges[0], f, True))) for f in range(k)]
        table.append((3, 0.0, *ending(-1, *let_through(0, edges[0], 0, False))))
    return table


def circuit_intervals(calls: DataFrame, k: int = 3, secs: int = 60, chunk_seconds: int = 86_400) -> DataFrame:
    """Refusals, failure counts and alerts per call of ``calls(provider, ts, seq, ok[, attempt])``.

    A provider of any size is spread over its time chunks; what one task orders alone is one table row per entry
    and chunk. ``chunk_seconds`` should be well above ``secs``, as only entries within ``secs`` of a chunk's start
    are tabulated one by one."""
    k, wait = max(1, k), float(max(1, secs))
    src = calls if "attempt" in calls.columns else calls.withColumn("attempt", F.lit(1))
    ready = src.select(
        F.coalesce(F.concat(F.lit("="), F.col("provider").cast("string")), F.lit("")).alias("provider"), time_chunk("ts", chunk_seconds).alias("chunk"), "seq",
        (F.unix_micros("ts") / F.lit(1e6)).alias("at"), "ok", (F.col("attempt") == 1).alias("first"))
    keys = ["provider", "chunk"]

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "seq"])
        chunk = int(pdf["chunk"].iloc[0])
        rows = transfer_table(pdf["at"].to_numpy(), pdf["ok"].to_numpy(bool), pdf["first"].to_numpy(bool), k, wait, chunk * chunk_seconds + wait)
        calls_in = int(pdf["first"].sum())
        return pd.DataFrame([(pdf["provider"].iloc[0], chunk, calls_in, *r) for r in rows],
                            columns=[c.split()[0] for c in table_schema.split(", ")])

    table_schema = ("provider string, chunk bigint, calls bigint, kind int, entry double, known boolean, failures bigint, until double, through boolean")
    # the rows go by provider and chunk here and below: one shuffle
    dealt = ready.repartition(*keys)
    tables = dealt.groupBy(*keys).applyInPandas(tabulate, table_schema)

    def leave(state: tuple, found: tuple | None, calls_in: int, retries: bool) -> tuple:
        failures, until, through = state
        if found is None:  # no call let through; retries alone leave the decision as it is
            return failures, until, through and calls_in == 0
        known, errors, end, passed = found
        return (errors if known else failures + errors), end, passed

    def compose(run, row):
        state, chunk, found, calls_in, retries = run
        made = None
        if row.chunk != chunk:
            if chunk is not None:
                state = leave(state, found, calls_in, retries)
            chunk, found, calls_in, retries = row.chunk, None, row.calls, False
            made = (row.provider, row.chunk, *state)
        failures, until, through = state
        retries = retries or row.kind > 1
        fits = (row.entry == failures if failures < k else row.entry >= until) if row.kind < 2 else (
            through and (row.kind == 2 and row.entry == failures or row.kind == 3 and failures >= k))
        if fits and row.kind == int(failures >= k) + (2 if row.kind > 1 else 0) and (found is None or row.kind > 1):
            found = (row.known, int(row.failures), row.until, row.through)
        return (state, chunk, found, calls_in, retries), made

    entries = ordered_fold(tables, ["provider"], ["chunk", "kind", "entry"], lambda: (START, None, None, 0, False), compose,
                           "provider string, chunk bigint, failures bigint, until double, through boolean")

    def forward(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "seq"])
        state = (int(entry["failures"].iloc[0]), float(entry["until"].iloc[0]), bool(entry["through"].iloc[0]))
        made = []
        for at, ok, first in zip(pdf["at"].tolist(), pdf["ok"].tolist(), pdf["first"].tolist()):
            state, refused, alert = circuit_step(state, at, ok, first, k, wait)
            made.append((refused, state[0], alert, state[1] if state[1] > at else math.nan))
        out = pd.DataFrame(made, columns=["refused", "failures", "alert", "open_until"])
        name = pdf["provider"].iloc[0]
        return out.assign(provider=name[1:] if name else None, seq=pdf["seq"].to_numpy())

    out = dealt.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(
        forward, "provider string, seq bigint, refused boolean, failures bigint, alert boolean, open_until double")
    return out.withColumn("open_until", F.nanvl("open_until", F.lit(None).cast("double")))
