"""Ordered event-time state: late rows, several files, expiry; the circuit's transfer tables; changing roles."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.catalog.streams import finish, late_files
from corpusflow.operators import circuit, telemetry
from corpusflow.streaming import operators as so
from corpusflow.streaming.ordered import ordered_stream

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def stream_of(spark, path, files, schema):
    """A stream that reads the given lists of rows one file a batch."""
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def counting(stream, delay, idle_ms=None):
    def step(state, row):
        return (state[0] + 1,), (row.seq, state[0] + 1)
    return ordered_stream(stream, ["key"], ["seq"], ["seq"], "n bigint", lambda: (0,), step, "seq bigint, n bigint", delay=delay, idle_ms=idle_ms)


SCHEMA = "key string, ts timestamp, seq bigint"


def test_rows_of_a_later_file_are_counted_in_event_time(spark, tmp_path):
    files = [[("a", at(0), 0), ("a", at(60), 2)], [("a", at(30), 1), ("a", at(120), 4), ("b", at(100), 1)], [("a", at(90), 3)], [("~", at(9_999_999), 0)]]
    out = finish(counting(stream_of(spark, str(tmp_path / "in"), files, SCHEMA), "100 seconds"))
    assert sorted(map(tuple, out.collect())) == [("a", k, k + 1) for k in range(5)] + [("b", 1, 1)]


def test_rows_behind_the_watermark_change_nothing(spark, tmp_path):
    files = [[("a", at(0), 0), ("a", at(500), 1)], [("b", at(1000), 0)], [("a", at(10), 9), ("a", at(995), 2)], [("~", at(9_999_999), 0)]]
    out = finish(counting(stream_of(spark, str(tmp_path / "in"), files, SCHEMA), "10 seconds"))
    assert sorted(map(tuple, out.collect())) == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 1)]


def test_idle_keys_are_forgotten(spark, tmp_path):
    files = [[("a", at(0), 0), ("b", at(0), 0)], [("a", at(50), 1)], [("b", at(5000), 1), ("c", at(5001), 0)], [("a", at(9000), 2)], [("~", at(9_999_999), 0)]]
    query = counting(stream_of(spark, str(tmp_path / "in"), files, SCHEMA), "1 second", idle_ms=1_000_000)
    out = finish(query)
    # a and b begin anew after more than 1000 seconds of silence
    assert sorted(map(tuple, out.collect())) == [("a", 0, 1), ("a", 1, 2), ("a", 2, 1), ("b", 0, 1), ("b", 1, 1), ("c", 0, 1)]


def test_first_pair_in_event_time_wins(spark, tmp_path):
    schema = "ts timestamp, row_idx bigint, user_text string, assistant_text string, in_domain boolean, is_low_quality boolean, has_quality boolean, quality_text string, corrected_by_verifier boolean, verifier_issues array<string>"
    row = lambda s, i, text: (at(s), i, text, "an answer " * 30, True, False, True, "0.9", False, [])
    files = [[row(50, 5, "Hello  there"), row(51, 6, "other")], [row(20, 2, "hello there"), row(50, 1, "hello there")], [row(9_999_999, 9, "~")]]
    stream = stream_of(spark, str(tmp_path / "in"), files, schema)
    out = finish(so.curate_stream(stream, delay="100 seconds"))
    assert sorted((r.row_idx, r.instruction) for r in out.collect()) == [(2, "hello there"), (6, "other")]


def test_late_files_hold_every_row(spark, root):
    events = spark.read.parquet(f"{root}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    stream, delay = late_files(events, "event_id", {"event_id": -1})
    assert finish(stream).filter("event_id >= 0").count() == events.count() and int(delay.split()[0]) > 0


@pytest.mark.parametrize("k,secs", [(1, 3), (2, 10), (3, 30)])
def test_transfer_table_gives_the_end_of_every_entry(k, secs):
    rng = random.Random(k * 100 + secs)
    for _ in range(150):
        n = rng.randint(1, 25)
        times = np.sort(np.array([float(rng.randint(100, 160)) for _ in range(n)]))
        ok, first = np.array([rng.random() < 0.4 for _ in range(n)]), np.array([rng.random() < 0.7 for _ in range(n)])
        table = circuit.transfer_table(times, ok, first, k, float(secs), 100.0 + secs)
        entries = [(f, 0.0, t) for f in range(k) for t in (True, False)] + [(k + 2, u, t) for u in (90.0, *np.arange(100.0, 100.0 + secs)) for t in (True, False)]
        for entry in entries:
            state = entry
            for x, good, one in zip(times, ok, first):
                state = circuit.circuit_step(state, x, good, one, k, float(secs))[0]
            lead = not first[0] and entry[2]
            kind = (0 if entry[0] < k else 1) + (2 if lead else 0)
            fits = [r for r in table if r[0] == kind and (kind == 3 or (r[1] >= entry[1] if kind == 1 else r[1] == entry[0]))]
            if not fits:
                calls = int(first.sum())
                assert state == (entry[0], entry[1], entry[2] and not calls)
                continue
            _, _, known, errors, until, through = fits[0]
            assert (state[0], state[2]) == (errors if known else entry[0] + errors, through)
            assert state[1] == until or (state[0] < k and max(state[1], until) <= times[-1])


def test_circuit_of_one_hot_provider_runs_by_chunks(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "a", None, ""]), at(rng.randint(0, 3000)), i, rng.random() > 0.6, rng.choice([1, 1, 2])) for i in range(600)]
    calls = spark.createDataFrame(rows, "provider string, ts timestamp, seq bigint, ok boolean, attempt int")
    state, want = {}, []
    for p, ts, i, ok, attempt in sorted(rows, key=lambda r: (r[1], r[2])):
        now = ts.replace(tzinfo=dt.timezone.utc).timestamp()
        new, refused, alert = circuit.circuit_step(state.get(p, circuit.START), now, ok, attempt == 1, 2, 30.0)
        state[p] = new
        want.append((i, p, refused, new[0], alert, new[1] if new[1] > now else None))
    got = circuit.circuit_intervals(calls.repartition(3), 2, 30, 200)
    assert sorted((r.seq, r.provider, r.refused, r.failures, r.alert, r.open_until) for r in got.collect()) == sorted(want)
    assert calls.select(F.floor(F.unix_seconds("ts") / 200)).distinct().count() > 10


def test_quota_of_changing_roles(spark):
    rng = random.Random(1)
    limits = {"basic": (2, 5), "advanced": (3, 7), "admin": (5, 9)}
    rows = [(rng.choice("ab"), rng.choice(["basic", "advanced", "admin", None]), at(rng.randint(0, 86_400 * 2)), i) for i in range(400)]
    minute, day, want = defaultdict(int), defaultdict(int), []
    for p, role, ts, i in sorted(rows, key=lambda r: (r[2], r[3])):
        now, (a, b) = ts.replace(tzinfo=dt.timezone.utc).timestamp(), limits.get(role, limits["basic"])
        if minute[p, now // 7200] >= a:
            want.append((i, "minute_limit"))
            continue
        minute[p, now // 7200] += 1
        admitted = day[p, now // 86_400] < b
        day[p, now // 86_400] += admitted
        want.append((i, "admitted" if admitted else "day_quota"))
    requests = spark.createDataFrame(rows, "principal string, role string, ts timestamp, seq bigint")
    got = telemetry.rate_quota(requests, limits, 7200).select("seq", "decision").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({d for _, d in want}) == 3
    stream, delay = late_files(requests, "seq", {"principal": "~", "role": "basic", "seq": -1})
    assert sorted((r.seq, r.decision) for r in finish(so.rate_quota_stream(stream, limits, 7200, delay)).collect()) == sorted(want)
