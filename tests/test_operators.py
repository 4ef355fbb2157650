"""Order-dependent operators against plain loops, across chunk borders and partitionings."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.catalog.base import calls, conversations, documents, requests
from corpusflow.catalog.jobs import eval_runs
from corpusflow.catalog.relations import LIMITS, TEST_POLICY, _policy_rows
from corpusflow.functions.text import norm_text
from corpusflow.operators import dedupe, evaluate, overlap, pairs, policy, sampling, scan, search, sessions, telemetry
from corpusflow.plans.curation import validate_series


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture()
def tiny_chunks(monkeypatch):
    small = lambda c, width=2: F.floor(F.col(c) / F.lit(width)).cast("bigint")
    monkeypatch.setattr(pairs, "chunk_of", small)
    monkeypatch.setattr(sessions, "chunk_of", small)


# --- scans over chunk borders ----------------------------------------------
def test_training_rows_over_chunks(spark, root, monkeypatch):
    c = conversations(spark, root)
    whole = rows(pairs.training_rows(c), "conv_id", "turn", "instruction", "response", "history")
    monkeypatch.setattr(pairs, "chunk_of", lambda x: F.floor(F.col(x) / 2).cast("bigint"))
    assert rows(pairs.training_rows(c), "conv_id", "turn", "instruction", "response", "history") == whole
    assert whole


def test_training_rows_against_loop(spark, tiny_chunks):
    rnd = random.Random(3)
    told = [(1, i, rnd.choice(["user", "user", "assistant", "assistant", "system"]), rnd.choice(["", " ", "w" * rnd.randint(1, 90)]))
            for i in range(300)]
    want, parts, user = [], [], None
    for _, turn, role, text in told:
        text = text.strip()
        if not text:
            continue
        if role == "user":
            user = text
            parts.append("Utilisateur: " + text)
        elif role == "assistant" and user:
            want.append((turn, user, text, " ||| ".join(parts[:-1])[:1400]))
            parts.append("Assistant: " + text)
            user = None
    df = spark.createDataFrame(told, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    assert rows(pairs.training_rows(df), "turn", "instruction", "response", "history") == want


def test_scan_features_equal_plain_windows(spark, root):
    c = conversations(spark, root).withColumn("_chunk", F.floor(F.col("turn") / 2))
    slot = F.when(F.length("text") % 3 == 0, F.col("text"))
    got = scan.scan_features(c, ["conv_id"], ["turn"], "_chunk", {"n": F.lit(1)}, {"slot": slot}, {"tail": (F.col("turn"), 3)})
    w = Window.partitionBy("conv_id").orderBy("turn")
    want = c.select(
        "conv_id", "turn", F.row_number().over(w).alias("n"),
        F.last(slot, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("slot"),
        F.collect_list("turn").over(w.rowsBetween(-3, -1)).alias("tail"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_neighbours_over_chunks(spark, root):
    c = conversations(spark, root).withColumn("_chunk", F.floor(F.col("turn") / 1))
    got = scan.with_neighbours(c, ["conv_id"], ["turn"], ["turn"], "_chunk", "p", "f")
    w = Window.partitionBy("conv_id").orderBy("turn")
    want = c.select("conv_id", "turn", F.lag("turn").over(w).alias("p"), F.lead("turn").over(w).alias("f"))
    key = lambda t: tuple(-9 if x is None else x for x in t)
    assert sorted(map(key, map(tuple, got.select("conv_id", "turn", "p.turn", "f.turn").collect()))) == \
        sorted(map(key, map(tuple, want.collect())))


def test_streak_against_loop(spark, root):
    streaks, want = {}, []
    for r in calls(spark, root).orderBy("ts", "seq").collect():
        streaks[r.provider] = 0 if r.ok else streaks.get(r.provider, 0) + 1
        want.append((r.seq, streaks[r.provider]))
    for seconds in (3_600, 86_400 * 40):
        assert rows(telemetry.failure_streak(calls(spark, root), seconds), "seq", "streak") == sorted(want)


def loop_circuit(call_rows, k, secs):
    state, out = {}, []
    for r in call_rows:
        failures, until, through = state.get(r.provider, (0, 0.0, True))
        now = r.ts.replace(tzinfo=dt.timezone.utc).timestamp()
        if r.attempt == 1:
            through = not until > now
        alert = False
        if through and r.ok:
            failures, until = 0, 0.0
        elif through:
            failures += 1
            if failures >= k:
                alert = until <= now
                until = now + secs
        state[r.provider] = (failures, until, through)
        out.append((r.seq, not through, failures, alert))
    return sorted(out)


@pytest.mark.parametrize("k,secs,providers,chunk", [(3, 60, 1, 7_200), (2, 3_600, 5, 86_400), (1, 20_000, 3, 43_200)])
def test_circuit_against_loop(spark, root, k, secs, providers, chunk):
    few = calls(spark, root).withColumn("provider", (F.col("provider").cast("bigint") % providers).cast("string"))
    few = few.withColumn("attempt", F.when(F.col("seq") % 9 == 0, 2).otherwise(1))
    want = loop_circuit(few.orderBy("ts", "seq").collect(), k, secs)
    got = telemetry.circuit_intervals(few.repartition(5), k, secs, chunk)
    assert rows(got, "seq", "refused", "failures", "alert") == want
    assert any(w[1] for w in want) or secs < 100


def test_circuit_stream_equals_batch(spark, root):
    from corpusflow.catalog.streams import circuit_breaker_stream
    few = calls(spark, root).withColumn("provider", (F.col("provider").cast("bigint") % 7).cast("string"))
    batch = telemetry.circuit_intervals(few, 2, 3600)
    assert rows(circuit_breaker_stream(spark, root), "seq", "refused", "failures", "alert") == \
        rows(batch, "seq", "refused", "failures", "alert")


def test_quota_against_loop(spark, root):
    minute, day, want = {}, {}, []
    for r in requests(spark, root).orderBy("ts", "seq").collect():
        now = r.ts.replace(tzinfo=dt.timezone.utc).timestamp()
        m, d = (r.principal, now // 21_600), (r.principal, now // 86_400)
        per_minute, per_day = LIMITS[r.role]
        if minute.get(m, 0) >= per_minute:
            want.append((r.seq, "minute_limit"))
            continue
        minute[m] = minute.get(m, 0) + 1
        if day.get(d, 0) >= per_day:
            want.append((r.seq, "day_quota"))
            continue
        day[d] = day.get(d, 0) + 1
        want.append((r.seq, "admitted"))
    assert rows(telemetry.rate_quota(requests(spark, root), LIMITS, 21_600), "seq", "decision") == sorted(want)
    assert len({w[1] for w in want}) == 3


def clipped(text, limit):
    return text if len(text) <= limit else text[:limit - 1].rstrip() + "…"


def plain_summary(previous, bullets, tail, cap):
    parts = ["Resume precedent: " + clipped(previous, 260)] if previous else []
    parts += ["Points cles: - " + " - ".join(bullets)] if bullets else []
    whole = " ".join((clipped(" ".join(parts), cap) + " " + " ".join(tail)).split())
    head = int(cap * 0.55)
    return whole if len(whole) <= cap else whole[:head].rstrip() + " ... " + whole[len(whole) - (cap - head - 5):].lstrip()


@pytest.mark.parametrize("cap", [1400, 420, 90])
def test_session_summary_against_loop(spark, tiny_chunks, cap):
    rnd = random.Random(5)
    lexicon = ["pipeline", "je veux", "rien", "voici", "texte " * 30, "api", "objectif"]
    told = [("s", i, f"{rnd.choice(lexicon)} u{rnd.randint(0, 40)}", f"{rnd.choice(lexicon)} a{i}") for i in range(240)]
    import re
    from corpusflow.functions import lexicons as lx
    want, previous, points = [], "", []
    for n, (_, _, user, reply) in enumerate(told, 1):
        u, a = " ".join(user.split()), " ".join(reply.split())
        if re.search(lx.SUMMARY_TECH, u.lower()):
            points.append("Demande technique: " + clipped(u, 170))
        elif re.search(lx.SUMMARY_INTENT, u.lower()):
            points.append("Intention utilisateur: " + clipped(u, 170))
        if re.search(lx.SUMMARY_COMMITMENT, a.lower()):
            points.append("Engagement assistant: " + clipped(a, 170))
        if n % 4 == 0:
            seen, unique = set(), []
            for b in points + ["Derniere demande: " + clipped(u, 170), "Derniere reponse: " + clipped(a, 170)]:
                if b.lower() not in seen:
                    seen.add(b.lower())
                    unique.append(b)
            tail = [x for _, _, p, q in told[max(0, n - 3):n] for x in ("Utilisateur: " + p, "Assistant: " + q)]
            previous = plain_summary(previous, unique[:8], tail, cap)
            want.append((n // 4, previous))
    df = spark.createDataFrame(told, "session_id string, pos bigint, user_text string, assistant_text string")
    for size in (1000, 23):
        got = sessions.session_summary(df, 4, cap, {"prenom": F.lit(None).cast("string")}, steps_per_chunk=size)
        assert rows(got, "step", "summary") == want


def test_promotion_against_loop(spark, root):
    p = evaluate.PromotionPolicy(min_improvement=0.001)
    best, want = {}, []
    for r in eval_runs(spark, root).orderBy("lane", "run_at").collect():
        comp = .40 * r.score_mean + .20 * r.pass_rate + .25 * r.token_f1_mean + .10 * r.keyword_coverage_mean + .05 * r.exact_match_rate
        b = best.get(r.lane)
        if b is None:
            reason = "first_best"
        elif r.memory_recall_rate + 1e-9 < b[0].memory_recall_rate:
            reason = "memory_regression"
        elif r.lane == "global" and r.score_mean + .005 + 1e-9 < b[0].score_mean:
            reason = "score_regression_too_high"
        elif r.lane == "global" and r.pass_rate + .02 + 1e-9 < b[0].pass_rate:
            reason = "pass_rate_regression_too_high"
        elif r.question_recognition_rate + .05 + 1e-9 < b[0].question_recognition_rate:
            reason = "question_recognition_regression_too_high"
        else:
            reason = "composite_improved" if comp > b[1] + .001 else "no_significant_improvement"
        if reason in ("first_best", "composite_improved"):
            best[r.lane] = (r, comp)
        want.append((r.lane, r.run_at, reason))
    assert rows(evaluate.promotion_history(eval_runs(spark, root), p), "lane", "run_at", "reason") == sorted(want)


def test_paragraph_packing(spark):
    rnd = random.Random(1)
    texts = ["\n \n".join("p" * rnd.randint(1, 300) for _ in range(rnd.randint(0, 8))) for _ in range(40)] + ["", "x" * 900]
    want = []
    for i, text in enumerate(texts):
        buf, used, n = [], 0, 0
        out = []
        for para in [p.strip() for p in text.split("\n \n") if p.strip()]:
            if used + len(para) > 480 and buf:
                out.append("\n\n".join(buf))
                buf, used = [para], len(para)
            else:
                buf.append(para)
                used += len(para)
        if buf:
            out.append("\n\n".join(buf))
        want += [(i, n, t) for n, t in enumerate(out, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert rows(search.split_paragraph_chunks(df).filter("length(text) > 1"), "doc_id", "chunk", "text") == \
        sorted(w for w in want if len(w[2]) > 1)


@pytest.mark.parametrize("size,overlap", [(1200, 200), (10, 3), (10, 10), (10, 15)])
def test_window_chunks(spark, size, overlap):
    texts = ["x" * n for n in (0, 1, 9, 10, 11, 1200, 1201, 2200, 2201)] + [" " * 12 + "ab"]
    def loop(t):
        out, start, step = [], 0, max(1, size - max(0, overlap))
        while start < len(t):
            piece = t[start:start + size].strip()
            out += [piece] if piece else []
            if start + size >= len(t):
                break
            start += step
        return out
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.orderBy("i").select(search.window_chunks(F.col("t"), size, overlap)).collect()
    assert [r[0] for r in got] == [loop(t) for t in texts]


# --- invariance and conservation -------------------------------------------
@pytest.mark.parametrize("n", [1, 4, 17])
def test_partitioning_does_not_matter(spark, root, n):
    d = documents(spark, root)
    mixed = d.repartition(n, F.rand(n))
    key = F.col("doc_id").cast("string")
    once = lambda x: rows(dedupe.first_wins_dedupe(x, [norm_text("text")], ["doc_id"]), "doc_id")
    sample = lambda x: rows(sampling.seeded_sample(x, 40, 7, key), "doc_id")
    assert once(mixed) == once(d)
    assert sample(mixed) == sample(d)
    c = conversations(spark, root)
    assert rows(pairs.training_rows(c.repartition(n, F.rand(n))), "conv_id", "turn", "history") == \
        rows(pairs.training_rows(c), "conv_id", "turn", "history")


def test_waterfall_conserves_rows(spark, root):
    src = _policy_rows(spark, root)
    kept, counts = policy.policy_waterfall(src, TEST_POLICY)
    total = {r.reason: r.rows for r in counts.collect()}
    assert sum(total.values()) == src.count()
    assert total["kept"] == kept.count()


def test_waterfall_reasons(spark):
    ok = "Voici une methode claire: tester puis deployer le modele avec soin."
    told = [
        ("", ok), ("une blague svp", ok), ("la politique", ok), ("la haine", ok), ("aide stp", ok), ("bjr aide", ok),
        ("q1", "je pense que " + ok), ("q2", "je crois que " + ok), ("q3", "je ne peux pas. " + ok), ("q4", "pardon. " + ok),
        ("q5", "cool. " + ok), ("q6", "python 2 " + ok), ("q7", "mode incognito " + ok), ("q8", "Voici."), ("q9", "court"),
        ("q10", "x: " * 900), ("q11", "mot " * 30), ("même", ok), ("MÊME  ", ok), ("même", ok + " Autre."),
        ("une blague", "je pense que " + ok),
    ]
    df = spark.createDataFrame([(q, r, "", "", 0, i) for i, (q, r) in enumerate(told)],
                               "instruction string, response string, history string, source string, src_rank int, row_idx bigint")
    kept, counts = policy.policy_waterfall(df, policy.CleaningPolicy())
    got = {r.reason: r.rows for r in counts.collect()}
    assert got.pop("removed_generalist") == 2 and got.pop("kept") == 1
    assert got == {r: 1 for r in policy.REASONS if r != "removed_generalist"}
    assert kept.select("instruction", "source").first() == ("même", "cleaned")


def test_validation_conserves_rows(spark, root):
    d = documents(spark, root).select(
        F.col("source").alias("dataset"), F.substring("source", 4, 9).cast("int").alias("src_rank"), F.col("doc_id").alias("row_idx"),
        F.substring("text", 1, 2).alias("instruction"), F.substring("text", 5, 1).alias("response"))
    clean, report, _ = validate_series(d)
    r = report.agg(*[F.sum(c).alias(c) for c in report.columns if c != "dataset"]).first().asDict()
    empty_q = d.filter((norm_text("instruction") == "")).count()
    assert r["before_rows"] == empty_q + sum(v for k, v in r.items() if k.startswith("removed_")) + r["after_rows"]
    assert r["after_rows"] == clean.count()


def test_dominant_response_ties_and_majority(spark):
    told = [("q", "a"), ("q", "b"), ("q", "B "), ("p", "x"), ("p", "y")]
    df = spark.createDataFrame([(q, r, 0, i) for i, (q, r) in enumerate(told)], "instruction string, response string, src_rank int, row_idx int")
    assert rows(dedupe.dominant_response(df), "row_idx") == [(1,), (2,), (3,)]


@pytest.mark.parametrize("total,ratios,want", [
    (10, {"a": 0.0, "b": 0.0}, {"core": 4, "ml_deep": 2, "signature": 2, "agent": 1, "memory": 1}),
    (10, {"a": 1.0, "b": 1.0, "c": -3}, {"a": 5, "b": 5, "c": 0}),
    (2, {"a": 1, "b": 1, "c": 1}, {"a": 1, "b": 1, "c": 0})])
def test_quota_plan(total, ratios, want):
    assert sampling.quota_plan(total, ratios) == want


# --- overlap, search, telemetry edges --------------------------------------
def test_jaccard_edges(spark):
    train = spark.createDataFrame([("a b c d e f g",), ("!!!",), ("x y",)], "text string")
    prompts = spark.createDataFrame(
        [(1, "a b c d e f g h i j"), (2, "???"), (3, "a b c d e f g h i j k"), (4, "X, Y!"), (5, "the")], "prompt_id int, prompt string")
    assert rows(overlap.jaccard_overlap(prompts, train), "prompt_id") == [(1,), (2,), (4,)]
    assert rows(overlap.exact_overlap(prompts, train), "prompt_id") == [(2,), (4,)]


def test_allowlist_edges(spark):
    urls = ["http://example.org/a", "https://www.Example.org", "http://evil-example.org", "http://example.org:80/x", "nonsense"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    ok, no = search.domain_allowlist(pages, spark.createDataFrame([("example.org",)], "domain string"))
    assert rows(ok, "url") == sorted((u,) for u in urls[:2])
    assert no.count() == 3
    assert search.domain_allowlist(pages, spark.createDataFrame([], "domain string"))[0].count() == 5


def test_search_ties_and_repeats(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "beta beta unknown"), (2, "unknown")], "query_id int, query string")
    assert rows(search.search(q, docs, 1, "knowledge"), "query_id", "doc_id", "rank") == [(1, 1, 1)]
    import math
    got = search.tfidf_join(q, docs, "web").filter("doc_id = 1").first().score
    assert abs(got - (2 * (math.log(4 / 3) + 1) + 2 * 1 / 2)) < 1e-9


def test_jobs_counts_and_expiry(spark):
    told = [("j1", "p", "queued", "2024-01-01T00:00:00Z", None), ("j2", "p", "running", "2024-01-01T00:00:00Z", None),
            ("j3", "p", "done", "2024-01-01T00:00:00Z", "2024-01-01T00:10:00Z"), ("j4", "r", "error", "2024-01-01T00:00:00Z", "junk"),
            ("j5", "r", "done", "junk", None), ("j6", "r", "done", "2024-01-01T00:00:00Z", "2024-01-01T00:59:30Z")]
    df = spark.createDataFrame(told, "job_id string, principal string, status string, created_at string, finished_at string")
    assert telemetry.job_counters(df).first().asDict() == {"queued": 1, "running": 1, "finished": 4, "total": 6}
    assert rows(telemetry.pending_jobs(df), "principal", "pending") == [("p", 2)]
    _, gone = telemetry.expire_jobs(df, 5, F.lit(1704070800.0))  # 01:00, TTL raised to 60 s
    assert rows(gone, "job_id") == [("j3",), ("j4",)]


def test_benchmark_edges(spark):
    told = [(1, "k" + "x" * 79), (2, "k" + "x" * 78), (3, "k" + "x" * 1200), (4, "z" * 100)]
    a = spark.createDataFrame(told, "case_id int, answer string")
    c = spark.createDataFrame([(i, ["k"]) for i, _ in told], "case_id int, keywords array<string>")
    assert rows(evaluate.score_benchmark(a, c), "case_id", "score", "length_ok", "passed") == [
        (1, 1.0, 1, 1), (2, 0.9, 0, 1), (3, 0.9, 0, 1), (4, 0.3, 1, 0)]


def test_guard_raises(spark):
    df = spark.createDataFrame([("good",), ("Dialog_CSV:x",)], "source string")
    with pytest.raises(ValueError):
        overlap.source_guard(df)
    overlap.source_guard(df.filter("source = 'good'"))


def test_hot_key_keeps_every_row(spark):
    """A third of all rows under one key, across many chunks."""
    hot = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"),
                                     F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("w").alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    want = hot.withColumn("p", F.lag("role").over(w)).filter("role = 'assistant' AND p = 'user'").count()
    assert pairs.training_rows(hot).count() == want
