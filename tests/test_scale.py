"""Borders of a top-n, positions, entities, dialog literals and overlap against plain Python."""

import html
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators import overlap, sampling, scan, search


def test_border_is_split_until_it_is_small(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 50) if i % 3 else 7) for i in range(5000)]  # a third of the rows share one score
    df = spark.createDataFrame(rows, "id bigint, score bigint").repartition(6)
    order = [F.col("score"), F.col("id")]
    best = sorted(rows, key=lambda r: (r[1], r[0]))
    for need in (1, 40, 700, 2500, 4999, 5000, 6000):
        got = scan._first_of(df, order, need, small=30)
        assert sorted(map(tuple, got.collect())) == sorted(best[:need])
    same = spark.createDataFrame([(1, 1)] * 300, "id bigint, score bigint").repartition(4)
    assert scan._first_of(same, order, 120, small=30).count() == 120


def test_top_n_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(scan, "SMALL_BORDER", 25)
    rows = [(i, (i * 37) % 11) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, score bigint").repartition(5)
    got = scan.take_first(df, 900, [F.col("score"), F.col("id")], F.col("score"))
    assert sorted(map(tuple, got.collect())) == sorted(sorted(rows, key=lambda r: (r[1], r[0]))[:900])
    assert scan.take_first(df.limit(0), 900, [F.col("score"), F.col("id")], F.col("score")).count() == 0


def test_heads_of_long_files(spark):
    rows = [(f, i * 3) for f, n in (("a", 4000), ("b", 5), ("c", 900)) for i in range(n)]
    df = spark.createDataFrame(rows, "file string, row_idx bigint").repartition(5)
    for n in (1, 7, 1000):
        want = sorted((f, i) for f in "abc" for i in sorted(x for g, x in rows if g == f)[:n])
        assert sorted(map(tuple, sampling.head_per_file(df, n, ["file"]).collect())) == want
    buckets = df.select(F.floor(F.log2(F.col("row_idx") + F.lit(1.0)) * 256)).distinct().count()
    assert buckets < 2700  # grows with the logarithm of the length


def test_references_as_python_reads_them(spark):
    rng = random.Random(4)
    bits = ["&", "&amp;", "&amp", "&lt;b", "&notit;", "&notin;", "&#65;", "&#x41", "&#0;", "&#128;", "&#129;", "&#xD800;", "&#x110000;", "&#99999999999999999999;",
            "&#1;", "&#13;", "&#x1F600;", "&copy2", "&CounterClockwiseContourIntegral;", "&NotEqualTilde;", "&;", "& x", "&#;", "&#x;", "é", "a;b", "<", "&eacute", "&hellip;z"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 7))) for _ in range(400)] + bits
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.u for r in df.select("i", tx.unescape("t").alias("u")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == html.unescape(t), t
    plan = df.select(tx.html_text("t"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and spark.range(1).select(tx.unescape_some(F.lit(None).cast("string")).alias("x")).first().x is None


def test_dialogs_by_their_quotes(spark):
    rng = random.Random(5)
    words = ["hi", "there", "ok.", "well,", "don", "a-b", "1"]
    turns = [[" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) + rng.choice(["", "'s it", "?"]) for _ in range(rng.randint(2, 6))] for _ in range(60)]
    listed = [str(t) for t in turns]
    spaced = ["[" + " ".join(f'"{x}"' if "'" in x else f"'{x}'" for x in t) + "]" for t in turns]
    broken = ["[" + "\n ".join(f"'{x}'" for x in t) + "]" for t in turns]  # quotes inside stay open
    clean = lambda x: re.sub(r"\s+([,;:.!?])", r"\1", x).strip("\"'")
    for texts in (listed, spaced, broken):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        for r in df.select("i", tx.parse_dialog("t").alias("d")).collect():
            assert r.d == [clean(x) for x in turns[r.i]]
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "no quotes"), (3, "['only one']"), (4, "\"['a b' 'c']\""), (5, "['a &amp; b' 'c\\n d']")], "i int, t string")
    assert [r.d for r in odd.select("i", tx.parse_dialog("t").alias("d")).orderBy("i").collect()] == [[], [], [], [], ["a b", "c"], ["a & b", "c d"]]


def plain_tokens(text):
    return set(re.sub(r"[^a-z0-9\s]", " ", text.lower()).split())


def test_overlap_of_changed_prompts(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of"] * 20
    lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    prompts = [" ".join(w for k, w in enumerate(x.split()) if (k + i) % 5) for i, x in enumerate(lines)] + ["", "zz yy", lines[3].upper() + "!"]
    train = spark.createDataFrame([(x,) for x in lines + ["  ", lines[0]]], "text string")
    asked = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)] + [(0, prompts[0])], "prompt_id int, prompt string")
    known = [plain_tokens(x) for x in lines if x.strip()]
    for threshold in (0.5, 0.7, 0.9, 1.0):
        def near(p):
            a = plain_tokens(p)
            return any((not a and not b) or (a and b and len(a & b) / len(a | b) >= threshold) for b in known)
        want = Counter(i for i, p in enumerate(prompts + [prompts[0]]) if near(p))
        want = Counter({i % len(prompts): 0 for i in want}) + Counter(i % len(prompts) for i in want.elements())
        got = Counter(r.prompt_id for r in overlap.jaccard_overlap(asked, train, threshold).collect())
        assert got == want


def test_pairs_of_an_overlap_are_keys(spark, root):
    from corpusflow.catalog.relations import _passages
    plan = overlap.jaccard_overlap(*_passages(spark, root), 0.7)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_search_keeps_the_best_of_each_task(spark):
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 17} w{i % 5} gamma") for i in range(400)], "doc_id bigint, text string").repartition(7)
    queries = spark.createDataFrame([(0, "alpha w3 w16"), (1, "beta w1 gamma"), (2, "none")], "query_id bigint, query string")
    best = search.topk_per_query(search.tfidf_join(queries, docs, "web"), 3, ["doc_id"])
    plan = best._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    every = search.tfidf_join(queries, docs, "web").collect()
    for q in (0, 1, 2):
        want = sorted(((-round(r.score, 6), r.doc_id) for r in every if r.query_id == q))[:3]
        assert sorted((r.rank, r.doc_id) for r in best.collect() if r.query_id == q) == [(k + 1, d) for k, (_, d) in enumerate(want)]
