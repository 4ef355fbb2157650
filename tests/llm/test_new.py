"""Alignment, fertility rules and whitening against plain loops, with edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import align, fertility, queries, whiten

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_alignment(rows):
    t, each, held = align.tokenizers(), [], Counter()
    for i, x in rows:
        a, b = ([], []) if not x else (t.a.encode(" " + x, add_special_tokens=False).ids, t.b.encode(x))
        whole = b"" if not x else (" " + x).encode()
        if any(b"".join(raw[k] for k in ids) != whole for raw, ids in ((t.raw_a, a), (t.raw_b, b))):
            a, b = [], []
        groups, ca, cb, pa, pb, ib = [], [], [], 0, 0, iter(b)
        for k in a:
            ca.append(k)
            pa += len(t.raw_a[k])
            while pb < pa:
                cb.append(next(ib))
                pb += len(t.raw_b[cb[-1]])
            if pa == pb:
                groups.append((ca, cb))
                ca, cb = [], []
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        each.append((i, len(a), len(b), groups, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
        held.update({(x, y) for xs, ys in groups for x in xs for y in ys})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for i, n_a, n_b, groups, sha in each:
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        out.append((i, n_a, n_b, len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha))
    return sorted(out, key=repr)


def odd_texts():
    rng = random.Random(5)
    bits = ["the ", "ing", "  ", "\n", "\n\n", " ", "é", "漢字", "　", "\xa0", " a", "<|endoftext|>", "</s>", "\x00", "😀", "x" * 30, "12345", "don't", "$$$ ", "\t", "\r\n"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for k in range(80)]
    rows += [(k, "".join(rng.choice([*bits, "▁"]) for _ in range(8))) for k in range(100, 120)]
    long = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(900))
    rows += [(1000, None), (1001, ""), (None, "abc"), (None, "abc"), (7, "a b"), (7, "a b"), (2000, long), (2000, long), (2000, long)]
    return rows + [(2001, "漢" * 900), (2002, "x" * 900 + " y"), (2003, "a\nb " * 300), (2004, " " * 700), (2005, "a b ▁ " * 100)]


@pytest.mark.parametrize("chunk", [1 << 18, 64, 200])
def test_alignment(spark, chunk):
    rows = [(i, t, 1, "x", 5) for i, t in odd_texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block long, own string, part int")
    got = sorted((tuple(r) for r in align.align(docs.repartition(5), chunk=chunk).collect()), key=repr)
    assert got == plain_alignment([(i, t) for i, t, *_ in rows])
    assert align.align(docs.limit(0), chunk=chunk).count() == 0


def test_alignment_of_real_documents(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES["op11_align"](spark, root).collect()), key=repr)
    assert got == plain_alignment([(r.doc_id, r.text) for r in docs.collect()])


def test_ranges_cover_a_text_once():
    rng = random.Random(1)
    for _ in range(300):
        text = " " + "".join(rng.choice("ab \n漢") for _ in range(rng.randint(0, 400)))
        found = align.ranges(text, 50)
        assert [lo for _, _, lo, _ in found][1:] == [hi for _, _, _, hi in found][:-1] and (found[0][2], found[-1][3]) == (0, len(text))
        assert all(x <= lo < hi <= y for x, y, lo, hi in found) or len(text) == 1
    solid = " " + "x" * 100_000
    assert align.ranges(solid + " y" * 10, 5000)[0][3] == len(solid)  # no border inside a stretch without a way out


def test_composition_is_associative():
    t = align.tokenizers()
    rng = random.Random(4)
    for _ in range(60):
        text = " " + "".join(rng.choice(["the ", "ing", "é", "漢", "don't", "12345 ", "\n"]) for _ in range(rng.randint(1, 40)))
        (a,), (b,) = t.encode([text])
        whole = text.encode()
        cuts = sorted({0, len(whole), *(rng.randint(0, len(whole)) for _ in range(6))})
        parts = [align.fragment(a, b, whole, lo, hi, t) for lo, hi in zip(cuts, cuts[1:])]
        while len(parts) > 1:  # any order of composition
            k = rng.randrange(len(parts) - 1)
            parts[k:k + 2] = [align.compose(parts[k], parts[k + 1], t)]
        one, two = align.fragment(a, b, whole, 0, len(whole), t), parts[0]
        assert all(np.array_equal(getattr(one, n), getattr(two, n)) for n in align._NAMES)


def test_wide_groups():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 7, 260)
    na, nb = np.array([100, 200]), np.array([60, 200])
    pairs, times = align._summed(*align._linked(a, b, na, nb, 10)[:2])
    want = Counter(int(x) * 10 + int(y) for xs, ys in ((a[:100], b[:60]), (a[100:], b[60:])) for x in xs for y in ys)
    assert dict(zip(pairs.tolist(), times.tolist())) == want


def plain_counts(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def plain_measures(text, vocabularies):
    byte_level, sp, fallback = vocabularies
    words = WORD.findall(text or "")
    one = [i for w in words for i in byte_level.encode_ordinary(" " + w)]
    two = [i for w in words for i in sp.encode(w)]
    if not words or len(one) < 2:
        return None
    same = sum(n * (n - 1) for n in Counter(one).values())
    chars = sum(map(len, words))
    return chars / len(one), chars / len(two), sum(bool(fallback[i]) for i in two) / len(two), np.log2(len(one) * (len(one) - 1) / max(same, 1))


def test_fertility(spark, root):
    rng = random.Random(2)
    bits = ["a", "b", "\n", "\n", " ", "\t", "é", "漢", "#", "*", "\r", "ab cd ef", " x ", ""]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 200))), rng.choice(["en", "fr-CA", "", None, "1x"]), 1) for i in range(200)]
    rows += [(None, None, None, 1), (None, None, None, 1), (1001, "", None, 1), (1002, "  \n\n", "", 1)] + [(1003, "a a a a a\na a a a a\n", "xx-YY", 1)] * 2
    rows += [(1004, "漢字 かな " * 40000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, language int")
    got = fertility.judge(docs).collect()
    plain = lambda r: (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    want = [(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, c in ((i, plain_counts(t)) for i, t, *_ in rows)]
    assert sorted(map(plain, got), key=repr) == sorted(want, key=repr)
    assert not any(r.kept for r in got if r.base_failed)
    vocabularies, texts = fertility._vocabularies(fertility.BYTE_RANKS, fertility.PIECES), {i: t for i, t, *_ in rows}
    for r in got:
        m = plain_measures(texts[r.doc_id], vocabularies)
        assert m is None or np.allclose(m, [r[name] for name, *_ in fertility.MEASURES])
    assert {r.language for r in got} >= {"en", "fr", "xx"} and next(r.language for r in got if r.doc_id == 1004) == "han"
    assert fertility.judge(docs.limit(0)).count() == 0 and fertility.judge(docs.select("doc_id", "text")).count() == len(rows)


def test_bands_are_exact_quartiles(spark):
    rng = random.Random(3)
    rows = [(["en", "de", "xx"][min(i % 7, 2) if i > 40 else 2 if i < 5 else 0], *(rng.random() * 4 for _ in fertility.MEASURES)) for i in range(400)]
    names = [m for m, *_ in fertility.MEASURES]
    got = {r.language: r for r in fertility.bands(spark.createDataFrame(rows, ", ".join(["language string", *(f"{m} double" for m in names)])), least_rows=80).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
        by[""].append(r)
    assert set(got) == {k for k, v in by.items() if len(v) >= 80 or k == ""}
    for language, r in got.items():
        for k, (m, step, slack) in enumerate(fertility.MEASURES):
            v = sorted(int(np.floor(x[k + 1] / step + 0.5)) for x in by[language])
            low, high = (v[-(-len(v) * q // 4) - 1] * step for q in (1, 3))
            wide = max(fertility.FENCE * (high - low), slack)
            assert abs(r[f"{m}_low"] - (low - wide)) < 1e-9 and abs(r[f"{m}_high"] - (high + wide)) < 1e-9


def test_fertility_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = fertility.judge(docs).join(labels, "doc_id").filter("NOT base_failed").select("quality", "kept").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_components():
    rng = np.random.default_rng(1)
    turn, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    tables = [np.cov((rng.standard_normal((300, n)) * np.linspace(1, 5, n)).T).reshape(n, n) for n in (1, 2, 3, 17, 64)]
    tables += [np.eye(10), np.zeros((4, 4)), np.ones((30, 30)), (turn * ([5] * 10 + [5 + 1e-12] * 5 + [1] * 25)) @ turn.T, np.diag([1.0, 2, 2, 2, 3]), np.kron(np.eye(8), [[2.0, 1], [1, 2]])]
    for v in tables:
        m = min(len(v), 32)
        values, vectors = whiten.leading_components(v, m)
        want, size = np.sort(np.linalg.eigvalsh(v))[::-1][:m], max(np.abs(v).max() * len(v), 1e-200)
        assert np.abs(values - want).max() <= 1e-13 * size and np.abs(v @ vectors.T - vectors.T * values).max() <= 1e-12 * size
        assert np.abs(vectors @ vectors.T - np.eye(m)).max() < 1e-12


def test_whitening(spark, root):
    table = spark.read.parquet(f"{root}/embeddings.parquet")
    odd = spark.createDataFrame([(None, [1.0] * 64), (-5, None), (-6, [None] * 64), (-7, [float("nan")] * 64), (-8, [float("inf")] + [0.0] * 63), (-9, []), (-10, [1.0])],
                                "vec_id long, embedding array<float>")
    table = table.select("vec_id", "embedding").unionByName(odd).withColumn("x", F.lit(1)).withColumn("n", F.lit("w"))
    rows = [r for r in table.collect() if r.embedding and len(r.embedding) == 64 and all(c is not None and np.isfinite(c) for c in r.embedding)]
    got = whiten.whiten(table.repartition(3)).collect()
    x = np.floor(np.array([r.embedding for r in rows], float) * 64).astype(np.int64) + 1_000_000
    n, d = len(x), x * len(x) - x.sum(axis=0)
    values, vectors = np.linalg.eigh((d / n).T @ (d / n) / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    want, at = (d / n) @ (vectors / np.sqrt(values)), {r.vec_id: k for k, r in enumerate(rows)}
    assert len(got) == 32 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    signs = {}
    for r in got:
        k, c = at[r.vec_id], r.component - 1
        assert r.deviation == int((d[k].astype(object) ** 2).sum()) and abs(r.explained - values[c] / ((d / n) ** 2).mean(axis=0).sum()) < 1e-9
        assert abs(abs(r.whitened) - abs(want[k, c])) < 1e-6
        if abs(want[k, c]) > 1e-3:
            assert signs.setdefault(c, np.sign(want[k, c]) == np.sign(r.whitened)) == (np.sign(want[k, c]) == np.sign(r.whitened))


def test_whitening_edges(spark):
    make = lambda rows, kind="float": spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    for rows in ([], [(1, None), (2, [1.0, None]), (3, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        assert whiten.whiten(make(rows)).collect() == []
    got = whiten.whiten(make([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0]), (4, [5.0])])).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, int(r.deviation)) for r in got) == [(0, 1, 3, 65536), (1, 1, 3, 16384), (1, 1, 3, 16384)]
    wide = [(i, [float(1 << (40 + i)), 1.0, -float(1 << 45) * i]) for i in range(5)]
    x = [[int(np.floor(c * 64)) + 1_000_000 for c in v] for _, v in wide]
    sums = [sum(c) for c in zip(*x)]
    got = {r.vec_id: int(r.deviation) for r in whiten.whiten(make(wide, "double")).collect()}
    assert got == {i: sum((5 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    with pytest.raises(Exception, match="64 bits"):
        whiten.whiten(make([(1, [1e300]), (2, [0.0])], "double")).collect()


def test_stages_leave_columns_of_any_name_alone(spark):
    import corpus_pipeline
    from corpusflow.llm import mixing, pieces, simhash
    texts = ["a b c d e f", "a b c d e f", None, "", "other words of another text here", "x " * 3000]
    names = ["_key", "_k", "_copies", "_rows", "_row", "row", "sig", "toxic_score", "toxic_reject"]
    rows = [(i % 5, t, "en", "s", *([700 + i] * len(names))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = {tuple(r) for r in docs.collect()}
    for made in (mixing.mixed_rows(docs), simhash.keep_one(docs)):
        assert made.columns == docs.columns and {tuple(r) for r in made.collect()} <= want and made.count()
    from corpusflow.llm import toxicity
    model = toxicity.train(docs, labels)
    with pytest.raises(ValueError, match="taken"):
        toxicity.score(docs, model)
    assert toxicity.score(docs, model, ("a", "b")).columns == [*docs.columns, "a", "b"]
    coded = pieces.encode(docs).withColumn("text", F.lit("old"))
    assert {r.doc_id: r.text for r in pieces.decode(coded).collect()}[4] == "other words of another text here"
    assert corpus_pipeline.without_personal_data(spark, docs, "").columns == docs.columns
