"""Operators against plain loops, the tokenizer library, SQL and held-out labels, with edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from corpusflow.llm import imatch, mixing, pieces, pii, queries, simhash, suffix, superkmer, toxicity, vafile, warc
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, cell long, bucket string"


def make(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, "x") for i, t, s in rows], DOCS)


def awkward(seed=3):
    """Copies, near copies, shared passages, nulls, empty, blank and long texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 120))) for _ in range(40)]
    passage = " ".join(rng.choice(vocab) for _ in range(90))
    texts += [t + "\n" + passage for t in texts[:6]] + [texts[9]] * 4 + [passage + "  " + passage]
    texts += ["", "   ", None, None, "a", "ab " * 700, "x" * 2500, " ".join(rng.choice(vocab) for _ in range(4000)), "Ab\tC\x0bd"]
    return [(i, t, [None, "", "s1", "s2", "é"][i % 5]) for i, t in enumerate(texts)]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, awkward())


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def test_mixing(docs, empty, spark):
    rows = {i: (t, s) for i, t, s in awkward()}
    got = by_id(mixing.mix(docs, bucket_rows=4))
    size = {i: len(WORD.findall(t or "")) for i, (t, _) in rows.items()}
    per = defaultdict(int)
    for i, (_, s) in rows.items():
        per[s] += size[i]
    names = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(per.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * per[s]}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: 3.0 * per[s] for s in over})
        left -= sum(3 * per[s] for s in over)
        open_ -= over
    assert set(got) == set(rows)
    taken = defaultdict(int)
    for i, r in got.items():
        s = rows[i][1]
        assert (r.size, r.source_size) == (size[i], per[s]) and abs(r.target - target[s]) < 1e-6
        assert r.taken == r.copies * r.size and r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max((size[i] for i in rows if rows[i][1] == s), default=0)
    again = by_id(mixing.mix(docs.repartition(7), bucket_rows=4))
    assert {i: r.taken for i, r in got.items()} == {i: r.taken for i, r in again.items()}
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_rows(docs.union(docs.limit(3))).columns == docs.columns


def test_pivotal_keeps_probabilities():
    hits = np.zeros(12)
    part, size = np.full(12, 0.3), np.arange(1, 13) * 10
    for seed in range(1500):
        taken, held, p = mixing.settle_fractions(np.arange(12), size, part, seed)
        hits += taken
        if held >= 0:
            hits[held] += p
            assert abs((taken * size).sum() + p * size[held] - (part * size).sum()) < 1e-6
    assert np.abs(hits / 1500 - 0.3).max() < 0.06


def test_toxicity_held_out(spark, root, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = (toxicity.score(docs.select("doc_id", "lang", "text"), model).join(labels, "doc_id")
            .filter(toxicity._held_out("doc_id")).select("toxic_score", "toxic_reject", "toxic").collect())
    order = sorted(rows, key=lambda r: r.toxic_score)
    ranks = [k + 1 for k, r in enumerate(order) if r.toxic]
    pos, neg = len(ranks), len(rows) - len(ranks)
    assert (sum(ranks) - pos * (pos + 1) / 2) / (pos * neg) > 0.9
    assert sum(r.toxic_reject for r in rows if not r.toxic) < 0.05 * neg
    odd = by_id(toxicity.score(make(spark, awkward()), model))
    assert all(0 <= r.toxic_score <= 1 for r in odd.values()) and len(odd) == len(awkward())
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0


def plain_spans(t):
    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                           r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            total = sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(d[::-1]))
            if (k == 1 and any(int(x) > 255 for x in m.group().split("."))) or (k == 2 and not (13 <= len(d) <= 19 and total % 10 == 0)) \
                    or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_pii(spark, root, empty):
    rng = random.Random(1)
    for _ in range(20000):
        t = "".join(rng.choice("a1.@+- _(9.é4") for _ in range(rng.randint(0, 60)))
        assert sorted(pii.base_spans(t)) == sorted(plain_spans(t))
    assert pii.base_spans("a" * 200_000 + " " + "1" * 200_000) == []
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    hits = found = 0
    for r in pii.find(docs, model).collect():
        base = plain_spans(texts[r.doc_id])
        assert r.base == pii.as_text(base) and set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
        alone = pii.added_spans(model, [texts[r.doc_id]], [[]])[0]
        hits += len(set(alone) & set(base))
        found += len(base)
    assert hits > 0.5 * found  # what the network finds without the patterns
    masked = pii.mask(make(spark, [(1, "to a.b@c.de, 8.8.8.8", "s"), (2, None, "s"), (3, "", "s"), (4, "plain", "s")]), model)
    assert {r.doc_id: r.text for r in masked.collect()} == {1: "to <email>, <ip>", 2: None, 3: "", 4: "plain"}
    assert pii.find(empty, pii.train(empty)).count() == 0


def test_pii_gradient():
    m = pii.new_tagger(1)
    x = np.random.default_rng(0).integers(0, 130, (3, 7))
    y = np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [5, 6, 0, 7, 8, 8, 0]])
    _, grads = pii.loss_and_gradient(m, x, y)
    for p, g in zip((m.chars, m.w, m.b, m.tags, m.tag_bias, m.moves), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = p[at]
        p[at] = keep + 1e-2
        up = pii.loss_and_gradient(m, x, y)[0]
        p[at] = keep - 1e-2
        down = pii.loss_and_gradient(m, x, y)[0]
        p[at] = keep
        assert abs(g[at] - (up - down) / 2e-2) < 1e-3


def test_imatch(docs, empty):
    rows = sorted(((i, t or "") for i, t, _ in awkward()), reverse=True)
    got = by_id(imatch.edited_fingerprints(docs))
    prints = {}
    for k, (i, t) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)], len(t)
        edited = t[:n - n // 3] + after[1][:n // 3]
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and (got[i].near_next == 1 or got[i].fingerprint != got[after[0]].fingerprint)
    assert {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs).collect()} == {i: r.fingerprint for i, r in got.items()}
    assert imatch.edited_fingerprints(empty).count() == 0


def test_warc(spark):
    pages = [(i, f"http://x/{i}\n", t) for i, t, _ in awkward()] + [(None, None, "lonely"), (500, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n")]
    df = spark.createDataFrame([(*p, 7) for p in pages], "page_id long, url string, html string, offset long")
    got = {r.page_id: r for r in warc.round_trip(df, per_file=9).collect()}
    best = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    import base64
    for i, _, h in pages:
        body = (h or "").encode()
        r, lead = got[i], best[h or ""]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if lead in (i, -1) else ("revisit", lead))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_superkmer(docs, empty, spark):
    seen, want = set(), {}
    for i, t, _ in awkward():
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            k = tuple(w[a:a + 20])
            if k in seen:
                gone[a:a + 20] = [True] * 20
            seen.add(k)
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    for df in (docs, docs.repartition(5)):
        assert {i: (r.n_words, r.n_removed, r.kept) for i, r in by_id(superkmer.remove_repeats(df)).items()} == want
    assert superkmer.remove_repeats(empty).count() == 0
    twice = make(spark, [(1, "a b c d", "s"), (1, "a b c d", "s"), (None, "a b c d", "s")])
    assert sorted((str(r.doc_id), r.n_removed) for r in superkmer.remove_repeats(twice, window=2).collect()) == [("1", 0), ("1", 0), ("None", 4)]


@pytest.mark.parametrize("length,reach", [(400, 256), (60, 30)])
def test_suffix(docs, empty, length, reach):
    rows = [(i, (t or "").encode()) for i, t, _ in awkward()]
    n = Counter(t[a:a + length] for _, t in rows for a in range(len(t) - length + 1))
    want = {}
    for i, t in rows:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if n[t[a:a + length]] > 1:
                gone[a:a + length] = b"\1" * length
        want[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(t, gone) if not g))
    got = by_id(suffix.remove_repeats(docs, length, reach))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in got.items()} == want
    assert suffix.remove_repeats(empty).count() == 0


def test_suffix_levels():
    family, seen, hits = suffix.SuffixLevels(), {}, set()
    rng = np.random.default_rng(4)
    at = 0
    for _ in range(30):
        keys = np.unique(rng.integers(0, 400, 20)).astype(np.uint64)
        hits |= set(family.add(keys, at + np.arange(len(keys))).tolist())
        for k in keys.tolist():
            seen.setdefault(k, []).append(at)
            at += 1
    assert hits == {p for places in seen.values() if len(places) > 1 for p in places}
    assert len(family.levels) <= 10


def plain_simhash(text, words=4):
    w = ["".join(c.lower() if c < "\x7f" else c for c in x) for x in WORD.findall(text or "")]
    s = [" ".join(w[k:k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, empty):
    rows = {i: plain_simhash(t) for i, t, _ in awkward()}
    got = by_id(simhash.near_duplicates(docs))
    assert {i: r.fp % 2**64 for i, r in got.items()} == rows
    low = {i: i for i in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if bin(rows[a] ^ rows[b]).count("1") <= 4:
                    low[a] = low[b] = min(low[a], low[b])
    assert {i: r.component_id for i, r in got.items()} == low
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(docs.union(docs.limit(3)))
    assert kept.columns == docs.columns and kept.count() == kept.select("doc_id").distinct().count()


@pytest.mark.parametrize("segments,blocks", [(32, 3), (32, 5), (16, 2)])
def test_simhash_links(spark, segments, blocks):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fp = list(base)
    for x in base:
        for d in range(1, 7):
            fp.append(x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, d, replace=False).astype(np.uint64)))
    fp = np.unique(np.array(fp, np.uint64))
    found = simhash.links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), 4, segments, blocks)
    root = {int(r.node): int(r.root) for r in simhash.components(found).collect()}
    want = {int(x): int(x) for x in fp.view(np.int64)}
    near = [(int(a), int(b)) for a in fp.view(np.int64) for b in fp.view(np.int64) if a < b and bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") <= 4]
    for _ in range(12):
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
    assert {x: root.get(x, x) for x in want} == want


def plain_shingles(t, words=5):
    return set(zip(*[t.split()[k:] for k in range(words)]))


def plain_jaccard(a, b):
    return len(a & b) / len(a | b)


def plain_kept(texts, least=0.8):
    held = [plain_shingles(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if plain_jaccard(held[a], held[b]) >= least]
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return {k for k, r in enumerate(root) if k == r}


def test_keep_one_similarity(spark, monkeypatch):
    """Pairs of any similarity from 0.6 on; then many copies of one text, whose keys hold more texts than SMALL."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, likes = [], []
    for k in range(40):
        base = words(104)
        near = base[:]
        for at in range(k % 5 + 1):
            near[10 + 20 * at] = "other"
        texts += [" ".join(base), " ".join(near)]
        likes.append(plain_jaccard(*map(plain_shingles, texts[-2:])))
    assert sum(0.8 <= x < 0.9 for x in likes) >= 8 and sum(x < 0.8 for x in likes) >= 8
    got = simhash.keep_one(make(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    assert {r.doc_id for r in got.collect()} == plain_kept(texts)

    monkeypatch.setattr(simhash, "SMALL", 8)
    base = words(60)
    texts = [" ".join(w if rng.random() > 0.02 else f"v{rng.randrange(10**6)}" for w in base) for _ in range(50)]
    got = simhash.keep_one(make(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    assert {r.doc_id for r in got.collect()} == plain_kept(texts)


def test_keep_one_shared_ids(spark):
    """Different texts that share a doc_id both stay; a near copy goes although its doc_id is kept elsewhere."""
    one, two, three = (" ".join(f"{c}{k}" for k in range(80)) for c in "xyz")
    near = "other " + one
    rows = [(1, one, "s"), (5, two, "s"), (5, three, "s"), (5, near, "s"), (6, two, "s"), (7, "own", "s"), (7, "own", "s")]
    got = simhash.keep_one(make(spark, rows))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(1, one), (5, two), (5, three), (7, "own")])


def test_pieces(docs, empty, spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(2)
    rows = awkward() + [(900 + k, "".join(rng.choice("abehtin  \n.,É漢é1▁\t😀") for _ in range(rng.randint(0, 80))), "s") for k in range(40)]
    rows += [(990, " lead  and trail ", "s"), (991, "supercalifragilistic" * 9, "s")]
    texts = {i: t or "" for i, t, _ in rows}
    coded = pieces.encode(make(spark, rows))
    got = by_id(coded)
    assert {i: list(r.ids) for i, r in got.items()} == {i: sp.encode(t) for i, t in texts.items()}
    assert {i: r.text for i, r in by_id(pieces.decode(coded)).items()} == {i: t.replace("▁", " ") for i, t in texts.items()}
    assert pieces.encode(empty).count() == 0


def test_pieces_by_lattice(spark):
    v = pieces.read_vocabulary()
    words = ["▁the", "▁mississippi", "漢字", "▁unbelievable", "a", "▁▁▁▁x", "éàü"]
    rows = {r.word: r.cuts for r in pieces.cut_words(spark.createDataFrame([(w,) for w in words], "word string"), v).collect()}
    assert all(pieces._ids(w, rows.get(w), v) == pieces.merge(w, v) for w in words)


def test_vafile(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 360)]  # ties
    rows += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (None, rows[0][1]), (450, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, block int")
    use = [(i, np.floor(np.array(v) * 256).astype(np.int64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q, v in use:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in use if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for block in (64, 10_000):
        assert sorted(map(tuple, vafile.top_k(df, block=block, query_block=3).collect())) == sorted(want)
    assert vafile.top_k(df.limit(0)).count() == 0 and vafile.top_k(df.filter("vec_id in (50, 51)")).count() == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, root, name):
    assert compare(queries.QUERIES[name](spark, root), connect(root), queries.ORACLES[name]) == ""


def test_pipeline_stages(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "sentencepiece"]
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        from corpusflow.session import settle
        out = settle(stage(spark, docs, root))
        if k < 4:
            assert out.columns == spark.read.parquet(f"{root}/documents.parquet").columns
        if k < 3:
            assert 0.5 * n < out.count() <= n
        docs = out
    assert set(docs.columns) == {"doc_id", "ids", "n_tokens"} and docs.count() > 0
