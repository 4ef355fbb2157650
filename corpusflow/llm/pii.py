"""Personal data by patterns and by a character-level bidirectional LSTM with CRF transitions.

Emails, addresses of machines, cards and phone numbers that fit the patterns are always found. The network
is trained in numpy on windows around such labelled spans and on rewritten ones (a phone number without
its plus sign, say), and adds spans that the patterns miss. It reads overlapping windows; each window is
decoded with the best path of the CRF, and the spans of all windows of a text are reconciled together:
the set without overlaps that has the largest total margin stays.

All four kinds hold a digit or an @ sign, so windows are laid over every stretch that has one; a text
without either has no spans of any kind and is not sent to Python at all."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
HIDDEN, DIMS = 16, 12
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
MAX_WINDOWS = 1500
MARGIN = 1.0  # of the tag scores over staying outside, on average over a span

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its first digit fails from all, so only the first is tried
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# characters as the network sees them: ASCII one by one, other letters, the rest
_CODES = 130


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _valid(kind: str, text: str) -> bool:
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and (len(p.lstrip("0")) < 4 and int(p) <= 255) for p in parts)
    if kind == "card":
        d = _digits(text)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(text)) <= 15
    host = text.rpartition("@")[2]
    return "@" in text[1:] and "." in host[1:-1] and not any(c.isspace() for c in text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the patterns: leftmost and non-overlapping per kind, failing matches dropped."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        # the local part is the run of its characters before the sign, as far as the last match left it
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((0, start, host.end()))
            floor = host.end()
        at = text.find("@", max(at + 1, floor))
    for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(k, m.start(), m.end()) for m in pattern.finditer(text) if _valid(KINDS[k], m.group())]
    return out


def encode_chars(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, code, 128 + (code > 0x24F)).astype(np.int16)


# --- the network -----------------------------------------------------------
@dataclass
class Tagger:
    """Character embedding, LSTM weights of both directions, tag layer and CRF transitions."""

    chars: np.ndarray   # codes x DIMS
    w: np.ndarray       # 2 x (DIMS + HIDDEN) x 4 HIDDEN
    b: np.ndarray       # 2 x 1 x 4 HIDDEN
    tags: np.ndarray    # 2 HIDDEN x TAGS
    tag_bias: np.ndarray
    moves: np.ndarray   # TAGS x TAGS


def _allowed() -> np.ndarray:
    """Inside follows begin or inside of its kind only."""
    a = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        a[:, 2 + 2 * k] = False
        a[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return a


_BAN = np.where(_allowed(), 0.0, -1e4).astype(np.float32)
_FIRST_BAN = np.array([0.0] + [0.0, -1e4] * len(KINDS), np.float32)


def new_tagger(seed: int) -> Tagger:
    rng = np.random.default_rng(seed)
    n = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    bias = np.zeros((2, 1, 4 * HIDDEN), np.float32)
    bias[:, :, HIDDEN:2 * HIDDEN] = 1.0
    return Tagger(n(_CODES, DIMS, scale=0.3), n(2, DIMS + HIDDEN, 4 * HIDDEN, scale=0.2), bias,
                  n(2 * HIDDEN, TAGS, scale=0.2), np.zeros(TAGS, np.float32), n(TAGS, TAGS, scale=0.05))


def _sig(x):
    return 1 / (1 + np.exp(-x))


def _lstm(m: Tagger, x: np.ndarray, keep: bool):
    """x: batch x time codes. Hidden states 2 x time x batch x HIDDEN, the second direction still reversed."""
    n, t = x.shape
    e = np.stack([m.chars[x.T], m.chars[x.T[::-1]]])
    pre = e.reshape(2, t * n, DIMS) @ m.w[:, :DIMS] + m.b
    pre = pre.reshape(2, t, n, 4 * HIDDEN)
    wh = m.w[:, DIMS:]
    h = np.zeros((2, n, HIDDEN), np.float32)
    c = np.zeros_like(h)
    hs = np.zeros((2, t, n, HIDDEN), np.float32)
    trace = []
    for k in range(t):
        z = pre[:, k] + h @ wh
        g = _sig(z[..., :3 * HIDDEN])
        i, f, o = g[..., :HIDDEN], g[..., HIDDEN:2 * HIDDEN], g[..., 2 * HIDDEN:]
        u = np.tanh(z[..., 3 * HIDDEN:])
        before, last = c, h
        c = f * c + i * u
        tc = np.tanh(c)
        h = o * tc
        hs[:, k] = h
        if keep:
            trace.append((i, f, o, u, before, tc, last))
    return e, hs, trace


def emissions(m: Tagger, x: np.ndarray, keep: bool = False):
    e, hs, trace = _lstm(m, x, keep)
    both = np.concatenate([hs[0], hs[1, ::-1]], axis=-1)  # time x batch x 2 HIDDEN
    return both @ m.tags + m.tag_bias, both, e, hs, trace


def viterbi(m: Tagger, x: np.ndarray):
    """Best tags, batch x time, and the margin of every position's tag over staying outside."""
    emit = emissions(m, x)[0]
    t, n, _ = emit.shape
    moves = m.moves + _BAN
    score = emit[0] + _FIRST_BAN
    back = np.zeros((t, n, TAGS), np.int8)
    for k in range(1, t):
        s = score[:, :, None] + moves[None]
        back[k] = s.argmax(axis=1)
        score = s.max(axis=1) + emit[k]
    best = np.zeros((t, n), np.int8)
    best[-1] = score.argmax(axis=1)
    for k in range(t - 1, 0, -1):
        best[k - 1] = back[k, np.arange(n), best[k]]
    margin = np.take_along_axis(emit, best[:, :, None].astype(np.int64), axis=2)[:, :, 0] - emit[:, :, 0]
    return best.T, margin.T


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def loss_and_gradient(m: Tagger, x: np.ndarray, y: np.ndarray):
    """Negative log-likelihood of the tag paths y (batch x time) and the gradient of every part."""
    emit, both, e, hs, trace = emissions(m, x, True)
    t, n, _ = emit.shape
    moves = m.moves + _BAN
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    alpha[0] = emit[0] + _FIRST_BAN
    for k in range(1, t):
        alpha[k] = _logsum(alpha[k - 1][:, :, None] + moves[None], 1) + emit[k]
    for k in range(t - 2, -1, -1):
        beta[k] = _logsum(moves[None] + (emit[k + 1] + beta[k + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    yt = y.T.astype(np.int64)
    gold = np.take_along_axis(emit, yt[:, :, None], 2)[:, :, 0].sum(axis=0) + moves[yt[:-1], yt[1:]].sum(axis=0)
    d_emit = np.exp(alpha + beta - z[None, :, None])
    np.put_along_axis(d_emit, yt[:, :, None], np.take_along_axis(d_emit, yt[:, :, None], 2) - 1, 2)
    d_moves = np.zeros_like(m.moves)
    for k in range(1, t):
        d_moves += np.exp(alpha[k - 1][:, :, None] + moves[None] + (emit[k] + beta[k])[:, None, :] - z[:, None, None]).sum(axis=0)
    np.add.at(d_moves, (yt[:-1].ravel(), yt[1:].ravel()), -1)
    d_emit, d_moves = (d_emit / n).astype(np.float32), (d_moves / n).astype(np.float32)
    d_tags = both.reshape(-1, 2 * HIDDEN).T @ d_emit.reshape(-1, TAGS)
    d_both = d_emit @ m.tags.T
    d_hs = np.stack([d_both[..., :HIDDEN], d_both[::-1, :, HIDDEN:]])
    wh = m.w[:, DIMS:]
    d_z = np.zeros((2, t, n, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    last = np.zeros((2, t, n, HIDDEN), np.float32)
    for k in range(t - 1, -1, -1):
        i, f, o, u, before, tc, h0 = trace[k]
        last[:, k] = h0
        dh = dh + d_hs[:, k]
        dc = dc + dh * o * (1 - tc * tc)
        d_z[:, k] = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=-1)
        dh = d_z[:, k] @ wh.transpose(0, 2, 1)
        dc = dc * f
    flat = d_z.reshape(2, t * n, 4 * HIDDEN)
    d_w = np.concatenate([e.reshape(2, t * n, DIMS).transpose(0, 2, 1) @ flat, last.reshape(2, t * n, HIDDEN).transpose(0, 2, 1) @ flat], axis=1)
    d_e = (flat @ m.w[:, :DIMS].transpose(0, 2, 1)).reshape(2, t, n, DIMS)
    d_chars = np.zeros_like(m.chars)
    np.add.at(d_chars, x.T, d_e[0])
    np.add.at(d_chars, x.T[::-1], d_e[1])
    grads = (d_chars, d_w, flat.sum(axis=1, keepdims=True), d_tags, d_emit.sum(axis=(0, 1)), d_moves)
    return float((z - gold).mean()), grads


def _rewritten(text: str, spans: list, rng) -> tuple[str, list]:
    """The window with some of its spans written in another way, so that the network learns more than the patterns."""
    out, at, made = [], 0, []
    grown = 0
    for k, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        new = text[a:b]
        if k == 3 and rng.random() < 0.5:
            d = _digits(new)[-10:]
            new = (f"{d[:3]}-{d[3:6]}-{d[6:]}", f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}")[int(rng.integers(3))]
        out.append(text[at:a] + new)
        made.append((k, a + grown, a + grown + len(new)))
        grown += len(new) - (b - a)
        at = b
    return "".join(out) + text[at:], made


def fit(windows: list[str], steps: int = 450, batch: int = 48, seed: int = 5, rate: float = 0.02) -> Tagger | None:
    """Train on texts of one window each, labelled by the patterns; None without any span."""
    labelled = [(w, base_spans(w)) for w in windows]
    if not any(s for _, s in labelled):
        return None
    rng = np.random.default_rng(seed)
    m = new_tagger(seed)
    params = [m.chars, m.w, m.b, m.tags, m.tag_bias, m.moves]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        x = np.full((batch, WINDOW), 10, np.int16)
        y = np.zeros((batch, WINDOW), np.int8)
        for r, k in enumerate(rng.integers(len(labelled), size=batch)):
            text, spans = _rewritten(*labelled[k], rng)
            codes = encode_chars(text)[:WINDOW]
            x[r, :len(codes)] = codes
            for kind, a, b in spans:
                if b <= WINDOW and not y[r, a:b].any():
                    y[r, a] = 1 + 2 * kind
                    y[r, a + 1:b] = 2 + 2 * kind
        _, grads = loss_and_gradient(m, x, y)
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        for p, g, u, v in zip(params, grads, first, second):
            g = g * min(1.0, 5.0 / max(norm, 1e-9))
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            p -= rate * min(1.0, 2 - 2 * step / (steps + 1)) * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return m


def train(docs: DataFrame, max_windows: int = MAX_WINDOWS, seed: int = 5) -> Tagger | None:
    """Fit on at most ``max_windows`` windows of texts with a digit or an @ sign, chosen by a hash of the window."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, known = [], []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                for _, a, b in spans:
                    lo = max(0, a - int(hashlib.blake2b(text[a:b].encode("utf-8", "replace"), digest_size=2).hexdigest(), 16) % 40)
                    out.append(text[lo:lo + WINDOW - 8])
                    known.append(True)
                for at in _anchors(text)[:4]:
                    lo = max(0, at - 40)
                    out.append(text[lo:lo + WINDOW - 8])
                    known.append(False)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(known, pa.bool_())], names=["window", "known"])

    made = docs.filter(F.col("text").rlike("[0-9@]")).select("text").mapInArrow(cut, "window string, known boolean")
    rows = []
    for known, n in ((True, max_windows * 2 // 3), (False, max_windows // 3)):
        part = made.filter(F.col("known") == known).select("window", F.xxhash64("window", F.lit(seed)).alias("h"))
        rows += [r.window for r in part.distinct().orderBy("h", "window").limit(n).collect()]
    return fit(rows, seed=seed)


# --- decoding --------------------------------------------------------------
def _anchors(text: str) -> list[int]:
    """Starts of the digits and signs that windows are laid over, one per quarter of a window at most."""
    out, at = [], 0
    while (m := _ANCHOR.search(text, at)) is not None:
        out.append(m.start())
        at = m.start() + WINDOW // 4
    return out


def _window_starts(text: str) -> list[int]:
    """Overlapping windows on a fixed grid of the text, all that hold an anchor or lie next to one."""
    cells = set()
    last = max(0, (len(text) - WINDOW + STRIDE - 1) // STRIDE)
    for m in _anchors(text):
        for g in range(max(0, (m - WINDOW) // STRIDE), (m + WINDOW // 4) // STRIDE + 1):
            cells.add(min(g, last))
    return sorted(c * STRIDE for c in cells)


def reconcile(spans: list[tuple[int, int, int, float]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The spans without overlaps, to each other or to ``taken``, with the largest total margin."""
    best: dict[tuple[int, int, int], float] = {}
    for k, a, b, s in spans:
        best[k, a, b] = max(s, best.get((k, a, b), s))
    taken = sorted(taken)
    ends = [b for _, b in taken]
    free = []
    for (k, a, b), s in best.items():
        at = np.searchsorted(ends, a, "right")
        if at >= len(taken) or taken[at][0] >= b:
            free.append((b, a, k, s))
    free.sort()
    stops = [f[0] for f in free]
    total, pick = [0.0], []
    for b, a, k, s in free:
        before = int(np.searchsorted(stops, a, "right"))
        use = total[min(before, len(total) - 1)] + s
        pick.append(before if use > total[-1] else -1)
        total.append(max(use, total[-1]))
    out, i = [], len(free)
    while i > 0:
        if pick[i - 1] >= 0:
            b, a, k, _ = free[i - 1]
            out.append((k, a, b))
            i = pick[i - 1]
        else:
            i -= 1
    return out[::-1]


def added_spans(m: Tagger | None, texts: list[str], base: list[list], batch: int = 1024) -> list[list[tuple[int, int, int]]]:
    """Spans that the network adds to the base spans of each text."""
    found: list[list] = [[] for _ in texts]
    if m is None:
        return found
    raw: list[list] = [[] for _ in texts]
    todo: list[tuple[int, int]] = []

    def decode() -> None:
        x = np.full((len(todo), WINDOW), 10, np.int16)
        for r, (d, lo) in enumerate(todo):
            codes = encode_chars(texts[d][lo:lo + WINDOW])
            x[r, :len(codes)] = codes
        tags, margin = viterbi(m, x)
        for r in np.flatnonzero((tags > 0).any(axis=1)).tolist():
            d, lo = todo[r]
            t, n = tags[r], min(WINDOW, len(texts[d]) - lo)
            for a in np.flatnonzero(t % 2 == 1).tolist():
                b = a + 1
                while b < n and t[b] == t[a] + 1:
                    b += 1
                # a span that a window cuts is left to the window that holds it whole
                if (a == 0 and lo > 0) or (b == n and lo + n < len(texts[d])) or a >= n:
                    continue
                kind, text = (int(t[a]) - 1) // 2, texts[d][lo + a:lo + b]
                if margin[r, a:b].mean() >= MARGIN and _valid(KINDS[kind], text) and _ANCHOR.search(text):
                    raw[d].append((kind, lo + a, lo + b, float(margin[r, a:b].mean())))
        todo.clear()

    for d, text in enumerate(texts):
        for lo in _window_starts(text):
            todo.append((d, lo))
            if len(todo) == batch:
                decode()
    if todo:
        decode()
    for d in range(len(texts)):
        if raw[d]:
            found[d] = reconcile(raw[d], [(a, b) for _, a, b in base[d]])
    return found


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id with the base spans and all spans of the whole text, as lists of (kind, start, end).

    Offsets are code points, ends exclusive. Null and empty texts have none. Added spans never overlap
    base spans or each other; base spans of different kinds may overlap."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) if t else [] for t in texts]
                more = added_spans(shared.value, texts, base)
                counts = np.array([[sum(s[0] == k for s in b) for k in range(len(KINDS))] for b in base], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(counts[:, k]) for k in range(len(KINDS))],
                     pa.array([as_text(b) for b in base]), pa.array([as_text(b + a) for b, a in zip(base, more)])],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    # texts without a digit or an @ sign have no spans; only their ids go to Python
    text = F.when(F.col("text").rlike("[0-9@]"), F.col("text"))
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, schema)


def mask(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """The rows of ``docs`` with every span of the text replaced by its kind in angle brackets.

    Overlapping spans are replaced as one, under the kind of the first. Texts without spans stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(at).to_pylist()
                some = [i for i, t in enumerate(texts) if t and _ANCHOR.search(t)]
                base = [base_spans(texts[i]) for i in some]
                more = added_spans(shared.value, [texts[i] for i in some], base)
                for i, b, a in zip(some, base, more):
                    if b or a:
                        texts[i] = _masked(texts[i], b + a)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(texts, pa.string()), *part.columns[at + 1:]], names=schema.names)

    return docs.mapInArrow(run, schema)


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out.append(f"{text[at:a]}<{KINDS[k]}>")
        at = max(at, b)
    return "".join(out) + text[at:]
