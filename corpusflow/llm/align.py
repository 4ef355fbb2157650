"""Alignment of two tokenizers by an associative composition of fragments.

The tokens of two vocabularies cover the same bytes. Where a token of each ends at one place, a group closes;
tokens of one group are linked. A byte range of a text yields a fragment: the tokens up to its first common
end (open prefix), the groups between common ends (closed), and the tokens behind the last one (open suffix).
Two neighbouring fragments compose into one: the suffix of the left and the prefix of the right are one group.
A range without a common end is all open and only grows its neighbour. Composition is associative, so a tree
of tasks, ``FAN`` fragments a node, reduces a text of any length; ``START`` in front closes the first group.

A text up to ``chunk`` bytes is aligned in the task that reads it: it falls into pieces where both tokenizers
surely begin anew, and such a piece is a closed fragment, so that each distinct piece of a batch of texts is
aligned once, all of them as if they were one text. A longer text is dealt as byte ranges
to other tasks; a range travels with its text from the last place before it where both tokenizers surely
begin anew to the first such place behind it, and owns the tokens that end inside it.

Pairs of ids are counted over documents without one row per document: documents are packed into blocks,
a block reports each of its pairs once, and gets one dictionary of counts back, joined on the block."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import settle

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 64 << 10
#: A border moves to the end of a stretch that both tokenizers can't surely leave, if that is longer.
STRETCH = 4 << 10
FAN = 16
BLOCK_PAIRS = 1 << 20
BATCH_BYTES = 3 << 20
ENCODED = 8192

#: Both tokenizers begin anew in front of a blank or line break between two other characters.
_ANEW = re.compile(r"(?<=\S)[ \n](?=\S)")
_PIECE = re.compile(r"(?<=\S)(?=[ \n]\S)")
_NONE = np.zeros(0, np.int64)


class Tokenizers:
    """Both vocabularies: ids of a text, and the bytes of every id."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        spelled = self.a.get_vocab(with_added_tokens=True)
        self.raw_a = [b""] * (max(spelled.values()) + 1)
        for token, i in spelled.items():
            self.raw_a[i] = bytes(byte[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.raw_b = []
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            none = self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)
            self.raw_b.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if none else p.replace("▁", " ").encode())
        self.mark = self.b.piece_to_id("▁")
        pieces_of = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(("\n" in p and len(p) > 1) or "▁" in p.lstrip("▁") for p in pieces_of):
            raise ValueError("a piece goes on behind a word mark or line break; a text can't be cut there")
        self.len_a, self.len_b = (np.array([len(x) for x in raw], np.int64) for raw in (self.raw_a, self.raw_b))
        numbers = [str(i).encode() for i in range(max(len(self.raw_a), len(self.raw_b)))]
        self.spelling = [n + end for end in (b",", b"|", b";") for n in numbers]
        self.numbers = len(numbers)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with the blank in front of a document, or with a blank or line break inside."""
        a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # the piece model puts its own mark in front: it is the blank; before a line break it is one too many
        b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return a, [x[1:] if t[0] != " " and x[:1] == [self.mark] else x for x, t in zip(b, texts)]


@functools.lru_cache(maxsize=2)
def tokenizers(byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


@dataclass
class Fragment:
    """Open prefix, closed groups (text, number, links, pairs and how often each), open suffix.

    Without a common end (``ended``) all tokens are in the prefix."""

    ended: bool = False
    n_a: int = 0
    n_b: int = 0
    groups: int = 0
    links: int = 0
    text: bytes = b""
    pairs: np.ndarray = field(default_factory=lambda: _NONE)
    times: np.ndarray = field(default_factory=lambda: _NONE)
    prefix_a: np.ndarray = field(default_factory=lambda: _NONE)
    prefix_b: np.ndarray = field(default_factory=lambda: _NONE)
    suffix_a: np.ndarray = field(default_factory=lambda: _NONE)
    suffix_b: np.ndarray = field(default_factory=lambda: _NONE)
    fits: bool = True


START = Fragment(ended=True)


def _summed(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their times."""
    if times is None:
        return np.unique(keys, return_counts=True)
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=times, minlength=len(found)).astype(np.int64)


def _linked(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs a * width + b of groups of ``na`` and ``nb`` tokens, how often each is linked, and its group."""
    ta = tb = None
    if len(na) and int((na * nb).max()) > 4096:
        # wide groups by their distinct ids, so that a run of one id is one entry
        lift = 1 + int(max(a.max(), b.max()))
        (a, ta), (b, tb) = (_summed(np.repeat(np.arange(len(n)), n) * lift + ids) for ids, n in ((a, na), (b, nb)))
        na, nb = (np.bincount(x // lift, minlength=len(na)) for x in (a, b))
        a, b = a % lift, b % lift
    of = np.repeat(np.arange(len(na)), na)  # group of each a
    wide = nb[of]
    first = np.cumsum(nb) - nb
    i = np.repeat(np.arange(len(a)), wide)
    j = np.arange(len(i)) - np.repeat(np.cumsum(wide) - wide, wide) + first[of][i]
    return a[i] * width + b[j], np.ones(len(i), np.int64) if ta is None else ta[i] * tb[j], of[i]


def _spelling(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, t: Tokenizers) -> list[bytes]:
    """Groups as text, token by token: ids of the first, a bar, ids of the second, a semicolon."""
    ends_a, ends_b = np.cumsum(na), np.cumsum(nb)
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + np.repeat(ends_b - nb, na)] = a
    code[np.arange(len(b)) + np.repeat(ends_a, nb)] = b
    code[ends_a + ends_b - nb - 1] += t.numbers
    code[ends_a + ends_b - 1] += 2 * t.numbers
    return list(map(t.spelling.__getitem__, code.tolist()))


def _closed(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, t: Tokenizers) -> dict:
    pairs, times = _summed(*_linked(a, b, na, nb, len(t.raw_b))[:2])
    return {"groups": len(na), "links": int(na @ nb), "text": b"".join(_spelling(a, b, na, nb, t))[:-1], "pairs": pairs, "times": times}


def fragment(ids_a: list[int], ids_b: list[int], whole: bytes, lo: int, hi: int, t: Tokenizers) -> Fragment:
    """Fragment of the byte range (lo, hi] of ``whole``: it owns the tokens that end inside.

    If the tokens don't spell ``whole``, it fits no text."""
    if b"".join(map(t.raw_a.__getitem__, ids_a)) != whole or b"".join(map(t.raw_b.__getitem__, ids_b)) != whole:
        return Fragment(fits=False)
    a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    ends_a, ends_b = np.cumsum(t.len_a[a]), np.cumsum(t.len_b[b])
    if lo > 0 or hi < len(whole):
        keep_a, keep_b = ((e > lo) & (e <= hi) for e in (ends_a, ends_b))
        a, b, ends_a, ends_b = a[keep_a], b[keep_b], ends_a[keep_a], ends_b[keep_b]
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    m = len(common)
    if not m:
        return Fragment(n_a=len(a), n_b=len(b), prefix_a=a, prefix_b=b)
    na, nb = (np.bincount(np.searchsorted(common, e), minlength=m + 1) for e in (ends_a, ends_b))
    pa_, pb_, sa, sb = na[0], nb[0], len(a) - na[m], len(b) - nb[m]
    return Fragment(True, len(a), len(b), **_closed(a[pa_:sa], b[pb_:sb], na[1:m], nb[1:m], t),
                    prefix_a=a[:pa_], prefix_b=b[:pb_], suffix_a=a[sa:], suffix_b=b[sb:])


def compose(f: Fragment, g: Fragment, t: Tokenizers) -> Fragment:
    """Fragment of two neighbouring ranges; associative."""
    if not (f.fits and g.fits):
        return Fragment(fits=False)
    sums = {"n_a": f.n_a + g.n_a, "n_b": f.n_b + g.n_b}
    both = lambda x, y: np.concatenate((x, y))
    if not g.ended:
        if not f.ended:
            return Fragment(**sums, prefix_a=both(f.prefix_a, g.prefix_a), prefix_b=both(f.prefix_b, g.prefix_b))
        return Fragment(True, **sums, groups=f.groups, links=f.links, text=f.text, pairs=f.pairs, times=f.times,
                        prefix_a=f.prefix_a, prefix_b=f.prefix_b, suffix_a=both(f.suffix_a, g.prefix_a), suffix_b=both(f.suffix_b, g.prefix_b))
    if not f.ended:
        return Fragment(True, **sums, groups=g.groups, links=g.links, text=g.text, pairs=g.pairs, times=g.times,
                        prefix_a=both(f.prefix_a, g.prefix_a), prefix_b=both(f.prefix_b, g.prefix_b), suffix_a=g.suffix_a, suffix_b=g.suffix_b)
    a, b = both(f.suffix_a, g.prefix_a), both(f.suffix_b, g.prefix_b)
    made = _closed(a, b, np.array([len(a)]), np.array([len(b)]), t)
    pairs, times = _summed(np.concatenate((f.pairs, made["pairs"], g.pairs)), np.concatenate((f.times, made["times"], g.times)))
    return Fragment(True, **sums, groups=f.groups + 1 + g.groups, links=f.links + made["links"] + g.links,
                    text=b";".join(x for x in (f.text, made["text"], g.text) if x), pairs=pairs, times=times,
                    prefix_a=f.prefix_a, prefix_b=f.prefix_b, suffix_a=g.suffix_a, suffix_b=g.suffix_b)


def aligned(raws: list[bytes], t: Tokenizers) -> list[Fragment]:
    """Whole texts, each as a closed fragment; what has no tokens has none of anything."""
    known: dict[str, int] = {}
    of: list[int] = []
    sizes = []
    for raw in raws:
        text = " " + raw.decode("utf-8", "replace")
        parts = _PIECE.split(text) if raw else []
        of += [known.setdefault(x, len(known)) for x in parts]
        sizes.append(len(parts))
    pieces = list(known)
    found = [([], [], [], [], [])]
    for lo in range(0, len(pieces), ENCODED):  # what the tokenizers return is large
        some = pieces[lo:lo + ENCODED]
        ids_a, ids_b = t.encode(some)
        fit = [b"".join(map(t.raw_a.__getitem__, a)) == x.encode() == b"".join(map(t.raw_b.__getitem__, b)) for a, b, x in zip(ids_a, ids_b, some)]
        ids_a, ids_b = ([x if f else [] for x, f in zip(ids, fit)] for ids in (ids_a, ids_b))
        found.append((fit, *([len(x) for x in ids] for ids in (ids_a, ids_b)), *(np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))))
    fits, n_a, n_b, a, b = (np.concatenate(x).astype(k) for x, k in zip(zip(*found), (bool, *(np.int64,) * 4)))
    ends_a, ends_b = np.cumsum(t.len_a[a]), np.cumsum(t.len_b[b])
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    na, nb = (np.bincount(np.searchsorted(common, e), minlength=len(common)) for e in (ends_a, ends_b))
    piece = np.searchsorted(np.cumsum(n_a), np.cumsum(na))  # of each group: pieces end where groups end
    m = len(pieces)
    groups, links = np.bincount(piece, minlength=m), np.bincount(piece, weights=na * nb, minlength=m).astype(np.int64)
    spelling, last = _spelling(a, b, na, nb, t), np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
    texts = [b"".join(spelling[x:y]) for x, y in zip(last, last[1:])]
    pairs, times, group = _linked(a, b, na, nb, len(t.raw_b))
    width = np.bincount(piece[group], minlength=m)
    start = np.cumsum(width) - width
    sizes = np.array(sizes, np.int64)
    doc, at = np.repeat(np.arange(len(raws)), sizes), np.array(of, np.int64)
    whole = np.array([" ".encode() + r == (" " + r.decode("utf-8", "replace")).encode() and len(r) > 0 for r in raws], bool)
    whole &= np.bincount(doc, weights=~fits[at], minlength=len(raws)) == 0
    keep = whole[doc]
    doc, at = doc[keep], at[keep]
    sums = [np.bincount(doc, weights=x[at], minlength=len(raws)).astype(np.int64).tolist() for x in (n_a, n_b, groups, links)]
    # distinct pieces of a text first, then their pairs
    held, often = np.unique(doc * max(m, 1) + at, return_counts=True)
    doc_of, p = held // max(m, 1), held % max(m, 1)
    i = np.repeat(start[p] - (np.cumsum(width[p]) - width[p]), width[p]) + np.arange(int(width[p].sum()))
    lift = len(t.raw_a) * len(t.raw_b)
    keys, n = _summed(np.repeat(doc_of, width[p]) * lift + pairs[i], np.repeat(often, width[p]) * times[i])
    edge = np.searchsorted(keys, np.arange(len(raws) + 1) * lift)
    keys = keys % lift
    out, begin = [], np.concatenate(([0], np.cumsum(sizes))).tolist()
    for d in range(len(raws)):
        text = b"".join([texts[k] for k in of[begin[d]:begin[d + 1]]])[:-1] if whole[d] else b""
        out.append(Fragment(True, sums[0][d], sums[1][d], sums[2][d], sums[3][d], text, keys[edge[d]:edge[d + 1]], n[edge[d]:edge[d + 1]]))
    return out


def ranges(text: str, chunk: int) -> list[tuple[int, int, int, int]]:
    """Context and borders (from, to, lo, hi), in characters, of the ranges of some ``chunk`` characters of a text."""
    borders, n, at = [], len(text), chunk
    while at < n:
        # the places around the border where both tokenizers begin anew
        before = max((m.start() for m in _ANEW.finditer(text, max(0, at - STRETCH), at + 1)), default=None)
        after = _ANEW.search(text, at)
        after = after.start() if after else n
        if before is None or after - before > STRETCH:
            at = before = after  # no place near by: the range goes on to the next one
        if at >= n:
            break
        borders.append((before, at, max(after, at)))
        at += chunk
    edges = [(0, 0, 0), *borders, (n, n, n)]
    return [(x[0], y[2], x[1], y[1]) for x, y in zip(edges, edges[1:])]


_FRAGMENT = ("ended boolean, n_a long, n_b long, groups long, links long, spelled binary, pairs array<long>, times array<long>, "
             "prefix_a array<long>, prefix_b array<long>, suffix_a array<long>, suffix_b array<long>, fits boolean")
_NAMES = ("ended", "n_a", "n_b", "groups", "links", "text", "pairs", "times", "prefix_a", "prefix_b", "suffix_a", "suffix_b", "fits")
_KEY = "doc_id long, digest binary, part int, copies long, "


def _row(key: tuple, f: Fragment) -> pa.RecordBatch:
    values = [getattr(f, n) for n in _NAMES]
    columns = [pa.array([v]) if not isinstance(v, np.ndarray) else pa.array([v], pa.list_(pa.int64())) for v in values]
    names = ["doc_id", "digest", "part", "copies", *(x.split()[0] for x in _FRAGMENT.split(", "))]
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, types)), *columns], names=names)


def _fragment_of(table: pa.Table, i: int) -> Fragment:
    at = table.schema.get_field_index("ended")
    values = [table.column(at + k)[i] for k in range(len(_NAMES))]
    return Fragment(**{n: v.values.to_numpy() if pa.types.is_list(v.type) else v.as_py() for n, v in zip(_NAMES, values)})


def long_fragments(docs: DataFrame, chunk: int, paths: tuple[str, str]) -> DataFrame:
    """One fragment per text, from ranges that are tokenized in tasks of their own and composed by a tree.

    Rows equal in doc_id and text collapse into one with their number as ``copies``."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw in zip(batch.column(0), batch.column(1)):
                raw = raw.as_py()
                text, digest = " " + raw.decode("utf-8", "replace"), hashlib.sha256(raw).digest()
                valid = text.encode()[1:] == raw
                for k, (x, y, lo, hi) in enumerate(ranges(text, chunk)):
                    before = len(text[x:lo].encode())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc.as_py()], pa.int64()), pa.array([digest]), pa.array([k], pa.int32()), pa.array([text[x:y].encode()]),
                         pa.array([before]), pa.array([before + len(text[lo:hi].encode())]), pa.array([valid])],
                        names=["doc_id", "digest", "part", "text", "lo", "hi", "valid"])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(*paths)
        for batch in batches:
            for doc, digest, k, raw, lo, hi, valid in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = t.encode([raw.decode()])
                f = fragment(a[0], b[0], raw, lo, hi, t) if valid else Fragment(fits=False)
                yield _row((doc, digest, k, 1), f)

    def meet(table: pa.Table) -> pa.Table:
        t = tokenizers(*paths)
        part = table.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        made, last, same = None, -1, 0
        for i in order.tolist():
            same += part[i] == part[order[0]]
            if part[i] != last:  # another copy of a range is the same fragment
                f = _fragment_of(table, i)
                made, last = f if made is None else compose(made, f, t), part[i]
        # only the ranges themselves come in copies; each has as many as the text
        copies = max(int(same), int(table.column("copies")[0].as_py()))
        row = _row((table.column("doc_id")[0].as_py(), table.column("digest")[0].as_py(), int(part.min()) // FAN, copies), made)
        return pa.Table.from_batches([row])

    dealt = (docs.mapInArrow(split, "doc_id long, digest binary, part int, text binary, lo long, hi long, valid boolean")
             .repartition("doc_id", "digest", "part"))
    now = settle(dealt.mapInArrow(tokenise, _KEY + _FRAGMENT))
    last = now.agg(F.max("part")).first()[0]
    while last is not None:
        now = settle(now.groupBy("doc_id", "digest", F.expr(f"part div {FAN}")).applyInArrow(meet, _KEY + _FRAGMENT))
        last = last // FAN or None
    return now


_BLOCK = ("block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, "
          "copies array<long>, sizes array<int>, places binary, times binary, own long, held long")


def _blocks(found: Iterable[tuple[int | None, Fragment, int]]) -> Iterator[pa.RecordBatch]:
    """Documents packed into blocks. A block is one row with the figures of its documents and their pairs as
    places in its own list, and one row per pair of that list with the number of documents that link it."""
    pack, task, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
    rows: list[tuple] = []
    pairs: list[np.ndarray] = []
    times: list[np.ndarray] = []

    fields = [x.split() for x in _BLOCK.split(", ")]
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
             "array<string>": pa.list_(pa.string()), "binary": pa.binary()}

    def batch(n: int, have: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(have[c], kinds[k]) if c in have else pa.nulls(n, kinds[k]) for c, k in fields],
                                          names=[c for c, _ in fields])

    def flush() -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(p) for p in pairs], np.int64)
        own, at = np.unique(np.concatenate(pairs), return_inverse=True)
        copies = np.repeat(np.array([r[6] for r in rows], np.int64), sizes)
        held = np.bincount(at, weights=copies, minlength=len(own)).astype(np.int64)
        columns = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "copies"), zip(*rows)))
        yield batch(1, {"block": [task << 32 | number], **{c: [list(v)] for c, v in columns.items()}, "sizes": [sizes],
                        "places": [pack.compress(at.astype("<u4").tobytes())],
                        "times": [pack.compress(np.concatenate(times).astype("<u4").tobytes())]})
        for lo in range(0, len(own), 100_000):
            some = own[lo:lo + 100_000]
            yield batch(len(some), {"block": np.full(len(some), task << 32 | number), "own": some, "held": held[lo:lo + 100_000]})

    filled = 0
    for doc, f, copies in found:
        sha = hashlib.sha256(f.text).hexdigest() if f.groups else ""
        rows.append((doc, f.n_a, f.n_b, f.groups, f.links, sha, copies))
        pairs.append(f.pairs)
        times.append(f.times)
        filled += len(f.pairs) + 16
        if filled >= BLOCK_PAIRS:
            yield from flush()
            number, filled = number + 1, 0
            rows, pairs, times = [], [], []
    if rows:
        yield from flush()


def align(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every whole text.

    A null or empty text, one that is not UTF-8, and one that its tokens don't spell (one with U+2581) has
    zeros and an empty digest. Repeated rows, null ids too, are documents of their own. An empty table gives
    no rows; other columns are not read."""
    paths = (byte_level, pieces)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    size = F.octet_length("text")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(*paths)

        def every() -> Iterator[tuple[int | None, Fragment, int]]:
            for batch in batches:
                ids, raws, held = [], [], 0
                for doc, raw in zip(batch.column(0), batch.column(1)):
                    ids.append(doc.as_py())
                    raws.append(raw.as_py())
                    held += len(raws[-1])
                    if held > BATCH_BYTES:
                        yield from zip(ids, aligned(raws, t), repeat(1))
                        ids, raws, held = [], [], 0
                yield from zip(ids, aligned(raws, t), repeat(1))

        yield from _blocks(every())

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(*paths)

        def every() -> Iterator[tuple[int | None, Fragment, int]]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for i, (doc, copies) in enumerate(zip(table.column("doc_id").to_pylist(), table.column("copies").to_pylist())):
                    f = compose(START, _fragment_of(table, i), t)
                    yield doc, f if f.fits else Fragment(), copies

        yield from _blocks(every())

    blocks = settle(docs.filter(size <= chunk).mapInArrow(short, _BLOCK).unionByName(
        long_fragments(docs.filter(size > chunk), chunk, paths).mapInArrow(root, _BLOCK)))
    return counted(blocks, tokenizers(*paths))


def counted(blocks: DataFrame, t: Tokenizers) -> DataFrame:
    """Rows of the documents of the blocks, with the counts of their pairs over all documents."""
    each = blocks.filter("own IS NOT NULL").select("block", "own", "held")
    counts = settle(each.groupBy("own").agg(F.sum("held").alias("n")))
    a = F.expr(f"own div {len(t.raw_b)}")
    # one row per id of the first vocabulary, whose size is fixed
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    judged = counts.withColumn("a", a).join(F.broadcast(best), "a").select("own", "n", (F.col("n") == F.col("most")).alias("best"))
    known = each.select(F.col("block").alias("of"), "own").join(judged, "own").select("of", "own", "n", "best")

    def look_up(block: pa.Table, dictionary: pa.Table) -> pa.Table:
        get = lambda c: block.column(c).chunk(0)[0]
        order = np.argsort(dictionary.column("own").to_numpy())  # places follow the order of the pairs
        n, best = dictionary.column("n").to_numpy()[order], dictionary.column("best").to_numpy(zero_copy_only=False)[order]
        unpack = zstandard.ZstdDecompressor()
        at, times = (np.frombuffer(unpack.decompress(get(c).as_py()), "<u4").astype(np.int64) for c in ("places", "times"))
        sizes, copies = (get(c).values.to_numpy().astype(np.int64) for c in ("sizes", "copies"))
        of = np.repeat(np.arange(len(sizes)), sizes)
        sums = [np.zeros(len(sizes), np.int64) for _ in range(2)]
        np.add.at(sums[0], of, times * best[at])
        np.add.at(sums[1], of, times * n[at])
        rows = np.repeat(np.arange(len(sizes)), copies)
        values = [get(c).values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        out = [*values, *map(pa.array, sums), get("sha").values]
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        return pa.table([x.take(pa.array(rows)) for x in out], names=names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return blocks.filter("own IS NULL").drop("own", "held").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(look_up, schema)
