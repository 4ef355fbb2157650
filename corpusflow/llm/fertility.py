"""Quality rules by the fertility of tokenisers.

Two public vocabularies are put to the words of a text: one of bytes, one of pieces that falls back to bytes.
A text is measured by characters per token under each, the share of byte tokens of the second, and the entropy
of its tokens under the first (of order 2: two tokens drawn from the text are equal with probability 2^-entropy;
its estimate does not grow with the length of the text). Junk that word counts let through spells badly, falls
back to bytes, or draws few tokens again and again.

The bands of the measures are fences around the quartiles of all texts that pass the plain rules, by language:
a tag of two or three letters, else the script of most letters, so that there are some 18,000 groups at most.
Quartiles come from counts of the measures rounded to a fixed step, so they are exact to that step and the
same on any partitioning, and a language that most rows share is counted in the tasks first."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import SPACES, chunks, prefix_sums, range_hash, word_bounds
from corpusflow.session import settle

BYTE_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed: how the byte vocabulary splits a text before it merges bytes.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 2 << 20
FENCE = 3.0
LEAST_ROWS = 50
#: Measure, step of its counts, and the least distance of a fence from its quartile.
MEASURES = [("chars_per_byte_token", 1 / 64, 0.25), ("chars_per_piece", 1 / 64, 0.25), ("fallback_share", 1 / 512, 0.05), ("token_entropy", 1 / 32, 0.5)]

_BLANK, _SYMBOL, _START = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_BLANK[list(SPACES)] = True
_SYMBOL[list(b"#*$%&|<>")] = True
_START[0x80:0xC0] = False  # a byte that goes on a code point
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Fixed: first code points of blocks, and the script of each up to the next.
_BLOCKS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "thai"),
           (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
           (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other")]


@functools.lru_cache(maxsize=2)
def _vocabularies(byte_ranks: str, pieces: str):
    import sentencepiece
    import tiktoken

    with open(byte_ranks, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
    fallback = np.array([sp.is_byte(i) or sp.is_unknown(i) for i in range(sp.get_piece_size())])
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), sp, fallback


def script(text: str) -> str:
    """The script of most letters; without letters, 'none'."""
    points = np.frombuffer("".join(c for c in text if c.isalpha()).encode("utf-32-le", "replace"), np.uint32)
    if not len(points):
        return "none"
    at = np.searchsorted([p for p, _ in _BLOCKS], points, "right") - 1
    names = sorted({s for _, s in _BLOCKS})
    of = np.array([names.index(s) for _, s in _BLOCKS])[at]
    return names[int(np.bincount(of).argmax())]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def plain_counts(buf: np.ndarray, offsets: np.ndarray, words, hashes: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text. Lines and word windows
    are told apart by 64-bit hashes."""
    starts, _, doc = words
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    filled = ~_BLANK[buf]
    chars, symbols = _per_text(filled & _START[buf], offsets), _per_text(_SYMBOL[buf], offsets)
    breaks = np.flatnonzero(buf == 10)
    begins = np.union1d(breaks + 1, offsets[:-1])
    begins = begins[begins < len(buf)]
    of = np.searchsorted(offsets, begins, "right") - 1
    line_end = np.minimum(np.append(breaks, len(buf))[np.searchsorted(breaks, begins)], offsets[of + 1])
    held = np.concatenate(([0], np.cumsum(filled)))
    some = held[line_end] > held[begins]
    begins, line_end, of = begins[some], line_end[some], of[some]
    line = range_hash(prefix_sums(buf), begins, line_end)
    order = np.lexsort((line, of))
    same = (line[order][1:] == line[order][:-1]) & (of[order][1:] == of[order][:-1])
    dup = np.bincount(of[order][1:][same], minlength=n)
    repeated = np.zeros(len(starts) + 1, np.int64)
    if len(starts) > 2:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        three = range_hash(prefix_sums(hashes), at, at + 3)
        order = np.lexsort((three, doc[at]))
        same = (three[order][1:] == three[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
        often = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]] if len(at) else at
        for k in range(3):
            repeated[often + k] = 1
    return [count, chars, symbols, dup, np.bincount(doc, weights=repeated[:-1], minlength=n).astype(np.int64)]


def token_measures(buf: np.ndarray, n: int, words, hashes: np.ndarray, chars: np.ndarray, vocabularies) -> list[np.ndarray]:
    """Characters per token under both vocabularies, share of byte tokens, entropy of tokens; NaN without words.

    Every distinct word is encoded once, with a blank in front."""
    starts, ends, doc = words
    byte_level, sp, fallback = vocabularies
    _, first, at = np.unique(hashes, return_index=True, return_inverse=True)
    raw = buf.tobytes()
    distinct = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    one = [byte_level.encode_ordinary(" " + w) for w in distinct]
    two = sp.encode(distinct, num_threads=1)
    size_one, size_two = (np.fromiter(map(len, x), np.int64, len(x)) for x in (one, two))
    flat_one, flat_two = (np.fromiter((i for x in ids for i in x), np.int64, int(s.sum())) for ids, s in ((one, size_one), (two, size_two)))
    bytes_two = np.bincount(np.repeat(np.arange(len(two)), size_two), weights=fallback[flat_two], minlength=len(two))
    per = lambda weights: np.bincount(doc, weights=weights[at], minlength=n)
    n_one, n_two = per(size_one), per(size_two)
    # tokens of each text: distinct words with their number, then their tokens
    keys, times = np.unique(doc * len(distinct) + at, return_counts=True) if len(doc) else (np.zeros(0, np.int64),) * 2
    text, word = keys // max(len(distinct), 1), keys % max(len(distinct), 1)
    wide = size_one[word]
    i = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat((np.cumsum(size_one) - size_one)[word], wide)
    lift = int(flat_one.max()) + 1 if len(flat_one) else 1
    found, of = np.unique(np.repeat(text, wide) * lift + flat_one[i], return_inverse=True)
    m = np.bincount(of, weights=np.repeat(times, wide), minlength=len(found))
    pairs = np.bincount(found // lift, weights=m * (m - 1), minlength=n)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.log2(n_one * (n_one - 1)) - np.log2(np.maximum(pairs, 1))
        out = [chars / n_one, chars / n_two, per(bytes_two) / n_two, entropy]
    return [np.where(np.isfinite(x), x, np.nan) for x in out]


def measured(docs: DataFrame, byte_ranks: str = BYTE_RANKS, pieces: str = PIECES) -> DataFrame:
    """doc_id, the group of its language, the five counts, and the four measures (null without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _vocabularies(byte_ranks, pieces)
        for batch in batches:
            tags = batch.column(1).to_pylist()
            for lo, hi, buf, offsets in chunks(batch, "text", CHUNK):
                words = word_bounds(buf, offsets)
                hashes = range_hash(prefix_sums(buf), words[0], words[1])
                counts = plain_counts(buf, offsets, words, hashes)
                values = token_measures(buf, hi - lo, words, hashes, counts[1], vocabularies)
                group = [t or script(buf[a:b].tobytes().decode("utf-8", "replace")) for t, a, b in zip(tags[lo:hi], offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(group), *(pa.array(c.astype(np.int64)) for c in counts),
                     *(pa.array(v, from_pandas=True) for v in values)], names=["doc_id", "language", *_COUNTS, *(m for m, _, _ in MEASURES)])

    tag = F.lower(F.regexp_extract("lang", "^([A-Za-z]{2,3})(?:$|[^A-Za-z])", 1)) if "lang" in docs.columns else F.lit("")
    schema = ", ".join(["doc_id long, language string", *(f"{c} long" for c in _COUNTS), *(f"{m} double" for m, _, _ in MEASURES)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(tag, F.lit("")).alias("tag"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def bands(rows: DataFrame, fence: float = FENCE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """language and the lower and upper fence of every measure, over the rows given; '' stands for all of them.

    A language of fewer rows than ``least_rows`` has no bands of its own."""
    points = F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.col(m) / step).cast("long").alias("v")) for k, (m, step, _) in enumerate(MEASURES)])
    counts = (rows.select("language", F.explode(points).alias("p")).groupBy("language", "p.k", "p.v").agg(F.count("*").alias("n")))
    counts = counts.select(F.explode(F.array("language", F.lit(""))).alias("language"), "k", "v", "n").groupBy("language", "k", "v").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("language", "k")  # as many rows as steps of a measure
    ranked = counts.withColumn("upto", F.sum("n").over(group.orderBy("v"))).withColumn("of", F.sum("n").over(group))
    quartile = lambda q: F.min(F.when(F.col("upto") >= F.col("of") * q, F.col("v")))
    found = ranked.groupBy("language", "k").agg(quartile(0.25).alias("low"), quartile(0.75).alias("high"), F.max("of").alias("of"))
    found = found.filter((F.col("of") >= least_rows) | (F.col("language") == ""))
    out = []
    for k, (m, step, slack) in enumerate(MEASURES):
        wide = F.greatest(fence * (F.col("high") - F.col("low")) * step, F.lit(slack))
        mine = F.col("k") == k
        out += [F.max(F.when(mine, F.col("low") * step - wide)).alias(f"{m}_low"), F.max(F.when(mine, F.col("high") * step + wide)).alias(f"{m}_high")]
    return found.groupBy("language").agg(*out)


def judge(docs: DataFrame, byte_ranks: str = BYTE_RANKS, pieces: str = PIECES, fence: float = FENCE) -> DataFrame:
    """doc_id, the five counts, base_failed, the measures, and ``kept``: the plain rules are met and every
    measure lies inside the band of its language. One row per row of ``docs``.

    Null, empty and blank texts have zeros and fail. Without a column ``lang``, or where it is no tag of two or
    three letters, the script stands for the language. Repeated rows and null ids are rows like others. An empty
    table gives no rows. Other columns are not read."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = settle(measured(docs, byte_ranks, pieces).withColumn("base_failed", failed))
    # tags and scripts: some 18,000 rows at most
    limits = bands(rows.filter("NOT base_failed"), fence)
    every = limits.filter("language = ''").first()  # one row
    both = rows.join(F.broadcast(limits), "language", "left")
    inside = F.lit(every is not None)
    for m, _, _ in MEASURES:
        low, high = (F.coalesce(F.col(f"{m}_{side}"), F.lit(every[f"{m}_{side}"] if every else None)) for side in ("low", "high"))
        inside &= F.col(m).between(low, high)
    return both.select("doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
                       "language", *[m for m, _, _ in MEASURES])
