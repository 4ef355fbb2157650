"""Vectorised helpers over the UTF-8 bytes of an Arrow text column, and small Spark helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: the bytes that end a word.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
SPACE_CLASS = "\\x20\\x09-\\x0D"

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Entries of a power table that a worker keeps; longer ones, for very long texts, are made anew.
KEPT_POWERS = 1 << 21


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, kept and grown up to a bound."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        made = np.full(size, base, np.uint64)
        made[0] = 1
        have = np.multiply.accumulate(made)
        if size <= KEPT_POWERS or base not in _powers:
            _powers[base] = have[:KEPT_POWERS].copy() if size > KEPT_POWERS else have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * base^i, one longer than the values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(values)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range, the same wherever its values lie."""
    inverse = _power(_INVERSE, len(sums))
    n = (ends - starts).astype(np.uint64)
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + n * np.uint64(0xD6E8FEB86659FD93))


def word_bounds(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE):
    """Start, end and text number of every word; words never cross texts."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    gap = space[buf]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    edge = gap[:-1] | first[1:n]
    start = ~gap
    start[1:] &= edge
    edge = gap[1:] | first[1:n]
    end = ~gap
    end[:-1] &= edge
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def join_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The words with one blank after each, and the place where each begins (one more for the end)."""
    at = np.zeros(len(starts) + 1, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint8), at
    np.cumsum(ends - starts + 1, out=at[1:])
    step = np.ones(int(at[-1]), np.int64)
    step[0] = starts[0]
    step[at[1:-1]] = starts[1:] - ends[:-1]  # from the blank after a word to the next word
    joined = buf[np.minimum(np.cumsum(step), len(buf) - 1)]
    joined[at[1:] - 1] = 32
    return joined, at


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    more = width - have
    return np.minimum(out[:-more], out[more:]) if more else out


def merged_runs(keys: list[np.ndarray], lo: np.ndarray, hi: np.ndarray):
    """Sorted ranges of equal keys, merged where they meet or overlap."""
    order = np.lexsort((lo, *keys[::-1]))
    keys, lo, hi = [k[order] for k in keys], lo[order], hi[order]
    if not len(lo):
        return keys, lo, hi
    new = np.ones(len(lo), bool)
    same = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    group = np.concatenate(([0], np.cumsum(~same)))
    # ends so far within a group: groups are lifted apart so that one running maximum serves all
    lift = group * (int(hi.max()) + 1)
    far = np.maximum.accumulate(hi + lift)
    new[1:] = ~same | (lo[1:] + lift[1:] > far[:-1])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], lo[at], np.maximum.reduceat(hi, at)


def chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a batch in runs of about ``most`` text bytes: from, to, bytes, offsets of the texts.

    A longer text is a run of its own; a null text is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    col = col.cast(pa.string()).fill_null("") if col.null_count or col.type != pa.string() else col
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, whole[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def integers(batch: pa.RecordBatch, column: str, null: int) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(column))
    return col.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def word_count(text) -> F.Column:
    """Number of words of a text; 0 for null."""
    marks = F.regexp_replace(text, f"[^{SPACE_CLASS}]+", "x")
    return F.coalesce(F.length(F.regexp_replace(marks, f"[{SPACE_CLASS}]+", "")), F.lit(0)).cast("long")


def spread(df: DataFrame) -> int:
    """Tasks of a shuffle in this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
