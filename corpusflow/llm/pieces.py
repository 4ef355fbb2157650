"""SentencePiece encoding and decoding over a relational lattice.

Blanks become U+2581 and one goes in front. No piece crosses from another character into U+2581 or holds
a character that only stands alone, so the text falls into words that are encoded on their own. Distinct
words are encoded once: their substrings up to the longest piece are exploded and equi-joined to the piece
table, the edges are grouped by word, and a higher-order ``aggregate`` folds them into the cuts of the word.

The public model is of the merging kind: its scores are ranks of merges, and the path with the best sum is
not the encoding that the model defines. So the fold replays the merges instead of Viterbi's recursion:
the state is the set of cuts of the word as bits; the edges come by rank, then from the left, and each one
whose ends are cuts with one cut between removes that cut. One pass is enough where every piece falls into
two parts by merges of better rank: between two cuts that stay, those merges do the same as in the piece
alone, so an edge can be taken when its rank comes up or never. ``late_pieces`` finds the exceptions of a
vocabulary; words that hold one of them are merged where they are met.

Texts never move. A task reports the distinct words of each shard of its texts; the cuts of the words go back
as one dictionary per shard in the shared folder, where the second pass over the texts looks them up. Both
passes find words in arrays of code points and tell them apart by a 64-bit hash; a dictionary is a sorted array
of hashes with the ids of each. Words beyond ``LONGEST`` characters or with a late piece, and words of a shard that was dealt otherwise the second time, are merged
where they are met, with the same result."""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import chunks, prefix_sums, range_hash, spread
from corpusflow.llm.warc import _store
from corpusflow.session import scratch_path

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LONGEST = 48
SHARD_BYTES = 12 << 20
RUN_BYTES = 256 << 10
DECODED = 256
CACHED_WORDS = 20_000
SLICE = 20_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@dataclass
class Vocabulary:
    """Piece to (rank, id), the id of byte 0, and the bytes of every id."""

    pieces: dict[str, tuple[float, int]]
    byte0: int
    raw: list[bytes]


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, raw, byte0 = {}, [], -1
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            raw.append(bytes([int(p[3:5], 16)]))
            byte0 = i if p == "<0x00>" else byte0
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            pieces[p] = (-sp.get_score(i), i)
            raw.append(p.replace(MARK, " ").encode())
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece goes on behind a word mark; words can't be told apart")
    return Vocabulary(pieces, byte0, raw)


def _parts(word: str, v: Vocabulary, below: float = math.inf) -> list[str]:
    """Neighbours merge by rank, then from the left, while a piece of a rank ``below`` joins them."""
    n = len(word)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    text: list[str | None] = list(word)
    heap: list = []

    def offer(a: int, b: int) -> None:
        if 0 <= a and b < n:
            found = v.pieces.get(text[a] + text[b])
            if found:
                heapq.heappush(heap, (found[0], a, b, text[a] + text[b]))

    for k in range(n - 1):
        offer(k, k + 1)
    while heap:
        rank, a, b, made = heapq.heappop(heap)
        if rank >= below:
            break
        if text[a] is None or text[b] is None or right[a] != b or text[a] + text[b] != made:
            continue
        text[a], text[b] = made, None
        right[a] = right[b]
        if right[b] < n:
            left[right[b]] = a
        offer(left[a], a)
        offer(a, right[a])
    return [t for t in text if t is not None]


def _spell(parts: list[str], v: Vocabulary) -> list[int]:
    out = []
    for t in parts:
        found = v.pieces.get(t)
        out += [found[1]] if found else [v.byte0 + x for x in t.encode("utf-8", "replace")]
    return out


def merge(word: str, v: Vocabulary) -> list[int]:
    """Ids of one word."""
    return _spell(_parts(word, v), v)


def late_pieces(v: Vocabulary) -> list[str]:
    """The shortest pieces that merges of better rank leave in other than two parts."""
    late: list[str] = []
    for p in sorted(v.pieces, key=len):
        if len(p) > 1 and not any(x in p for x in late) and len(_parts(p, v, v.pieces[p][0])) != 2:
            late.append(p)
    return late


def _bit(value: int, by) -> F.Column:
    return F.call_function("shiftleft", F.lit(value).cast("long"), by)


def cut_words(words: DataFrame, v: Vocabulary, n: Column | None = None) -> DataFrame:
    """word and ``cuts``, the ends of its pieces as bits; ``words`` has distinct words of at most LONGEST
    characters without a late piece, dealt by word, and ``n`` is their length where it is known. A word in which no two characters join has no row."""
    spark = words.sparkSession
    longest = max(map(len, v.pieces))
    ranks = {r: k for k, r in enumerate(sorted({r for r, _ in v.pieces.values()}))}
    table = spark.createDataFrame([(p, ranks[r]) for p, (r, _) in v.pieces.items() if len(p) > 1], "piece string, rank long")
    n = F.length("word") if n is None else n
    spans = words.select("word", n.alias("n"), F.explode(F.when(n > 1, F.sequence(F.lit(0), n - 2))).alias("s"))
    spans = spans.select("word", "s", F.explode(F.sequence(F.lit(2), F.least(F.lit(longest), F.col("n") - F.col("s")))).alias("k"))
    spans = spans.withColumn("sub", F.substring("word", F.col("s") + 1, F.col("k")))
    # the vocabulary has a fixed size; an edge is one number, in the order of rank and place
    edges = spans.join(F.broadcast(table), spans["sub"] == table["piece"]).select(
        "word", (_shift("rank", 16) + _shift("s", 8) + F.col("s") + F.col("k")).alias("edge"))
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))

    def bits(x):
        a, b = F.call_function("shiftright", x, F.lit(8)).bitwiseAND(255).cast("int"), x.bitwiseAND(255).cast("int")
        return F.struct((_bit(1, a) + _bit(1, b)).alias("ends"), (_bit(1, b) - _bit(2, a)).alias("inner"))

    def taken(mask, x):
        fits = (mask.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(mask.bitwiseAND(x["inner"])) == 1)
        return F.when(fits, mask.bitwiseAND(F.bitwise_not(x["inner"]))).otherwise(mask)

    every = _bit(2, F.length("word")) - 1
    return grouped.select("word", F.aggregate(F.transform("edges", bits), every, taken).alias("cuts"))


def _shift(name: str, by: int) -> F.Column:
    return F.call_function("shiftleft", F.col(name).cast("long"), F.lit(by))


def _ids(word: str, cuts: int | None, v: Vocabulary) -> list[int]:
    """Ids of the pieces between the cuts; without cuts every character stands alone."""
    ends = [b for b in range(1, len(word) + 1) if cuts is None or cuts >> b & 1]
    return _spell([word[a:b] for a, b in zip([0, *ends], ends)], v)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[tuple[int, int, np.ndarray, np.ndarray]]]]:
    """Batch parts of bounded text size, the number of each (from its content), and its texts in smaller runs."""
    for batch in batches:
        for lo, hi, buf, offsets in chunks(batch, "text", SHARD_BYTES):
            part = batch.slice(lo, hi - lo)
            yield part, xxhash.xxh64_intdigest(np.ascontiguousarray(buf), len(offsets)) >> 1, chunks(part, "text", RUN_BYTES)


def _unseen(seen: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted, distinct ``h`` are not among ``seen``, and both together, sorted."""
    at = np.searchsorted(seen, h)
    new = at == len(seen)
    new[~new] = seen[at[~new]] != h[~new]
    return new, np.insert(seen, at[new], h[new])


class Cutter:
    """Finds the words of texts: word marks go in front of characters that pieces join; others stand alone."""

    def __init__(self, v: Vocabulary) -> None:
        self.joined = np.zeros(0x110000, bool)
        self.joined[[ord(c) for p in v.pieces if len(p) > 1 for c in p]] = True
        self.joined[ord(MARK)] = False

    def words(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of the texts with their marks, and of every word: start, end, hash, number of its text."""
        raw, mark = buf.tobytes(), ord(MARK)
        texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        points = np.frombuffer("".join([" " + t if t else "" for t in texts]).encode("utf-32-le"), np.uint32).copy()
        points[points == 32] = mark
        edges = np.concatenate(([0], np.cumsum([len(t) + 1 if t else 0 for t in texts])))
        is_mark, joined = points == mark, self.joined[points]
        start = ~(is_mark | joined)
        start[1:] |= (is_mark[1:] & ~is_mark[:-1]) | (joined[1:] & ~(joined[:-1] | is_mark[:-1]))
        start[edges[:-1][np.diff(edges) > 0]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(points))[:len(begin)]
        return points, begin, end, range_hash(prefix_sums(points), begin, end), np.searchsorted(edges, begin, "right") - 1


def _strings(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[str]:
    text = points.tobytes().decode("utf-32-le", "replace")
    return [text[x:y] for x, y in zip(begin.tolist(), end.tolist())]


def write_dictionaries(docs: DataFrame, v: Vocabulary) -> tuple[str, int]:
    """Encode the distinct words of ``docs``; returns the folder with one dictionary per shard, and its sub-folders.

    Folders grow in number with the texts, so that each holds about one dictionary. An empty table makes an empty
    folder; equal texts share a dictionary or have equal ones."""
    spark = docs.sparkSession
    late = late_pieces(v)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, math.ceil(total / SHARD_BYTES))
    shared = spark.sparkContext.broadcast(v)  # a vocabulary of fixed size

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(shared.value)
        for _, shard, runs in _shards(batches):
            seen = np.zeros(0, np.uint64)
            for _, _, buf, offsets in runs:
                points, begin, end, h, _ = cutter.words(buf, offsets)
                short = end - begin <= LONGEST
                h, first = np.unique(h[short], return_index=True)
                new, seen = _unseen(seen, h)
                own = _strings(points, begin[short][first[new]], end[short][first[new]])
                own = [w for w in own if not any(x in w for x in late)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(own), pa.int64()), pa.array(own, pa.string())], names=["shard", "word"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, held, n = zstandard.ZstdCompressor(level=6), {}, 0

        def flush():
            shards, texts, masks = [], [], []
            for shard, found in held.items():
                found.sort()  # like beside like, for the compressor
                shards.append(shard)
                texts.append(squeeze.compress(" ".join([w for w, _ in found]).encode()))  # no word holds a blank
                planes = np.array([c for _, c in found], "<i8").view(np.uint8).reshape(-1, 8).T
                masks.append(squeeze.compress(planes.tobytes()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(texts, pa.binary()), pa.array(masks, pa.binary())], names=["shard", "words", "cuts"])

        for batch in batches:
            for shard, word, cuts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held.setdefault(shard, []).append((word, cuts or 0))
            n += batch.num_rows
            if n > 200_000:
                yield flush()
                n = 0
        if held:
            yield flush()

    parts = spread(docs)
    # the same columns as in the second pass, so that batches and shards end at the same rows
    pairs = docs.mapInArrow(report, "shard long, word string")
    # the join asks for words that aren't null on one side; asked on both, both read one shuffle
    pairs = pairs.filter(F.col("word").isNotNull()).repartition(parts, "word")
    # the length is an aggregate that needs the shard, so nothing is filtered or pruned below that shuffle
    words = pairs.groupBy("word").agg(F.max(F.when(F.col("shard").isNotNull(), F.length("word"))).alias("n"))
    coded = cut_words(words, v, F.col("n"))
    back = pairs.join(coded.hint("shuffle_hash"), "word", "left").select("shard", "word", "cuts").mapInArrow(pack, "shard long, words binary, cuts binary")
    path = scratch_path(spark)
    (back.withColumn("bucket", F.pmod("shard", F.lit(buckets))).repartition(spread(docs), "bucket")
     .write.partitionBy("bucket").parquet(path))
    return path, buckets


Dictionary = tuple[np.ndarray, np.ndarray, np.ndarray]


def _dictionary(path: str, buckets: int, shard: int, v: Vocabulary, kind: np.dtype) -> Dictionary:
    """Sorted hashes of the words of one shard, as far as it was written, where the ids of each begin, and the ids."""
    from pyarrow.fs import FileSelector

    files, root = _store(path)
    hashes, sizes, flat = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, kind)]
    unpack = zstandard.ZstdDecompressor()
    for info in files.get_file_info(FileSelector(f"{root}/bucket={shard % buckets}", allow_not_found=True)):
        if not info.path.endswith(".parquet"):
            continue
        with files.open_input_file(info.path) as f:
            table = pq.read_table(f, filters=[("shard", "=", shard)])
        for packed, cuts in zip(table.column("words"), table.column("cuts")):
            raw = unpack.decompress(packed.as_py())
            planes = np.frombuffer(unpack.decompress(cuts.as_py()), np.uint8).reshape(8, -1)
            ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), len(raw))
            for lo in range(0, len(ends), SLICE):
                hi = min(lo + SLICE, len(ends))
                text = raw[ends[lo - 1] + 1 if lo else 0:ends[hi - 1]].decode()
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                blanks = np.flatnonzero(points == 32)
                hashes.append(range_hash(prefix_sums(points), np.concatenate(([0], blanks + 1)), np.append(blanks, len(points))))
                masks = np.ascontiguousarray(planes[:, lo:hi].T).view("<i8").ravel().tolist()
                own, count = array(kind.char), []
                for word, mask in zip(text.split(" "), masks):
                    ids = _ids(word, mask or None, v)
                    own.extend(ids)
                    count.append(len(ids))
                sizes.append(np.array(count, np.int64))
                flat.append(np.frombuffer(own, kind))
    h, size = np.concatenate(hashes), np.concatenate(sizes)
    order = np.argsort(h)
    return h[order], np.stack(((np.cumsum(size) - size)[order], size[order])), np.concatenate(flat)


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids and n_tokens of every whole text, equal to the model's own encoding.

    Null and empty texts have no ids. Rows are independent of each other; repeated rows have equal ids.
    A batch on its way to Python is bounded by the bytes of a shard, for the whole session (the second pass is lazy),
    unless the session sets a bound of its own; else it holds 10,000 texts of any length."""
    v = read_vocabulary(path)
    if docs.sparkSession.conf.get(BATCH_BYTES, None) is None:
        docs.sparkSession.conf.set(BATCH_BYTES, str(SHARD_BYTES))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder, buckets = write_dictionaries(docs, v)
    shared = docs.sparkSession.sparkContext.broadcast(v)  # a vocabulary of fixed size
    kind = np.dtype("H" if len(v.raw) <= 1 << 16 else "I")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, merged = shared.value, {}
        cutter = Cutter(vocabulary)
        for part, shard, runs in _shards(batches):
            known, place, flat = _dictionary(folder, buckets, shard, vocabulary, kind)
            for lo, hi, buf, offsets in runs:
                points, begin, end, h, doc = cutter.words(buf, offsets)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                there = known[at] == h if len(known) else np.zeros(len(h), bool)
                first, size = (np.where(there, x[at], 0) if len(known) else np.zeros(len(h), np.int64) for x in place)
                # words that no dictionary holds are merged here
                rest = np.flatnonzero(~there)
                more, ids = array(kind.char), flat
                for k, word in zip(rest.tolist(), _strings(points, begin[rest], end[rest]) if len(rest) else []):
                    found = merged.get(word)
                    if found is None:
                        found = merge(word, vocabulary)
                        if len(merged) < CACHED_WORDS and len(word) <= LONGEST:
                            merged[word] = found
                    first[k], size[k] = len(flat) + len(more), len(found)
                    more.extend(found)
                if more:
                    ids = np.concatenate((flat, np.frombuffer(more, kind)))
                upto = np.cumsum(size)
                gather = np.repeat(first - (upto - size), size) + np.arange(int(size.sum()))
                count = np.bincount(doc, weights=size, minlength=hi - lo).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(ids[gather].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), lists, pa.array(count)], names=["doc_id", "ids", "n_tokens"])

    return docs.mapInArrow(look_up, "doc_id long, ids array<int>, n_tokens long")


def decode(coded: DataFrame, path: str = MODEL, spark: SparkSession | None = None) -> DataFrame:
    """All columns of ``coded`` with the ``text`` that its ids spell, in place of one of that name; without ids, the
    empty text.

    Bytes that are not UTF-8 become U+FFFD. Encoding and decoding give the text back, with U+2581 as a blank."""
    shared = coded.sparkSession.sparkContext.broadcast(read_vocabulary(path).raw)
    from pyspark.sql import types as T

    coded = coded.drop("text")
    at = coded.columns.index("ids")
    schema = T.StructType([*coded.schema.fields]).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.array(shared.value, object)
        for batch in batches:
            for lo in range(0, batch.num_rows, DECODED):
                part, texts = batch.slice(lo, DECODED), []
                for row in part.column(at):
                    ids = row.values.to_numpy() if row.is_valid else np.zeros(0, np.int32)
                    text = b"".join(raw[ids].tolist()).decode("utf-8", "replace")
                    texts.append(text[1:] if text[:1] == " " else text)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return coded.mapInArrow(run, schema)
