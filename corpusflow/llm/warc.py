"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record, indexed.

The writer is Spark's text writer: a record is a value and the two line ends that close a record are the
separator, so each file is one gzip stream. The normaliser inflates such a stream once, in pieces, writes
every record as a member of its own and a sidecar index of offsets beside it; a reader then fetches any
record alone. Files are written under another name and moved when whole, so a repeated task leaves the
same files."""

from __future__ import annotations

import hashlib
import base64
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import spread
from corpusflow.session import scratch_path, settle

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, record_type string, record_id string"


def base32_sha1(data) -> F.Column:
    """Bare upper-case base32 SHA-1, ten hex digits at a time."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One WARC record per page as ``value``, without the two line ends that close it.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is the
    response (rows that share it are responses too) and the others are revisits of it: HTTP headers
    only, with the digest and length of the full payload. A null html is empty, a null url too."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\r\\n]", "").alias("url"),
                     body.alias("html"), base32_sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    lead = p.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("lead"))
    p = p.join(lead, "digest", "left")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("lead")), F.lit(False)) & F.col("lead").isNotNull()

    def page(c):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, "html"))
    return p.select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), page("page_id"), F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), "url",
        F.lit("\r\nWARC-Payload-Digest: sha1:"), "digest",
        F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), page("lead"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    ).alias("value"))


def write_monolithic(made: DataFrame, path: str, per_file: int = 5000) -> None:
    """Archives that are one gzip stream each."""
    (made.write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", per_file).text(path))


def _store(uri: str):
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of the bytes of a WARC stream."""
    held = bytearray()
    need = 0
    for piece in pieces:
        held += piece
        while len(held) >= max(need, 1):
            head = held.find(b"\r\n\r\n")
            if head < 0:
                need = len(held) + 1
                break
            size = next((int(x.split(b":", 1)[1]) for x in bytes(held[:head]).split(b"\r\n") if x[:15].lower() == b"content-length:"), None)
            if size is None:
                raise ValueError("a record without Content-Length")
            need = head + 8 + size
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflate(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in bounded pieces."""
    machine = zlib.decompressobj(31)
    for at in range(0, len(content), step):
        data = content[at:at + step]
        while data:
            yield machine.decompress(data, step << 2)
            data = machine.unconsumed_tail
            if machine.eof:
                data, machine = machine.unused_data.lstrip(b"\0"), zlib.decompressobj(31)


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite the archives below ``source`` into ``target``; returns archive, n_records, n_bytes."""
    store, root = _store(target)
    store.create_dir(root, recursive=True)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _store(target)
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                name = path.as_py().rsplit("/", 1)[1].split(".")[0]
                part = f"{place}/.{name}-{uuid.uuid4().hex}"
                at, lines = 0, []
                with files.open_output_stream(part, compression=None) as out:
                    for record in split_records(inflate(content.as_py())):
                        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = pack.compress(record) + pack.flush()
                        out.write(member)
                        head = dict(x.split(b": ", 1) for x in record.split(b"\r\n\r\n", 1)[0].split(b"\r\n")[1:])
                        lines.append(f"{name}\t{at}\t{len(member)}\t{head[b'WARC-Type'].decode()}\t{head[b'WARC-Record-ID'].decode()}\n")
                        at += len(member)
                with files.open_output_stream(f"{part}.cdx", compression=None) as out:
                    out.write("".join(lines).encode())
                files.move(part, f"{place}/{name}.warc.gz")
                files.move(f"{part}.cdx", f"{place}/{name}.cdx")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(lines)]), pa.array([at])], names=["archive", "n_records", "n_bytes"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source)
    return settle(found.select("path", "content").mapInArrow(rewrite, "archive string, n_records long, n_bytes long"))


def read_index(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("pathGlobFilter", "*.cdx").schema(INDEX).csv(target)


def read_records(spark: SparkSession, target: str, block: int = 4 << 20) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records, each fetched by its offset."""
    index = read_index(spark, target).withColumn("block", F.floor(F.col("offset") / block))
    dealt = index.repartition(4 * spread(index), "archive", "block").sortWithinPartitions("archive", "offset")

    def number(value: bytes | None):
        text = (value or b"").decode().removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text not in ("", "none") else None

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _store(target)
        opened, file = None, None
        for batch in batches:
            rows = []
            for name, at, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if name != opened:
                    opened, file = name, files.open_input_file(f"{place}/{name}.warc.gz")
                file.seek(at)
                head, rest = zlib.decompress(file.read(size), 31).split(b"\r\n\r\n", 1)
                head = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
                http, payload = rest[:-4].split(b"\r\n\r\n", 1)
                kind = head[b"WARC-Type"].decode()
                if kind == "response":
                    n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                else:
                    n = int(http.rsplit(b": ", 1)[1])
                    digest = head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                rows.append((number(head[b"WARC-Record-ID"]), n, digest, kind, number(head.get(b"WARC-Refers-To"))))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return dealt.select("archive", "offset", "length").mapInArrow(
        fetch, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_bytes: int = 0, per_file: int = 5000) -> DataFrame:
    """Write the pages, normalise the archives and read every record back by the index."""
    spark = pages.sparkSession
    base = scratch_path(spark)
    write_monolithic(records(pages, min_bytes), f"{base}/whole", per_file)
    normalise(spark, f"{base}/whole", f"{base}/members")
    return read_records(spark, f"{base}/members")
