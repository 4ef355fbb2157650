"""Registered queries of the operators, each over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import align, fertility, imatch, mixing, pieces, pii, simhash, suffix, superkmer, toxicity, vafile, warc, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


@query
def op1_mixing(spark: SparkSession, root: str) -> DataFrame:
    """Copies of every document so that sources meet their target words."""
    return mixing.mix(_table(spark, root, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op2_toxicity(spark: SparkSession, root: str) -> DataFrame:
    """Toxicity score of every document; ``reject`` is the decision at the threshold of its language."""
    docs = _table(spark, root, "documents")
    model = toxicity.train(docs, _table(spark, root, "labels"))
    return toxicity.score(docs.select("doc_id", "lang", "text"), model).select(
        F.col("doc_id").cast("long").alias("doc_id"), toxicity._held_out("doc_id").alias("held_out"),
        F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxic_reject").alias("reject"))


@query
def op3_pii(spark: SparkSession, root: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    docs = _table(spark, root, "documents")
    found = pii.find(docs, pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op4_imatch(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return imatch.edited_fingerprints(_table(spark, root, "documents"))


@query
def op5_warc(spark: SparkSession, root: str) -> DataFrame:
    """Every page as it is read back from the normalised archives."""
    return warc.round_trip(_table(spark, root, "pages"))


@query
def op6_superkmer(spark: SparkSession, root: str) -> DataFrame:
    """Every document without the words of repeated windows."""
    return superkmer.remove_repeats(_table(spark, root, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_suffix(spark: SparkSession, root: str) -> DataFrame:
    """Every document without the bytes of repeated strings."""
    return suffix.remove_repeats(_table(spark, root, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_simhash(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, root, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Piece ids of every document, and a digest of the text that they decode to."""
    coded = pieces.encode(_table(spark, root, "documents"))
    return pieces.decode(coded).select("doc_id", "n_tokens", "ids", F.sha2("text", 256).alias("decoded_sha256"))


@query
def op10_vafile(spark: SparkSession, root: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return vafile.top_k(_table(spark, root, "embeddings"))


@query
def op11_align(spark: SparkSession, root: str) -> DataFrame:
    """Groups and links of the tokens of two vocabularies in every document."""
    return align.align(_table(spark, root, "documents"))


@query
def op12_fertility(spark: SparkSession, root: str) -> DataFrame:
    """Counts, token measures and verdict of every document."""
    return fertility.judge(_table(spark, root, "documents"))


@query
def op13_whitening(spark: SparkSession, root: str) -> DataFrame:
    """Every vector along its leading components. A squared deviation beyond 64 bits is null here."""
    return whiten.whiten(_table(spark, root, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLES["op6_superkmer"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s+19], ' ') AS k
        FROM d, unnest(range(1, len(w) - 18)) AS u(s) WHERE len(w) >= 20),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM late, unnest(range(0, 20)) AS u(i)),
cut AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, p, w[p] AS t FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLES["op10_vafile"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
      FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body)::BIGINT AS n, sha1(body) AS d FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS lead FROM h)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(d, i * 5 + 1, 5))::BIGINT >> b) & 31)::INTEGER + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to
FROM g"""
