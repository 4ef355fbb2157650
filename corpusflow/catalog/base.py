"""Registry of the runnable queries and the SQL each one is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators.pairs import role_pairs
from corpusflow.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain_types(df: DataFrame) -> DataFrame:
    """Integers as bigint and fractions as double, as the SQL side returns them."""
    made = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        made.append(c.alias(f.name))
    return df.select(*made)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its statement for the comparison, if SQL can say it."""
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, root: plain_types(fn(spark, root))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


# --- shared inputs ---------------------------------------------------------
def documents(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "documents")


def conversations(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "conversations")


def doc_rows(spark: SparkSession, root: str) -> DataFrame:
    """Documents as training rows: first line, rest, source number as precedence."""
    d = documents(spark, root)
    first = F.substring_index("text", "\n", 1)
    return d.select(
        "doc_id", first.alias("instruction"),
        F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("response"),
        F.lit("").alias("history"), "source", "lang",
        F.substring("source", 4, 9).cast("int").alias("src_rank"), F.col("doc_id").alias("row_idx"),
    )


COPY_STEP = 1_000_000_000


def repeated_rows(spark: SparkSession, root: str) -> DataFrame:
    """Every training row with two copies: padded, half of them with another answer; and owned by source 0."""
    d = doc_rows(spark, root)
    padded = F.concat(F.lit("  "), "instruction", F.lit(" "))
    key = lambda n: (F.col("doc_id") + F.lit(n * COPY_STEP)).cast("bigint")
    answer = F.when(F.col("doc_id") % 2 == 1, F.concat("response", F.lit(" bis"))).otherwise(F.col("response"))
    other = d.withColumns({"doc_id": key(1), "row_idx": key(1), "instruction": padded, "response": answer})
    moved = d.withColumns({"doc_id": key(2), "row_idx": key(2), "instruction": padded,
                           "source": F.lit("src0"), "src_rank": F.lit(0)})
    same = d.withColumns({"doc_id": F.col("doc_id").cast("bigint"), "row_idx": F.col("row_idx").cast("bigint")})
    return same.unionByName(other).unionByName(moved)


def pairs(spark: SparkSession, root: str) -> DataFrame:
    return role_pairs(conversations(spark, root))


def calls(spark: SparkSession, root: str) -> DataFrame:
    """Events read as provider calls."""
    return load(spark, root, "events").select(
        F.col("user_id").cast("string").alias("provider"), "ts", F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"))


def requests(spark: SparkSession, root: str) -> DataFrame:
    """Events read as API requests; the role follows from the principal."""
    role = F.element_at(F.array(*[F.lit(r) for r in ("basic", "advanced", "admin")]),
                        (F.col("user_id") % 3 + 1).cast("int"))
    return load(spark, root, "events").select(
        F.col("user_id").cast("string").alias("principal"), role.alias("role"), "ts",
        F.col("event_id").alias("seq"))


def event_k():
    return F.get_json_object("props", "$.k").cast("bigint")


def chat_events(spark: SparkSession, root: str, exchanges: DataFrame | None = None, texts: tuple[str, ...] = ("user_text", "assistant_text")) -> DataFrame:
    """Every event with the exchanges of its conversation: events deal the conversations out in turn.

    ``exchanges`` are the pairs of the conversations, if they are at hand, of which ``texts`` are taken over."""
    n = conversations(spark, root).agg(F.max("conv_id") + 1).first()[0] or 1
    e = load(spark, root, "events").select(
        "event_id", (F.col("event_id") % n).alias("conv_id"), "event_type", "value", event_k().alias("k"), "ts")
    p = pairs(spark, root) if exchanges is None else exchanges
    return p.join(e, "conv_id").select(
        "conv_id", "turn", *texts,
        (F.col("event_type") != "error").alias("in_domain"),
        (F.col("k") % 7 == 0).alias("is_low_quality"),
        (F.col("k") % 3 == 0).alias("corrected_by_verifier"),
        F.when(F.col("k") % 2 == 1, F.array(F.lit("issue"))).otherwise(
            F.array().cast("array<string>")).alias("verifier_issues"),
        (F.col("k") % 5 == 0).alias("has_quality"), (F.col("k") / F.lit(100.0)).cast("string").alias("quality_text"),
        F.concat(F.lit("s"), F.col("k").cast("string")).alias("summary"),
        (F.col("event_id") * 1000 + F.col("turn")).alias("row_idx"), "ts", "k",
    )


# --- SQL fragments ---------------------------------------------------------
def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x},''), '^\\s+|\\s+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x},''), '\\s+', ' ', 'g'))"


def norm(x: str) -> str:
    return collapse(f"lower({x})")


def soft(x: str) -> str:
    return collapse(f"regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g')")


def letters(x: str) -> str:
    return collapse(f"regexp_replace(lower({x}), '[^a-z0-9à-öø-ÿ\\s]', ' ', 'g')")


def toks(x: str, least: int = 2) -> str:
    return f"list_filter(string_split({letters(x)}, ' '), lambda t: length(t) >= {least})"


def ascii_toks(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[a-zA-Z0-9_]{{2,}}'), lambda t: lower(t))"


def words(x: str) -> str:
    return f"list_filter(string_split({collapse(x)}, ' '), lambda t: t <> '')"


def has(x: str, lexicon: list[str]) -> str:
    """Substring test, any of."""
    return "(" + " OR ".join(f"contains({x}, '{w.replace(chr(39), chr(39) * 2)}')" for w in lexicon) + ")"


def word(x: str, lexicon: list[str]) -> str:
    """Whole words (ASCII lexicon), written without a look-around."""
    return f"regexp_matches(' ' || regexp_replace({x}, '[^a-z0-9_à-öø-ÿ]', ' ', 'g') || ' ', ' ({'|'.join(lexicon)}) ')"


def inlist(x: str, values: list[str]) -> str:
    return f"{x} IN (" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


SQL_DOCS = """docs AS (
  SELECT doc_id, string_split(text, chr(10))[1] AS instruction,
         substr(text, length(string_split(text, chr(10))[1]) + 2) AS response,
         source, lang, CAST(substr(source, 4) AS BIGINT) AS src_rank
  FROM documents)"""

SQL_REPEATED = SQL_DOCS + """, rep AS (
  SELECT doc_id + copy * 1000000000 AS doc_id, CASE WHEN copy = 0 THEN instruction ELSE '  ' || instruction || ' ' END AS instruction,
         CASE WHEN copy = 1 AND doc_id % 2 = 1 THEN response || ' bis' ELSE response END AS response,
         CASE WHEN copy = 2 THEN 'src0' ELSE source END AS source, CASE WHEN copy = 2 THEN 0 ELSE src_rank END AS src_rank
  FROM docs, (SELECT unnest([0, 1, 2]) AS copy))"""

SQL_PAIRS = f"""pairs AS (
  SELECT conv_id, turn, {strip('text')} AS user_text, {strip('nt')} AS assistant_text
  FROM (SELECT *, lead(text) OVER w AS nt, lead(role) OVER w AS nr FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND nr = 'assistant' AND {strip('text')} <> '' AND {strip('nt')} <> '')"""

SQL_EVENTS = """ev AS (
  SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""

SQL_CHAT = SQL_PAIRS + ", " + SQL_EVENTS + """, chat AS (
  SELECT p.*, e.event_type <> 'error' AS in_domain, k % 7 = 0 AS low, k % 3 = 0 AS corrected,
         k % 2 = 1 AS issue, k % 5 = 0 AS has_quality, k / 100.0::DOUBLE AS q, 's' || k AS summary,
         event_id * 1000 + turn AS row_idx, e.ts, k
  FROM pairs p JOIN ev e ON e.event_id % (SELECT max(conv_id) + 1 FROM conversations) = p.conv_id)"""
