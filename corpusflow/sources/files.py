"""Readers and writers for the file formats of a conversation corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import (
    clean_text, first_text, list_literal, parse_dialog, strip, text_of,
)

from corpusflow.operators.scan import chunk_of, running_sum
from corpusflow.session import settle

DELIMITER = " +++$+++ "
PAIR_COLUMNS = [
    "conversation_id", "turn_index", "movie_id", "movie_title", "movie_year", "genres",
    "speaker_id", "speaker_name", "speaker_gender", "listener_id", "listener_name",
    "listener_gender", "prompt_en", "response_en", "source_dataset", "is_pretranslated_fr",
]
TRAINING_COLUMNS = ["instruction", "response", "history", "source"]


# --- files -----------------------------------------------------------------
def list_files(spark: SparkSession, root: str, suffix: str = "") -> list[str]:
    """Sorted paths directly under ``root``; a table may be one file or a folder of parts."""
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(path)]
    return sorted((p for p in found if p.endswith(suffix)), key=lambda p: p.rsplit("/", 1)[-1])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def file_stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def with_row_index(df: DataFrame, name: str = "row_idx", start: int = 0) -> DataFrame:
    """Number the rows of a scan in file-name and file order, across splits and files.

    Rows of one file block are numbered where they are read; one count per block shifts them.
    ``df`` has to be a scan, possibly with filters and projections kept above it."""
    src = df.select("*", F.col("_metadata.file_path").alias("_file"),
                    F.col("_metadata.file_block_start").alias("_block"),
                    F.monotonically_increasing_id().alias("_mid"))
    blocks = src.groupBy("_file", "_block").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # one row per file block, so this window only ever sees scan metadata
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_file", "_block", "_first",
                           F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    at = F.col("_base") + F.col("_mid") - F.col("_first") + start
    return src.join(blocks, ["_file", "_block"]).withColumn(name, at).select(*df.columns, name)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, on_bad: str = "drop") -> DataFrame:
    """JSON lines; blank, broken and non-object lines are dropped or kept as ``_corrupt_record``.

    A field whose value does not fit its type is NULL; the line stays."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    kept = schema.add("_corrupt_record", T.StringType()) if "_corrupt_record" not in schema.names else schema
    lines = spark.read.text(path)
    row = F.from_json(F.trim("value"), kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # from_json marks a line with one off-type field like a broken one; the variant parser tells them apart
    whole = row["_corrupt_record"].isNull() | F.try_parse_json(F.trim("value")).isNotNull()
    is_object = F.trim("value").startswith("{") & whole
    parsed = lines.filter(strip("value") != "").select(row.alias("r"), is_object.alias("_o"), "value")
    if on_bad == "keep":
        bad = ~F.col("_o")
        return parsed.select(
            *[F.col(f"r.{c}") for c in schema.names if c != "_corrupt_record"],
            F.when(bad, F.col("value")).alias("_corrupt_record"),
        )
    good = parsed.filter("_o")
    return good.select(*[F.col(f"r.{c}") for c in schema.names if c != "_corrupt_record"])


CSV = {"quote": '"', "escape": '"'}
LINES_PER_CHUNK = 50_000


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, number): the records of CSV files without their headers, numbered in file order from 0.

    A line break inside quotes is told by the quotes before it: their number is a sum over the lines of a file,
    taken in chunks and shifted by one row per chunk, so a file of any size is read by all its splits. Quotes
    inside a field have to be doubled, as CSV demands; a stray one would join lines."""
    lines = with_row_index(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")), "line")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = settle(lines.withColumns({"chunk": chunk_of("line", LINES_PER_CHUNK), "quotes": quotes}))
    upto = running_sum(lines, ["path"], ["line"], "chunk", F.col("quotes"), "seen")
    inside = (F.col("seen") - F.col("quotes")) % 2 == 1
    kept = upto.filter(inside | (F.col("value") != "")).withColumn("begins", (~inside).cast("int"))
    numbered = running_sum(kept, ["path"], ["line"], "chunk", F.col("begins"), "number")
    whole = numbered.groupBy("path", "number").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("parts"))
    files = numbered.groupBy("path").agg((F.max("number") - 1).alias("records"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = files.select("path", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("base"))
    text = F.array_join(F.transform("parts", lambda x: x["value"]), "\n")
    return whole.filter("number > 1").join(files, "path").select(text.alias("record"), (F.col("base") + F.col("number") - 2).alias("number"))


def read_pairs_csv(spark: SparkSession, path: str, indexed: bool = True) -> DataFrame:
    """Header CSV, every column a string; a missing file is an empty table.

    Files with line breaks inside quotes are read by all their splits too (``csv_records``)."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in TRAINING_COLUMNS) + ", row_idx bigint")
    head = spark.read.options(header=True, multiLine=True, inferSchema=False, **CSV).csv(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head.columns])
    odd = spark.read.text(path).filter((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1)
    if odd.isEmpty():  # no quote stays open at the end of a line
        df = spark.read.options(header=True, **CSV).schema(schema).csv(path)
        return with_row_index(df) if indexed else df
    fields = F.lit(", ".join(f"`{c}` string" for c in schema.names))
    rows = csv_records(spark, path).select(F.from_csv("record", fields, CSV).alias("r"), "number")
    return rows.select("r.*", F.col("number").alias("row_idx")) if indexed else rows.select("r.*")


def read_lines(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """Trimmed non-blank lines in order; ``comments`` drops lines that start with ``#``."""
    if not exists(spark, path):
        return spark.createDataFrame([], "line string, row_idx bigint")
    rows = with_row_index(spark.read.text(path)).select(strip("value").alias("line"), "row_idx")
    rows = rows.filter(F.col("line") != "")
    return rows.filter(~F.col("line").startswith("#")) if comments else rows


def write_pairs(df: DataFrame, path: str, columns: list[str] | None = None, form: str = "csv") -> None:
    """Fixed column order; absent columns and NULLs become empty texts."""
    columns = columns or TRAINING_COLUMNS
    out = df.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c)
        for c in columns
    ])
    writer = out.write.mode("overwrite")
    if form == "parquet":
        writer.parquet(path)
    else:
        writer.options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


# --- delimited dialogue corpus ---------------------------------------------
def _fields(spark: SparkSession, path: str, least: int, indexed: bool = False) -> DataFrame:
    lines = spark.read.text(path)
    if indexed:
        lines = with_row_index(lines, "line_no", 1)
    cut = lines.withColumn("f", F.split("value", r"\Q" + DELIMITER + r"\E", -1))
    return cut.filter(F.size("f") >= least)


def _nth(*names: str) -> list[Column]:
    return [F.col("f")[i].alias(n) for i, n in enumerate(names)]


def read_delimited_corpus(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Titles, characters, lines and conversations; short rows drop, extra fields are ignored."""
    genres = F.when(
        F.col("genres").startswith("["), F.array_join(list_literal("genres"), ", ")
    ).otherwise(F.col("genres"))
    titles = _fields(spark, f"{root}/movie_titles_metadata.txt", 6).select(
        *_nth("movie_id", "movie_title", "movie_year", "imdb_rating", "imdb_votes", "genres"))
    titles = titles.withColumn("genres", clean_text(genres)).withColumn("movie_title", clean_text("movie_title"))
    characters = _fields(spark, f"{root}/movie_characters_metadata.txt", 6).select(
        *_nth("character_id", "character_name", "movie_id", "movie_title_from_char", "character_gender",
              "character_credit_pos"))
    for c in ("character_name", "movie_title_from_char"):
        characters = characters.withColumn(c, clean_text(c))
    lines = _fields(spark, f"{root}/movie_lines.txt", 5).select(
        *_nth("line_id", "character_id", "movie_id", "character_name", "text"))
    for c in ("character_name", "text"):
        lines = lines.withColumn(c, clean_text(c))
    conversations = _fields(spark, f"{root}/movie_conversations.txt", 4, True).select(
        "line_no", *_nth("char1", "char2", "movie_id", "ids"))
    conversations = conversations.filter(
        F.col("ids").rlike(r"^\s*\[.*\]\s*$")
    ).select(
        F.concat(F.lit("conv_"), F.col("line_no").cast("string")).alias("conversation_id"), "line_no",
        "char1", "char2", "movie_id", list_literal("ids").alias("line_ids"),
    )
    return {"titles": titles, "characters": characters, "lines": lines, "conversations": conversations}


# --- pair tables -----------------------------------------------------------
def zip_files(a: DataFrame, b: DataFrame, by: str = "row_idx") -> DataFrame:
    """Pair rows by position; the shorter side decides the length."""
    left = a.select(by, *[F.col(c).alias(f"a_{c}") for c in a.columns if c != by])
    right = b.select(by, *[F.col(c).alias(f"b_{c}") for c in b.columns if c != by])
    return left.join(right, by)


def _pair_rows(df: DataFrame, prompt: Column, response: Column, conv: Column, turn: Column, source: str,
               pretranslated: bool = False, max_chars: int | None = None) -> DataFrame:
    rows = df.select(
        conv.alias("conversation_id"), turn.cast("int").alias("turn_index"), prompt.alias("prompt_en"),
        response.alias("response_en"), F.lit(source).alias("source_dataset"),
        F.lit(pretranslated).alias("is_pretranslated_fr"), F.col("row_idx"),
    )
    rows = rows.filter((text_of("prompt_en") != "") & (text_of("response_en") != ""))
    if max_chars is None:
        return rows
    return rows.filter((F.length("prompt_en") <= max_chars) & (F.length("response_en") <= max_chars))


def question_answer_pairs(df: DataFrame, name: str, max_chars: int | None = None) -> DataFrame:
    stem = file_stem(name)
    conv = F.concat(F.lit(f"qa_{stem}_"), (F.col("row_idx") + 1).cast("string"))
    return _pair_rows(df, clean_text("question"), clean_text("answer"), conv, F.lit(0), f"qa_csv:{name}",
                      stem.lower().endswith("_fr"), max_chars)


def dialog_pairs(df: DataFrame, name: str, max_chars: int | None = None) -> DataFrame:
    """Neighbouring turns of the dialog column; blanks are gone before pairing."""
    turns = df.select("row_idx", parse_dialog("dialog").alias("t"))
    at = F.sequence(F.lit(0), F.size("t") - 2)
    steps = turns.filter(F.size("t") >= 2).select("row_idx", "t", F.explode(at).alias("i"))
    conv = F.concat(F.lit(f"dialog_{file_stem(name)}_"), (F.col("row_idx") + 1).cast("string"))
    return _pair_rows(steps, F.get("t", F.col("i")), F.get("t", F.col("i") + 1), conv, F.col("i"),
                      f"dialog_csv:{name}", max_chars=max_chars)


def input_target_pairs(a: DataFrame, b: DataFrame, name_a: str, name_b: str,
                       max_chars: int | None = None) -> DataFrame:
    def texts(df: DataFrame) -> DataFrame:
        return df.select("row_idx", first_text([c for c in df.columns if c != "row_idx"]).alias("text"))
    both = zip_files(texts(a), texts(b))
    conv = F.concat(F.lit(f"input_target_{file_stem(name_a)}_"), (F.col("row_idx") + 1).cast("string"))
    return _pair_rows(both, F.col("a_text"), F.col("b_text"), conv, F.lit(0), f"input_target_csv:{name_a}+{name_b}",
                      max_chars=max_chars)


def discover_pair_sources(spark: SparkSession, root: str, prefer_native: bool = True,
                          native: str = "synthetic_realistic_qa_fr.csv",
                          twin: str = "synthetic_realistic_qa.csv", max_chars: int | None = None,
                          ) -> tuple[DataFrame | None, DataFrame | None]:
    """Every pair table in a folder, routed by its header; sorted names give the precedence.

    Pairs with a text over ``max_chars`` characters are left out; None keeps all. Only names and header
    lines are looked at on the driver."""
    paths = {p.rsplit("/", 1)[-1]: p for p in list_files(spark, root, ".csv")}
    lower = {n.lower() for n in paths}
    used: set[str] = set()
    parts: list[DataFrame] = []
    for name, path in paths.items():
        if name in used or (prefer_native and native in lower and name.lower() == twin):
            continue
        df = None
        if name.lower().startswith("input"):
            target = f"target{file_stem(name)[5:]}.csv"
            if target in paths:
                df = input_target_pairs(read_pairs_csv(spark, path), read_pairs_csv(spark, paths[target]), name, target, max_chars)
                used.add(target)
        if df is None:
            table = read_pairs_csv(spark, path)
            names = {c.strip().lower(): c for c in table.columns}
            if {"question", "answer"} <= names.keys():
                df = question_answer_pairs(
                    table.select("row_idx", F.col(names["question"]).alias("question"), F.col(names["answer"]).alias("answer")), name, max_chars)
            elif "dialog" in names:
                df = dialog_pairs(table.select("row_idx", F.col(names["dialog"]).alias("dialog")), name, max_chars)
        if df is not None:
            parts.append(df.withColumn("src_rank", F.lit(len(parts) + 1)))
    if not parts:
        return None, None
    rows = reduce(lambda x, y: x.unionByName(y), parts)
    return rows, rows.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("rows"))
