"""Queries for sources, sinks and composite jobs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.catalog.base import (
    SQL_CHAT, SQL_DOCS, SQL_EVENTS, SQL_PAIRS, SQL_REPEATED, chat_events, conversations, doc_rows, documents, has, toks,
    norm, pairs, query, repeated_rows, strip, words,
)
from corpusflow.catalog.expressions import (
    FLAG_WORDS, INTENTS, SCORE_WORDS, TAGS, sql_flags, sql_html_text, sql_intent, sql_message_score, sql_tags,
    sql_unescape,
)
from corpusflow.catalog.relations import (
    MARKS, SQL_ALLOWED, SQL_HOST, SQL_OPENING, TEST_POLICY, allowed, answers, cases, sql_bench, sql_feedback,
    sql_hash, sql_waterfall,
)
from corpusflow.functions import text as tx
from corpusflow.operators import evaluate as ev
from corpusflow.operators import overlap as ov
from corpusflow.operators import search as se
from corpusflow.operators.policy import FeedbackPolicy
from corpusflow.plans import bundle as bn
from corpusflow.plans import continual as cn
from corpusflow.plans import corpus as cp
from corpusflow.plans import curation as cu
from corpusflow.plans import synthesis as sy
from corpusflow.session import load
from corpusflow.session import scratch_path as scratch
from corpusflow.sources import files as fi
from corpusflow.sources.store import StoreWords


# --- sources and sinks -----------------------------------------------------
@query("s01_read_jsonl", f"WITH {SQL_EVENTS} SELECT k, count(*) AS rows FROM ev WHERE event_type <> 'view' GROUP BY k")
def read_jsonl(spark, root):
    """Every fifth kind of line is broken in one of several ways."""
    e = load(spark, root, "events")
    bad = F.element_at(F.array(*[F.lit(x) for x in ("", "[1]", '{"k": ', "7", "   ")]), (F.col("event_id") % 5 + 1).cast("int"))
    line = F.when(F.col("event_type") == "view", bad).otherwise(F.concat(F.lit("  "), "props"))
    path = scratch(spark)
    e.select(line.alias("value")).write.text(path)
    return fi.read_jsonl(spark, path, "k bigint").groupBy("k").agg(F.count(F.lit(1)).alias("rows"))


@query("s02_read_pairs_csv", f"WITH {SQL_DOCS} SELECT instruction, response, source, count(*) AS rows FROM docs GROUP BY ALL")
def read_pairs_csv(spark, root):
    path = scratch(spark)
    fi.write_pairs(doc_rows(spark, root), path)
    back = fi.read_pairs_csv(spark, path).na.fill("", ["instruction", "response", "source"])
    return back.groupBy("instruction", "response", "source").agg(F.count(F.lit(1)).alias("rows"))


@query("s06_write_pairs", """
SELECT doc_id::VARCHAR AS doc_id, '' AS missing, lang FROM documents""")
def write_pairs(spark, root):
    path = scratch(spark)
    fi.write_pairs(documents(spark, root), path, ["doc_id", "missing", "lang"], "parquet")
    return spark.read.parquet(path)


@query("s07_write_jsonl", "SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang FROM documents")
def write_jsonl(spark, root):
    path = scratch(spark)
    d = documents(spark, root).select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"))
    fi.write_jsonl(d, path)
    return fi.read_jsonl(spark, path, "doc_id bigint, text string, lang string")


@query("s12_read_lines", f"""
WITH l AS (SELECT {strip('unnest(string_split(text, chr(10)))')} AS line FROM documents)
SELECT line, count(*) AS rows FROM l WHERE line <> '' AND NOT starts_with(line, '#') GROUP BY line""")
def read_lines(spark, root):
    path = scratch(spark)
    documents(spark, root).select(F.col("text").alias("value")).write.text(path)
    return fi.read_lines(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("rows"))


def _flat(c: str):
    return F.regexp_replace(c, "\n", " ")


@query("s05_zip_files", """
WITH u AS (SELECT replace(text, chr(10), ' ') AS t, row_number() OVER (ORDER BY conv_id, turn) AS i FROM conversations WHERE role = 'user'),
a AS (SELECT replace(text, chr(10), ' ') AS t, row_number() OVER (ORDER BY conv_id, turn) AS i FROM conversations WHERE role = 'assistant')
SELECT i - 1 AS row_idx, trim(u.t) AS a_line, trim(a.t) AS b_line FROM u JOIN a USING (i)""")
def zip_files(spark, root):
    c = conversations(spark, root).orderBy("conv_id", "turn")
    sides = []
    for role in ("user", "assistant"):
        path = scratch(spark)
        c.filter(F.col("role") == role).select(_flat("text").alias("value")).write.text(path)
        sides.append(fi.read_lines(spark, path, False))
    return fi.zip_files(*sides)


SQL_QA = f"""{SQL_DOCS}, qa AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM docs WHERE src_rank % 4 = 3),
dl AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM docs WHERE src_rank % 4 = 0),
a AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM docs WHERE src_rank % 4 = 1),
b AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM docs WHERE src_rank % 4 = 2),
found AS (
  SELECT 'dialog_dialogs_' || i AS conversation_id, source AS p, lang AS r, 'dialog_csv:dialogs.csv' AS source_dataset FROM dl
  UNION ALL SELECT 'input_target_input1_' || a.i, a.lang, b.source, 'input_target_csv:input1.csv+target1.csv' FROM a JOIN b USING (i)
  UNION ALL SELECT 'qa_qa_fr_' || i, instruction, lang, 'qa_csv:qa_fr.csv' FROM qa)"""


def _pair_folder(spark: SparkSession, root: str) -> str:
    """Every source in one of a question table, a dialog table and an input/target twin."""
    d = doc_rows(spark, root).orderBy("doc_id")
    path = scratch(spark)
    plain = F.translate("instruction", "\"'&()`’“”", "")
    fi.write_pairs(d.filter("src_rank % 4 = 3").select(plain.alias("question"), F.col("lang").alias("answer")), f"{path}/qa_fr.csv", ["question", "answer"])
    dialog = F.concat(F.lit("['"), "source", F.lit("' \""), "lang", F.lit("\"]"))
    fi.write_pairs(d.filter("src_rank % 4 = 0").select(dialog.alias("dialog")), f"{path}/dialogs.csv", ["dialog"])
    fi.write_pairs(d.filter("src_rank % 4 = 1").select("doc_id", F.col("lang").alias("text")), f"{path}/input1.csv", ["doc_id", "text"])
    fi.write_pairs(d.filter("src_rank % 4 = 2").select("doc_id", F.col("source").alias("utterance")), f"{path}/target1.csv", ["doc_id", "utterance"])
    return path


@query("s04_discover_pair_sources", f"""
WITH {SQL_QA} SELECT conversation_id, trim(regexp_replace(regexp_replace(translate(p, '"''&()`’“”', ''), '\\s+', ' ', 'g'), '\\s+([,;:.!?])', '\\1', 'g')) AS prompt_en,
  r AS response_en, source_dataset, source_dataset LIKE 'qa%' AS is_pretranslated_fr FROM found""")
def discover_pair_sources(spark, root):
    return fi.discover_pair_sources(spark, _pair_folder(spark, root), max_chars=None)[0].select(
        "conversation_id", "prompt_en", "response_en", "source_dataset", "is_pretranslated_fr")


def _corpus_folder(spark: SparkSession, root: str) -> str:
    """Conversations as a delimited dialogue corpus, documents as film titles."""
    c = conversations(spark, root)
    path, d = scratch(spark), fi.DELIMITER
    line = F.concat(F.lit("L"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string"))
    who = F.concat(F.lit("u"), (F.col("conv_id") % 9).cast("string"), "role")
    c.select(F.concat_ws(d, line, who, F.col("conv_id").cast("string"), "role", _flat("text")).alias("value")).write.text(f"{path}/movie_lines.txt")
    ids = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("'"), line, F.lit("'")).alias("id"))))
    convs = c.groupBy("conv_id").agg(F.array_join(F.transform(ids, lambda x: x["id"]), ", ").alias("ids")).orderBy("conv_id")
    convs.select(F.concat_ws(d, F.lit("a"), F.lit("b"), F.col("conv_id").cast("string"), F.concat(F.lit("["), "ids", F.lit("]"))).alias("value")).write.text(f"{path}/movie_conversations.txt")
    documents(spark, root).select(F.concat_ws(
        d, F.col("doc_id").cast("string"), "source", F.lit("1999"), F.lit("7"), F.lit("8"), F.concat(F.lit("['"), "lang", F.lit("', 'x']"))).alias("value")
    ).write.text(f"{path}/movie_titles_metadata.txt")
    c.filter("role = 'user'").select(F.concat_ws(
        d, who, F.concat(F.lit("N"), (F.col("conv_id") % 9).cast("string")), F.lit("m"), F.lit("t"), F.lit("f"), F.lit("1")).alias("value")
    ).distinct().write.text(f"{path}/movie_characters_metadata.txt")
    return path


SQL_CLEANED = "trim(regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(10), ' '), '\\s+', ' ', 'g'), '\\s+([,;:.!?])', '\\1', 'g'), '^\\s+|\\s+$', '', 'g'), '\"''')"
SQL_CORPUS = f"""l AS (SELECT conv_id, turn, role, {SQL_CLEANED.replace('{x}', 'text')} AS t FROM conversations),
n AS (SELECT *, row_number() OVER w - 1 AS pos, lead(t) OVER w AS nt, lead(role) OVER w AS nr, dense_rank() OVER (ORDER BY conv_id) AS line_no FROM l
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
kept AS (SELECT *, row_number() OVER (PARTITION BY lower(t), lower(nt) ORDER BY line_no, pos) AS copy FROM n WHERE t <> '' AND nt <> '' AND length(t) <= 300 AND length(nt) <= 300)"""


@query("s03_read_delimited_corpus", f"""
WITH {SQL_CORPUS} SELECT 'L' || (conv_id * 1000 + turn) AS line_id, conv_id::VARCHAR AS movie_id, role AS character_name, t AS text FROM l""")
def read_delimited_corpus(spark, root):
    return fi.read_delimited_corpus(spark, _corpus_folder(spark, root))["lines"].select("line_id", "movie_id", "character_name", "text")


@query("s03_read_conversations", """
SELECT 'conv_' || dense_rank() OVER (ORDER BY conv_id) AS conversation_id, conv_id::VARCHAR AS movie_id,
  string_agg('L' || (conv_id * 1000 + turn), ' ' ORDER BY turn) AS line_ids FROM conversations GROUP BY conv_id""")
def read_corpus_conversations(spark, root):
    c = fi.read_delimited_corpus(spark, _corpus_folder(spark, root))["conversations"]
    return c.select("conversation_id", "movie_id", F.array_join("line_ids", " ").alias("line_ids"))


@query("c01_build_pair_corpus", f"""
WITH {SQL_CORPUS} SELECT CASE WHEN length(t) % 2 = 0 THEN 'fr ' || t ELSE t END AS instruction, CASE WHEN length(nt) % 2 = 0 THEN 'fr ' || nt ELSE nt END AS response,
  'movie_dialogs' AS source, 'conv_' || line_no AS conversation_id, coalesce(d.source, '') AS movie_title, coalesce(d.lang || ', x', '') AS genres
FROM kept LEFT JOIN documents d ON d.doc_id = kept.conv_id WHERE copy = 1""")
def build_pair_corpus(spark, root):
    """Half of the texts are in the translation cache."""
    folder = _corpus_folder(spark, root)
    lines = fi.read_delimited_corpus(spark, folder)["lines"]
    template = tx.mask_placeholders("text")["template"]
    cache = lines.filter(F.length("text") % 2 == 0).select(
        F.concat(F.lit("en|fr::"), template).alias("key"), F.concat(F.lit("fr "), template).alias("translated")).distinct()
    return cp.build_pair_corpus(spark, folder, cache)["train"]


# --- bundle ----------------------------------------------------------------
BUNDLE_GROUPS = ["core", "ml_deep", "signature", "agent", "memory"]
SHARES = {"core": 0.4, "ml_deep": 0.2, "signature": 0.2, "agent": 0.1, "memory": 0.1}
BUNDLE = bn.BundlePolicy(
    cleaning=TEST_POLICY, feedback=FeedbackPolicy(150, 0.5), ratios=SHARES,
    strict_domain=True, domain_words=["tion", "er"], dedupe=True, seed=42)

SQL_KEY = f"concat_ws('|', {norm('instruction')}, {norm('response')}, source)"
SQL_BUNDLE = f"""{SQL_CHAT}, {SQL_DOCS},
rowsin AS (SELECT doc_id AS o, ['core', 'ml_deep', 'signature', 'agent', 'memory'][src_rank % 5 + 1] AS g, src_rank, {strip('instruction')} AS instruction,
  {strip('response')} AS response, source, [15000, 12000, 15000, 12000, 10000][src_rank % 5 + 1] AS cap FROM docs),
capped AS (SELECT *, row_number() OVER (PARTITION BY g, source ORDER BY {sql_hash(42, SQL_KEY)}, {SQL_KEY}) AS rc FROM rowsin WHERE instruction <> '' AND response <> ''),
base AS (SELECT * FROM capped WHERE rc <= cap), {sql_waterfall('instruction', 'response').replace(
    "length(response) < 60", "length(response) < (CASE WHEN g = 'memory' THEN 30 ELSE 60 END)").replace("ORDER BY o)", "ORDER BY src_rank, o)")},
dom AS (SELECT * FROM uniq WHERE variant = 1 AND (g = 'memory' OR {has("lower(instruction || ' ' || response || '  ' || source)", ['tion', 'er'])})),
quota AS (SELECT unnest(['core', 'ml_deep', 'signature', 'agent', 'memory']) AS g, unnest([4000, 2000, 2000, 1000, 1000]) AS n, unnest([0, 1, 2, 3, 4]) AS gi),
picked AS (SELECT d.*, quota.n, gi, row_number() OVER (PARTITION BY d.g ORDER BY {sql_hash(42, SQL_KEY)}, {SQL_KEY}) AS rq FROM dom d JOIN quota ON quota.g = d.g),
{sql_feedback(150, 0.5).replace('reasoned', 'freasoned').replace('ranked', 'franked').replace('judged', 'fjudged')},
fb AS (SELECT user_text AS instruction, assistant_text AS response, 'feedback_q' || format('{{:.2f}}', quality) AS source, row_idx FROM franked WHERE copy = 1),
fbs AS (SELECT * FROM fb ORDER BY {sql_hash(42, SQL_KEY)}, {SQL_KEY} LIMIT 30000),
allrows AS (SELECT instruction, response, source, g, gi * 1000000 + src_rank AS sr, o FROM picked WHERE rq <= n
  UNION ALL SELECT instruction, response, source, 'feedback', 5000000, row_idx FROM fbs),
final AS (SELECT *, row_number() OVER (PARTITION BY {norm('instruction')}, {norm('response')} ORDER BY sr, o) AS rf FROM allrows)"""


def _bundle(spark, root):
    d = doc_rows(spark, root)
    group = F.element_at(F.array(*[F.lit(g) for g in BUNDLE_GROUPS]), F.col("src_rank") % 5 + 1)
    rows = bn.prepare_rows(d, F.lit("x")).withColumn("group", group).withColumn("dataset", F.col("source"))
    return bn.build_feeding_bundle(chat_events(spark, root), rows.drop("doc_id", "lang"), BUNDLE)


@query("c02_build_feeding_bundle", f"WITH {SQL_BUNDLE} SELECT instruction, response, source, g AS \"group\" FROM final WHERE rf = 1")
def build_feeding_bundle(spark, root):
    return _bundle(spark, root)["bundle"].select("instruction", "response", "source", "group")


@query("c02_bundle_from_files", f"WITH {SQL_BUNDLE} SELECT instruction, response, source, g AS \"group\" FROM final WHERE rf = 1 AND g <> 'feedback'")
def bundle_from_files(spark, root):
    """The groups written as a CSV file each and read back; without feedback."""
    d = doc_rows(spark, root)
    folder = scratch(spark)
    paths = {}
    for i, g in enumerate(BUNDLE_GROUPS):
        paths[g] = [f"{folder}/{g}.csv"]
        fi.write_pairs(d.filter(F.col("src_rank") % 5 == i).orderBy("src_rank", "row_idx"), paths[g][0])
    rows = bn.read_groups(spark, paths)
    bundle = bn.build_feeding_bundle(chat_events(spark, root).limit(0), rows, BUNDLE)["bundle"]
    bn.check_not_empty(bundle, BUNDLE)
    return bundle.select("instruction", "response", "source", "group")


@query("s10_run_report", f"""
WITH {SQL_BUNDLE} SELECT 'counts' AS section, g AS key, count(*) AS value FROM final WHERE rf = 1 GROUP BY g
UNION ALL SELECT 'cleaning_filter', g || '.' || reason, rows FROM counts
UNION ALL SELECT 'feedback_filter', reason, count(*) FROM freasoned WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'feedback_filter', 'filtered_duplicate', count(*) FROM franked WHERE copy > 1 HAVING count(*) > 0
UNION ALL SELECT 'feedback_filter', 'kept', count(*) FROM franked WHERE copy = 1
UNION ALL SELECT 'targets', g, n FROM quota""")
def run_report(spark, root):
    r = bn.run_report(_bundle(spark, root), BUNDLE)
    parts = [r.select(F.lit(c).alias("section"), F.explode(F.col(c).cast("map<string,bigint>")).alias("key", "value"))
             for c in ("counts", "cleaning_filter", "feedback_filter", "targets")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- conversation store ----------------------------------------------------
CONTINUAL = cn.ContinualPolicy(
    min_score=0.55, select_min_score=0.6, style_words=("sich", "avec"),
    words=StoreWords(flags=FLAG_WORDS, score=SCORE_WORDS, tags=TAGS, intents=INTENTS))


def _exchange_log(spark, root) -> DataFrame:
    p = pairs(spark, root)
    return p.select(
        F.concat(F.lit("c"), "conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_idx"),
        F.concat(F.lit("t"), F.col("turn").cast("string")).alias("timestamp"), "user_text", "assistant_text",
        F.lit("u").alias("user_id"))


def _sql_store() -> str:
    f = sql_flags("v")
    both = norm("user_text || ' ' || assistant_text")
    return f"""{SQL_PAIRS}, two AS (SELECT 'c' || conv_id AS cid, conv_id * 1000 + turn AS line, turn, user_text, assistant_text, {both} AS pv FROM pairs),
m AS (SELECT cid, line, 'user' AS role, {norm('user_text')} AS v FROM two UNION ALL SELECT cid, line, 'assistant', {norm('assistant_text')} FROM two),
s AS (SELECT *, {sql_message_score('role', 'v')} AS q, {f['domain']}::INTEGER AS d, {f['error']}::INTEGER AS e FROM m),
c AS (SELECT cid, avg(q) * 0.75::DOUBLE + avg(d) * 0.20::DOUBLE + (1.0::DOUBLE - avg(e)) * 0.05::DOUBLE
  - (CASE WHEN count(DISTINCT CASE WHEN role = 'assistant' THEN v END) > 1 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END) AS raw FROM s GROUP BY cid),
sc AS (SELECT cid, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, raw)), 9) AS score FROM c),
hd AS (SELECT cid, max(turn) AS last_turn, arg_max({sql_tags('pv')}, line) AS tags FROM two GROUP BY cid),
fil AS (SELECT *, score >= 0.55 AS ok FROM sc JOIN hd USING (cid)),
best AS (SELECT cid FROM fil WHERE ok AND score >= 0.6 ORDER BY score DESC, 't' || last_turn DESC, cid LIMIT 5000)"""


@query("c03_conversation_status", f"""
WITH {_sql_store()} SELECT cid AS conv_id, tags, string_split(tags, ',')[1] AS topic, 't' || last_turn AS ended_at, round(score, 6) AS quality_score,
  CASE WHEN cid IN (SELECT cid FROM best) THEN 'selected' WHEN ok THEN 'filtered' ELSE 'raw' END AS status FROM fil""")
def conversation_status(spark, root):
    out = cn.continual_conversations(cn.pairs_from_events(_exchange_log(spark, root)), CONTINUAL)
    return out["conversations"].select(
        "conv_id", "tags", "topic", "ended_at", F.round("quality_score", 6).alias("quality_score"), "status")


@query("c03_continual_export", f"""
WITH {_sql_store()}, h AS (SELECT two.*, coalesce(left(string_agg('Utilisateur: ' || user_text || ' ||| Assistant: ' || assistant_text, ' ||| ')
  OVER (PARTITION BY cid ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1400), '') AS history FROM two JOIN best USING (cid)),
st AS (SELECT *, {sql_intent('pv')} AS intent, {strip('assistant_text')} AS a FROM h)
SELECT cid AS conv_id, user_text AS instruction, assistant_text AS response, history, CASE WHEN (starts_with(a, '{{') AND ends_with(a, '}}')) OR intent = 'workflow' THEN 'agent_actions'
  WHEN intent = 'summary' THEN 'context_memory' WHEN {has(norm('user_text'), ['sich', 'avec'])} THEN 'style_signature' ELSE 'core_qa' END AS dataset FROM st""")
def continual_export(spark, root):
    out = cn.continual_conversations(cn.pairs_from_events(_exchange_log(spark, root)), CONTINUAL)
    return out["rows"].select("conv_id", "instruction", "response", "history", "dataset")


@query("c03_seed_conversations", f"""
WITH {SQL_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM docs),
p AS (SELECT 'csv_' || source || '_' || (doc_id + 1) AS cid, {strip('instruction')} AS q, {strip('response')} AS a FROM r WHERE n <= 3000)
SELECT cid AS conv_id, count(*) AS messages FROM (SELECT cid, q, a, unnest([1, 2, 3]) FROM p) WHERE q <> '' AND a <> '' GROUP BY cid""")
def seed_conversations(spark, root):
    """An empty log: the documents seed the store, each with its source as history."""
    seeds = doc_rows(spark, root).withColumns({"dataset": F.col("source"), "history": F.col("source")})
    log = cn.pairs_from_events(_exchange_log(spark, root).limit(0))
    out = cn.continual_conversations(log, CONTINUAL, seeds=seeds)
    return out["messages"].groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))


@query("c03_reingest_adds_nothing", f"WITH {SQL_PAIRS} SELECT count(*) * 2 AS messages, 0::BIGINT AS added FROM pairs")
def reingest(spark, root):
    p = cn.pairs_from_events(_exchange_log(spark, root))
    headers, messages, _ = cn.ingest(None, None, p, CONTINUAL.words)
    _, again, added = cn.ingest(headers, messages, p, CONTINUAL.words)
    total = added.agg(F.sum("added").alias("added"))
    return again.agg(F.count(F.lit(1)).alias("messages")).withColumn("added", total.scalar())


# --- pages -----------------------------------------------------------------
SQL_CHUNKS = f"""read AS (SELECT url, {SQL_HOST} AS domain, {sql_unescape(strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title,
  {sql_html_text('html')} AS t FROM pages WHERE {SQL_ALLOWED}),
cut AS (SELECT *, unnest(generate_series(0, (ceil(greatest(length(t) - 500, 0) / 400.0) * 400)::BIGINT, 400)) AS st FROM read WHERE length(t) > 0),
txt AS (SELECT url, domain, title, st, {strip('substr(t, st + 1, 500)')} AS text FROM cut),
chunks AS (SELECT url, domain, title, text, row_number() OVER (PARTITION BY url ORDER BY st) - 1 AS chunk_index, length(text) AS text_length FROM txt WHERE text <> '')"""


@query("c04_build_web_chunks", f"WITH {SQL_CHUNKS} SELECT * FROM chunks")
def build_web_chunks(spark, root):
    return se.build_web_chunks(load(spark, root, "pages"), allowed(spark), 500, 100, 0)[0]


@query("w10_chunk_index", f"WITH {SQL_CHUNKS} SELECT url, max(chunk_index) + 1 AS chunks FROM chunks GROUP BY url")
def chunk_index(spark, root):
    chunks = se.build_web_chunks(load(spark, root, "pages"), allowed(spark), 500, 100, 0)[0]
    return chunks.groupBy("url").agg((F.max("chunk_index") + 1).alias("chunks"))


@query("a18_ingest_manifest", f"""
WITH {SQL_CHUNKS} SELECT 'urls_seen' AS metric, count(*) AS value FROM pages UNION ALL SELECT 'urls_blocked', count(*) FROM pages WHERE NOT {SQL_ALLOWED}
UNION ALL SELECT 'chunks_written', count(*) FROM chunks UNION ALL SELECT 'urls_failed', count(*) FROM pages WHERE page_id % 50 = 0""")
def ingest_manifest(spark, root):
    p = load(spark, root, "pages")
    return se.build_web_chunks(p, allowed(spark), 500, 100, 0, p.filter("page_id % 50 = 0"))[1]


@query("c05_split_paragraph_chunks", f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: {strip('l')}), lambda l: l <> '') AS ps FROM documents),
r AS (SELECT doc_id, list_reduce(list_transform(ps, lambda x: {{'done': []::VARCHAR[], 'buf': x, 'used': length(x)}}),
  lambda a, b: CASE WHEN a.used + b.used > 480 THEN {{'done': list_append(a.done, a.buf), 'buf': b.buf, 'used': b.used}}
    ELSE {{'done': a.done, 'buf': a.buf || chr(10) || chr(10) || b.buf, 'used': a.used + b.used}} END) AS r FROM p WHERE len(ps) > 0),
c AS (SELECT doc_id, list_append(r.done, r.buf) AS cs FROM r),
n AS (SELECT doc_id, unnest(generate_series(1, len(cs))) AS chunk, unnest(cs) AS text FROM c)
SELECT * FROM n WHERE len({toks('text')}) > 0""")
def split_paragraph_chunks(spark, root):
    """Document lines as paragraphs."""
    d = documents(spark, root).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return se.split_paragraph_chunks(d)


# --- curation --------------------------------------------------------------
SQL_VALID = f"""{SQL_REPEATED}, b AS (SELECT doc_id, source AS dataset, src_rank, {norm("instruction")} AS q, {norm("CASE WHEN doc_id % 13 = 0 THEN '' ELSE response END")} AS r FROM rep),
f AS (SELECT *, first_value(r) OVER w AS r0, row_number() OVER w AS n FROM b WHERE q <> '' AND r <> '' WINDOW w AS (PARTITION BY dataset, q ORDER BY doc_id)),
o AS (SELECT *, min(src_rank) OVER (PARTITION BY q) AS owner FROM f WHERE n = 1)"""


def _series(spark, root):
    return repeated_rows(spark, root).select(
        "doc_id", F.col("source").alias("dataset"), "src_rank", "row_idx", "instruction",
        F.when(F.col("doc_id") % 13 == 0, " ").otherwise(F.col("response")).alias("response"))


@query("c07_validate_series", f"WITH {SQL_VALID} SELECT doc_id FROM o WHERE src_rank = owner")
def validate_series(spark, root):
    return cu.validate_series(_series(spark, root))[0].select("doc_id")


@query("a17_validation_report", f"""
WITH {SQL_VALID} SELECT b.dataset, count(*) AS before_rows, count_if(q <> '' AND r = '')::BIGINT AS removed_empty_response,
  (SELECT count_if(n > 1 AND r = r0) FROM f WHERE f.dataset = b.dataset)::BIGINT AS removed_duplicate_qr_within,
  (SELECT count_if(n > 1 AND r <> r0) FROM f WHERE f.dataset = b.dataset)::BIGINT AS removed_duplicate_question_within,
  (SELECT count_if(src_rank <> owner) FROM o WHERE o.dataset = b.dataset)::BIGINT AS removed_duplicate_question_cross_dataset,
  (SELECT count_if(src_rank = owner) FROM o WHERE o.dataset = b.dataset)::BIGINT AS after_rows FROM b GROUP BY b.dataset""")
def validation_report(spark, root):
    return cu.validate_series(_series(spark, root))[1]


@query("a17_duplicate_sample", f"""
WITH {SQL_VALID} SELECT q AS question, string_agg(dataset, ',' ORDER BY src_rank) AS datasets FROM o GROUP BY q HAVING count(*) > 1 ORDER BY q LIMIT 30""")
def duplicate_sample(spark, root):
    d = cu.duplicate_sample(cu.validate_series(_series(spark, root))[2])
    return d.select("question", F.array_join("datasets", ",").alias("datasets"))


def _sql_marks(x: str) -> str:
    return f"(len({words(x)}) >= 18 OR length({x}) - length(translate({x}, ',;:()-', '')) >= 2)"


def _sql_gain(cond: str, points: float) -> str:
    return f"(CASE WHEN {cond} THEN {points}::DOUBLE ELSE 0.0::DOUBLE END)"


SQL_SIGNATURE = f"""{SQL_DOCS}, b AS (SELECT *, row_number() OVER (PARTITION BY {strip('instruction')}, {strip('response')} ORDER BY src_rank, doc_id) AS c FROM docs),
u AS (SELECT *, {SQL_OPENING} AS opening FROM b WHERE c = 1), fr AS (SELECT opening, count(*) AS freq FROM u GROUP BY opening),
sc AS (SELECT doc_id, CASE WHEN {strip('instruction')} = '' OR {strip('response')} = '' THEN -1e9::DOUBLE ELSE
  least(len({words('response')}), 40) * 0.08::DOUBLE + least(len({words('instruction')}), 30) * 0.05::DOUBLE + {_sql_gain(_sql_marks('response'), 1.2)}
  + {_sql_gain(_sql_marks('instruction'), 0.8)} + {_sql_gain("contains(instruction, '?')", 0.4)} - {_sql_gain(f"len({words('response')}) <= 8", 1.2)}
  - least(freq / 1200.0::DOUBLE, 2.0::DOUBLE) - {_sql_gain("contains(lower(source), 'synthetic')", 0.15)} END AS score FROM u JOIN fr USING (opening))"""


@query("c09_signature_score", f"WITH {SQL_SIGNATURE} SELECT doc_id, round(score, 6) AS score FROM sc")
def signature_score(spark, root):
    return cu.score_signature(doc_rows(spark, root)).select("doc_id", F.round("score", 6).alias("score"))


@query("c09_select_signature", f"""
WITH {SQL_SIGNATURE}, r AS (SELECT doc_id, {sql_hash(42, 'doc_id')} AS h, row_number() OVER (ORDER BY round(score, 6) DESC, {sql_hash(42, 'doc_id')}, doc_id::VARCHAR) AS r FROM sc),
z AS (SELECT least(200, count(*)) AS target, floor(least(200, count(*)) * 0.8::DOUBLE)::BIGINT AS core FROM sc),
c AS (SELECT *, row_number() OVER (PARTITION BY r <= 2 * core ORDER BY h, doc_id::VARCHAR) AS k FROM r, z)
SELECT doc_id FROM c WHERE (r <= 2 * core AND k <= core) OR (r > 2 * core AND k <= target - core)""")
def select_signature(spark, root):
    return cu.select_signature(doc_rows(spark, root), 200).select("doc_id")


# --- synthesis -------------------------------------------------------------
def _slots(spark, root):
    """Slot catalogues taken from the tables: questions, sources, languages."""
    b = load(spark, root, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("value"))
    d = documents(spark, root)
    s = d.select(F.substring("source", 4, 9).cast("bigint").alias("idx"), F.col("source").alias("value")).distinct()
    langs = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])
    la = d.select("lang").distinct().select((F.array_position(langs, F.col("lang")) - 1).alias("idx"), F.col("lang").alias("value"))
    return {"q": b, "s": s, "l": la}


SQL_SLOTS3 = """b AS (SELECT item_id AS i, text AS q FROM benchmark),
s AS (SELECT DISTINCT substr(source, 4)::BIGINT AS j, source AS s FROM documents), l AS (SELECT DISTINCT list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS k, lang AS l FROM documents),
n AS (SELECT (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM s) AS ns),
made AS (SELECT 'Ask ' || q || ' for ' || s || ' in ' || l || '.' AS instruction, 'About ' || q || ': ' || s AS response, i + j * nb + k * nb * ns AS row_idx FROM b, s, l, n)"""


def sql_feistel(seed: int) -> str:
    """Numbers x below 4 ** h, the least such domain of the product, and their images p."""
    rounds, was = [], "f"
    for i in range(4):
        mixed = f"(('0x' || substr(md5('{seed}|{i}|' || r), 1, 8))::BIGINT & mask)"
        rounds.append(f"f{i} AS (SELECT x, h, mask, r AS l, xor(l, {mixed}) AS r FROM {was})")
        was = f"f{i}"
    return """dom AS (SELECT total, greatest(1, (length(ltrim(bin(greatest(1, total - 1)), '0')) + 1) // 2)::INTEGER AS h FROM (SELECT count(*) AS total FROM made)),
f AS (SELECT x, h, ((1 << h) - 1)::BIGINT AS mask, (x >> h)::BIGINT AS l, (x & ((1 << h) - 1))::BIGINT AS r FROM (SELECT unnest(range(0, (4 ** h)::BIGINT)) AS x, h FROM dom)),
""" + ",\n".join(rounds) + f", per AS (SELECT x, ((l << h) | r)::BIGINT AS p FROM {was})"


@query("c08_synthesize_templates", f"""
WITH {SQL_SLOTS3}, {sql_feistel(9)}, u AS (SELECT *, row_number() OVER (PARTITION BY lower(instruction), lower(response) ORDER BY x) AS c FROM made JOIN per ON p = row_idx)
SELECT instruction, response, 'template' AS source FROM u WHERE c = 1 ORDER BY x LIMIT (SELECT total // 2 FROM dom)""")
def synthesize_templates(spark, root):
    slots = _slots(spark, root)
    half = math.prod(v.count() for v in slots.values()) // 2
    return sy.synthesize_templates(spark, slots, "Ask {q} for {s} in {l}.", "About {q}: {s}", half, 9).select(
        "instruction", "response", "source")


@query("c08_padded_templates", f"""
WITH {SQL_SLOTS3}, cyc AS (SELECT unnest(generate_series(0, 49)) AS i), ls AS (SELECT list(q ORDER BY i) AS qs FROM b), ss AS (SELECT list(s ORDER BY j) AS s3 FROM s),
m AS (SELECT DISTINCT 'Ask ' || q AS instruction, 'On ' || s AS response FROM b, s)
SELECT instruction, response FROM m UNION ALL SELECT 'Ask ' || qs[i % len(qs) + 1], 'On ' || s3[i % len(s3) + 1] FROM cyc, ls, ss""")
def padded_templates(spark, root):
    slots = {k: v for k, v in _slots(spark, root).items() if k != "l"}
    full = slots["q"].count() * slots["s"].count()
    return sy.synthesize_templates(spark, slots, "Ask {q}", "On {s}", full + 50, 9, pad=True).select("instruction", "response")


@query("c08_question_variants", f"""
WITH b AS (SELECT doc_id, text AS q FROM documents),
x AS (SELECT *, ('0x' || substr(md5('r0|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS a, ('0x' || substr(md5('r1|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS b1,
  ('0x' || substr(md5('join|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS j, ('0x' || substr(md5('lower|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS lo FROM b),
y AS (SELECT *, CASE WHEN a < 0.25 THEN replace(q, 'the', 'th') ELSE q END AS q1 FROM x), z AS (SELECT *, CASE WHEN b1 < 0.25 THEN replace(q1, 'of', 'o') ELSE q1 END AS q2 FROM y),
w AS (SELECT *, CASE WHEN j < 0.30 AND length(q2) < 28 THEN replace(q2, ' ', '') ELSE q2 END AS q3 FROM z),
v AS (SELECT doc_id, trim(regexp_replace(CASE WHEN lo < 0.40 THEN lower(q3) ELSE q3 END, '\\s+', ' ', 'g')) AS instruction FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(lower(instruction), '\\s+', ' ', 'g')) ORDER BY doc_id) AS c FROM v) SELECT doc_id, instruction FROM r WHERE c = 1""")
def question_variants(spark, root):
    rows = documents(spark, root).select("doc_id", F.col("text").alias("q"))
    return sy.question_variants(rows, "q", "doc_id", [("the", "th"), ("of", "o")]).select("doc_id", "instruction")


@query("c11_remediation_from_failures", f"""
WITH {sql_bench()}, fr AS (SELECT unnest(['Directly.', 'In short.', 'For beginners.']) AS frame),
f AS (SELECT DISTINCT {strip('question')} AS question, array_to_string([x for x in string_split(question, ' ') if x <> ''], ', ') AS kw FROM bench WHERE final < 0.60),
r AS (SELECT question || ' ' || frame AS instruction, 'Key points: ' || kw || '.' AS response FROM f, fr)
SELECT instruction, response FROM r ORDER BY md5('4|' || lower(instruction) || '|' || lower(response)), lower(instruction) || '|' || lower(response) LIMIT (SELECT count(*) FROM benchmark)""")
def remediation(spark, root):
    scored = ev.score_benchmark(answers(spark, root), cases(spark, root), bad_markers=MARKS)
    frames = spark.createDataFrame([(0, "Directly."), (1, "In short."), (2, "For beginners.")], "idx int, value string")
    out = sy.remediation_from_failures(spark, scored, frames, "Key points: {keywords}.", load(spark, root, "benchmark").count(), 4)
    return out.select("instruction", "response")


@query("c13_source_guard", "SELECT doc_id, source FROM documents WHERE contains(source, 'src7') OR contains(source, 'src1')")
def source_guard(spark, root):
    return ov.forbidden_rows(documents(spark, root), ["src7", "src1"]).select("doc_id", "source")


SQL_RUNS = """e AS (SELECT *, CAST(json_extract(props, '$.k') AS DOUBLE) / 100.0::DOUBLE AS k FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY run_at) AS i,
  score * 0.40::DOUBLE + pass * 0.20::DOUBLE + f1 * 0.25::DOUBLE + kw * 0.10::DOUBLE + exact * 0.05::DOUBLE AS composite
  FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'global' ELSE 'question' END AS lane, strftime(ts, '%Y-%m-%d %H') AS run_at, round(avg(k), 6) AS f1,
    round(max(k), 6) AS score, round(min(k), 6) AS q, round(avg((event_type = 'view')::INTEGER), 6) AS pass, round(avg((event_type = 'click')::INTEGER), 6) AS exact,
    round(avg((event_type = 'purchase')::INTEGER), 6) AS mem, round(avg((event_type = 'signup')::INTEGER), 6) AS kw FROM e GROUP BY ALL))"""


@query("c16_promotion_history", f"""
WITH RECURSIVE {SQL_RUNS}, run AS (SELECT lane, i, run_at, composite, 'first_best' AS reason, composite AS bc, score AS bs, pass AS bp, q AS bq, mem AS bm FROM r WHERE i = 1
  UNION ALL SELECT lane, i, run_at, composite, reason, CASE WHEN up THEN composite ELSE bc END, CASE WHEN up THEN score ELSE bs END,
    CASE WHEN up THEN pass ELSE bp END, CASE WHEN up THEN q ELSE bq END, CASE WHEN up THEN mem ELSE bm END
  FROM (SELECT *, reason = 'composite_improved' AS up FROM (SELECT r.*, bc, bs, bp, bq, bm, CASE WHEN mem + 1e-9::DOUBLE < bm THEN 'memory_regression'
    WHEN r.lane = 'global' AND score + 0.005::DOUBLE + 1e-9::DOUBLE < bs THEN 'score_regression_too_high'
    WHEN r.lane = 'global' AND pass + 0.02::DOUBLE + 1e-9::DOUBLE < bp THEN 'pass_rate_regression_too_high'
    WHEN q + 0.05::DOUBLE + 1e-9::DOUBLE < bq THEN 'question_recognition_regression_too_high'
    WHEN r.composite > bc + 0.001::DOUBLE THEN 'composite_improved' ELSE 'no_significant_improvement' END AS reason
    FROM run p JOIN r ON r.lane = p.lane AND r.i = p.i + 1)))
SELECT lane, run_at, reason IN ('first_best', 'composite_improved') AS accepted, reason FROM run""")
def promotion_history(spark, root):
    """Daily averages per event type as evaluation runs of two lanes."""
    runs = ev.promotion_history(eval_runs(spark, root), ev.PromotionPolicy(min_improvement=0.001))
    return runs.select("lane", "run_at", "accepted", "reason")


def eval_runs(spark, root) -> DataFrame:
    e = load(spark, root, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double") / 100.0)
    share = {"pass_rate": "view", "exact_match_rate": "click", "memory_recall_rate": "purchase", "keyword_coverage_mean": "signup"}
    run = e.groupBy(
        F.when(F.col("user_id") % 2 == 0, "global").otherwise("question").alias("lane"),
        F.date_format("ts", "yyyy-MM-dd HH").alias("run_at"))
    return run.agg(
        F.round(F.avg("k"), 6).alias("token_f1_mean"), F.round(F.max("k"), 6).alias("score_mean"),
        F.round(F.min("k"), 6).alias("question_recognition_rate"),
        *[F.round(F.avg((F.col("event_type") == v).cast("double")), 6).alias(n) for n, v in share.items()])
