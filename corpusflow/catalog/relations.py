"""Queries with joins, aggregations, windows, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.catalog.base import (
    COPY_STEP, SQL_CHAT, SQL_DOCS, SQL_EVENTS, SQL_PAIRS, SQL_REPEATED, ascii_toks, calls, chat_events, conversations,
    doc_rows, documents, has, norm, pairs, query, repeated_rows, requests, soft, strip, toks, word, words,
)
from corpusflow.catalog.expressions import (
    FLAG_WORDS, SCORE_WORDS, SLOTS, sql_flags, sql_message_score, sql_quality, sql_slots,
    sql_structured, sql_toxic,
)
from corpusflow.functions import labels as lb
from corpusflow.functions import text as tx
from corpusflow.operators import dedupe as dd
from corpusflow.operators import evaluate as ev
from corpusflow.operators import overlap as ov
from corpusflow.operators import pairs as pr
from corpusflow.operators import policy as po
from corpusflow.operators import sampling as sm
from corpusflow.operators import search as se
from corpusflow.operators import sessions as ss
from corpusflow.operators import telemetry as te
from corpusflow.plans.curation import opening_frequency
from corpusflow.session import load
from corpusflow.sources import store as st


def _count(df):
    return df.agg(F.count(F.lit(1)).alias("rows"))


# --- joins -----------------------------------------------------------------
SQL_LINES = """lines AS (SELECT conv_id, turn, 'L' || (conv_id * 1000 + turn) AS line_id, text FROM conversations),
seen AS (SELECT l.conv_id, l.turn, CASE WHEN (l.conv_id * 1000 + l.turn) % 11 <> 0 THEN l.text END AS text,
         l.line_id FROM lines l),
nxt AS (SELECT *, row_number() OVER w - 1 AS pos, lead(text) OVER w AS nt, lead(line_id) OVER w AS nl FROM seen
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def _line_tables(spark, root):
    """Conversations as line-id lists; every eleventh line is missing from the line table."""
    c = conversations(spark, root).withColumn("_n", F.col("conv_id") * 1000 + F.col("turn"))
    lines = c.filter(F.col("_n") % 11 != 0).select(
        F.concat(F.lit("L"), F.col("_n").cast("string")).alias("line_id"), "text",
        F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.col("role")).alias("character_id"),
        (F.col("conv_id")).cast("string").alias("movie_id"), F.col("role").alias("character_name"))
    ids = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("L"), F.col("_n").cast("string")).alias("id"))))
    convs = c.groupBy("conv_id").agg(ids.alias("_ids")).select(
        F.col("conv_id").cast("string").alias("conversation_id"), F.transform("_ids", lambda x: x["id"]).alias("line_ids"))
    return convs, lines


@query("j01_resolve_utterances", f"""
WITH {SQL_LINES} SELECT conv_id::VARCHAR AS conversation_id, pos AS turn_index, text AS prompt, nt AS response,
  line_id AS prompt_line_id, nl AS response_line_id FROM nxt
WHERE {strip('text')} <> '' AND {strip('nt')} <> '' AND length(text) <= 600 AND length(nt) <= 600""")
def resolve_utterances(spark, root):
    convs, lines = _line_tables(spark, root)
    return pr.resolve_utterances(convs, lines.select("line_id", "text"), 600)


@query("j02_attach_metadata", f"""
WITH {SQL_LINES}
SELECT n.conv_id::VARCHAR AS conversation_id, pos AS turn_index, n.conv_id::VARCHAR AS movie_id,
  coalesce(d.source, '') AS movie_title, coalesce(d.lang, '') AS genres,
  CASE WHEN n.conv_id % 2 = 0 AND r.role <> 'system' THEN 'N' || n.conv_id || r.role ELSE r.role END AS speaker_name,
  CASE WHEN n.conv_id % 2 = 0 AND r.role <> 'system' THEN 'f' ELSE '?' END AS speaker_gender
FROM nxt n JOIN conversations r USING (conv_id, turn)
LEFT JOIN documents d ON d.doc_id = n.conv_id AND d.doc_id % 3 <> 0
WHERE {strip('n.text')} <> '' AND {strip('nt')} <> ''""")
def attach_metadata(spark, root):
    convs, lines = _line_tables(spark, root)
    movies = documents(spark, root).filter("doc_id % 3 <> 0").select(
        F.col("doc_id").cast("string").alias("movie_id"), F.col("source").alias("movie_title"),
        F.lit("2000").alias("movie_year"), F.col("lang").alias("genres"))
    people = conversations(spark, root).filter("role <> 'system' AND conv_id % 2 = 0").select(
        F.concat(F.lit("u"), "conv_id", "role").alias("character_id"),
        F.concat(F.lit("N"), "conv_id", "role").alias("character_name"), F.lit("f").alias("character_gender")).distinct()
    rows = pr.attach_metadata(pr.resolve_utterances(convs, lines, None), movies, people)
    return rows.select("conversation_id", "turn_index", "movie_id", "movie_title", "genres", "speaker_name", "speaker_gender")


def _cached_pairs(spark, root):
    """Pairs with a cache that knows the texts of even length."""
    rows = pairs(spark, root).select(
        "conv_id", "turn", F.col("user_text").alias("prompt_en"), F.col("assistant_text").alias("response_en"),
        (F.col("conv_id") % 4 == 0).alias("is_pretranslated_fr"))
    texts = rows.select(F.explode(F.array("prompt_en", "response_en")).alias("text")).distinct()
    cache = texts.filter(F.length("text") % 2 == 0).select(
        F.concat(F.lit("en|fr::"), tx.mask_placeholders("text")["template"]).alias("key"),
        F.concat(F.lit("fr "), tx.mask_placeholders("text")["template"]).alias("translated")).distinct()
    return rows, cache


def _sql_translated(x: str) -> str:
    return f"CASE WHEN conv_id % 4 <> 0 AND length({x}) % 2 = 0 THEN 'fr ' || {x} ELSE {x} END"


@query("j03_translation_cache", f"""
WITH {SQL_PAIRS} SELECT conv_id, turn, {_sql_translated('user_text')} AS prompt_fr,
  {_sql_translated('assistant_text')} AS response_fr FROM pairs""")
def translation_cache(spark, root):
    return pr.translation_cache(*_cached_pairs(spark, root))[1].select("conv_id", "turn", "prompt_fr", "response_fr")


@query("j03_translation_todo", f"""
WITH {SQL_PAIRS} SELECT DISTINCT t AS template FROM (
  SELECT user_text AS t FROM pairs WHERE conv_id % 4 <> 0 UNION ALL SELECT assistant_text FROM pairs WHERE conv_id % 4 <> 0)
WHERE length(t) % 2 = 1""")
def translation_todo(spark, root):
    return pr.translation_cache(*_cached_pairs(spark, root))[0]


SQL_HOST = "lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1))"
SQL_ALLOWED = f"({SQL_HOST} = 'example.org' OR ends_with({SQL_HOST}, '.example.org') OR {SQL_HOST} = 'example.net' OR ends_with({SQL_HOST}, '.example.net'))"


def allowed(spark):
    return spark.createDataFrame([("example.org",), ("Example.net",)], "domain string")


@query("j04_domain_allowlist", f"SELECT page_id, {SQL_ALLOWED} AS allowed FROM pages")
def domain_allowlist(spark, root):
    ok, no = se.domain_allowlist(load(spark, root, "pages"), allowed(spark))
    return ok.select("page_id", F.lit(True).alias("allowed")).unionByName(
        no.select("page_id", F.lit(False).alias("allowed")))


def _passages(spark, root):
    """Every line of every document, and prompts: benchmark items, and every line without a fifth of its words."""
    d = documents(spark, root)
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    b = load(spark, root, "benchmark").select(F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt"))
    kept = F.filter(F.split("text", " "), lambda w, i: (i + F.col("doc_id") + F.col("pos")) % 5 != 0)
    own = lines.select(((F.col("doc_id") + 1) * COPY_STEP + F.col("pos")).cast("bigint").alias("prompt_id"), F.array_join(kept, " ").alias("prompt"))
    return b.unionByName(own), lines.select("doc_id", "text")


SQL_PASSAGES = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos FROM documents),
train AS (SELECT text FROM ln),
prompts AS (SELECT item_id AS prompt_id, text AS prompt FROM benchmark UNION ALL
  SELECT (doc_id + 1) * 1000000000 + pos, array_to_string(list_filter(string_split(text, ' '), lambda w, i: (i - 1 + doc_id + pos) % 5 <> 0), ' ') FROM ln)"""
SQL_EXACT = f"""{SQL_PASSAGES},
exact AS (SELECT prompt_id FROM prompts WHERE {soft('prompt')} IN (SELECT {soft('text')} FROM train WHERE {strip('text')} <> ''))"""


def sql_set(x: str) -> str:
    return f"list_distinct(list_filter(string_split({soft(x)}, ' '), lambda t: t <> ''))"


def _sql_first(side: str) -> str:
    """The rarest tokens of every set, of which similar sets share one."""
    return f"""{side}x AS (SELECT k, tok, n FROM (SELECT k, tok, n, row_number() OVER (PARTITION BY k ORDER BY coalesce(c, 0), tok) AS r
  FROM (SELECT k, s, len(s) AS n, unnest(s) AS tok FROM {side}s) LEFT JOIN f USING (tok)) WHERE r <= n - ceil(0.7 * n - 1e-9) + 1)"""


SQL_JACCARD = f"""ts AS (SELECT row_number() OVER () AS k, s FROM (SELECT DISTINCT list_sort({sql_set('text')}) AS s FROM train WHERE {strip('text')} <> '')),
pq AS (SELECT prompt_id, list_sort({sql_set('prompt')}) AS s FROM prompts), ps AS (SELECT row_number() OVER () AS k, s FROM (SELECT DISTINCT s FROM pq)),
f AS (SELECT tok, count(*) AS c FROM (SELECT unnest(s) AS tok FROM ts) GROUP BY tok), {_sql_first('t')}, {_sql_first('p')},
cand AS (SELECT DISTINCT px.k AS p, tx.k AS t FROM px JOIN tx USING (tok) WHERE tx.n >= 0.7 * px.n - 1e-9 AND px.n >= 0.7 * tx.n - 1e-9),
hit AS (SELECT DISTINCT ps.s FROM cand JOIN ps ON ps.k = p JOIN ts ON ts.k = t
  WHERE len(list_intersect(ps.s, ts.s))::DOUBLE / (len(ps.s) + len(ts.s) - len(list_intersect(ps.s, ts.s))) >= 0.70::DOUBLE
  UNION SELECT ps.s FROM ps JOIN ts USING (s)),
near AS (SELECT prompt_id FROM pq SEMI JOIN hit USING (s))"""


@query("j05_exact_overlap", f"""
WITH train AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos FROM documents),
prompts AS (SELECT doc_id * 1000000 + pos AS prompt_id, CASE WHEN doc_id % 2 = 0 THEN '  ' || text || ' !' ELSE text || ' bis' END AS prompt FROM train
  UNION ALL SELECT -item_id - 1, text FROM benchmark)
SELECT prompt_id FROM prompts WHERE {soft('prompt')} IN (SELECT {soft('text')} FROM train WHERE {strip('text')} <> '')""")
def exact_overlap(spark, root):
    """Benchmark items and every line, repunctuated or with another word, against every line."""
    d = documents(spark, root)
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    asked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  "), "text", F.lit(" !"))).otherwise(F.concat("text", F.lit(" bis")))
    own = lines.select((F.col("doc_id") * 1_000_000 + F.col("pos")).cast("bigint").alias("prompt_id"), asked.alias("prompt"))
    b = load(spark, root, "benchmark").select((-F.col("item_id") - 1).cast("bigint").alias("prompt_id"), F.col("text").alias("prompt"))
    return ov.exact_overlap(own.unionByName(b), lines.select("doc_id", "text")).select("prompt_id")


@query("j06_jaccard_overlap", f"WITH {SQL_PASSAGES}, {SQL_JACCARD} SELECT prompt_id FROM near")
def jaccard_overlap(spark, root):
    return ov.jaccard_overlap(*_passages(spark, root), 0.70)


@query("c12_contamination_report", f"""
WITH {SQL_EXACT}, {SQL_JACCARD}, n AS (SELECT (SELECT count(*) FROM prompts) AS prompts,
  (SELECT count(*) FROM exact) AS exact_norm_overlap, (SELECT count(*) FROM near) AS high_jaccard_overlap)
SELECT *, round(exact_norm_overlap::DOUBLE / prompts, 4) AS exact_norm_overlap_rate,
  round(high_jaccard_overlap::DOUBLE / prompts, 4) AS high_jaccard_overlap_rate FROM n""")
def contamination_report(spark, root):
    return ov.contamination_report(*_passages(spark, root), 0.70)


SQL_OWN = f"""{SQL_REPEATED}, q AS (SELECT *, {norm("instruction")} AS qn FROM rep),
own AS (SELECT qn, min(src_rank) AS owner FROM q GROUP BY qn)"""


@query("j07_cross_dataset_owner", f"WITH {SQL_OWN} SELECT doc_id FROM q JOIN own USING (qn) WHERE src_rank = owner")
def cross_dataset_owner(spark, root):
    return dd.cross_dataset_owner(repeated_rows(spark, root))[0].select("doc_id")


@query("j07_cross_dataset_duplicates", f"""
WITH {SQL_OWN}, h AS (SELECT DISTINCT qn, src_rank, source FROM q)
SELECT qn AS question, string_agg(source, ',' ORDER BY src_rank) AS datasets FROM h GROUP BY qn HAVING count(*) > 1""")
def cross_dataset_duplicates(spark, root):
    d = dd.cross_dataset_owner(repeated_rows(spark, root))[1]
    return d.select("question", F.array_join("datasets", ",").alias("datasets"))


def _queries(spark, root):
    return load(spark, root, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def sql_scored(kind: str) -> str:
    t = toks if kind == "knowledge" else ascii_toks
    n = "(SELECT count(*) FROM (SELECT 1 FROM documents WHERE len(" + t("text") + ") > 0))" if kind == "knowledge" \
        else "(SELECT count(*) FROM documents)"
    extra = "" if kind == "knowledge" else " + 2.0::DOUBLE * count(*) / max(size)"
    return f"""tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({t('text')}) AS token FROM documents) GROUP BY ALL),
idf AS (SELECT token, ln((1 + {n})::DOUBLE / (1 + count(*))) + 1.0::DOUBLE AS idf FROM tf GROUP BY token),
qtf AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({t('text')}) AS token FROM benchmark) GROUP BY ALL),
qs AS (SELECT query_id, count(*) AS size FROM qtf GROUP BY query_id),
scored AS (SELECT query_id, doc_id, sum(qtf * tf * idf){extra} AS score FROM qtf JOIN qs USING (query_id) JOIN tf USING (token) JOIN idf USING (token) GROUP BY query_id, doc_id)"""


@query("j08_tfidf_knowledge", f"WITH {sql_scored('knowledge')} SELECT query_id, doc_id, round(score, 4) AS score FROM scored")
def tfidf_knowledge(spark, root):
    s = se.tfidf_join(_queries(spark, root), documents(spark, root), "knowledge")
    return s.select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query("j08_tfidf_web", f"WITH {sql_scored('web')} SELECT query_id, doc_id, round(score, 4) AS score FROM scored")
def tfidf_web(spark, root):
    s = se.tfidf_join(_queries(spark, root), documents(spark, root), "web")
    return s.select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query("w09_topk_per_query", f"""
WITH {sql_scored('knowledge')}, r AS (SELECT query_id, doc_id,
  row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored)
SELECT * FROM r WHERE rank <= 5""")
def topk_per_query(spark, root):
    s = se.tfidf_join(_queries(spark, root), documents(spark, root), "knowledge")
    return se.topk_per_query(s, 5, ["doc_id"]).select("query_id", "doc_id", "rank")


@query("c06_search", f"""
WITH {sql_scored('web')}, r AS (SELECT query_id, doc_id,
  row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored)
SELECT query_id, doc_id, rank, text FROM r JOIN documents USING (doc_id) WHERE rank <= 3""")
def search(spark, root):
    hits = se.search(_queries(spark, root), documents(spark, root), 3, "web")
    return hits.select("query_id", "doc_id", "rank", "text")


SQL_CASES = """cases AS (SELECT item_id AS case_id, text AS question,
  [trim(lower(w)) for w in string_split(text, ' ') if trim(w) <> ''] AS kw FROM benchmark),
ans AS (SELECT doc_id, doc_id % (SELECT max(item_id) + 1 FROM benchmark) AS case_id, text AS answer FROM documents)"""


def cases(spark, root):
    return load(spark, root, "benchmark").select(
        F.col("item_id").alias("case_id"), F.col("text").alias("question"), F.split("text", " ").alias("keywords"))


def answers(spark, root):
    """Every document as an answer; the cases take turns."""
    n = load(spark, root, "benchmark").agg(F.max("item_id") + 1).first()[0] or 1
    return documents(spark, root).select("doc_id", (F.col("doc_id") % n).alias("case_id"), F.col("text").alias("answer"))


def sql_low(collapsed: bool) -> str:
    return norm("answer") if collapsed else strip("lower(answer)")


@query("j09_keyword_coverage", f"""
WITH {SQL_CASES} SELECT doc_id, case_id, len(kw) AS total, len(list_filter(kw, lambda k: contains({norm('answer')}, k))) AS hits,
  round(len(list_filter(kw, lambda k: contains({norm('answer')}, k)))::DOUBLE / len(kw), 6) AS coverage
FROM cases JOIN ans USING (case_id)""")
def keyword_coverage(spark, root):
    k = ev.keyword_coverage(answers(spark, root), cases(spark, root))
    return k.select("doc_id", "case_id", "total", "hits", F.round("coverage", 6).alias("coverage"))


MARKS = ["thble ", "erheti"]


def sql_bench(collapsed: bool = True) -> str:
    low = sql_low(collapsed)
    return f"""{SQL_CASES}, hit AS (SELECT doc_id, case_id, question, kw, answer, {low} AS low,
  len(list_filter(kw, lambda k: contains({low}, k)))::DOUBLE / len(kw) AS cov FROM cases JOIN ans USING (case_id)),
fin AS (SELECT *, CASE WHEN contains(low, 'thble ') THEN 'thble ' WHEN contains(low, 'erheti') THEN 'erheti' ELSE '' END AS bad_marker,
  CASE WHEN length({strip('answer')}) BETWEEN 80 AND 1200 THEN 1 ELSE 0 END AS length_ok FROM hit),
bench AS (SELECT *, cov * 0.70::DOUBLE + (CASE WHEN bad_marker = '' THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END)
  + length_ok * 0.10::DOUBLE AS final FROM fin)"""


@query("c10_score_benchmark", f"""
WITH {sql_bench()} SELECT doc_id, case_id, round(cov, 4) AS keyword_coverage, bad_marker, length_ok::BIGINT AS length_ok,
  round(final, 4) AS score, (final >= 0.60::DOUBLE)::BIGINT AS passed FROM bench""")
def score_benchmark(spark, root):
    s = ev.score_benchmark(answers(spark, root), cases(spark, root), bad_markers=MARKS)
    return s.select("doc_id", "case_id", "keyword_coverage", "bad_marker", "length_ok", "score", "passed")


@query("c10_score_benchmark_live", f"""
WITH {sql_bench(False)} SELECT doc_id, case_id, round(final, 4) AS score, (final >= 0.60::DOUBLE)::BIGINT AS passed FROM bench""")
def score_benchmark_live(spark, root):
    s = ev.score_benchmark(answers(spark, root), cases(spark, root), "live", bad_markers=MARKS)
    return s.select("doc_id", "case_id", "score", "passed")


SQL_SUMMARY = f"""{sql_bench()}, summary AS (SELECT count(*) AS cases, round(avg(round(final, 4)), 4) AS score_mean,
  round(avg(round(cov, 4)), 4) AS keyword_coverage_mean, round(avg((final >= 0.60::DOUBLE)::INTEGER), 4) AS pass_rate,
  sum((bad_marker <> '')::INTEGER)::BIGINT AS bad_marker_count FROM bench)"""


@query("a08_business_summary", f"WITH {SQL_SUMMARY} SELECT * FROM summary")
def business_summary(spark, root):
    return ev.business_summary(ev.score_benchmark(answers(spark, root), cases(spark, root), bad_markers=MARKS))


@query("a19_alert_check", f"""
WITH {SQL_SUMMARY} SELECT cases, pass_rate, CASE WHEN pass_rate >= 0.95 THEN 'OK' ELSE 'ALERT' END AS status,
  'status=' || CASE WHEN pass_rate >= 0.95 THEN 'OK' ELSE 'ALERT' END || format(' pass_rate={{:.4f}} threshold={{:.4f}} cases={{}}',
  pass_rate, 0.95::DOUBLE, cases) AS line FROM summary""")
def alert_check(spark, root):
    s = ev.business_summary(ev.score_benchmark(answers(spark, root), cases(spark, root), bad_markers=MARKS))
    return ev.alert_check(s, 0.95).select("cases", "pass_rate", "status", "line")


# --- conversation store ----------------------------------------------------
def _sql_store(min_score: float) -> str:
    f = sql_flags("v")
    return f"""m AS (SELECT conv_id, turn, role, {norm('text')} AS v FROM conversations WHERE role <> 'system'),
s AS (SELECT *, {sql_message_score('role', 'v')} AS q, {f['domain']}::INTEGER AS d, {f['error']}::INTEGER AS e FROM m),
c AS (SELECT conv_id, avg(q) * 0.75::DOUBLE + avg(d) * 0.20::DOUBLE + (1.0::DOUBLE - avg(e)) * 0.05::DOUBLE
  - (CASE WHEN count(DISTINCT CASE WHEN role = 'assistant' THEN v END) > 1 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END) AS raw
  FROM s GROUP BY conv_id),
score AS (SELECT conv_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, raw)), 9) AS quality_score FROM c),
stat AS (SELECT *, CASE WHEN quality_score >= {min_score} THEN 'filtered' ELSE 'raw' END AS status FROM score)"""


def _scored_messages(spark, root):
    f = lb.message_flags("text", **FLAG_WORDS)
    c = conversations(spark, root).filter("role <> 'system'").withColumn("f", f)
    return c.select(
        "conv_id", "turn", "role", F.col("text").alias("content"), "f.*",
    ).withColumn("quality_score", lb.message_score(
        F.col("role"), "content", F.col("is_in_domain"), F.col("is_technical"), F.col("has_error"), **SCORE_WORDS))


def _headers(spark, root, min_score=0.6):
    h = st.conversation_score(_scored_messages(spark, root), min_score)
    return h.withColumn("ended_at", F.concat(F.lit("t"), (F.col("conv_id") % 3).cast("string")))


@query("a04_conversation_score", f"WITH {_sql_store(0.6)} SELECT conv_id, round(quality_score, 6) AS quality_score, status FROM stat")
def conversation_score(spark, root):
    return _headers(spark, root).select("conv_id", F.round("quality_score", 6).alias("quality_score"), "status")


@query("t01_select_best", f"""
WITH {_sql_store(0.6)} SELECT conv_id FROM stat WHERE status = 'filtered' AND quality_score >= 0.65
ORDER BY quality_score DESC, conv_id % 3 DESC, conv_id LIMIT 20""")
def select_best(spark, root):
    return sm.select_best(_headers(spark, root), 20, 0.65)


@query("j10_mark_selected", f"""
WITH {_sql_store(0.6)}, best AS (SELECT conv_id FROM stat WHERE status = 'filtered' AND quality_score >= 0.65
  ORDER BY quality_score DESC, conv_id % 3 DESC, conv_id LIMIT 20),
old AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'selected' ELSE status END AS was FROM stat)
SELECT conv_id, CASE WHEN conv_id IN (SELECT conv_id FROM best) THEN 'selected' WHEN was = 'selected' THEN 'filtered' ELSE was END AS status
FROM old""")
def mark_selected(spark, root):
    h = _headers(spark, root)
    ids = sm.select_best(h, 20, 0.65)
    old = h.withColumn("status", F.when(F.col("conv_id") % 5 == 0, "selected").otherwise(F.col("status")))
    return st.mark_selected(old, ids).select("conv_id", "status")


def _split_messages(spark, root):
    """Two deliveries that overlap in every third message; every seventh id is blank."""
    c = conversations(spark, root)
    n = F.col("conv_id") * 1000 + F.col("turn")
    c = c.select("conv_id", F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("m"), n.cast("string"))).alias("id"),
                 "role", F.col("turn").alias("seq"), n.alias("n"))
    a = c.filter("seq < 3").withColumn("origin", F.lit("a"))
    b = c.filter("seq >= 3 OR n % 3 = 0").withColumn("origin", F.lit("b"))
    return a, b


@query("a15_merge_messages", """
WITH c AS (SELECT conv_id, 'm' || (conv_id * 1000 + turn) AS id, turn, conv_id * 1000 + turn AS n FROM conversations WHERE (conv_id * 1000 + turn) % 7 <> 0)
SELECT conv_id, id, CASE WHEN turn < 3 THEN 'a' ELSE 'b' END AS origin FROM c""")
def merge_messages(spark, root):
    return st.merge_messages(*_split_messages(spark, root))[0].select("conv_id", "id", "origin")


@query("a15_merge_added", """
SELECT conv_id, sum((turn >= 3)::INTEGER)::BIGINT AS added FROM conversations WHERE (conv_id * 1000 + turn) % 7 <> 0 GROUP BY conv_id""")
def merge_added(spark, root):
    return st.merge_messages(*_split_messages(spark, root))[1]


@query("s08_conversation_table", """
WITH o AS (SELECT conv_id, min(turn) FILTER (turn < 3) AS a, max(turn) FILTER (turn >= 3) AS b, min(turn) FILTER (turn >= 3) AS b0,
  max(turn) FILTER (turn < 3) AS a1 FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(a, b0) AS started_at, coalesce(b, a1) AS ended_at, CASE WHEN b IS NULL THEN 'filtered' ELSE 'raw' END AS status,
  CASE WHEN b IS NULL THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS quality_score FROM o""")
def conversation_table(spark, root):
    c = conversations(spark, root)
    def part(df, status, score):
        return df.groupBy("conv_id").agg(F.min("turn").alias("started_at"), F.max("turn").alias("ended_at")).select(
            "*", F.lit(status).alias("status"), F.lit(score).alias("quality_score"))
    return st.conversation_table(part(c.filter("turn < 3"), "filtered", 0.9), part(c.filter("turn >= 3"), "raw", 0.0))


@query("s11_backfill_defaults", """
SELECT conv_id, turn, coalesce(CASE WHEN conv_id % 2 = 0 THEN 'filtered' END, 'raw') AS status,
  CASE WHEN conv_id % 2 = 0 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS quality_score, text AS content, false AS is_technical,
  'question' AS intent FROM conversations""")
def backfill_defaults(spark, root):
    known = F.col("conv_id") % 2 == 0
    message = F.struct(
        F.col("text").alias("content"), F.lit(True).alias("is_technical"), F.lit(True).alias("is_in_domain"),
        F.lit(True).alias("has_error"), F.lit(1.0).alias("quality_score"), F.lit("x").alias("intent"),
        F.lit("code").alias("structure_type"))
    docs = conversations(spark, root).select(
        "conv_id", "turn", F.when(known, "filtered").alias("status"), F.when(known, F.lit(0.8)).alias("quality_score"),
        F.array(message).alias("messages"))
    ledger = spark.createDataFrame([], "id string, name string, description string, result string, applied_at string")
    out, _ = st.backfill_defaults(docs, ledger)
    m = F.get("messages", F.lit(0))
    return out.select("conv_id", "turn", "status", "quality_score", m["content"].alias("content"),
                      m["is_technical"].alias("is_technical"), m["intent"].alias("intent"))


# --- counts ----------------------------------------------------------------
@query("a03_source_counts", "SELECT source, lang, count(*) AS rows FROM documents GROUP BY ALL")
def source_counts(spark, root):
    return documents(spark, root).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("rows"))


@query("a05_document_frequency", f"""
WITH t AS (SELECT doc_id, list_distinct({toks('text')}) AS t FROM documents), n AS (SELECT count(*) AS n FROM t WHERE len(t) > 0)
SELECT token, count(*) AS df, round(ln((1 + n)::DOUBLE / (1 + count(*))) + 1.0::DOUBLE, 6) AS idf
FROM (SELECT unnest(t) AS token FROM t), n GROUP BY token, n""")
def document_frequency(spark, root):
    return se.document_frequency(documents(spark, root)).withColumn("idf", F.round("idf", 6))


@query("a05_document_frequency_web", f"""
WITH t AS (SELECT doc_id, list_distinct({ascii_toks('text')}) AS t FROM documents), n AS (SELECT count(*) AS n FROM t)
SELECT token, count(*) AS df, round(ln((1 + n)::DOUBLE / (1 + count(*))) + 1.0::DOUBLE, 6) AS idf
FROM (SELECT unnest(t) AS token FROM t), n GROUP BY token, n""")
def document_frequency_web(spark, root):
    return se.document_frequency(documents(spark, root), kind="ascii", filled_only=False).withColumn("idf", F.round("idf", 6))


@query("a06_term_frequency", f"""
SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({toks('text')}) AS token FROM documents) GROUP BY ALL""")
def term_frequency(spark, root):
    return se.term_frequency(documents(spark, root))


SQL_OPENING = "array_to_string({w}[1:2], ' ')".replace("{w}", words("lower(response)"))


@query("a07_opening_frequency", f"""
WITH {SQL_DOCS} SELECT {SQL_OPENING} AS opening, count(*) AS freq FROM docs GROUP BY 1""")
def opening_frequency_q(spark, root):
    return opening_frequency(doc_rows(spark, root))


@query("a09_scenario_recall", f"""
WITH t AS (SELECT conv_id, CASE WHEN turn % 2 = 1 THEN (contains(lower(text), 'of') AND contains(lower(text), 'the'))::INTEGER END AS ok FROM conversations),
p AS (SELECT conv_id, coalesce(avg(ok), 0.0::DOUBLE) AS m FROM t GROUP BY conv_id)
SELECT count(*) AS scenarios, round(avg(m), 4) AS memory_recall_rate FROM p""")
def scenario_recall(spark, root):
    ok = F.when(F.col("turn") % 2 == 1, ev.all_tokens_present("text", F.array(F.lit("of"), F.lit("The"))))
    return ev.scenario_recall(conversations(spark, root).withColumn("ok", ok), "conv_id")


@query("a10_text_match_metrics", f"""
WITH {SQL_PAIRS}, b AS (SELECT conv_id * 1000 + turn AS id, {words('lower(user_text)')} AS p, {words('lower(assistant_text)')} AS r FROM pairs),
pc AS (SELECT id, t, count(*) AS c FROM (SELECT id, unnest(p) AS t FROM b) GROUP BY ALL),
rc AS (SELECT id, t, count(*) AS c FROM (SELECT id, unnest(r) AS t FROM b) GROUP BY ALL),
o AS (SELECT id, sum(least(pc.c, rc.c))::BIGINT AS o FROM pc JOIN rc USING (id, t) GROUP BY id)
SELECT id, round(CASE WHEN o > 0 THEN 2.0::DOUBLE * (o::DOUBLE / len(p)) * (o::DOUBLE / len(r)) / (o::DOUBLE / len(p) + o::DOUBLE / len(r)) ELSE 0.0::DOUBLE END, 6) AS token_f1
FROM b LEFT JOIN o USING (id)""")
def text_match(spark, root):
    rows = pairs(spark, root).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return ev.text_match(rows, "id", "user_text", "assistant_text").select("id", F.round("token_f1", 6).alias("token_f1"))


@query("a10_text_match_summary", f"""
WITH {SQL_DOCS}, b AS (SELECT doc_id, {words('lower(instruction)')} AS p, {words('lower(response)')} AS r,
  ({strip('lower(instruction)')} = {strip('lower(response)')})::INTEGER AS em FROM docs),
pc AS (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(p) AS t FROM b) GROUP BY ALL),
rc AS (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(r) AS t FROM b) GROUP BY ALL),
o AS (SELECT doc_id, sum(least(pc.c, rc.c))::BIGINT AS o FROM pc JOIN rc USING (doc_id, t) GROUP BY doc_id)
SELECT count(*) AS samples, round(avg(CASE WHEN o > 0 THEN 2.0::DOUBLE * o / (len(p) + len(r)) ELSE 0.0::DOUBLE END), 4) AS token_f1_mean,
  round(avg(em), 4) AS exact_match_rate FROM b LEFT JOIN o USING (doc_id)""")
def text_match_summary(spark, root):
    return ev.text_match_metrics(doc_rows(spark, root), "doc_id", "instruction", "response")


HINTS = ["the", "of", "tion", "nicht", "erly"]


@query("a11_recognition_summary", f"""
WITH t AS (SELECT {norm('text')} AS p FROM conversations),
s AS (SELECT greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({" + ".join(f"contains(p, '{h}')::INTEGER" for h in HINTS)}) / 3.0::DOUBLE) * 0.75::DOUBLE
  + (CASE WHEN length(p) >= 35 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) - (CASE WHEN p = '' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)) AS s FROM t)
SELECT count(*) AS cases, round(avg(round(s, 4)), 4) AS recognition_score_mean, round(avg((s >= 0.60::DOUBLE)::INTEGER), 4) AS recognition_rate FROM s""")
def recognition_summary(spark, root):
    return ev.recognition_summary(conversations(spark, root), "text", HINTS)


def _traffic(spark, root):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return load(spark, root, "events").select(
        "event_id", "ts", F.col("event_type").alias("intent"), (k % 4 != 0).alias("in_domain"),
        (k % 6 == 0).alias("corrected_by_verifier"), (k % 9 == 0).alias("used_rule_reply"), "value")


@query("a12_traffic_metrics", f"""
WITH {SQL_EVENTS} SELECT 'total' AS metric, count(*) AS value FROM ev
UNION ALL SELECT 'corrected_by_verifier', count(*) FROM ev WHERE k % 6 = 0
UNION ALL SELECT 'rule_reply', count(*) FROM ev WHERE k % 9 = 0
UNION ALL SELECT 'out_of_domain', count(*) FROM ev WHERE k % 4 = 0
UNION ALL SELECT 'intent_' || event_type, count(*) FROM ev GROUP BY event_type""")
def traffic_metrics(spark, root):
    return te.traffic_metrics(_traffic(spark, root))


@query("a13_provider_metrics", """
WITH c AS (SELECT CASE WHEN user_id % 7 <> 0 THEN user_id::VARCHAR END AS provider, ts, event_id, event_type <> 'error' AS ok, value FROM events)
SELECT provider, CASE WHEN grouping(provider) = 1 THEN 'all' ELSE 'provider' END AS scope,
  count(*) AS total, count_if(ok)::BIGINT AS success, count_if(NOT ok)::BIGINT AS error,
  coalesce(arg_max(value, (ts, event_id)) FILTER (ok), 0.0::DOUBLE) AS last_latency_ms, max(event_id) AS last_seq FROM c GROUP BY ROLLUP (provider)""")
def provider_metrics(spark, root):
    known = F.when(F.col("provider").cast("bigint") % 7 != 0, F.col("provider"))  # some calls name no provider
    c = calls(spark, root).withColumn("provider", known)
    m = te.provider_metrics(c).drop("updated_at")
    scope = F.when(F.grouping("provider") == 1, "all").otherwise("provider").alias("scope_")
    last = c.rollup("provider").agg(scope, F.max("seq").alias("last_seq")).withColumnRenamed("provider", "provider_")
    same = m["provider"].eqNullSafe(last["provider_"]) & (m["scope"] == last["scope_"])
    return m.join(last, same).drop("provider_", "scope_")


STATUS = {"view": "queued", "click": "running", "purchase": "done", "error": "error", "signup": "archived"}
SQL_STATUS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"


def _jobs(spark, root):
    table = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return load(spark, root, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("principal"), table[F.col("event_type")].alias("status"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.when(F.col("event_id") % 3 == 0, "junk").otherwise(
            F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("finished_at"))


@query("a14_job_counters", f"""
WITH j AS (SELECT {SQL_STATUS} AS s FROM events), c AS (SELECT count_if(s = 'queued')::BIGINT AS queued, count_if(s = 'running')::BIGINT AS running,
  count_if(s IN ('done', 'error'))::BIGINT AS finished FROM j) SELECT *, queued + running + finished AS total FROM c""")
def job_counters(spark, root):
    return te.job_counters(_jobs(spark, root))


@query("a14_pending_jobs", "SELECT user_id AS principal, count(*) AS pending FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def pending_jobs(spark, root):
    return te.pending_jobs(_jobs(spark, root))


@query("c17_expire_jobs", f"""
SELECT event_id AS job_id FROM events WHERE {SQL_STATUS} NOT IN ('queued', 'running')
  AND epoch(TIMESTAMP '2024-01-31 00:00:00') - (epoch(date_trunc('second', ts)) + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 3600 END) > 86400 * 10""")
def expire_jobs(spark, root):
    now = F.lit(1706659200.0)
    return te.expire_jobs(_jobs(spark, root), 86_400 * 10, now)[1].select("job_id")


@query("c18_task_progress", f"""
WITH {SQL_EVENTS}, t AS (SELECT user_id AS task_id, count(DISTINCT CASE WHEN k % 25 = 5 THEN 'step' || (k % 10) END) AS done,
  count_if(event_type = 'error' AND k % 40 = 1)::BIGINT AS errors, arg_max(k % 11 = 0, (ts, event_id)) AS closed, user_id % 6 AS planned FROM ev GROUP BY user_id)
SELECT task_id, planned, done AS done_count, greatest(0, planned - done) AS remaining_steps, errors,
  CASE WHEN closed OR (planned > 0 AND done >= planned) THEN 'done' WHEN errors > 0 THEN 'blocked' ELSE 'active' END AS status FROM t""")
def task_progress(spark, root):
    e = load(spark, root, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    tasks = e.select(F.col("user_id").alias("task_id")).distinct().withColumn(
        "steps", F.transform(F.slice(F.array(*[F.lit(f"p{i}") for i in range(6)]), F.lit(1), (F.col("task_id") % 6).cast("int")), lambda s: s))
    events = e.select(
        F.col("user_id").alias("task_id"), "ts", F.col("event_id").alias("seq"),
        F.when(F.col("k") % 25 == 5, F.concat(F.lit(" step"), (F.col("k") % 10).cast("string"))).alias("done_step"),
        F.when((F.col("event_type") == "error") & (F.col("k") % 40 == 1), "boom").alias("error"), (F.col("k") % 11 == 0).alias("mark_done"))
    return te.task_progress(tasks, events)


# --- policies --------------------------------------------------------------
TEST_POLICY = po.CleaningPolicy(
    min_response_chars=60, max_response_chars=1500, generalist=["thble"], off_domain=["nicht"], toxic=["erst", "avec"],
    negation=["of ", "la "], sms=["thwhesou"], noise=[r"[!?]{3,}", r"#{3}"], subjective=["thre the"], hesitation=["thha the"],
    limitation=["un de"], apology=["erth of"], style=["thea the"], outdated=["to[ ]the[ ]of"], invention=["der die"],
    low_signal=["than"])


def sql_waterfall(instruction: str, response: str, min_chars: int = 60) -> str:
    """Reason per row; ``base`` has the stripped texts."""
    return f"""n AS (SELECT *, {norm(instruction + " || ' '")} AS tp, {norm(instruction + " || ' ' || " + response + " || ' '")} AS jt, {norm(response)} AS rp FROM base),
reasoned AS (SELECT *, CASE WHEN {instruction} = '' OR {response} = '' THEN 'removed_empty'
  WHEN {word('tp', ['thble'])} THEN 'removed_generalist' WHEN {word('tp', ['nicht'])} THEN 'removed_off_domain'
  WHEN {sql_toxic('tp', ['erst', 'avec'], ['of ', 'la '])} THEN 'removed_toxic'
  WHEN contains(jt, 'thwhesou') THEN 'removed_sms_style'
  WHEN regexp_matches(tp, '[!?]{{3,}}|#{{3}}') OR (len({words('tp')}) >= 8 AND len(list_filter({words('tp')}, lambda x: length(x) <= 2
     AND x NOT IN ('ia', 'ml', 'ai', 'de', 'du', 'la', 'le', 'et')))::DOUBLE / len({words('tp')}) > 0.35) THEN 'removed_language_quality'
  WHEN contains(rp, 'thre the') THEN 'removed_subjective' WHEN contains(rp, 'thha the') THEN 'removed_hesitation'
  WHEN contains(rp, 'un de') THEN 'removed_legacy_limitations' WHEN contains(rp, 'erth of') THEN 'removed_excessive_apology'
  WHEN contains(rp, 'thea the') THEN 'removed_style_inconsistent' WHEN contains(jt, 'to the of') THEN 'removed_obsolete'
  WHEN contains(jt, 'der die') THEN 'removed_hallucination_risk' WHEN trim(rp, ' .,!?:;"''') = 'than' THEN 'removed_low_signal'
  WHEN length({response}) < {min_chars} THEN 'removed_too_short' WHEN length({response}) > 1500 THEN 'removed_too_long'
  WHEN NOT {sql_structured(response)} THEN 'removed_unstructured' END AS reason FROM n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g, {norm(instruction)}, rp ORDER BY o) AS copy FROM reasoned WHERE reason IS NULL),
uniq AS (SELECT *, row_number() OVER (PARTITION BY g, {norm(instruction)} ORDER BY o) AS variant FROM ranked WHERE copy = 1),
counts AS (SELECT g, reason, count(*) AS rows FROM reasoned WHERE reason IS NOT NULL GROUP BY ALL
  UNION ALL SELECT g, 'removed_duplicate', count(*) FROM ranked WHERE copy > 1 GROUP BY g
  UNION ALL SELECT g, 'removed_contradiction', count(*) FROM uniq WHERE variant > 1 GROUP BY g
  UNION ALL SELECT g, 'kept', count(*) FROM uniq WHERE variant = 1 GROUP BY g)"""


SQL_A1 = f"""{SQL_PAIRS}, base AS (SELECT conv_id * 1000 + turn AS o, 0 AS g, user_text, assistant_text FROM pairs
  UNION ALL SELECT 1000000 + conv_id * 1000 + turn, 0, replace(user_text, ' ', '  '), assistant_text FROM pairs WHERE conv_id % 3 = 0
  UNION ALL SELECT 2000000 + conv_id * 1000 + turn, 0, user_text, assistant_text || ' Once more.' FROM pairs WHERE conv_id % 4 = 0),
""" + sql_waterfall("user_text", "assistant_text")


def _policy_rows(spark, root):
    """Exchanges, repeated with wider spacing for some and with a second answer for others."""
    p = pairs(spark, root).select(
        "conv_id", F.col("user_text").alias("instruction"), F.col("assistant_text").alias("response"), F.lit(None).cast("string").alias("history"),
        F.lit("").alias("source"), F.lit(0).alias("src_rank"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_idx"))
    loud = p.filter("conv_id % 3 = 0").withColumns({"instruction": F.replace("instruction", F.lit(" "), F.lit("  ")), "src_rank": F.lit(1)})
    other = p.filter("conv_id % 4 = 0").withColumns({"response": F.concat("response", F.lit(" Once more.")), "src_rank": F.lit(2)})
    return p.unionByName(loud).unionByName(other)


@query("a01_policy_waterfall", f"WITH {SQL_A1} SELECT reason, rows FROM counts")
def policy_waterfall(spark, root):
    return po.policy_waterfall(_policy_rows(spark, root), TEST_POLICY)[1]


@query("a01_policy_kept", f"WITH {SQL_A1} SELECT user_text AS instruction, assistant_text AS response, 'cleaned' AS source FROM uniq WHERE variant = 1")
def policy_kept(spark, root):
    return po.policy_waterfall(_policy_rows(spark, root), TEST_POLICY)[0].select("instruction", "response", "source")


def sql_feedback(min_chars: int, min_quality: float) -> str:
    return f"""judged AS (SELECT *, {sql_quality(min_chars)} AS quality FROM chat),
reasoned AS (SELECT *, CASE WHEN length(assistant_text) < {min_chars} THEN 'filtered_short' WHEN NOT in_domain THEN 'filtered_domain'
  WHEN low THEN 'filtered_low_quality' WHEN quality < {min_quality}::DOUBLE THEN 'filtered_score' END AS reason FROM judged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {norm('user_text')}, {norm('assistant_text')} ORDER BY row_idx) AS copy FROM reasoned WHERE reason IS NULL)"""


@query("a02_feedback_filter", f"""
WITH {SQL_CHAT}, {sql_feedback(150, 0.5)} SELECT reason, count(*) AS rows FROM reasoned WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'filtered_duplicate', count(*) FROM ranked WHERE copy > 1 HAVING count(*) > 0
UNION ALL SELECT 'kept', count(*) FROM ranked WHERE copy = 1""")
def feedback_filter(spark, root):
    return po.feedback_filter(chat_events(spark, root), po.FeedbackPolicy(150, 0.5))[1]


@query("a02_feedback_rows", f"""
WITH {SQL_CHAT}, {sql_feedback(150, 0.5)} SELECT row_idx, user_text AS instruction, summary AS history,
  'feedback_q' || format('{{:.2f}}', quality) AS source FROM ranked WHERE copy = 1""")
def feedback_rows(spark, root):
    return po.feedback_filter(chat_events(spark, root), po.FeedbackPolicy(150, 0.5))[0].select(
        "row_idx", "instruction", "history", "source")


@query("c14_continual_from_log", f"""
WITH {SQL_CHAT}, g AS (SELECT *, row_number() OVER (PARTITION BY user_text, assistant_text ORDER BY row_idx) AS copy FROM chat
  WHERE length(assistant_text) >= 24 AND in_domain AND NOT low)
SELECT row_idx, user_text AS instruction, assistant_text AS response, '' AS history, 'continual_log' AS source FROM g WHERE copy = 1""")
def continual_from_log(spark, root):
    """Half of the events come under the second producer's column names."""
    e = chat_events(spark, root)
    here = F.col("k") % 2 == 0
    named = e.withColumns({"user": F.when(~here, F.col("user_text")), "assistant": F.when(~here, F.col("assistant_text")),
                           "user_text": F.when(here, F.col("user_text")), "assistant_text": F.when(here, F.col("assistant_text"))})
    return po.continual_from_log(po.alternate_event_names(named))


@query("a16_dominant_response", f"""
WITH {SQL_REPEATED}, q AS (SELECT doc_id, {norm("instruction")} AS qn, {norm("response")} AS rn FROM rep),
v AS (SELECT qn, rn, count(*) AS n, min(doc_id) AS f FROM q GROUP BY ALL),
b AS (SELECT qn, rn, row_number() OVER (PARTITION BY qn ORDER BY n DESC, f) AS r FROM v)
SELECT doc_id FROM q JOIN b USING (qn, rn) WHERE r = 1""")
def dominant_response(spark, root):
    return dd.dominant_response(repeated_rows(spark, root), order=["row_idx"]).select("doc_id")


@query("a16_dominant_counts", f"""
WITH {SQL_REPEATED}, q AS (SELECT {norm("instruction")} AS qn, {norm("response")} AS rn FROM rep),
v AS (SELECT qn, rn, count(*) AS n FROM q GROUP BY ALL), p AS (SELECT qn, sum(n) AS n, max(n) AS t FROM v GROUP BY qn)
SELECT sum(t)::BIGINT AS kept, sum(n - t)::BIGINT AS removed FROM p""")
def dominant_counts(spark, root):
    return dd.dominant_counts(repeated_rows(spark, root))


# --- windows ---------------------------------------------------------------
@query("w01_adjacent_pairs", f"""
WITH n AS (SELECT conv_id, turn AS turn_index, text AS prompt, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response FROM conversations)
SELECT * FROM n WHERE {strip('prompt')} <> '' AND {strip('response')} <> '' AND length(prompt) <= 600 AND length(response) <= 600""")
def adjacent_pairs(spark, root):
    return pr.adjacent_pairs(conversations(spark, root), max_chars=600)


@query("w01_adjacent_pairs_whole", f"""
WITH n AS (SELECT conv_id, turn AS turn_index, text AS prompt, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response FROM conversations)
SELECT * FROM n WHERE {strip('prompt')} <> '' AND {strip('response')} <> ''""")
def adjacent_pairs_whole(spark, root):
    return pr.adjacent_pairs(conversations(spark, root), max_chars=None)


SQL_W2 = f"""u AS (SELECT conv_id, turn, role, {strip('text')} AS text FROM conversations WHERE role IN ('user', 'assistant') AND {strip('text')} <> ''),
l AS (SELECT *, lag(role) OVER w AS pr, lag(text) OVER w AS pt FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT * FROM l WHERE role = 'user' OR pr = 'user'),
h AS (SELECT *, coalesce(left(string_agg(CASE role WHEN 'user' THEN 'Utilisateur: ' ELSE 'Assistant: ' END || text, ' ||| ')
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 1400), '') AS history FROM k),
rows AS (SELECT conv_id, turn, pt AS instruction, text AS response, history FROM h WHERE role = 'assistant')"""


@query("w02_training_rows", f"""
WITH {SQL_W2}, r AS (SELECT *, row_number() OVER (PARTITION BY {norm('instruction')}, {norm('response')} ORDER BY conv_id, turn) AS copy FROM rows)
SELECT conv_id, turn, instruction, response, history FROM r WHERE copy = 1""")
def training_rows(spark, root):
    """Flagship: user/assistant rows with history, one per normalised pair."""
    rows = pr.training_rows(conversations(spark, root))
    once = dd.first_wins_dedupe(rows, dd.pair_key("normalized"), ["conv_id", "turn"])
    return once.select("conv_id", "turn", "instruction", "response", "history")


@query("w03_first_wins_dedupe", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY {norm('text')} ORDER BY doc_id) AS copy FROM documents)
SELECT doc_id, text, source FROM r WHERE copy = 1""")
def first_wins_dedupe(spark, root):
    d = documents(spark, root)
    return dd.first_wins_dedupe(d, [tx.norm_text("text")], ["doc_id"]).select("doc_id", "text", "source")


LIMITS = {"basic": (1, 3), "advanced": (2, 4), "admin": (3, 6)}
SQL_REQ = """r AS (SELECT event_id AS seq, user_id AS p, ts, [1, 2, 3][user_id % 3 + 1] AS pm, [3, 4, 6][user_id % 3 + 1] AS pd,
  floor(epoch(ts) / 21600) AS m, date_trunc('day', ts) AS d FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY p, m ORDER BY ts, seq) AS rm FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY p, d ORDER BY ts, seq) AS rd FROM a WHERE rm <= pm)"""


@query("w04_rate_quota", f"""
WITH {SQL_REQ} SELECT a.seq, CASE WHEN a.rm > a.pm THEN 'minute_limit' WHEN rd > a.pd THEN 'day_quota' ELSE 'admitted' END AS decision
FROM a LEFT JOIN b USING (seq)""")
def rate_quota(spark, root):
    return te.rate_quota(requests(spark, root), LIMITS, 21_600).select("seq", "decision")


@query("w05_failure_streak", """
WITH c AS (SELECT event_id AS seq, user_id AS p, ts, event_type = 'error' AS bad FROM events),
i AS (SELECT *, count_if(NOT bad) OVER (PARTITION BY p ORDER BY ts, seq) AS island FROM c)
SELECT seq, CASE WHEN bad THEN count_if(bad) OVER (PARTITION BY p, island ORDER BY ts, seq) ELSE 0 END::BIGINT AS streak FROM i""")
def failure_streak(spark, root):
    return te.failure_streak(calls(spark, root)).select("seq", "streak")


def sql_circuit(k: int, secs: int) -> str:
    """One step per call and provider, as ``run`` rows."""
    return f"""RECURSIVE c AS MATERIALIZED (SELECT user_id % 7 AS p, event_id AS seq, epoch_us(ts) / 1e6::DOUBLE AS t, event_type <> 'error' AS ok,
  row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS i FROM events),
run AS (SELECT p, 0::BIGINT AS i, NULL::BIGINT AS seq, false AS refused, 0::BIGINT AS failures, 0::DOUBLE AS until, false AS alert, 0::DOUBLE AS t FROM c WHERE i = 1
  UNION ALL SELECT c.p, c.i, c.seq, r.until > c.t, CASE WHEN r.until > c.t THEN r.failures WHEN ok THEN 0 ELSE r.failures + 1 END,
    CASE WHEN r.until > c.t THEN r.until WHEN ok THEN 0 WHEN r.failures + 1 >= {k} THEN c.t + {secs} ELSE r.until END,
    NOT ok AND r.until <= c.t AND r.failures + 1 >= {k}, c.t
  FROM run r JOIN c ON c.p = r.p AND c.i = r.i + 1)"""


@query("w06_circuit_intervals", f"""
WITH {sql_circuit(2, 3600)} SELECT p::VARCHAR AS provider, seq, refused, failures, alert, CASE WHEN until > t THEN until END AS open_until FROM run WHERE i > 0""")
def circuit_intervals(spark, root):
    few = calls(spark, root).withColumn("provider", (F.col("provider").cast("bigint") % 7).cast("string"))
    return te.circuit_intervals(few, 2, 3600)


@query("w07_recent_turns", """
WITH w AS (SELECT conv_id, turn, list(role || ':' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS r FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(r, '|'), '') AS recent,
  coalesce(array_to_string(list_filter(r, lambda x: starts_with(x, 'user:')), '|'), '') AS users FROM w""")
def recent_turns(spark, root):
    r = ss.recent_turns(conversations(spark, root), 2)
    line = F.transform("recent", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    return r.select("conv_id", "turn", F.array_join(line, "|").alias("recent"),
                    F.array_join(F.filter(line, lambda x: F.startswith(x, F.lit("user:"))), "|").alias("users"))


def slots_of(text: str = "text"):
    s = lb.slot_extract(text, SLOTS, "thble")
    return {n: s[n] for n in SLOTS}


SQL_SLOTS = "v AS (SELECT conv_id, turn, " + ", ".join(f"{c} AS {n}" for n, c in sql_slots("text").items()) + " FROM conversations)"


@query("w08_slot_state", f"WITH {SQL_SLOTS} SELECT conv_id, turn, " + ", ".join(
    f"last_value({n} IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS {n}" for n in SLOTS) + " FROM v")
def slot_state(spark, root):
    return ss.slot_state(conversations(spark, root), slots_of()).select("conv_id", "turn", *SLOTS)


@query("w08_final_slots", f"WITH {SQL_SLOTS} SELECT conv_id, " + ", ".join(
    f"arg_max({n}, turn) FILTER ({n} IS NOT NULL) AS {n}" for n in SLOTS) + " FROM v GROUP BY conv_id")
def final_slots(spark, root):
    return ss.final_slots(conversations(spark, root), slots_of())


@query("c15_session_summary")
def session_summary(spark, root):
    rows = pairs(spark, root).select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "user_text", "assistant_text")
    return ss.session_summary(rows, 2, 900, slots_of("user_text"),
                              {"tech": "thble|nicht", "intent": "the", "promise": "of"})


@query("j11_context_assembly", f"""
WITH s AS (SELECT conv_id AS session_id, text AS user_text FROM conversations WHERE turn = 0),
t AS (SELECT conv_id AS session_id, '- t' || turn || ' | status=' || CASE WHEN turn % 3 = 1 THEN 'blocked' ELSE 'active' END || ' | remaining=' || turn AS line, turn,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE turn % 3 <> 2),
tt AS (SELECT session_id, string_agg(line, chr(10) ORDER BY r) AS tasks FROM t WHERE r <= 3 GROUP BY session_id),
b AS (SELECT session_id, CASE WHEN {has('lower(user_text)', ['api', 'webhook', 'endpoint'])} THEN 'api_integration'
   WHEN {has('lower(user_text)', ['dataset', 'csv', 'sql', 'analyse'])} THEN 'data_analysis' WHEN {has('lower(user_text)', ['workflow', 'automatisation'])} THEN 'automation'
   ELSE 'general_technical' END AS topic, tasks,
   CASE WHEN session_id % 2 = 0 THEN '[profile]' || chr(10) || '{{"prenom": "P' || session_id || '", "ville": "V"}}' END AS prof,
   CASE WHEN session_id % 3 = 0 THEN '[summary]' || chr(10) || 'sum ' || session_id END AS summ,
   CASE WHEN session_id % 4 <> 0 THEN '[knowledge]' || chr(10) || user_text END AS know FROM s LEFT JOIN tt USING (session_id)),
p AS (SELECT session_id, topic, concat_ws(',', CASE WHEN prof IS NOT NULL THEN 'profile' END, CASE WHEN tasks IS NOT NULL THEN 'task_memory' END,
   CASE WHEN summ IS NOT NULL THEN 'summary' END, CASE WHEN know IS NOT NULL THEN 'knowledge' END) AS used_blocks,
   trim(regexp_replace(concat_ws(chr(10) || chr(10), '[topic]' || chr(10) || topic, prof, '[task_memory]' || chr(10) || tasks, summ, know), '\\s+', ' ', 'g')) AS c FROM b)
SELECT session_id, topic, used_blocks, CASE WHEN length(c) > 400 THEN rtrim(substr(c, 1, 397)) || '...' ELSE c END AS injected_context FROM p""")
def context_assembly(spark, root):
    c = conversations(spark, root)
    first = c.filter("turn = 0")
    s = first.select(F.col("conv_id").alias("session_id"), F.col("text").alias("user_text"),
                     F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("sum "), "conv_id")).alias("summary"))
    turn = F.col("turn")
    tasks = c.select(
        F.col("conv_id").alias("session_id"), turn.alias("seq"), F.concat(F.lit("t"), turn.cast("string")).alias("title"),
        F.when(turn % 3 == 2, "done").when(turn % 3 == 1, "blocked").alias("status"), turn.alias("remaining_steps"))
    profile = F.create_map(F.lit("prenom"), F.concat(F.lit("P"), "conv_id"), F.lit("ville"), F.lit("V"))
    profiles = first.filter("conv_id % 2 = 0").select(F.col("conv_id").alias("session_id"), profile.alias("profile"))
    know = first.filter("conv_id % 4 <> 0").select(F.col("conv_id").alias("session_id"), F.col("text").alias("context"))
    out = ss.context_assembly(s, tasks, profiles, know, max_chars=400)
    return out.withColumn("used_blocks", F.array_join("used_blocks", ","))


# --- samples ---------------------------------------------------------------
def sql_hash(seed, key: str) -> str:
    return f"md5('{seed}|' || {key})"


@query("t02_seeded_sample", f"SELECT doc_id, source FROM documents ORDER BY {sql_hash(7, 'doc_id')} LIMIT 300")
def seeded_sample(spark, root):
    return sm.seeded_sample(documents(spark, root), 300, 7, F.col("doc_id").cast("string")).select("doc_id", "source")


@query("t02_seeded_sample_by_group", f"""
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {sql_hash(7, 'doc_id')}) AS r FROM documents) WHERE r <= 12""")
def seeded_sample_by_group(spark, root):
    return sm.seeded_sample(documents(spark, root), 12, 7, F.col("doc_id").cast("string"), ["source"]).select("doc_id", "source")


RATIOS = {"en": 0.5, "fr": 0.3, "de": 0.15, "xx": 0.05}


@query("t03_ratio_quota", f"""
WITH q AS (SELECT unnest(['en', 'fr', 'de', 'xx']) AS lang, unnest([102, 60, 30, 10]) AS quota),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {sql_hash(3, 'doc_id')}) AS r FROM documents)
SELECT doc_id, lang FROM r JOIN q USING (lang) WHERE r <= quota""")
def ratio_quota(spark, root):
    """Quotas of 202 rows: 101, 60, 30, 10 and the rounding row for the first group."""
    return sm.ratio_quota(documents(spark, root), 202, RATIOS, 3, F.col("doc_id").cast("string"), "lang").select("doc_id", "lang")


@query("t04_core_tail_select", f"""
WITH b AS (SELECT doc_id, round(n_chars % 700 / 7.0::DOUBLE, 6) AS s, {sql_hash(5, 'doc_id')} AS h FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY s DESC, h, doc_id::VARCHAR) AS r FROM b),
c AS (SELECT *, row_number() OVER (PARTITION BY r <= 160 ORDER BY h, doc_id::VARCHAR) AS k FROM r)
SELECT doc_id FROM c WHERE (r <= 160 AND k <= 80) OR (r > 160 AND k <= 20)""")
def core_tail_select(spark, root):
    d = documents(spark, root).withColumn("score", F.col("n_chars") % 700 / F.lit(7.0))
    return sm.core_tail_select(d, 100, 5, F.col("doc_id").cast("string")).select("doc_id")


@query("t05_head_per_file", """
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 9""")
def head_per_file(spark, root):
    return sm.head_per_file(documents(spark, root), 9, ["source"], "doc_id").select("doc_id", "source")


@query("t06_recent_n", f"""
WITH {SQL_EVENTS}, t AS (SELECT * FROM ev ORDER BY ts DESC, event_id DESC LIMIT 500) SELECT event_id, k FROM t WHERE k % 5 <> 0""")
def recent_n(spark, root):
    e = load(spark, root, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return sm.recent_n(e, 500, "ts", "event_id", F.when(F.col("k") % 5 != 0, F.col("k"))).select("event_id", "k")


@query("t07_hash_split", f"""
SELECT doc_id, ('0x' || substr({sql_hash(11, 'doc_id')}, 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 AS held_out FROM documents""")
def hash_split(spark, root):
    train, test = sm.hash_split(documents(spark, root), 0.2, 11, F.col("doc_id").cast("string"))
    return train.select("doc_id", F.lit(False).alias("held_out")).unionByName(
        test.select("doc_id", F.lit(True).alias("held_out")))


# --- sets ------------------------------------------------------------------
@query("u01_union_groups", f"""
WITH b AS (SELECT 0 AS g, doc_id, text FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT 1, doc_id, text FROM documents WHERE doc_id % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY {strip('text')} ORDER BY g, doc_id) AS c FROM b) SELECT doc_id, g::BIGINT AS src_rank FROM r WHERE c = 1""")
def union_groups(spark, root):
    d = documents(spark, root).select("doc_id", F.col("text").alias("instruction"), F.lit("").alias("response"), F.col("doc_id").alias("row_idx"))
    return dd.union_groups([d.filter("doc_id % 2 = 1"), d.filter("doc_id % 2 = 0")], "exact").select("doc_id", "src_rank")


@query("u02_distinct_texts", f"""
WITH {SQL_PAIRS} SELECT user_text AS text FROM pairs UNION SELECT assistant_text FROM pairs""")
def distinct_texts(spark, root):
    return dd.distinct_texts(pairs(spark, root), "user_text", "assistant_text")


@query("u03_token_set_ops", f"""
WITH x AS (SELECT item_id, doc_id, {toks('b.text')} AS a, {toks('d.text')} AS t FROM benchmark b
  JOIN documents d ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id)
SELECT item_id, doc_id, len(list_intersect(a, t)) AS inter, len(list_distinct(a || t)) AS "union",
  round(len(list_intersect(a, t))::DOUBLE / greatest(1, len(list_distinct(a))), 6) AS share FROM x""")
def token_set_ops(spark, root):
    b = load(spark, root, "benchmark").select("item_id", F.col("text").alias("q"))
    x = b.join(answers(spark, root), F.col("item_id") == F.col("case_id"))
    s = dd.token_set_ops(tx.tokens("q"), tx.tokens("answer"))
    return x.select("item_id", "doc_id", s.alias("s")).select("item_id", "doc_id", "s.inter", "s.union", F.round("s.share", 6).alias("share"))
