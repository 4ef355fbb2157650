"""Queries over single texts and exchanges."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.catalog.base import (
    SQL_CHAT, SQL_DOCS, SQL_EVENTS, SQL_PAIRS, ascii_toks, chat_events, collapse, conversations, doc_rows,
    documents, has, inlist, letters, norm, pairs, query, soft, strip, toks, word, words,
)
from corpusflow.functions import labels as lb
from corpusflow.functions import lexicons as lx
from corpusflow.functions import text as tx
from corpusflow.session import load

# lexicons in the language of the tables
EN = ["the", "and", "pour", "der"]
RARE = ["thble", "erst", "avec", "nicht"]
HINTS = ["of", "de", "und"]


@query("p01_norm_text", f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def norm_text(spark, root):
    return documents(spark, root).select("doc_id", tx.norm_text("text").alias("norm"))


def _sql_clean(x: str) -> str:
    x = f"translate({x}, '’`“”', '''''\"\"')"
    x = collapse(x)
    x = f"regexp_replace({x}, '\\s+([,;:.!?])', '\\1', 'g')"
    x = f"regexp_replace({x}, '\\(\\s+', '(', 'g')"
    x = f"regexp_replace({x}, '\\s+\\)', ')', 'g')"
    return f"trim({x}, '\"''')"


@query("p02_clean_text", f"""
SELECT doc_id, {_sql_clean("replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')")}
  AS clean FROM documents""")
def clean_text(spark, root):
    return documents(spark, root).select("doc_id", tx.clean_text("text").alias("clean"))


@query("p03_norm_soft", f"SELECT item_id, {soft('text')} AS soft FROM benchmark")
def norm_soft(spark, root):
    return load(spark, root, "benchmark").select("item_id", tx.norm_soft("text").alias("soft"))


@query("p04_tokens", f"""
SELECT doc_id, len({toks('text')}) AS n_letters2, len({ascii_toks('text')}) AS n_ascii,
       len({toks('text', 1)}) AS n_letters1 FROM documents""")
def tokens(spark, root):
    return documents(spark, root).select(
        "doc_id", *[F.size(tx.tokens("text", k)).alias(f"n_{k}") for k in ("letters2", "ascii", "letters1")])


@query("p05_matches_keywords", f"""
SELECT doc_id, {word(norm('text'), RARE)} AS as_word, {has(norm('text'), RARE)} AS as_part FROM documents""")
def matches_keywords(spark, root):
    return documents(spark, root).select(
        "doc_id", tx.matches_keywords("text", RARE, "word").alias("as_word"),
        tx.matches_keywords("text", RARE, "substring").alias("as_part"))


PATTERNS = [r"the\s+of", r"\ban[dt]?\b", r"[0-9]{3,5}"]


@query("p06_matches_patterns", f"""
SELECT doc_id, regexp_matches({norm('text')}, 'the\\s+of|(^|[^a-z0-9_à-öø-ÿ])an[dt]?([^a-z0-9_à-öø-ÿ]|$)|[0-9]{{3,5}}') AS hit
FROM documents""")
def matches_patterns(spark, root):
    return documents(spark, root).select("doc_id", tx.matches_patterns("text", PATTERNS).alias("hit"))


@query("p07_short_word_ratio", f"""
WITH t AS (SELECT doc_id, {words('lower(text)')} AS w FROM documents),
r AS (SELECT doc_id, CASE WHEN len(w) >= 8 THEN
  len(list_filter(w, lambda x: length(x) <= 2 AND NOT ({inlist('x', lx.SHORT_WORDS_ALLOWED)})))::DOUBLE / len(w)
  ELSE 0.0::DOUBLE END AS ratio FROM t)
SELECT doc_id, round(ratio, 6) AS ratio, ratio > 0.35 AS noisy FROM r""")
def short_word_ratio(spark, root):
    ratio = tx.short_word_ratio("text")
    return documents(spark, root).select(
        "doc_id", F.round(ratio, 6).alias("ratio"), (ratio > 0.35).alias("noisy"))


def _sql_runs() -> str:
    """Five equal characters in a row, one alternative per character that occurs."""
    chars = "abcdefghijklmnopqrstuvwxyz0123456789éèêàçôùûîïüöäßñáíóú#*$%&!?., "
    alts = "|".join("[" + c + "]{5}" for c in chars)
    return alts.replace("'", "''")


@query("p07_language_noise", f"""
SELECT doc_id, regexp_matches({norm('text')}, '{_sql_runs()}|[!?]{{3,}}')
  OR CASE WHEN len({words('lower(text)')}) >= 8 THEN
  len(list_filter({words('lower(text)')}, lambda x: length(x) <= 2
      AND NOT ({inlist('x', lx.SHORT_WORDS_ALLOWED)})))::DOUBLE / len({words('lower(text)')}) > 0.35
  ELSE false END AS noisy FROM documents""")
def language_noise(spark, root):
    noise = [r"(.)\1{4,}", r"[!?]{3,}"]
    return documents(spark, root).select("doc_id", tx.language_noise("text", noise).alias("noisy"))


def sql_toxic(x: str, lexicon: list[str], hints: list[str]) -> str:
    """First whole-word hit per keyword, hints looked for 24 characters around it."""
    plain = f"' ' || regexp_replace({x}, '[^a-z0-9_à-öø-ÿ]', ' ', 'g') || ' '"
    out = []
    for w in lexicon:
        at = f"(instr({plain}, ' {w} ') - 1)"
        near = (f"substr({x}, greatest({at} - 24, 0) + 1, "
                f"least({at} + {len(w)} + 24, length({x})) - greatest({at} - 24, 0))")
        out.append(f"({at} >= 0 AND NOT {has(near, hints)})")
    return "(" + " OR ".join(out) + ")"


@query("p08_toxic_with_negation", f"""
WITH t AS (SELECT doc_id, {norm('text')} AS n FROM documents)
SELECT doc_id, {sql_toxic('n', RARE, ['the ', 'los'])} AS toxic FROM t""")
def toxic(spark, root):
    return documents(spark, root).select(
        "doc_id", tx.toxic_with_negation("text", RARE, ["the ", "los"]).alias("toxic"))


SQL_SENTENCES = "len(list_filter(regexp_split_to_array({x}, '[.!?]+'), lambda s: regexp_matches(s, '\\S')))"


def sql_structured(x: str) -> str:
    marks = " OR ".join(f"contains({x}, '{m}')" for m in ("1)", "2)", "- ", ":", ";", "{"))
    return (f"(length({x}) < 60 OR contains({x}, chr(10)) OR {marks} OR "
            + SQL_SENTENCES.replace("{x}", x) + " >= 2)")


@query("p09_is_structured", f"""
WITH t AS (SELECT conv_id, turn, {strip('text')} AS v FROM conversations)
SELECT conv_id, turn, {sql_structured('v')} AS structured FROM t""")
def is_structured(spark, root):
    return conversations(spark, root).select("conv_id", "turn", tx.is_structured("text").alias("structured"))


LOW = ["eauouon", "et laouèelleê pa", "than", "the", "thion"]


@query("p10_low_signal", f"""
SELECT doc_id, count(*) AS lines, count_if({inlist("trim(" + norm("line") + ", ' .,!?:;\"''')", LOW)})::BIGINT AS low
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def low_signal(spark, root):
    """Low lines of every document."""
    lines = documents(spark, root).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(tx.low_signal("line", LOW)).alias("low"))


@query("p11_structure_type", f"""
WITH t AS (SELECT doc_id, {strip('text')} AS v FROM documents)
SELECT kind, count(*) AS rows FROM (
  SELECT CASE WHEN starts_with(v, '{{') AND ends_with(v, '}}') THEN 'json' WHEN contains(v, '```') THEN 'code'
    WHEN contains(v, '1)') OR contains(v, '2)') OR contains(v, chr(10) || '- ') THEN 'steps' ELSE 'plain' END AS kind
  FROM t) GROUP BY kind""")
def structure_type(spark, root):
    return documents(spark, root).groupBy(tx.structure_type("text").alias("kind")).agg(
        F.count(F.lit(1)).alias("rows"))


INTENTS = [("summary", ["thble"]), ("workflow", ["erly"]), ("code_help", ["nicht"]), ("planification", ["pour"])]


def sql_intent(v: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(v, ws)} THEN '{n}'" for n, ws in INTENTS) + " ELSE 'question' END"


@query("p12_pair_intent", f"""
WITH {SQL_PAIRS}, t AS (SELECT conv_id, turn, {norm("user_text || ' ' || assistant_text")} AS v FROM pairs)
SELECT conv_id, turn, {sql_intent('v')} AS intent FROM t""")
def pair_intent(spark, root):
    return pairs(spark, root).select(
        "conv_id", "turn", lb.pair_intent("user_text", "assistant_text", INTENTS).alias("intent"))


TAGS = ["erst", "avec", "nicht", "thble", "pour"]


def sql_tags(v: str) -> str:
    made = ", ".join(f"CASE WHEN contains({v}, '{t}') THEN '{t}' END" for t in sorted(TAGS))
    return f"coalesce(nullif(array_to_string(list_filter([{made}], lambda x: x IS NOT NULL), ','), ''), 'general')"


@query("p13_tags_topic", f"""
WITH {SQL_PAIRS}, t AS (SELECT conv_id, turn, {norm("user_text || ' ' || assistant_text")} AS v FROM pairs),
g AS (SELECT *, {sql_tags('v')} AS tags FROM t)
SELECT conv_id, turn, tags, CASE WHEN conv_id % 4 = 0 THEN 'fixed' ELSE string_split(tags, ',')[1] END AS topic FROM g""")
def tags_topic(spark, root):
    given = F.when(F.col("conv_id") % 4 == 0, "fixed").otherwise("")
    t = lb.tags_topic("user_text", "assistant_text", None, given, TAGS)
    return pairs(spark, root).select("conv_id", "turn", t.alias("t")).select(
        "conv_id", "turn", F.array_join("t.tags", ",").alias("tags"), F.col("t.topic").alias("topic"))


@query("p14_conversation_key", f"""
WITH {SQL_EVENTS}
SELECT event_id, CASE WHEN k % 4 = 0 THEN 'c' || k WHEN k % 4 = 1 THEN 's' || user_id
  WHEN k % 4 = 2 THEN event_type ELSE 'log_conv_' || event_id END AS conv_key FROM ev""")
def conversation_key(spark, root):
    e = load(spark, root, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    kind = F.col("k") % 4
    ids = [F.when(kind == 0, F.concat(F.lit("c"), "k")).otherwise(" "),
           F.when(kind == 1, F.concat(F.lit("s"), "user_id")),
           F.when(kind == 2, F.col("event_type")).otherwise("")]
    return e.select("event_id", lb.conversation_key(ids, F.col("event_id")).alias("conv_key"))


# --- message scores --------------------------------------------------------
DOMAIN = ["tion", "thon"]
OFF = ["zu ", "pour "]
ERRORS = ["erth", "oua"]
SCORE_WORDS = {
    "toxic": [r"\bthble\b"], "emotional": [r"\bsich\b"], "hesitation": [r"\bfrom\b"],
    "limitation": [r"\bby\b"], "low": ["the of"],
}
FLAG_WORDS = {"domain": DOMAIN, "off_domain": OFF, "errors": ERRORS}


def sql_flags(v: str) -> dict[str, str]:
    tech = has(v, DOMAIN)
    return {"technical": tech, "domain": f"({tech} AND NOT {has(v, OFF)})", "error": has(v, ERRORS)}


def sql_message_score(role: str, v: str) -> str:
    f = sql_flags(v)
    def loss(cond: str, points: float) -> str:
        return f"(CASE WHEN {cond} THEN {points}::DOUBLE ELSE 0.0::DOUBLE END)"
    bot = f"{role} = 'assistant'"
    raw = " - ".join([
        "1.0::DOUBLE", loss(f"NOT {f['domain']}", 0.45), loss(f"NOT {f['technical']}", 0.20),
        loss(f"len({words(v)}) < 4", 0.25), loss(word(v, ["thble"]), 0.70), loss(word(v, ["sich"]), 0.50),
        loss(f["error"], 0.30), loss(f"{bot} AND {word(v, ['from'])}", 0.25),
        loss(f"{bot} AND {word(v, ['by'])}", 0.35), loss(f"{bot} AND trim({v}, ' .,!?:;\"''') = 'the of'", 0.40),
    ])
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {raw}))"


@query("p15_message_score", f"""
WITH t AS (SELECT conv_id, turn, role, {norm('text')} AS v FROM conversations)
SELECT conv_id, turn, round({sql_message_score('role', 'v')}, 6) AS score FROM t""")
def message_score(spark, root):
    f = lb.message_flags("text", **FLAG_WORDS)
    s = lb.message_score(F.col("role"), "text", f["is_in_domain"], f["is_technical"], f["has_error"], **SCORE_WORDS)
    return conversations(spark, root).select("conv_id", "turn", F.round(s, 6).alias("score"))


def sql_quality(min_chars: int) -> str:
    def gain(cond: str, points: float) -> str:
        return f"(CASE WHEN {cond} THEN {points}::DOUBLE ELSE 0.0::DOUBLE END)"
    guess = " + ".join(["0.0::DOUBLE", gain("in_domain", 0.30), gain("NOT low", 0.25), gain("NOT corrected", 0.15),
                        gain("NOT issue", 0.15), gain(f"length(assistant_text) >= {min_chars}", 0.15)])
    return (f"CASE WHEN has_quality THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, q)) "
            f"ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {guess})) END")


@query("p16_event_quality", f"""
WITH {SQL_CHAT} SELECT row_idx, round({sql_quality(200)}, 6) AS quality FROM chat""")
def event_quality(spark, root):
    q = lb.event_quality(
        F.col("in_domain"), F.col("is_low_quality"), F.col("corrected_by_verifier"), F.size("verifier_issues"),
        F.col("assistant_text"), 200, F.col("has_quality"), F.col("quality_text"))
    return chat_events(spark, root).select("row_idx", F.round(q, 6).alias("quality"))


# --- answers ---------------------------------------------------------------
TECH = ["thly", "eant", "zu"]
OUTS = ["nichtst", "thble", "erble"]
BAD = ["of the the", "de la la"]
UNSTABLE = r"\b(the\s+of\s+and|de\s+la)\b"


def sql_issues(user: str, low: str, domain: str) -> str:
    t = toks(low, 1)
    rules = [
        (has(low, BAD), "known_bad_pattern"),
        (f"(len({t}) >= 14 AND len(list_distinct({t}))::DOUBLE / greatest(len({t}), 1) < 0.5)", "high_repetition"),
        (f"regexp_matches({low}, '(^|[^a-z0-9_à-öø-ÿ])(the\\s+of\\s+and|de\\s+la)([^a-z0-9_à-öø-ÿ]|$)')",
         "unstable_phrase"),
        (f"({domain} AND {has(low, OUTS)})", "out_of_domain_content"),
        (f"({domain} AND {has(f'lower({user})', TECH)} AND len({t}) < 8)", "too_short_for_technical"),
        (f"({domain} AND {has(f'lower({user})', TECH)} AND NOT {has(low, TECH)})", "missing_technical_signal"),
        (f"(len({t}) > 220)", "too_long"),
    ]
    made = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in rules)
    return f"CASE WHEN {low} = '' THEN ['empty'] ELSE list_filter([{made}], lambda x: x IS NOT NULL) END"


def issues_of(user="user_text", answer="assistant_text"):
    return lb.quality_issues(user, answer, F.col("conv_id") % 3 != 0, TECH, OUTS, BAD, UNSTABLE)


SQL_ISSUES = f"""{SQL_PAIRS}, low AS (SELECT *, {norm('assistant_text')} AS low, conv_id % 3 <> 0 AS dom FROM pairs),
judged AS (SELECT conv_id, turn, user_text, assistant_text, low, dom, {sql_issues('user_text', 'low', 'dom')} AS issues FROM low)"""


@query("p17_quality_issues", f"""
WITH {SQL_ISSUES} SELECT issue, count(*) AS rows FROM (SELECT unnest(issues) AS issue FROM judged) GROUP BY issue""")
def quality_issues(spark, root):
    rows = pairs(spark, root).select(F.explode(issues_of()).alias("issue"))
    return rows.groupBy("issue").agg(F.count(F.lit(1)).alias("rows"))


@query("p18_low_quality_answer", f"""
WITH t AS (SELECT conv_id, turn, {norm('text')} AS v FROM conversations)
SELECT conv_id, turn, v = '' OR {has('v', BAD)} OR (len({words('v')}) >= 12 AND
  len(list_distinct({words('v')}))::DOUBLE / greatest(len({words('v')}), 1) < 0.55) OR v IN ('the of') AS low
FROM t""")
def low_quality_answer(spark, root):
    return conversations(spark, root).select(
        "conv_id", "turn", lb.low_quality_answer("text", "space", BAD, ["the of"]).alias("low"))


def sql_sentences(x: str) -> str:
    """Split behind . ! ? and blanks: the place is marked, as there is no look-behind."""
    return f"string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query("p18_low_quality_chat", f"""
WITH t AS (SELECT conv_id, turn, {norm('text')} AS v FROM conversations),
p AS (SELECT *, list_filter({sql_sentences('v')}, lambda x: x <> '') AS parts FROM t)
SELECT conv_id, turn, v = '' OR {has('v', BAD)} OR regexp_matches(v, '{lx.UNSTABLE_PATTERN.replace(chr(39), chr(39) * 2)}')
  OR (len(parts) >= 2 AND len(list_distinct(parts)) < len(parts)) OR v = 'the of'
  OR (len(string_split(v, 'je ne')) >= 3 AND contains(v, 'je veux dire')) AS low FROM p""")
def low_quality_chat(spark, root):
    return conversations(spark, root).select(
        "conv_id", "turn", lb.low_quality_answer("text", "chat", BAD, ["the of"]).alias("low"))


OPEN = ["the", "of"]
FOLLOW = ["thwhesou", "erheti", "mentre"]
OUT2 = ["thble", "nichtst", "ouon"]


@query("p19_in_domain", f"""
WITH t AS (SELECT conv_id, turn, {letters('text')} AS v FROM conversations)
SELECT conv_id, turn, CASE WHEN v = '' THEN true WHEN v IN ('the', 'of') THEN true WHEN {has('v', OUT2)} THEN false
  ELSE {has('v', DOMAIN)} END AS chat,
  CASE WHEN v = '' THEN true
  WHEN v IN ('the') OR (len(string_split(v, ' ')) <= 6
    AND len(list_filter(string_split(v, ' '), lambda x: x IN ('the', 'of', 'and'))) > 0
    AND len(list_filter(string_split(v, ' '), lambda x: x NOT IN ('the', 'of', 'and', 'to'))) = 0) THEN true
  WHEN {has('v', FOLLOW)} THEN true WHEN v IN ('the', 'of') THEN true WHEN {has('v', OUT2)} THEN false
  ELSE {has('v', DOMAIN)} END AS space FROM t""")
def in_domain(spark, root):
    return conversations(spark, root).select(
        "conv_id", "turn", lb.in_domain("text", "chat", DOMAIN, OUT2, OPEN).alias("chat"),
        lb.in_domain("text", "space", DOMAIN, OUT2, OPEN, FOLLOW, marks=["the"], allowed=["the", "of", "and"],
                     links=["to"]).alias("space"))


INTENT_WORDS = {"automation": ["thble", "nicht"], "code": ["erly", "avec"], "tech": ["thon", "zu"],
                "out_words": ["thwhesou", "ouoi"], "greetings": ["the"], "thanks": ["of"],
                "thanks_prefix": "re ", "plan": ["erst", "und"]}


def sql_intent_class(v: str) -> tuple[str, str]:
    w = INTENT_WORDS
    auto, code, tech = (has(v, w[k]) for k in ("automation", "code", "tech"))
    rules = [
        (f"{v} = ''", "unknown", 0.0), (f"{v} IN ('the')", "greeting", 0.99),
        (f"{v} IN ('of') OR starts_with({v}, 're ')", "gratitude", 0.98),
        (has(v, w["out_words"]), "out_of_domain", 0.92),
        (f"{auto} AND {has(v, w['plan'])}", "automation_request", 0.95), (auto, "automation_request", 0.88),
        (code, "code_request", 0.9), (tech, "technical_question", 0.75),
        (f"contains({v}, '?')", "technical_question", 0.55),
    ]
    name = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in rules) + " ELSE 'unknown' END"
    conf = "CASE " + " ".join(f"WHEN {c} THEN {p}::DOUBLE" for c, _, p in rules) + " ELSE 0.35::DOUBLE END"
    return name, conf


@query("p20_classify_intent", f"""
WITH t AS (SELECT conv_id, turn, {norm('text')} AS v FROM conversations)
SELECT conv_id, turn, {sql_intent_class('v')[0]} AS intent, {sql_intent_class('v')[1]} AS confidence FROM t""")
def classify_intent(spark, root):
    i = lb.classify_intent("text", **INTENT_WORDS)
    return conversations(spark, root).select("conv_id", "turn", i.alias("i")).select(
        "conv_id", "turn", "i.intent", "i.confidence")


SKILLS = [("analyse_dataset", ["thble"]), ("debug_code", ["nicht", "avec"]), ("pipeline_ml", ["erly"]),
          ("workflow_automation", ["thon"])]
PERSONAS = [("debugging", ["thsh"], "debug_code"), ("data_analyst", ["eant"], "analyse_dataset"),
            ("automation", ["zu "], "workflow_automation"), ("documentation", ["ouon"], None)]
TONES = [("pedagogique", ["thwh"]), ("detaille", ["erha"]), ("concis", ["mentre"])]
TOPICS = [("api_integration", ["erth"]), ("data_analysis", ["lesq", "thly"]), ("automation", ["oun"])]
LABELS = [("github", ["thst"]), ("messaging_webhook", ["erre", "oun"])]
TOOLS = [("memory_summary", ["thst"], "summarization keywords"), ("integrations", ["erre"], "external tool keywords"),
         ("metacognition", ["ounon"], "explanation requested"), ("task_memory", ["esth"], "task tracking context")]


def sql_first(v: str, rules: list[tuple[str, list[str]]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(v, ws)} THEN '{n}'" for n, ws in rules) + f" ELSE {default} END"


def sql_tools(v: str, intent: str, tasks: str) -> str:
    hits = [(f"({intent} = 'automation_request' OR contains({v}, 'thwh'))", "automation_plan")]
    hits += [((f"({tasks} OR {has(v, ws)})" if n == "task_memory" else has(v, ws)), n) for n, ws, _ in TOOLS]
    made = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in hits)
    return f"coalesce(nullif(array_to_string(list_filter([{made}], lambda x: x IS NOT NULL), ','), ''), 'generation')"


SQL_ROUTED = f"""msg AS (SELECT conv_id, turn, lower(text) AS q, {norm('text')} AS v FROM conversations),
lab AS (SELECT *, {sql_intent_class('v')[0]} AS intent, {sql_first('q', SKILLS, "'general_technical'")} AS skill FROM msg),
routed AS (SELECT *,
  CASE WHEN {has('q', ['thsh'])} OR skill = 'debug_code' THEN 'debugging'
    WHEN {has('q', ['eant'])} OR skill = 'analyse_dataset' THEN 'data_analyst'
    WHEN {has('q', ['zu '])} OR skill = 'workflow_automation' THEN 'automation'
    WHEN {has('q', ['ouon'])} THEN 'documentation' ELSE 'expert_ia' END AS persona,
  CASE WHEN {has('q', ['thwh'])} THEN 'pedagogique' WHEN {has('q', ['erha'])} THEN 'detaille'
    WHEN {has('q', ['mentre'])} THEN 'concis'
    WHEN intent IN ('automation_request', 'code_request', 'technical_question') THEN 'expert'
    WHEN conv_id % 2 = 0 THEN 'doux' ELSE 'professionnel' END AS tone,
  {sql_first('q', TOPICS, "'general_technical'")} AS topic,
  {sql_tools('q', 'intent', '(conv_id % 5 = 0)')} AS selected FROM lab)"""


def routed(spark, root):
    """Messages with every routing label."""
    intent = lb.classify_intent("text", **INTENT_WORDS)["intent"]
    rows = conversations(spark, root).withColumn("intent", intent).withColumn("skill", lb.skill("text", SKILLS))
    liked = F.when(F.col("conv_id") % 2 == 0, "doux")
    tools = lb.select_tools("text", F.col("intent"), F.col("conv_id") % 5 == 0, TOOLS, "thwh")
    return rows.withColumns({
        "persona": lb.persona("text", F.col("skill"), PERSONAS),
        "tone": lb.tone("text", F.col("intent"), liked, TONES),
        "topic": lb.context_topic("text", TOPICS), "tools": lb.tool_labels("text", LABELS),
        "selected": tools["selected"],
    })


@query("p21_route_labels", f"""
WITH {SQL_ROUTED} SELECT skill, persona, tone, topic, selected, count(*) AS rows FROM routed GROUP BY ALL""")
def route_labels(spark, root):
    return routed(spark, root).withColumn("selected", F.array_join("selected", ",")).groupBy(
        "skill", "persona", "tone", "topic", "selected").agg(F.count(F.lit(1)).alias("rows"))


@query("p22_compliance_guardrails", f"""
WITH {SQL_ISSUES}, f AS (SELECT conv_id, lower(assistant_text) AS a, {collapse('assistant_text')} AS c, dom, len(issues) AS n FROM judged),
flags AS (SELECT unnest(list_filter([
  CASE WHEN dom AND {has('a', OUTS)} THEN 'violation_out_of_domain_content' END,
  CASE WHEN len({words('a')}) < 3 THEN 'violation_too_short' END,
  CASE WHEN NOT dom THEN 'domain_filter' END, CASE WHEN n > 0 THEN 'quality_filter' END,
  CASE WHEN length(c) < 8 THEN 'coherence_filter' END,
  CASE WHEN {has('lower(c)', ['erheti', '??'])} THEN 'uncertainty_filter' END,
  CASE WHEN NOT dom OR length(c) < 8 THEN 'blocked' END], lambda x: x IS NOT NULL)) AS flag FROM f)
SELECT flag, count(*) AS rows FROM flags GROUP BY flag""")
def compliance_guardrails(spark, root):
    dom = F.col("conv_id") % 3 != 0
    g = lb.guardrails("assistant_text", dom, F.size(issues_of()), ["erheti", "??"])
    v = lb.compliance("assistant_text", dom, OUTS)
    flags = F.concat(
        F.transform(v, lambda x: F.concat(F.lit("violation_"), x)), F.col("g.flags"),
        F.when(F.col("g.blocked"), F.array(F.lit("blocked"))).otherwise(F.array().cast("array<string>")))
    rows = pairs(spark, root).withColumn("g", g)
    return rows.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("rows"))


SQL_SCORES = f"""{SQL_ISSUES}, n AS (
  SELECT *, len(issues) AS n, conv_id % 4 AS tools, greatest(1, len({words('assistant_text')})) AS w FROM judged),
s AS (SELECT *,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN w > 6 THEN 0.15::DOUBLE ELSE 0.45::DOUBLE END)
    + least(0.35::DOUBLE, n * 0.1::DOUBLE))) AS un,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - least(0.7::DOUBLE, n * 0.2::DOUBLE)
    - (CASE WHEN length(assistant_text) < 16 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END))) AS co,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN dom THEN 0.85::DOUBLE ELSE 0.45::DOUBLE END)
    - least(0.4::DOUBLE, n * 0.12::DOUBLE) + least(0.1::DOUBLE, tools * 0.02::DOUBLE))) AS cf FROM n),
scored AS (SELECT *, round(cf, 4) AS confidence, round(co, 4) AS coherence,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, co * 0.45::DOUBLE + cf * 0.55::DOUBLE)), 4) AS quality,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (cf * 0.55::DOUBLE + co * 0.45::DOUBLE))), 4) AS risk,
  round(un, 4) AS uncertainty FROM s)"""


def scored_pairs(spark, root):
    rows = pairs(spark, root).withColumn("n", F.size(issues_of()))
    s = lb.internal_scores("assistant_text", F.col("conv_id") % 3 != 0, F.col("n"), F.col("conv_id") % 4)
    return rows.withColumn("s", s)


@query("p23_internal_scores", f"""
WITH {SQL_SCORES} SELECT conv_id, turn, confidence, coherence, quality, risk, uncertainty FROM scored""")
def internal_scores(spark, root):
    return scored_pairs(spark, root).select("conv_id", "turn", "s.*")


@query("p24_answer_confidence", f"""
WITH {SQL_PAIRS}, t AS (SELECT conv_id, turn, {letters('user_text')} AS q, {letters('assistant_text')} AS a FROM pairs)
SELECT conv_id, turn, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  (CASE WHEN conv_id % 4 = 0 THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END)
  + least(0.30::DOUBLE, ({" + ".join(f"contains(q, '{w}')::INTEGER" for w in TECH + DOMAIN)}) * 0.04::DOUBLE)
  + (CASE WHEN {has('q', ['thwh', 'oun'])} THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END)
  + (CASE WHEN len({words('a')}) >= 18 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END))), 6) AS confidence FROM t""")
def answer_confidence(spark, root):
    c = lb.answer_confidence("user_text", "assistant_text", F.col("conv_id") % 4 == 0, TECH + DOMAIN, ["thwh", "oun"])
    return pairs(spark, root).select("conv_id", "turn", F.round(c, 6).alias("confidence"))


@query("p25_eligible_for_action", f"""
WITH {SQL_SCORES}, r AS (SELECT *, {sql_intent_class(norm('user_text'))[0]} AS intent FROM scored)
SELECT CASE WHEN NOT dom THEN 'out_of_domain' WHEN tools = 3 THEN 'no_executable_tool' WHEN risk > 0.55 THEN 'risk_too_high'
  WHEN quality < 0.45 THEN 'quality_too_low' WHEN confidence < 0.45 THEN 'confidence_too_low'
  WHEN intent IN ('automation_request', 'code_request', 'technical_question') THEN 'eligible_intent'
  ELSE 'intent_not_eligible' END AS reason, count(*) AS rows FROM r GROUP BY 1""")
def eligible_for_action(spark, root):
    intent = lb.classify_intent("user_text", **INTENT_WORDS)["intent"]
    tools = F.when(F.col("conv_id") % 4 == 3, F.array(F.lit("generation"))).otherwise(F.array(F.lit("integrations")))
    e = lb.eligible_for_action(F.col("conv_id") % 3 != 0, tools, F.col("s.risk"), F.col("s.quality"),
                               F.col("s.confidence"), intent)
    return scored_pairs(spark, root).groupBy(e["reason"].alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


# --- pages and other formats ----------------------------------------------
def sql_unescape(x: str) -> str:
    pairs_ = [("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
    for a, b in pairs_:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def sql_html_text(x: str) -> str:
    for tag in ("script", "style", "noscript"):
        x = f"regexp_replace({x}, '(?is)<{tag}.*?>.*?</{tag}>', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    return collapse(sql_unescape(x))


@query("p26_html_text_title", f"""
SELECT page_id, {sql_unescape(strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title,
  {sql_html_text('html')} AS text FROM pages""")
def html_text_title(spark, root):
    return load(spark, root, "pages").select(
        "page_id", tx.html_title("html").alias("title"), tx.html_text("html", 0).alias("text"))


@query("p27_url_domain", """
SELECT page_id, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS domain FROM pages""")
def url_domain(spark, root):
    return load(spark, root, "pages").select("page_id", tx.url_domain("url").alias("domain"))


DIGITS = [r"\b\d{16}\b", r"\b\d{1,3}\.\d{1,3}\b"]


@query("p28_placeholder_key", """
SELECT doc_id, regexp_replace(regexp_replace(text, '\\b\\d{16}\\b', 'ZZPHZZ', 'g'), '\\b\\d{1,3}\\.\\d{1,3}\\b', 'ZZPHZZ', 'g')
  AS masked FROM documents""")
def placeholder_key(spark, root):
    return documents(spark, root).select("doc_id", tx.placeholder_key("text", DIGITS).alias("masked"))


@query("p28_mask_placeholders", """
SELECT doc_id, len(regexp_extract_all(text, '\\b\\d{16}\\b'))
  + len(regexp_extract_all(regexp_replace(text, '\\b\\d{16}\\b', 'ZZPHZZ', 'g'), '\\b\\d{1,3}\\.\\d{1,3}\\b')) AS masked,
  text AS restored FROM documents""")
def mask_placeholders(spark, root):
    m = documents(spark, root).select("doc_id", tx.mask_placeholders("text", DIGITS).alias("m"))
    return m.select("doc_id", F.size("m.values").alias("masked"),
                    tx.unmask(F.col("m.template"), F.col("m.values")).alias("restored"))


@query("p29_parse_dialog", f"""
WITH n AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
  lambda l: {_sql_clean("replace(replace(l, chr(34), ''), chr(39), '')")}), lambda l: l <> '') AS n FROM documents)
SELECT doc_id, CASE WHEN len(n) >= 2 THEN len(n) ELSE 0 END AS turns, CASE WHEN len(n) >= 2 THEN array_to_string(n, chr(10)) ELSE '' END AS said FROM n""")
def parse_dialog(spark, root):
    """Every document written as a list of its quoted lines, then read back."""
    plain = F.translate("text", "\"'", "")
    lit = F.concat(F.lit("['"), F.array_join(F.split(plain, "\n"), "' '"), F.lit("']"))
    told = documents(spark, root).select("doc_id", tx.parse_dialog(lit).alias("t"))
    return told.select("doc_id", F.size("t").alias("turns"), F.array_join("t", "\n").alias("said"))


@query("p30_first_text_column", f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_sql_clean("replace(source, '&amp;', '&')")} ELSE lang END AS value
FROM documents""")
def first_text_column(spark, root):
    rows = documents(spark, root).select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("question"), F.lit("x").alias("a"),
        "lang", F.lit(" ").alias("empty"))
    fallback = tx.first_text(["question", "empty", "a", "lang"])
    return rows.select("doc_id", fallback.alias("value"))


SYSTEM = "You answer."


@query("p31_render_prompt", f"""
WITH {SQL_PAIRS}
SELECT conv_id, turn, 'Systeme: {SYSTEM}' || chr(10)
  || CASE WHEN turn > 1 THEN 'Utilisateur: a' || chr(10) || 'Assistant: b' || chr(10) ELSE '' END
  || 'Utilisateur: ' || user_text || chr(10) || 'Assistant:' AS prompt FROM pairs""")
def render_prompt(spark, root):
    history = F.when(F.col("turn") > 1, "Utilisateur: a |||  ||| Assistant: b ").otherwise("")
    return pairs(spark, root).select(
        "conv_id", "turn", tx.render_prompt("user_text", history, "dialogue", SYSTEM).alias("prompt"))


@query("p32_cap_token_runs", f"""
WITH w AS (SELECT doc_id, unnest({words('text')}) AS t, generate_subscripts({words('text')}, 1) AS i FROM documents),
l AS (SELECT *, lower(lag(t, 1) OVER v) AS t1, lower(lag(t, 2) OVER v) AS t2 FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, coalesce(string_agg(t, ' ' ORDER BY i) FILTER (i <= 2 OR lower(t) <> t1 OR lower(t) <> t2), '') AS capped
FROM l GROUP BY doc_id""")
def cap_token_runs(spark, root):
    return documents(spark, root).select("doc_id", tx.cap_token_runs(tx.collapse("text")).alias("capped"))


@query("p32_degeneration_cleanup", f"""
WITH a AS (SELECT doc_id, {sql_sentences(collapse('text'))} AS s FROM documents),
b AS (SELECT doc_id, string_split(array_to_string(list_filter(s, lambda x, i: i = 1 OR lower(x) <> lower(s[i - 1])), ' '), ' ') AS t FROM a),
c AS (SELECT doc_id, array_to_string(list_filter(t, lambda x, i: i <= 2 OR lower(x) <> lower(t[i - 1]) OR lower(x) <> lower(t[i - 2])), ' ') AS v FROM b)
SELECT doc_id, CASE WHEN v = '' OR regexp_matches(v, '[.!?]$') THEN v ELSE v || '.' END AS clean FROM c""")
def degeneration_cleanup(spark, root):
    return documents(spark, root).select("doc_id", tx.degeneration_cleanup("text").alias("clean"))


@query("p33_restyle", f"""
WITH v AS (SELECT doc_id, {collapse('text')} AS v FROM documents)
SELECT doc_id,
  CASE WHEN length(v) > 240 THEN rtrim(substr(v, 1, 237)) || '...' ELSE v END AS concis,
  CASE WHEN v = '' OR starts_with(lower(v), 'voici') THEN v ELSE 'Voici une explication simple: ' || v END AS pedagogique,
  CASE WHEN NOT contains(v, '1)') AND length(v) > 80 THEN 'Approche recommandee: ' || v ELSE v END AS expert,
  CASE WHEN v = '' THEN v ELSE 'Veuillez noter: ' || v || CASE WHEN ends_with(v, '.') THEN '' ELSE '.' END END AS formal
FROM v""")
def restyle(spark, root):
    return documents(spark, root).select(
        "doc_id", *[tx.restyle("text", m).alias(m) for m in ("concis", "pedagogique", "expert", "formal")])


@query("p33_restyle_bullet", f"""
WITH v AS (SELECT doc_id, {collapse('text')} AS v FROM documents)
SELECT doc_id, array_to_string(list_transform(list_filter({sql_sentences('v')}, lambda x: x <> ''), lambda x: '- ' || x), chr(10)) AS bullet,
  regexp_replace(regexp_replace(v, '(?i)\\bimplementation\\b', 'mise en place', 'g'), '(?i)\\barchitecture\\b', 'organisation', 'g') AS simple FROM v""")
def restyle_bullet(spark, root):
    return documents(spark, root).select(
        "doc_id", tx.restyle("text", "bullet").alias("bullet"), tx.restyle("text", "simple").alias("simple"))


@query("p34_json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, NULL::VARCHAR AS missing FROM events")
def json_path(spark, root):
    return load(spark, root, "events").select(
        "event_id", tx.json_path("props", "k").alias("k"), tx.json_path("props", "k.0.x").alias("missing"))


@query("p35_action_plan_audit", f"""
WITH {SQL_EVENTS}
SELECT CASE WHEN k % 5 = 1 OR k % 5 = 4 THEN 'defaulted' WHEN k % 5 = 0 THEN 'valid' WHEN k % 5 = 2 THEN 'repaired'
  ELSE 'valid' END AS outcome, count(*) AS rows FROM ev GROUP BY 1""")
def action_plan_audit(spark, root):
    """Plans wrapped in prose, of five kinds by event."""
    k = F.get_json_object("props", "$.k").cast("bigint") % 5
    plan = (
        F.when(k == 0, F.lit('ok {"steps": [{"action": "respond"}]} done'))
        .when(k == 1, F.lit("no plan here"))
        .when(k == 2, F.lit('{"steps": [{"action": "respond"}, {"action": "rm"}, 3]}'))
        .when(k == 3, F.lit('x {"name": "p", "steps": [{"action": " store_jsonl ", "params": {"a": {}}}]}'))
        .otherwise(F.lit('{"steps": 5} {"steps": [{"action": "respond"}]}'))
    )
    rows = load(spark, root, "events").withColumn("p", lb.action_plan(F.concat(F.col("event_type"), F.lit(" "), plan)))
    return rows.groupBy(F.col("p.outcome").alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))


SLOTS = {"prenom": [r"(?:the|der)\s+([a-z]+)"], "ville": [r"(?:of|de)\s+([a-z]+)"],
         "sport": [r"(?:nicht)\s+([a-z]+)", r"(?:to)\s+([a-z]+)"], "objectif_minutes": [r"(\d+)\s*minutes"]}


def sql_slot(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, '(?i){pattern}', 1), '')"


def sql_slots(x: str) -> dict[str, str]:
    out = {n: "coalesce(" + ", ".join(sql_slot(x, p) for p in ps) + ", NULL)" for n, ps in SLOTS.items()}
    out["sport"] = f"CASE WHEN NOT regexp_matches({x}, '(?i)thble') THEN {out['sport']} END"
    return out


@query("p36_slot_extract", "SELECT conv_id, turn, " + ", ".join(
    f"{c} AS {n}" for n, c in sql_slots("text").items()) + " FROM conversations")
def slot_extract(spark, root):
    return conversations(spark, root).select(
        "conv_id", "turn", lb.slot_extract("text", SLOTS, "thble").alias("s")).select("conv_id", "turn", "s.*")


@query("p37_preference_extract", f"""
WITH t AS (SELECT conv_id, turn, lower(text) AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN {has('q', ['thble'])} THEN 'concis' WHEN {has('q', ['nicht', 'erly'])} THEN 'detaille' END
  AS tone_preference, CASE WHEN contains(q, 'avec') THEN 'avec' WHEN contains(q, 'thon') THEN 'thon' END AS favorite_tooling FROM t""")
def preference_extract(spark, root):
    p = lb.preference_extract("text", ["thble"], ["nicht", "erly"], ("avec", "thon"))
    return conversations(spark, root).select("conv_id", "turn", p.alias("p")).select("conv_id", "turn", "p.*")


@query("p38_shorten", f"""
WITH v AS (SELECT doc_id, {collapse('text')} AS v FROM documents)
SELECT doc_id, CASE WHEN length(v) > 180 THEN rtrim(substr(v, 1, 179)) || '…' ELSE v END AS short,
  CASE WHEN length(v) > 100 THEN rtrim(substr(v, 1, 97)) || '...' ELSE v END AS dots FROM v""")
def shorten(spark, root):
    return documents(spark, root).select(
        "doc_id", tx.shorten("text", 180).alias("short"), tx.shorten("text", 100, "...").alias("dots"))


@query("p39_domain_row", f"""
WITH {SQL_DOCS} SELECT doc_id, {has("lower(instruction || ' ' || response || '  ' || source)", ['src7', 'thonthe', 'nicht'])}
  AS in_domain FROM docs""")
def domain_row(spark, root):
    return doc_rows(spark, root).select("doc_id", lb.domain_row(
        "instruction", "response", "history", "source", ["src7", " thonthe ", "Nicht", ""]).alias("in_domain"))


@query("p40_state_trace", f"""
WITH {SQL_ROUTED}, x AS (SELECT CASE WHEN conv_id % 6 = 0 THEN 'done'
    WHEN len(list_filter(string_split(selected, ','), lambda s: s IN ('automation_plan', 'integrations'))) > 0 THEN 'planned'
    ELSE 'skipped' END AS ex FROM routed)
SELECT state, status, count(*) AS rows FROM (
  SELECT unnest(['analyse', 'planification', 'execution', 'verification', 'reponse_finale']) AS state,
         unnest(['done', 'done', ex, 'done', 'done']) AS status FROM x) GROUP BY ALL""")
def state_trace(spark, root):
    trace = lb.state_trace(F.col("selected"), F.col("conv_id") % 6 == 0)
    rows = routed(spark, root).select(F.explode(trace).alias("t"))
    return rows.groupBy("t.state", "t.status").agg(F.count(F.lit(1)).alias("rows"))


@query("p41_code_blocks", r"""
SELECT source, count(*) AS rows, count_if(regexp_matches(text, '(?is)```python\s*(.*?)```'))::BIGINT AS with_code
FROM documents GROUP BY source""")
def code_blocks(spark, root):
    return documents(spark, root).groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.size(tx.code_blocks("text")) > 0).alias("with_code"))


@query("p42_needs_clarification", f"""
WITH t AS (SELECT conv_id, turn, {strip('text')} AS q FROM conversations)
SELECT conv_id, turn, length(q) <= 10 OR (contains(lower(q), 'thwh') AND NOT {has('lower(q)', TECH)}) AS ask FROM t""")
def needs_clarification(spark, root):
    return conversations(spark, root).select(
        "conv_id", "turn", lb.needs_clarification("text", "thwh", TECH).alias("ask"))
