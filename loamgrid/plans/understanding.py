"""Query understanding on conversations, documents, parts and orders; rule tables name words that occur there."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import rules as L
from loamgrid.functions import tokens as T
from loamgrid.functions import understanding as U
from loamgrid.operators import decide as D
from loamgrid.plans.retrieval import table

INTENTS = [("URGENT", "whst\\s+the|inger[.]"), ("DETAIL", "tion of|ment de"), ("REFERRAL", "(?<![a-z0-9_])by the(?![a-z0-9_])"), ("PROCEDURE", "how to|(?<![a-z0-9_])for and(?![a-z0-9_])"), ("GREETING", "^(it|th)[\\s!.?]"), ("AFFIRM", "sure|right|ndre"), ("NEGATE", "^no[.!?]?$|other")]
SENTIMENTS = [("panic", "please|(?<![a-z0-9_])was(?![a-z0-9_])"), ("confused", "again|erst"), ("affirm", "good|(?<![a-z0-9_])ok(?![a-z0-9_])|ly")]
CATEGORIES = [("reds", "red|rose"), ("blues", "blue|navy"), ("greens", "green"), ("tools", "bolt|gear|widget")]
PHRASES = [("red widget", "crimson device"), ("blue bolt", "azure rod"), ("crimson device", "item")]
WORDS = {"green": "verdant", "gadget": "tool", "bolt": "fastener", "small": "little", "large": "big"}
EXPANSIONS = {"red": "crimson scarlet", "widget": "device gadget", "blue": "azure", "gear": "cog wheel", "bolt": "fastener"}
FILLERS = "the of and to in is that it for on was as with be by are this at from or an a".split()
VOCABULARY = "tion ing red blue er ed".split()
PATTERNS = [("tion\\s+the", ["motion", "the motion"]), ("(red|blue|green)", ["colour"]), ("ing of", ["making", "motion"])]


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def detect_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", U.detect_language(F.col("text")).alias("language"), U.english_script(F.col("text")).alias("latin"))


def intent_cascade(spark, sf_dir):
    c = F.col("text")
    return turns(spark, sf_dir).select("conv_id", "turn", U.classify_intent(c, INTENTS).alias("intent"), U.classify_intent(c).alias("plain_intent"), U.language_mode(c).alias("mode"), U.ambiguous(c).alias("ambiguous"), U.any_of(c).alias("out_of_scope"), U.analytics_intent(U.classify_intent(c, INTENTS)).alias("analytics_intent"))


def sentiment(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", U.sentiment(F.col("text"), SENTIMENTS).alias("sentiment"), U.sentiment(F.col("text")).alias("plain_sentiment"), U.tone(F.col("text")).alias("tone"))


def category_map(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", U.category(F.col("p_name"), CATEGORIES).alias("category"), U.chip(F.concat_ws(" - ", "p_name", "p_type", "p_brand"), 24).alias("chip"))


def normalize_query(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", U.normalize(F.col("p_name"), PHRASES, WORDS).alias("normalized"))


def expand_synonyms(spark, sf_dir):
    name = F.concat_ws("-", F.lit("red/blue"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", U.expand_synonyms(F.col("p_name"), EXPANSIONS).alias("expanded"), U.expand_synonyms(name, EXPANSIONS).alias("expanded_joined"))


def dedupe_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", U.dedupe_terms(F.col("text")).alias("terms"))


def narrative_extract(spark, sf_dir):
    c = F.col("text")
    return turns(spark, sf_dir).select("conv_id", "turn", U.narrative(c, FILLERS, VOCABULARY).alias("narrative"), U.narrative_terms(c, PATTERNS, FILLERS, VOCABULARY).alias("terms"))


def slot_extract(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ["years", "month", "weeks", "day"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    said = F.concat_ws(" ", F.lit("Patient"), (F.col("o_custkey") % 90).cast("string"), unit, F.lit("old,"), (F.col("o_orderkey") % 40).cast("string"), F.lit("kg"))
    spoken = F.element_at(F.array(*map(F.lit, ["the newborn cries", "a baby", "my toddler", "the child", "mother and child", "nothing"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    text = F.when(F.col("o_orderkey") % 3 == 0, spoken).otherwise(said)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).select("o_orderkey", U.slots(F.col("text")).alias("s")).select("o_orderkey", "s.*")


def correction(spark, sf_dir):
    said = F.element_at(F.array(F.concat(F.lit("no I meant "), F.col("p_name")), F.concat(F.lit("actually "), F.col("p_name")), F.concat(F.lit("not that "), F.col("p_name")), F.col("p_name")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", U.correction(said).alias("corrected"))


def key_terms(spark, sf_dir):
    return turns(spark, sf_dir).filter("role = 'assistant'").select("conv_id", "turn", D.key_terms(F.col("text")).alias("t")).select("conv_id", "turn", F.size("t").cast("long").alias("n_terms"), F.array_join("t", "|").alias("terms"))


def grounding_score(spark, sf_dir):
    """Assistant turns against what the user said in the turn before."""
    t = turns(spark, sf_dir)
    said = t.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    claims = t.filter("role = 'assistant'").join(said, ["conv_id", "turn"]).select("conv_id", "turn", F.array_distinct(F.filter(F.split(F.lower("text"), "\\s+"), lambda w: F.length(w) >= 4)).alias("claims"), "evidence")
    return claims.select("conv_id", "turn", D.grounding(F.col("claims"), F.col("evidence")).alias("score")).withColumn("grounded", F.col("score") >= 0.7)


def truncate_answer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(D.truncated(F.regexp_replace("text", "\\s+", " "))).alias("answer_md5"))


def raw_text(spark, sf_dir):
    """A part's fields as one text: lead, secondary and remaining fields that aren't empty."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n\n", "p_name", F.nullif("p_type", F.lit("")), F.concat(F.lit("Brand: "), F.col("p_brand")), F.concat(F.lit("Size: "), F.col("p_size").cast("string"))).alias("raw_text"))


def formatters(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.initcap("p_name").alias("title"), U.clean_topic(F.concat(F.lit("2.1 "), F.col("p_name"))).alias("topic"), U.word_count(F.col("p_name")).cast("long").alias("words"), U.hashed(F.col("p_brand"), "pepper").alias("brand_hash"))


def render_preview(spark, sf_dir):
    body = F.regexp_replace("text", "\\s+", " ")
    return table(spark, sf_dir, "documents").select("doc_id", U.chip(F.trim(body), 60).alias("preview"), F.concat_ws(": ", F.upper("lang"), U.chip(F.trim(body), 40)).alias("title"))


QUERIES = {
    f.__name__: f
    for f in (detect_language, intent_cascade, sentiment, category_map, normalize_query, expand_synonyms, dedupe_terms, narrative_extract, slot_extract, correction, key_terms, grounding_score, truncate_answer, raw_text, formatters, render_preview)
}


def re2(pattern: str) -> str:
    """The pattern for a test, without look-around."""
    return pattern.replace("(?<![a-z0-9_])", "(^|[^a-z0-9_])").replace("(?![a-z0-9_])", "([^a-z0-9_]|$)").replace("'", "''")


def _edges(pattern: str) -> str:
    """The pattern with ASCII word boundaries in place of look-around."""
    return pattern.replace(D.BEGIN, "\\b").replace(D.END, "\\b")


def _case(column: str, cascade, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{re2(p)}') THEN '{name}'" for name, p in cascade) + f" ELSE {default} END"


def _language() -> str:
    counts = {lang: " + ".join(f"CAST(contains(q, '{m}') AS INT)" for m in words) for lang, words in L.LANGUAGE_MARKERS.items()}
    cols = ", ".join(f"{c} AS n_{lang}" for lang, c in counts.items())
    top = "greatest(" + ", ".join(f"n_{x}" for x in counts) + ")"
    return f"""WITH t AS (SELECT doc_id, lower(trim(text)) AS q, regexp_replace(text, '\\s', '', 'g') AS s FROM documents), n AS (SELECT doc_id, s, {cols} FROM t)
SELECT doc_id, CASE WHEN {top} < 2 THEN 'en' {" ".join(f"WHEN n_{x} = {top} THEN '{x}'" for x in counts)} END AS language, CASE WHEN length(s) = 0 THEN true ELSE length(regexp_replace(s, '[\\x00-ɏ]', '', 'g')) / length(s) <= 0.3 END AS latin FROM n"""


_LOW = "lower(trim(text))"
_AMBIGUOUS = f"(len(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: length(t) >= 2)) <= 5 AND NOT regexp_matches(lower(text), '{re2(U.whole_word(L.VERBS))}') AND NOT regexp_matches(trim(lower(text)), '{L.QUESTION_START}'))"
_DEFAULT = f"CASE WHEN {_AMBIGUOUS} THEN 'HEADING_LOOKUP' ELSE 'CLINICAL' END"
_PIDGIN, _ENGLISH = re2(U.whole_word("|".join([*L.PIDGIN_WORDS, "how\\s+far"]))), re2(U.whole_word(L.ENGLISH_WORDS))
_MAP = "MAP {" + ", ".join(f"'{k}': {v.split()!r}" for k, v in EXPANSIONS.items()) + "}"


def _expand(x: str) -> str:
    found = f"list_transform(flatten(list_transform(list_filter(string_split_regex(lower({x}), '\\s+'), lambda t: length(t) >= 2), lambda t: CASE WHEN len(list_filter(string_split_regex(t, '[-/]'), lambda p: length(p) >= 2)) > 1 THEN list_filter(string_split_regex(t, '[-/]'), lambda p: length(p) >= 2) ELSE [regexp_replace(t, '[^a-z0-9_]', '', 'g')] END)), lambda z: z)"
    fresh = f"list_filter(flatten(list_transform({found}, lambda t: coalesce({_MAP}[t], []))), lambda w: NOT list_contains({found}, w))"
    once = f"list_filter({fresh}, lambda w, i: list_position({fresh}, w) = i)"
    return f"CASE WHEN len({fresh}) > 0 THEN {x} || ' ' || array_to_string({once}, ' ') ELSE {x} END"


def _normalize() -> str:
    out = "p_name"
    for p, r in PHRASES:
        out = f"regexp_replace({out}, '(^|\\s){p}(\\s|$)', '\\1{r}\\2', 'gi')"
    word = "CASE regexp_replace(lower(t), '[^a-z0-9_]', '', 'g') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in WORDS.items()) + " ELSE t END"
    return f"SELECT p_partkey, array_to_string(list_transform(string_split_regex({out}, '\\s+'), lambda t: CASE WHEN length(regexp_replace(t, '[^A-Za-z0-9_]', '', 'g')) < 3 THEN t ELSE {word} END), ' ') AS normalized FROM part"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_BARE = r"string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\s]', '', 'g'), '\s+')"
_NARRATIVE = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN {_list(t)} ELSE [] END" for p, t in PATTERNS)
_SAID = "concat_ws(' ', 'Patient', CAST(o_custkey % 90 AS VARCHAR), ['years', 'month', 'weeks', 'day'][CAST(o_orderkey % 4 + 1 AS INT)], 'old,', CAST(o_orderkey % 40 AS VARCHAR), 'kg')"

ORACLES = {
    "detect_language": _language(),
    "intent_cascade": f"""WITH i AS (SELECT *, {_case(_LOW, INTENTS, _DEFAULT)} AS intent FROM conversations)
SELECT conv_id, turn, intent, {_case(_LOW, L.INTENTS, _DEFAULT)} AS plain_intent,
CASE WHEN regexp_matches({_LOW}, '{_PIDGIN}') AND regexp_matches({_LOW}, '{_ENGLISH}') THEN 'mixed' WHEN regexp_matches({_LOW}, '{_PIDGIN}') THEN 'pidgin' WHEN regexp_matches({_LOW}, '{_ENGLISH}') THEN 'english' ELSE 'other' END AS mode,
{_AMBIGUOUS} AS ambiguous, regexp_matches(lower(text), '{"|".join(L.OUT_OF_SCOPE)}') AS out_of_scope,
CASE intent WHEN 'PROCEDURE' THEN 'treatment_dosage' WHEN 'DETAIL' THEN 'treatment_dosage' WHEN 'CLINICAL' THEN 'symptom_check' WHEN 'URGENT' THEN 'referral_criteria' ELSE 'general_inquiry' END AS analytics_intent FROM i""",
    "sentiment": f"""SELECT conv_id, turn, {_case(_LOW, SENTIMENTS, "'calm'")} AS sentiment, {_case(_LOW, L.SENTIMENTS, "'calm'")} AS plain_sentiment,
CASE WHEN regexp_matches(lower(text), 'urgent|emergency|help|now|quick') THEN 'urgent' WHEN regexp_matches(lower(text), 'worried|scared|afraid|anxious') THEN 'reassuring' WHEN length(text) < 50 THEN 'direct' ELSE 'formal' END AS tone FROM conversations""",
    "category_map": f"""WITH t AS (SELECT *, concat_ws(' - ', p_name, p_type, p_brand) AS x FROM part) SELECT p_partkey, {_case("lower(coalesce(p_name, ''))", CATEGORIES, "'general'")} AS category, CASE WHEN length(x) > 24 THEN substr(x, 1, 21) || '...' ELSE x END AS chip FROM t""",
    "normalize_query": _normalize(),
    "expand_synonyms": f"SELECT p_partkey, {_expand('p_name')} AS expanded, {_expand(chr(40) + chr(39) + 'red/blue-' + chr(39) + ' || p_name)')} AS expanded_joined FROM part",
    "dedupe_terms": r"""WITH t AS (SELECT item_id, string_split_regex(text, '\s+') AS w, list_transform(string_split_regex(text, '\s+'), lambda x: regexp_replace(lower(x), '[^a-z0-9_]', '', 'g')) AS b FROM benchmark)
SELECT item_id, array_to_string(list_filter(w, lambda x, i: b[i] <> '' AND list_position(b, b[i]) = i), ' ') AS terms FROM t""",
    "narrative_extract": f"""WITH t AS (SELECT conv_id, turn, text, list_filter({_BARE}, lambda w: length(w) >= 2) AS tk FROM conversations),
n AS (SELECT *, len(list_filter(tk, lambda w: list_contains({_list(VOCABULARY)}, w))) / len(tk) AS v, len(list_filter(tk, lambda w: list_contains({_list(FILLERS)}, w))) / len(tk) AS f,
flatten([{_NARRATIVE}, list_filter(tk, lambda w: length(w) >= 3 AND list_contains({_list(VOCABULARY)}, w) AND NOT list_contains({_list(FILLERS)}, w))]) AS a FROM t)
SELECT conv_id, turn, len(tk) >= 7 AND v < 0.3 AND f > 0.4 AS narrative, array_to_string(list_filter(a, lambda w, i: list_position(a, w) = i), ' ') AS terms FROM n""",
    "slot_extract": f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ['the newborn cries', 'a baby', 'my toddler', 'the child', 'mother and child', 'nothing'][CAST(o_orderkey % 6 + 1 AS INT)] ELSE {_SAID} END AS x FROM orders),
s AS (SELECT *, regexp_extract(x, '(\\d+)\\s*(year|month|week|day)s?\\s*old', 1) AS n, regexp_extract(x, '(\\d+)\\s*(year|month|week|day)s?\\s*old', 2) AS u FROM t)
SELECT o_orderkey, CAST(CASE WHEN n <> '' THEN floor(CASE u WHEN 'year' THEN CAST(n AS DOUBLE) * 12 WHEN 'week' THEN CAST(n AS DOUBLE) / CAST(4.345 AS DOUBLE) WHEN 'day' THEN CAST(n AS DOUBLE) / CAST(30.44 AS DOUBLE) ELSE CAST(n AS DOUBLE) END + 0.5) WHEN contains(x, 'newborn') THEN 0 WHEN contains(x, 'baby') THEN 6 WHEN contains(x, 'toddler') THEN 36 WHEN contains(x, 'child') AND NOT contains(x, 'mother') THEN 48 END AS BIGINT) AS age_months,
CASE WHEN n <> '' THEN n || ' ' || u WHEN contains(x, 'newborn') THEN 'newborn' WHEN contains(x, 'baby') THEN 'infant' WHEN contains(x, 'toddler') THEN 'child' WHEN contains(x, 'child') AND NOT contains(x, 'mother') THEN 'child' END AS age_label,
CAST(nullif(regexp_extract(x, '(\\d+) kg', 1), '') AS DOUBLE) AS weight_kg FROM s""".replace("\\\\", "\\"),
    "correction": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(trim(p_name)) WHEN 1 THEN CASE WHEN regexp_matches(lower(p_name), '^\\w[\\w\\s]{2,30}$') THEN lower(trim(p_name)) END END AS corrected FROM part",
    "key_terms": f"""WITH t AS (SELECT conv_id, turn, flatten([
list_filter(list_transform(list_filter(regexp_extract_all(text, '{_edges(D.CAPITALISED)}'), lambda w: length(w) > 1), lambda w: array_to_string(list_filter(string_split_regex(w, '\\s+'), lambda p: NOT list_contains({_list(D.COMMON_CAPITALISED)}, p)), ' ')), lambda w: w <> ''),
{", ".join(f"regexp_extract_all(text, '{_edges(p)}')" for p in D.CLAIM_PATTERNS)}]) AS a FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id, turn, list_filter(a, lambda w, i: list_position(a, w) = i) AS a FROM t) SELECT conv_id, turn, len(a) AS n_terms, array_to_string(a, '|') AS terms FROM u""",
    "grounding_score": r"""WITH c AS (SELECT a.conv_id, a.turn, list_distinct(list_filter(string_split_regex(lower(a.text), '\s+'), lambda w: length(w) >= 4)) AS cl, lower(u.text) AS ev FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND u.turn + 1 = a.turn WHERE a.role = 'assistant' AND u.role = 'user'),
s AS (SELECT conv_id, turn, CASE WHEN len(cl) = 0 THEN 1.0 ELSE round(len(list_filter(cl, lambda w: contains(ev, w))) / len(cl), 6) END AS score FROM c) SELECT conv_id, turn, CAST(score AS DOUBLE) AS score, score >= 0.7 AS grounded FROM s""",
    "truncate_answer": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS x FROM documents),
s AS (SELECT doc_id, x, len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) AS n, regexp_extract_all(x, '[^.!?]+[.!?]+') AS a FROM t),
r AS (SELECT *, list_filter(list_transform(list_slice(a, 3, 6), lambda y: trim(y)), lambda y: y <> '') AS rest, trim(array_to_string(list_slice(a, 1, 2), ' ')) AS spoken FROM s)
SELECT doc_id, md5(CASE WHEN n <= 120 OR len(a) = 0 THEN x WHEN len(rest) > 0 THEN spoken || chr(10) || chr(10) || 'Key points:' || chr(10) || array_to_string(list_transform(rest, lambda y: '• ' || regexp_replace(array_to_string(list_slice(string_split_regex(y, '\s+'), 1, 12), ' '), '[.!?]+$', '')), chr(10)) ELSE spoken END) AS answer_md5 FROM r""",
    "raw_text": "SELECT p_partkey, concat_ws(chr(10) || chr(10), p_name, nullif(p_type, ''), 'Brand: ' || p_brand, 'Size: ' || CAST(p_size AS VARCHAR)) AS raw_text FROM part",
    "formatters": r"""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS title, p_name AS topic, len(string_split_regex(trim(p_name), '\s+')) AS words, sha256(p_brand || 'pepper') AS brand_hash FROM part""",
    "render_preview": r"""WITH t AS (SELECT doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) > 60 THEN substr(x, 1, 57) || '...' ELSE x END AS preview, upper(lang) || ': ' || CASE WHEN length(x) > 40 THEN substr(x, 1, 37) || '...' ELSE x END AS title FROM t""",
}
