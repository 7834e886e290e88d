"""Checks on messages, query rewriting, chunk content, the usage store and tiers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import predicates as P
from loamgrid.functions import rules as L
from loamgrid.functions import understanding as U
from loamgrid.operators import analytics as A
from loamgrid.operators import content as C
from loamgrid.operators import retrieval as R
from loamgrid.operators import sessions as PS
from loamgrid.operators import store as S
from loamgrid.plans import retrieval as PR
from loamgrid.plans import understanding as PU
from loamgrid.plans.retrieval import table
from loamgrid.shared import written

TURN_WORDS = "the that tion with".split()
TRIGGERS, ALWAYS = ["the", "it", "of", "thanks", "bye"], ["it", "bye"]
SIGNS = [*L.DANGER_SIGNS, ("ending", "tion\\s+the"), ("linking", "and of")]
FAQS = [("offline", ["offline", "tion of the"]), ("update", ["update", "and the"]), ("search", ["how to search", "ing the"])]
MODULES = [("core", "1-URGENT"), ("core", "2-HIGH"), ("extra", "2-HIGH"), ("extra", "3-MEDIUM"), ("extra", "3-MEDIUM")]
PATTERNS = {"digits": "[0-9]{4}", "license": "[Ll]icen[sc]e", "table": "\\|", "mail": "[a-z]+@[a-z]+"}
CODE = "^[A-Z][a-z]+#[0-9]{1,2}$"


def message_checks(spark, sf_dir):
    c, low = F.col("text"), F.lower("text")
    clinical = P.clinical_presence(c, TURN_WORDS)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", clinical.alias("clinical"), P.has_word(c, L.PATIENT_WORDS).alias("patient"), P.has_word(c, L.INFORMATIONAL).alias("informational"), P.short_greeting(F.substring_index("text", ".", 1), F.col("turn") + 1, ["the"]).alias("greeting"),
        P.social(c, F.col("turn") > 2, F.contains(low, F.lit("shre")), TRIGGERS, ALWAYS).alias("social"), P.compiler_error(c).alias("failed"), P.deflection(F.concat(F.when(F.col("turn") % 3 == 0, "Tell me more about it. ").otherwise(""), F.col("text"), F.when(F.col("turn") % 5 == 1, " Would you like me to go on?").otherwise(""))).alias("deflects"),
    )


def input_validation(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.valid_code(F.col("p_brand"), CODE).alias("code_ok"), P.valid_weight(F.col("p_size")).alias("weight_ok"), P.patient_slot(F.nullif(F.col("p_size") % 5, F.lit(0)), F.nullif(F.col("p_partkey") % 3, F.lit(0))).alias("has_slot"))


def danger_escalation(spark, sf_dir):
    kind = F.when(F.col("turn") == 4, "danger_sign").otherwise("faq")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.danger(F.col("text"), kind, SIGNS).alias("sign"), P.app_faq(F.col("text"), FAQS).alias("faq"))


def rewrite_query(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    text = F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 3 == 0, "for the baby").when(F.col("p_partkey") % 3 == 1, "one/two-three"))
    k = F.col("p_partkey") % 4
    intent = F.when(k == 0, "HEADING_LOOKUP").when(k == 1, "CLINICAL").when(k == 2, "DETAIL").otherwise("AFFIRM")
    gap = F.when(F.col("p_size") % 2 == 0, "dosage")
    return part.select("p_partkey", P.rewritten(text, intent, gap, F.when(F.col("p_size") > 25, "blue fever"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")), phrases=PU.PHRASES, words=PU.WORDS, expansions=PU.EXPANSIONS).alias("rewritten"))


def dose_merge(spark, sf_dir):
    k = F.col("p_partkey") % 3
    intent = F.when(k == 0, "DETAIL").when(k == 1, "PROCEDURE").otherwise("CLINICAL")
    return table(spark, sf_dir, "part").select("p_partkey", P.merged_dose(F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")), F.when(F.col("p_size") > 10, F.col("p_brand")), intent, F.when(F.col("p_size") % 2 == 0, F.col("p_size"))).alias("answer"))


def answer_salvage(spark, sf_dir):
    """What a model might have written around a part's name: fenced JSON, broken JSON, plain text, nothing."""
    k = F.col("p_partkey") % 5
    made = F.when(k == 0, F.concat(F.lit('```json\n{"answer": "'), "p_name", F.lit('"}\n```'))).when(k == 1, F.concat(F.lit('{"answer": "'), "p_name", F.lit('", "more": '))).when(k == 2, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(k == 3, "{}").otherwise("``` ```")
    return table(spark, sf_dir, "part").select("p_partkey", P.salvaged(made).alias("answer"))


def _chunks(spark, sf_dir):
    """Parts as chunks of three types."""
    k = F.col("p_partkey") % 3
    content = F.to_json(F.struct(F.when(k != 0, F.col("p_name")).alias("title"), F.when(k != 1, F.col("p_name")).alias("name"), F.when(F.col("p_size") % 2 == 0, "iv").alias("route"), F.when(k == 1, F.array(F.struct((F.col("p_size") * 1.0).alias("minKg"), (F.col("p_size") * 2.0).alias("maxKg"), F.col("p_brand").alias("dose")))).alias("weightRanges")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(k == 0, "faq").when(k == 1, "drug_table").otherwise("protocol").alias("type"), content.alias("content"), F.col("p_type").alias("document"))


def artifacts(spark, sf_dir):
    none = spark.createDataFrame([], "id long, title string, publisher string, year int")
    return C.artifacts(_chunks(spark, sf_dir), none).withColumn("topics", F.array_join("topics", ","))


def drug_tables(spark, sf_dir):
    return C.drug_tables(_chunks(spark, sf_dir)).withColumn("ranges", F.array_join(F.transform("ranges", lambda r: F.concat_ws(":", r["minKg"].cast("int").cast("string"), r["maxKg"].cast("int").cast("string"), r["dose"])), ";"))


def decision_trees(spark, sf_dir):
    """Regions as trees, nations as their nodes, those with an even key as branches with two ways on."""
    ways = F.array(*[F.struct(F.lit(w).alias("id"), F.lit(w).alias("label"), F.lit("end").alias("next")) for w in ("yes", "no")])
    node = F.struct(F.when(F.col("n_nationkey") % 2 == 1, "action").alias("type"), F.concat(F.lit("Is it "), "n_name", F.lit("?")).alias("question"), F.when(F.col("n_nationkey") % 2 == 0, ways).alias("options"))
    nodes = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("n_name").alias("k"), node.alias("v"))))).alias("nodes"))
    trees = table(spark, sf_dir, "region").join(nodes, "r_regionkey")
    chunks = trees.select(F.col("r_regionkey").alias("id"), F.lit("decision_tree").alias("type"), F.to_json(F.struct(F.col("r_name").alias("name"), "nodes")).alias("content"), F.lit("").alias("document"))
    return C.decision_trees(chunks)


def point_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return C.by_ids(docs, docs.filter("doc_id % 50 = 0"), "doc_id").select("doc_id", "source", F.md5("text").alias("text_md5"))


def recursive_text(spark, sf_dir):
    content = F.to_json(F.struct("text", F.struct(F.col("lang").alias("a"), F.array("source", F.lit("x")).alias("b"), F.col("n_chars").alias("n")).alias("more")))
    held = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return held.select("doc_id", C.all_text(F.col("content")).alias("said")).select("doc_id", F.md5("said").alias("text_md5"))


def tier_fallback(spark, sf_dir):
    lists = written(PR.vector_lists(spark, sf_dir, 10).drop("rank"), "lists").filter(F.col("query_id") != F.col("chunk_id"))
    near = lists.filter("score >= 0.8")
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label"))
    same = lists.filter("score >= 0.5").join(labels.filter("label % 2 = 0"), "chunk_id").select("query_id", "chunk_id", "score")
    return R.tier_fallback([("dense", near), ("variant", same), ("proxy", lists.filter("score >= 0.1"))])


def result_outcome(spark, sf_dir):
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    lists = PR.vector_lists(spark, sf_dir, 10).filter("query_id <> chunk_id and score > 0.2")
    return R.outcome(asked, lists, 0.35, 0.97)


def module_routing(spark, sf_dir):
    modules = spark.createDataFrame(MODULES, "module string, intent string")
    return S.routed(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("intent")), modules, "general").select("o_orderkey", "module")


def intent_collisions(spark, sf_dir):
    """Customers' nations as modules, their segments as intents."""
    return S.collisions(table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("module"), F.col("c_mktsegment").alias("intent")))


def pattern_counts(spark, sf_dir):
    return A.pattern_counts(table(spark, sf_dir, "documents"), "text", PATTERNS)


def consented_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    prefs = events.select("user_id").distinct().withColumn("consent", F.col("user_id") % 3 != 0)
    new = S.consented(events.select("event_id", "user_id"), prefs)
    return S.appended(events.filter("event_id % 10 = 0").select("event_id", "user_id"), new, "event_id")


def stored_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 2).alias("synced"), F.when(F.col("event_id") % 3 > 0, F.to_json(F.array("event_type", F.lit("x")))).alias("tags"))
    return S.mapped_rows(e, ["synced"], ["tags"]).withColumn("tags", F.array_join("tags", ","))


def feedback_records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return S.feedback(e.select(F.col("event_id").alias("chunk_id"), (F.col("user_id") % 5 - 2).cast("int").alias("rating"), (F.col("event_id") % 1000 + 0.5).alias("latency"), F.col("props").alias("query")))


def cleared_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return S.cleared(e, F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id")


def weight_units(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", U.weight_kg(F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, "grams").otherwise("kg")).alias("kg"))


def openers(spark, sf_dir):
    k = F.col("p_partkey") % 5
    intent = F.element_at(F.array(*map(F.lit, ["URGENT", "HEADING_LOOKUP", "DETAIL", "REFERRAL", "SCOPE"])), (k + 1).cast("int"))
    opened = P.opener(intent, F.concat(F.lit("3.2 "), "p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), {"DETAIL": "On {aspect} of {topic}:", "REFERRAL": "When to refer for {topic}:"}, "An overview of {topic}:")
    return table(spark, sf_dir, "part").select("p_partkey", opened.alias("opener"))


def topic_shift(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, F.lower(F.substring("text", 1, 1))).alias("topic"), F.when(F.length("text") % 2 == 0, F.col("turn")).alias("slot"))
    return PS.cleared_on_shift(t, "topic", "slot").select("conv_id", "turn", "shifted", "kept")


def repeat_deflection(spark, sf_dir):
    """Turns as answers of one of two chunks; the same as before is not said again."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(F.substring("text", 1, 1)).alias("answer"), (F.length("text") % 2).alias("chunk"))
    before = lambda c: F.lag(c).over(PS.by_turn())
    held = t.withColumns({"a0": before("answer"), "c0": before("chunk")})
    return held.select("conv_id", "turn", P.deflected_repeat(F.col("answer"), F.col("a0"), F.col("chunk"), F.col("c0"), "As said before.").alias("answer"))


QUERIES = {
    f.__name__: f
    for f in (
        message_checks, input_validation, danger_escalation, rewrite_query, dose_merge, answer_salvage, artifacts, drug_tables, decision_trees, point_lookup, recursive_text, tier_fallback, result_outcome, module_routing, intent_collisions,
        pattern_counts, consented_sessions, stored_rows, feedback_records, cleared_events, weight_units, openers, topic_shift, repeat_deflection,
    )
}

_re, _ww = PU.re2, U.whole_word
_or = lambda column, words: "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"
_begins = lambda words: "(" + " OR ".join(f"(lower(trim(text)) = '{w}' OR starts_with(lower(trim(text)), '{w} '))" for w in words) + ")"
_TEXT = "concat_ws(' ', p_name, CASE p_partkey % 3 WHEN 0 THEN 'for the baby' WHEN 1 THEN 'one/two-three' END)"

ORACLES = {
    "message_checks": f"""WITH t AS (SELECT *, lower(text) AS low, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\\s]', '', 'g'), '\\s+'), lambda w: length(w) >= 2) AS tk,
CASE WHEN turn % 3 = 0 THEN 'Tell me more about it. ' ELSE '' END || text || CASE WHEN turn % 5 = 1 THEN ' Would you like me to go on?' ELSE '' END AS ans FROM conversations)
SELECT conv_id, turn, list_has_any(tk, {PU._list(TURN_WORDS)}) AS clinical, regexp_matches(low, '{_re(_ww(L.PATIENT_WORDS))}') AS patient, regexp_matches(low, '{_re(_ww(L.INFORMATIONAL))}') AS informational,
turn = 0 AND len(string_split_regex(trim(string_split(text, '.')[1]), '\\s+')) < 6 AND NOT contains(lower(string_split(text, '.')[1]), 'the') AS greeting,
{_begins(TRIGGERS)} AND NOT contains(low, 'shre') AND CASE WHEN turn > 2 THEN {_begins(ALWAYS)} ELSE true END AS social, false AS failed,
(turn % 3 = 0 AND len(string_split_regex(trim(ans), '\\s+')) < 60) OR turn % 5 = 1 AS deflects FROM t""",
    "input_validation": f"SELECT p_partkey, regexp_matches(p_brand, '{CODE}') AS code_ok, p_size BETWEEN 3 AND 60 AS weight_ok, p_size % 5 <> 0 OR p_partkey % 3 <> 0 AS has_slot FROM part",
    "danger_escalation": f"SELECT conv_id, turn, CASE WHEN turn <> 4 THEN {PU._case('lower(text)', SIGNS, 'NULL')} END AS sign, CASE {' '.join(f'WHEN {_or("lower(trim(text))", p)} THEN {chr(39)}{n}{chr(39)}' for n, p in FAQS)} END AS faq FROM conversations",
    "rewrite_query": f"""WITH t AS (SELECT p_partkey, p_size, {_TEXT} AS p_name FROM part),
n AS (SELECT t.*, m.normalized FROM t JOIN ({PU._normalize().replace("FROM part", "FROM t")}) m USING (p_partkey)),
a AS (SELECT p_partkey, regexp_replace(normalized || CASE WHEN p_partkey % 4 <> 2 AND p_size % 2 = 0 THEN ' dosage' ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN ' what is overview definition' ELSE '' END || CASE WHEN p_size > 25 THEN ' blue fever' ELSE '' END
|| CASE WHEN p_size % 3 <> 0 AND contains(p_name, ' baby') THEN CASE WHEN p_size < 24 THEN ' infant neonate' ELSE ' child' END ELSE '' END, '[-/]', ' ', 'g') AS x FROM n),
e AS (SELECT p_partkey, {PU._expand('x')} AS y FROM a),
w AS (SELECT p_partkey, string_split_regex(y, '\\s+') AS w, list_transform(string_split_regex(y, '\\s+'), lambda z: regexp_replace(lower(z), '[^a-z0-9_]', '', 'g')) AS b FROM e)
SELECT p_partkey, array_to_string(list_filter(w, lambda z, i: b[i] <> '' AND list_position(b, b[i]) = i), ' ') AS rewritten FROM w""",
    "dose_merge": """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS a, CASE WHEN p_size > 10 THEN p_brand END AS d, p_partkey % 3 AS k, p_size FROM part)
SELECT p_partkey, CASE WHEN d IS NULL THEN a WHEN k = 0 OR a IS NULL THEN d WHEN k = 1 OR p_size % 2 = 0 THEN a || chr(10) || chr(10) || d ELSE a END AS answer FROM t""",
    "answer_salvage": f"SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN trim(p_name) ELSE '{P.REFUSAL}' END AS answer FROM part",
    "artifacts": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS title, 'FMOH' AS publisher, CAST(2024 AS INT) AS year, CASE p_partkey % 3 WHEN 0 THEN 'name' ELSE 'title,name' END || CASE WHEN p_size % 2 = 0 THEN ',route' ELSE '' END AS topics FROM part WHERE p_partkey % 3 <> 1",
    "drug_tables": "SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_size % 2 = 0 THEN 'iv' ELSE 'oral' END AS route, 'tablet' AS form, 'once daily' AS frequency, '5 days' AS duration, p_size || ':' || 2 * p_size || ':' || p_brand AS ranges, p_type AS document FROM part WHERE p_partkey % 3 = 1",
    "decision_trees": """SELECT r_regionkey AS id, r_name AS name, first_value(n_name) OVER (PARTITION BY r_regionkey ORDER BY n_name) AS entry, n_name AS node, CASE WHEN n_nationkey % 2 = 1 THEN 'action' ELSE 'branch' END AS node_type, 'Is it ' || n_name || '?' AS question, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 0 END AS INT) AS n_options FROM region JOIN nation ON n_regionkey = r_regionkey""",
    "point_lookup": "SELECT doc_id, source, md5(text) AS text_md5 FROM documents WHERE doc_id % 50 = 0",
    "recursive_text": "SELECT doc_id, md5(text || ' ' || concat_ws(' ', lang, source, 'x') || ' ') AS text_md5 FROM documents",
    "tier_fallback": f"""WITH {PR.COS}, l AS (SELECT query_id, chunk_id, score FROM cr WHERE rank <= 10 AND query_id <> chunk_id),
a AS (SELECT *, 0 AS o, 'dense' AS tier FROM l WHERE score >= 0.8 UNION ALL SELECT l.*, 1, 'variant' FROM l JOIN embeddings ON vec_id = chunk_id WHERE score >= 0.5 AND label % 2 = 0 UNION ALL SELECT *, 2, 'proxy' FROM l WHERE score >= 0.1)
SELECT query_id, chunk_id, score, tier FROM (SELECT *, min(o) OVER (PARTITION BY query_id) AS f FROM a) WHERE o = f""",
    "result_outcome": f"""WITH {PR.COS}, l AS (SELECT query_id, chunk_id, score FROM cr WHERE rank <= 10 AND query_id <> chunk_id AND score > 0.2),
b AS (SELECT query_id, max(score) AS best, arg_min(chunk_id, (-score, chunk_id)) AS top FROM l GROUP BY query_id), n AS (SELECT query_id, any_value(best) AS best, any_value(top) AS top, count(*) FILTER (score >= CAST(0.97 AS DOUBLE) * best) AS n FROM l JOIN b USING (query_id) GROUP BY query_id),
o AS (SELECT vec_id AS query_id, coalesce(n, 0) AS n_close, top, CASE WHEN best IS NULL THEN 'none' WHEN best < 0.35 THEN 'fallback' WHEN n > 1 THEN 'choose' ELSE 'answer' END AS outcome FROM embeddings LEFT JOIN n ON query_id = vec_id WHERE vec_id % 50 = 0)
SELECT query_id, outcome, n_close, CASE WHEN outcome IN ('answer', 'choose') THEN top END AS chunk_id FROM o""",
    "module_routing": "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'core' WHEN o_orderpriority = '3-MEDIUM' THEN 'extra' ELSE 'general' END AS module FROM orders",
    "intent_collisions": """SELECT 'module' AS kind, CAST(c_nationkey AS VARCHAR) AS value, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > count(DISTINCT c_mktsegment)
UNION ALL SELECT 'intent', c_mktsegment, count(DISTINCT c_nationkey) FROM customer GROUP BY c_mktsegment HAVING count(DISTINCT c_nationkey) > 1""",
    "pattern_counts": "SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS {n}" for n, p in PATTERNS.items()) + ", count(*) FILTER (NOT (" + " OR ".join(f"regexp_matches(text, '{p}')" for p in PATTERNS.values()) + ")) AS none FROM documents",
    "consented_sessions": "SELECT event_id, user_id FROM events WHERE event_id % 10 = 0 OR user_id % 3 <> 0",
    "stored_rows": "SELECT event_id, event_id % 2 = 1 AS synced, CASE WHEN event_id % 3 > 0 THEN event_type || ',x' ELSE '' END AS tags FROM events",
    "feedback_records": "SELECT event_id AS chunk_id, CAST(user_id % 5 - 2 AS INT) AS rating, event_id % 1000 + 1 AS latency_ms, sha256(props) AS query_sha256 FROM events WHERE user_id % 5 BETWEEN 1 AND 3",
    "weight_units": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) / 1000 ELSE CAST(p_size AS DOUBLE) END AS kg FROM part",
    "openers": "SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'An overview of ' || p_name || ':' WHEN 2 THEN 'On ' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || ' of ' || p_name || ':' WHEN 3 THEN 'When to refer for ' || p_name || ':' ELSE '' END AS opener FROM part",
    "topic_shift": """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN lower(substr(text, 1, 1)) END AS topic, CASE WHEN length(text) % 2 = 0 THEN turn END AS slot FROM conversations),
s AS (SELECT *, coalesce(topic <> last_value(topic IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS shifted FROM t),
p AS (SELECT *, sum(CAST(shifted AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM s)
SELECT conv_id, turn, shifted, last_value(slot IGNORE NULLS) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM p""",
    "repeat_deflection": """WITH t AS (SELECT conv_id, turn, lower(substr(text, 1, 1)) AS answer, length(text) % 2 AS chunk FROM conversations)
SELECT conv_id, turn, CASE WHEN coalesce(chunk = lag(chunk) OVER w AND answer = lag(answer) OVER w, false) THEN 'As said before.' ELSE answer END AS answer FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "cleared_events": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'",
}
