"""Queries on what is answered and how: rendered chunks, decision trees, closings, neighbours; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import rendering as X
from loamgrid.operators import closings as C
from loamgrid.operators import neighbours as N
from loamgrid.plans.retrieval import table, vectors
from loamgrid.shared import shared_dir

KINDS = [*X.RENDERERS, "note"]


def chunk_table(spark, sf_dir):
    """Documents as chunks of seven types (the last one without a renderer) by doc_id; content is JSON by language, with English where doc_id is no multiple of 5.

    Lines are what a type lists: answers, dose rows, options, steps, inputs.
    """
    line = F.split("text", "\n")
    first, rest = line[0], F.slice(line, 2, 1_000_000)
    told = F.array_join(rest, "\n")
    dose = lambda x, i: F.struct((i + 1).cast("string").alias("weight_range"), x.alias("dose"), F.col("lang").alias("route"), F.split(x, " ")[0].alias("frequency"), F.length(x).cast("string").alias("duration"))
    option = lambda x, i: F.struct(x.alias("label"), F.concat(F.lit("n"), i.cast("string")).alias("next"))
    node = F.struct(F.when(F.col("n_chars") % 3 > 0, first).alias("question"), F.transform(rest, option).alias("options"), F.when(F.col("n_chars") % 3 == 1, told).alias("action"), told.alias("refer"))
    bodies = {
        "faq": F.struct(first.alias("question"), told.alias("answer"), F.when(F.col("n_chars") % 2 == 0, F.col("source")).alias("details")),
        "drug_table": F.struct(first.alias("drug_name"), F.transform(rest, dose).alias("rows"), F.filter(rest, lambda x: F.length(x) > 200).alias("watch_for"), F.filter(rest, lambda x: F.length(x) < 40).alias("refer_if")),
        "decision_tree": F.struct(F.when(F.col("n_chars") % 7 > 0, "start").otherwise("gone").alias("entry_node"), F.create_map(F.lit("start"), node).alias("nodes")),
        "protocol": F.struct(first.alias("title"), rest.alias("steps"), F.when(F.col("n_chars") % 2 == 0, F.col("source")).alias("notes")),
        "danger_sign": F.struct(first.alias("sign"), F.when(F.col("n_chars") % 2 == 0, "emergency").otherwise("urgent").alias("severity"), told.alias("immediate_action"), F.when(F.col("n_chars") % 3 == 0, F.col("lang")).alias("refer_urgency"), F.when(F.col("n_chars") % 5 < 2, F.col("source")).alias("handover_info")),
        "calculator": F.struct(first.alias("title"), F.transform(rest, lambda x: F.struct(x.alias("label"))).alias("inputs"), F.col("source").alias("output_unit")),
        "note": F.struct(F.length("text").alias("size")),
    }
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    body = F.coalesce(*[F.when(kind == name, F.to_json(b)) for name, b in bodies.items()])
    content = F.to_json(F.map_from_arrays(F.array("lang", F.when((F.col("doc_id") % 5 > 0) & (F.col("lang") != "en"), "en").otherwise("xx")), F.array(F.lit("@"), F.lit("@"))))
    # A map of JSON texts would be quoted; the bodies go in as they stand.
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.replace(content, F.lit('"@"'), body).alias("content"))


def render_chunks(spark, sf_dir):
    """Every chunk in French, or English where it has no French."""
    c = chunk_table(spark, sf_dir)
    said = X.rendered(F.col("kind"), F.col("content"), "fr")
    return c.select("doc_id", "kind", F.length(said).alias("n_chars"), F.md5(said).alias("said_md5"))


def tree_outline(spark, sf_dir):
    """Regions as decision trees: nations below, market segments below them, with their customers as actions."""
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    nodes = "map<string, struct<question:string, options:array<struct<label:string, next:string>>, action:string>>"
    leaf = F.struct(F.concat("c_nationkey", F.lit(":"), "c_mktsegment").alias("key"), F.struct(F.lit(None).cast("string").alias("question"), F.array().cast("array<struct<label:string,next:string>>").alias("options"), F.concat("n", F.lit(" customers")).alias("action")).alias("value"))
    below = n.groupBy("c_nationkey").agg(F.collect_list(leaf).alias("leaves"), F.sort_array(F.collect_list(F.struct(F.col("c_mktsegment").alias("label"), F.concat("c_nationkey", F.lit(":"), "c_mktsegment").alias("next")))).alias("segments"))
    nation = table(spark, sf_dir, "nation").join(below, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    asked = F.struct(F.concat(F.lit("Which segment of "), "n_name", F.lit("?")).alias("question"), F.coalesce("segments", F.array().cast("array<struct<label:string,next:string>>")).alias("options"), F.lit(None).cast("string").alias("action"))
    own = F.array(F.struct(F.col("n_nationkey").cast("string").alias("key"), asked.alias("value")))
    own = F.concat(own, F.coalesce(F.col("leaves"), F.slice(own, 1, 0)))
    trees = nation.groupBy("n_regionkey").agg(F.flatten(F.collect_list(own)).alias("nodes"), F.sort_array(F.collect_list(F.struct(F.col("n_name").alias("label"), F.col("n_nationkey").cast("string").alias("next")))).alias("nations"))
    entry = F.array(F.struct(F.lit("start").alias("key"), F.struct(F.concat(F.lit("Where in "), "r_name", F.lit("?")).alias("question"), F.col("nations").alias("options"), F.lit(None).cast("string").alias("action")).alias("value")))
    whole = table(spark, sf_dir, "region").join(trees, F.col("r_regionkey") == F.col("n_regionkey"))
    body = F.to_json(F.struct(F.lit("start").alias("entry_node"), F.map_from_entries(F.concat(entry, F.col("nodes"))).cast(nodes).alias("nodes")))
    return whole.select("r_regionkey", X.tree_outline(body).alias("outline"))


INTENTS = ["DEFINE", "SCOPE", "PROCEDURE", "REFERRAL", "AFFIRM", "DETAIL", "GREETING", "URGENT"]
GAPS = [*C.BY_GAP, "side_effects"]


def closing_lines(spark, sf_dir):
    """Turns whose intent, gaps, topic and patient follow from the lengths of their whole texts, so that lines often meet."""
    n = F.length("text")
    one = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", one(INTENTS, F.when(n % 5 < 4, n % 2 * 2).otherwise(n % len(INTENTS))).alias("intent"),
        F.when(n % 7 < 2, F.array(one(GAPS, F.when(n % 3 > 0, F.lit(0)).otherwise(n % len(GAPS))), F.lit("coverage"))).alias("gaps"), F.when(n % 2 == 0, F.col("role")).alias("topic"), (n % 11 == 0).alias("patient"),
    )
    return C.closings(turns, draw=F.col("turn")).select("conv_id", "turn", "intent", "closing")


def ann_topk(spark, sf_dir):
    """The ten nearest vectors of every vector whose id is divisible by 50, by an inverted file that is stored and read back."""
    v = vectors(spark, sf_dir)
    index = N.build_index(v, f"{shared_dir(spark)}/loamgrid-index-{N.new_name()}")
    return N.nearest(index, v.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), k=10)


QUERIES = {f.__name__: f for f in (render_chunks, tree_outline, closing_lines, ann_topk)}


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(key: str, lines: dict[str, str], other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_sql(k)} THEN {_sql(v)}" for k, v in lines.items()) + f" ELSE {_sql(other)} END"


def _pick(lines: list[str]) -> str:
    return "[" + ", ".join(map(_sql, lines)) + f"][CAST(turn % {len(lines)} + 1 AS INT)]"


_LIST = "array_to_string(list_transform({0}, lambda x, i: {1}), chr(10))"
_NL = "chr(10)"
_RENDER = f"""WITH t AS (SELECT *, string_split(text, chr(10)) AS l, ['{"', '".join(KINDS)}'][CAST(doc_id % {len(KINDS)} + 1 AS INT)] AS kind FROM documents),
p AS (SELECT *, l[1] AS a, l[2:] AS r, array_to_string(l[2:], chr(10)) AS told FROM t),
s AS (SELECT doc_id, kind, CASE WHEN lang NOT IN ('fr', 'en') AND doc_id % 5 = 0 THEN '{X.NO_CONTENT}' ELSE CASE kind
WHEN 'faq' THEN concat_ws({_NL}, nullif(a, ''), CASE WHEN told <> '' THEN {_NL} || told END, CASE WHEN n_chars % 2 = 0 THEN {_NL} || source END)
WHEN 'drug_table' THEN concat_ws({_NL}, a || ' Dosing', '', CASE WHEN len(r) > 0 THEN {_LIST.format("r", "'• ' || i || ': ' || x || ' — ' || lang || ', ' || string_split(x, ' ')[1] || ', for ' || length(x)")} END,
CASE WHEN len(list_filter(r, lambda x: length(x) > 200)) > 0 THEN {_NL} || '{X.WATCH_FOR}' || {_NL} || {_LIST.format("list_filter(r, lambda x: length(x) > 200)", "'  – ' || x")} END,
CASE WHEN len(list_filter(r, lambda x: length(x) < 40)) > 0 THEN {_NL} || '{X.REFER_IF}' || {_NL} || {_LIST.format("list_filter(r, lambda x: length(x) < 40)", "'  – ' || x")} END)
WHEN 'decision_tree' THEN CASE WHEN n_chars % 7 = 0 THEN '{X.NO_TREE}' WHEN n_chars % 3 > 0 AND a <> '' THEN concat_ws({_NL}, a, '', '{X.OPTIONS}', CASE WHEN len(r) > 0 THEN {_LIST.format("r", "i || '. ' || x")} END) WHEN n_chars % 3 = 1 AND told <> '' THEN '{X.ACTION}' || told WHEN told <> '' THEN '{X.REFER}' || told ELSE '' END
WHEN 'protocol' THEN concat_ws({_NL}, a, '', CASE WHEN len(r) > 0 THEN {_LIST.format("r", "i || '. ' || x")} END, CASE WHEN n_chars % 2 = 0 THEN {_NL} || '{X.NOTES}' || source END)
WHEN 'danger_sign' THEN concat_ws({_NL}, CASE WHEN n_chars % 2 = 0 THEN '{X.EMERGENCY}' ELSE '{X.URGENT}' END || ': ' || a, '', '{X.IMMEDIATE}', told, CASE WHEN n_chars % 3 = 0 THEN {_NL} || '{X.REFER_WHEN}' || lang END, CASE WHEN n_chars % 5 < 2 THEN {_NL} || '{X.HANDOVER}' || source END)
WHEN 'calculator' THEN concat_ws({_NL}, '{X.CALCULATE}' || a, '', '{X.ENTER}', CASE WHEN len(r) > 0 THEN {_LIST.format("r", "'• ' || x")} END, '', '{X.RESULT[0]}' || source || '{X.RESULT[1]}')
ELSE '{{"size":' || length(text) || '}}' END END AS said FROM p)
SELECT doc_id, kind, length(said) AS n_chars, md5(said) AS said_md5 FROM s"""

_CLOSING = f"""WITH RECURSIVE t AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
i AS (SELECT *, ['{"', '".join(INTENTS)}'][CAST(CASE WHEN n % 5 < 4 THEN n % 2 * 2 ELSE n % {len(INTENTS)} END + 1 AS INT)] AS intent, CASE WHEN n % 7 < 2 THEN ['{"', '".join(GAPS)}'][CAST(CASE WHEN n % 3 > 0 THEN 0 ELSE n % {len(GAPS)} END + 1 AS INT)] END AS gap FROM t),
c AS (SELECT *, CASE WHEN gap IS NOT NULL THEN {_case("gap", C.BY_GAP, C.OTHER_GAP)} WHEN intent = 'AFFIRM' THEN '{C.AFFIRMED}' WHEN n % 11 = 0 THEN '{C.PATIENT}' ELSE replace({_case("intent", C.BY_INTENT, C.OTHER_INTENT)}, '{{topic}}', CASE WHEN n % 2 = 0 THEN role ELSE 'this' END) END AS own,
CASE WHEN gap IS NOT NULL THEN {_pick(C.GAP_ALTERNATES)} ELSE CASE intent {" ".join(f"WHEN '{k}' THEN {_pick(v)}" for k, v in C.INTENT_ALTERNATES.items())} ELSE {_pick(C.PATIENT_ALTERNATES + C.GENERIC_ALTERNATES)} END END AS alt FROM i),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS k, '' AS intent, '' AS closing, CAST(NULL AS VARCHAR) AS last FROM c WHERE k = 1
UNION ALL SELECT c.conv_id, c.turn, c.k, c.intent, z.said, CASE WHEN c.intent IN ('GREETING', 'URGENT') THEN last ELSE z.said END FROM w JOIN c ON c.conv_id = w.conv_id AND c.k = w.k + 1,
LATERAL (SELECT CASE WHEN c.intent = 'GREETING' THEN '' WHEN c.intent = 'URGENT' THEN '{C.URGENT}' WHEN last IS DISTINCT FROM own THEN own WHEN alt IS DISTINCT FROM last THEN alt ELSE '{C.LAST_RESORT}' END AS said) z)
SELECT conv_id, turn, intent, closing FROM w WHERE k > 0"""

ORACLES = {
    "render_chunks": _RENDER,
    "tree_outline": f"""WITH n AS (SELECT n_regionkey, n_name, '  ' || n_name || ': Which segment of ' || n_name || '?' || coalesce({_NL} || string_agg('    ' || c_mktsegment || ': {X.ACTION}' || k || ' customers', {_NL} ORDER BY c_mktsegment), '') AS said
FROM nation LEFT JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS k FROM customer GROUP BY ALL) ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_name)
SELECT r_regionkey, 'Where in ' || r_name || '?' || {_NL} || string_agg(said, {_NL} ORDER BY n_name) AS outline FROM region JOIN n ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
    "closing_lines": _CLOSING,
}
