"""Retrieval queries: benchmark passages over documents, vectors over vectors; queries on vectors are the rows whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.functions import tokens as T
from loamgrid.operators import decide as D
from loamgrid.operators import prefixes as X
from loamgrid.operators import retrieval as R

CLASSES = [("ion", "tion"), ("ion", "sion"), ("ment", "ment"), ("ung", "ung"), ("license", "licen.*apache"), ("ble", "ble")]
GENERIC = "the|der|les"
TYPES = ["en", "fr", "de"]
ROUTES = [("r1", "ing\\s+the", "the", 10.0), ("r2", "tion\\s+(of|and)", "of", 8.0), ("r3", "(^|\\s)(que|der)(\\s|$)", "de", 0.1)]
FAQS = [(1, 1, "red"), (1, 2, "widget"), (2, 1, "blue"), (2, 1, "green"), (2, 2, "gear"), (2, 2, "gadgets"), (3, 1, "bolt"), (4, 1, "small widget"), (4, 2, "bolts")]

TOK = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9_\s]', '', 'g'), '\s+'), lambda t: length(t) >= 2)"
BM25 = rf"""q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS n FROM (SELECT query_id, unnest({TOK.format("query")}) AS term FROM q) GROUP BY ALL),
d AS (SELECT doc_id AS chunk_id, {TOK.format("text")} AS tk FROM documents),
st AS (SELECT count(*) AS chunks, avg(len(tk)) AS mean FROM d),
tf AS (SELECT chunk_id, term, sz, count(*) AS tf FROM (SELECT chunk_id, len(tk) AS sz, unnest(tk) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
post AS (SELECT term, chunk_id, ln(1 + (chunks - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sz / mean)) AS score FROM tf JOIN df USING (term), st),
bm AS (SELECT query_id, chunk_id, round(sum(score * n), 6) AS score FROM qt JOIN post USING (term) GROUP BY ALL)"""
ROW = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)"
COS = f"""e AS (SELECT vec_id, embedding AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings),
cs AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (a.n * b.n + 1e-10), 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0),
cr AS (SELECT *, {ROW} AS rank FROM cs)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def word_lists(spark: SparkSession, sf_dir: str, k: int, **how) -> DataFrame:
    return R.word_lists(passages(spark, sf_dir), chunks(spark, sf_dir), k, **how)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def vector_lists(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    v = vectors(spark, sf_dir)
    asked = v.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    return R.cosine_lists(asked, v, k)


def bm25_topk(spark, sf_dir):
    return word_lists(spark, sf_dir, 10)


def bm25_anchor(spark, sf_dir):
    return word_lists(spark, sf_dir, 10, anchored=True)


def class_boost(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("type"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))
    rules = spark.createDataFrame(CLASSES, "class string, term string")
    return R.class_boost(word_lists(spark, sf_dir, 20).drop("rank"), passages(spark, sf_dir), docs, rules, GENERIC, TYPES)


def cosine_topk(spark, sf_dir):
    return vector_lists(spark, sf_dir)


def variant_max(spark, sf_dir):
    v = vectors(spark, sf_dir)
    asked = v.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    owned = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("long").alias("label"))
    return R.cosine_lists(asked, owned, 10, owner="label")


def proxy_jaccard(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return R.best_proxy(turns, passages(spark, sf_dir).withColumnsRenamed({"query_id": "proxy_id", "query": "pattern"}), least=0.05)


def vector_gate(spark, sf_dir):
    return R.vector_gate(vector_lists(spark, sf_dir))


def _policy(spark, sf_dir):
    """Item n of the benchmark goes with the vector query 50 n; either may lack the other."""
    v = vector_lists(spark, sf_dir).withColumn("query_id", (F.col("query_id") / 50).cast("long"))
    return R.gate_policy(word_lists(spark, sf_dir, 10), v)


def confidence_floor(spark, sf_dir):
    return _policy(spark, sf_dir)


def confidence_tier(spark, sf_dir):
    return D.with_confidence(_policy(spark, sf_dir).select("query_id", "vector_top", "margin", "bm25_top", (~F.col("confident")).alias("gate_fired")))


def rrf_fusion(spark, sf_dir):
    return R.rrf(*R.several_word_lists(passages(spark, sf_dir), chunks(spark, sf_dir), 20, [{"shared": False}, {"shared": True}]))


def _graph(spark, sf_dir):
    lists = vector_lists(spark, sf_dir, 15)
    edges = lists.select(F.col("query_id").alias("src"), F.col("chunk_id").alias("dst"), F.col("rank").alias("ord"), F.col("score").alias("edge_score")).filter("ord > 5")
    last = lists.select("query_id").distinct().withColumn("last_chunk", F.col("query_id"))
    served = lists.filter("rank <= 3 or (query_id % 100 = 0 and rank <= 12) or query_id % 200 = 0").select("query_id", "chunk_id")
    return lists.filter("rank <= 10").drop("rank"), edges, last, served


def graph_boost(spark, sf_dir):
    lists, edges, last, _ = _graph(spark, sf_dir)
    return R.graph_boost(lists, last, edges)


def dead_end_escape(spark, sf_dir):
    lists, edges, last, served = _graph(spark, sf_dir)
    return R.dead_end_escape(lists, served, last, edges)


def variant_search(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    index = R.variant_index(part.groupBy("p_name").agg(F.min("p_partkey").alias("chunk_id")).select("chunk_id", F.col("p_name").alias("question"), (F.col("chunk_id") % 2 == 0).alias("primary")))
    asked = part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    return X.variant_search(asked, index)


def fuzzy_faq(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    return R.fuzzy_faq(asked, FAQS)


def pattern_routing(spark, sf_dir):
    titled = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.substring_index("text", "\n", 1).alias("title"))
    return R.pattern_routing(word_lists(spark, sf_dir, 20), passages(spark, sf_dir), titled, spark.createDataFrame(ROUTES, "route string, pattern string, hint string, boost double"))


def recall_at_1(spark, sf_dir):
    """Share of passages whose best document holds the whole passage, token by token."""
    docs, q = chunks(spark, sf_dir), passages(spark, sf_dir)
    passage = F.concat(F.lit(" "), F.array_join(T.hybrid_tokens(F.col("query")), " "), F.lit(" "))
    best = word_lists(spark, sf_dir, 1).select("query_id", "chunk_id")
    whole = best.join(q, "query_id").join(docs, "chunk_id")
    hit = F.contains(F.concat(F.lit(" "), F.array_join(T.hybrid_tokens(F.col("text")), " "), F.lit(" ")), passage)
    return whole.agg(F.count(F.lit(1)).alias("queries"), F.sum(hit.cast("long")).alias("hits"), F.round(F.avg(hit.cast("int")), 6).alias("recall"))


_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)

_POLICY = f"""WITH {BM25}, {COS},
w AS (SELECT query_id, max(score) AS bm25_top FROM bm GROUP BY query_id),
g AS (SELECT query_id, max(score) FILTER (rank = 1) AS top, max(score) FILTER (rank = 2) AS second FROM cr WHERE rank <= 2 GROUP BY query_id),
v AS (SELECT query_id // 50 AS query_id, top AS vector_top, CASE WHEN second > 0 THEN round((top - second) / second, 6) END AS margin FROM g),
p AS (SELECT query_id, vector_top, margin, CASE WHEN vector_top IS NOT NULL THEN vector_top >= 0.3 AND coalesce(margin >= 0.1, true) END AS passed, bm25_top FROM w FULL JOIN v USING (query_id)),
u AS (SELECT *, CASE WHEN bm25_top IS NOT NULL THEN coalesce(passed, false) ELSE vector_top IS NOT NULL END AS use_vector FROM p),
f AS (SELECT *, coalesce(bm25_top >= 1.5, false) OR (use_vector AND coalesce(vector_top >= 0.3, false)) AS confident FROM u)
"""
_GRAPH = f"""WITH {COS}, l AS (SELECT query_id, chunk_id, score, rank FROM cr WHERE rank <= 15),
ed AS (SELECT query_id AS src, chunk_id AS dst, rank AS ord, score AS edge_score FROM l WHERE rank > 5),
sv AS (SELECT query_id, chunk_id FROM l WHERE rank <= 3 OR (query_id % 100 = 0 AND rank <= 12) OR query_id % 200 = 0)
"""

QUERIES = {
    f.__name__: f
    for f in (bm25_topk, bm25_anchor, class_boost, cosine_topk, variant_max, proxy_jaccard, vector_gate, confidence_floor, confidence_tier, rrf_fusion, graph_boost, dead_end_escape, variant_search, fuzzy_faq, pattern_routing, recall_at_1)
}

ORACLES = {
    "bm25_topk": f"WITH {BM25} SELECT * FROM (SELECT *, CAST({ROW} AS INT) AS rank FROM bm) WHERE rank <= 10",
    "bm25_anchor": f"""WITH {BM25}, rare AS (SELECT term FROM post GROUP BY term HAVING count(*) <= 5),
an AS (SELECT DISTINCT query_id, chunk_id FROM qt JOIN post USING (term) WHERE term IN (SELECT term FROM rare) AND length(term) >= 4 AND regexp_matches(term, '^[a-z]+$') AND term NOT IN ({", ".join(f"'{w}'" for w in R.ANCHOR_EXCLUSIONS)})),
s AS (SELECT query_id, chunk_id, score * CASE WHEN an.chunk_id IS NOT NULL THEN CAST(1.3 AS DOUBLE) WHEN query_id IN (SELECT query_id FROM an) THEN CAST(0.7 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS score FROM bm LEFT JOIN an USING (query_id, chunk_id))
SELECT * FROM (SELECT *, CAST({ROW} AS INT) AS rank FROM s) WHERE rank <= 10""",
    "class_boost": f"""WITH {BM25}, l AS (SELECT * FROM (SELECT *, {ROW} AS rank FROM bm) WHERE rank <= 20),
r AS (SELECT * FROM (VALUES {_VALUES(CLASSES)}) v(class, term)),
nm AS (SELECT DISTINCT query_id, class FROM q JOIN r ON contains(lower(query), term)),
tx AS (SELECT doc_id AS chunk_id, lang, string_split(text, chr(10))[1] AS title, lower(string_split(text, chr(10))[1] || ' ' || text) AS body FROM documents),
says AS (SELECT DISTINCT chunk_id, class FROM tx JOIN r ON CASE WHEN contains(term, '*') THEN regexp_matches(body, term) ELSE contains(body, term) END WHERE lang IN ('en', 'fr', 'de')),
hit AS (SELECT DISTINCT query_id, chunk_id FROM nm JOIN says USING (class))
SELECT query_id, chunk_id, score * CASE WHEN query_id NOT IN (SELECT query_id FROM nm) OR lang NOT IN ('en', 'fr', 'de') THEN CAST(1 AS DOUBLE) WHEN hit.chunk_id IS NOT NULL THEN CAST(1.4 AS DOUBLE) WHEN regexp_matches(lower(title), '{GENERIC}') THEN CAST(0.6 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS score
FROM l LEFT JOIN hit USING (query_id, chunk_id) JOIN tx USING (chunk_id)""",
    "cosine_topk": f"WITH {COS} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM cr WHERE rank <= 10",
    "variant_max": f"""WITH {COS}, b AS (SELECT query_id, CAST(label AS BIGINT) AS chunk_id, max(score) AS score FROM cs JOIN embeddings ON vec_id = chunk_id WHERE score > 0 GROUP BY ALL)
SELECT * FROM (SELECT *, CAST({ROW} AS INT) AS rank FROM b) WHERE rank <= 10""",
    "proxy_jaccard": f"""WITH t AS (SELECT conv_id * 1000 + turn AS query_id, list_distinct(list_filter({TOK.format("text")}, lambda w: NOT list_contains({T.PROXY_STOP_WORDS}, w))) AS a FROM conversations WHERE role = 'user'),
p AS (SELECT item_id AS proxy_id, list_distinct(list_filter({TOK.format("text")}, lambda w: NOT list_contains({T.PROXY_STOP_WORDS}, w))) AS b FROM benchmark),
j AS (SELECT query_id, proxy_id, round(count(*) / (any_value(len(a)) + any_value(len(b)) - count(*)), 6) AS jaccard FROM (SELECT query_id, a, unnest(a) AS w FROM t) x JOIN (SELECT proxy_id, b, unnest(b) AS w FROM p) y USING (w) GROUP BY query_id, proxy_id)
SELECT query_id, proxy_id, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, proxy_id) AS k FROM j WHERE jaccard >= 0.05) WHERE k = 1""",
    "vector_gate": f"""WITH {COS}, g AS (SELECT query_id, max(score) FILTER (rank = 1) AS top, max(score) FILTER (rank = 2) AS second FROM cr WHERE rank <= 2 GROUP BY query_id),
m AS (SELECT *, CASE WHEN second > 0 THEN round((top - second) / second, 6) END AS margin FROM g) SELECT *, top >= 0.3 AND coalesce(margin >= 0.1, true) AS passed FROM m""",
    "confidence_floor": _POLICY + "SELECT query_id, bm25_top, vector_top, margin, passed, use_vector, confident FROM f",
    "confidence_tier": _POLICY + f""", s AS (SELECT query_id, vector_top, margin, bm25_top, NOT confident AS gate_fired, {D.CONFIDENCE_SQL} AS confidence FROM (SELECT *, NOT confident AS gate_fired FROM f))
SELECT *, CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM s""",
    "rrf_fusion": f"""WITH {BM25}, a AS (SELECT query_id, chunk_id, rank AS rank_a FROM (SELECT *, CAST({ROW} AS INT) AS rank FROM bm) WHERE rank <= 20),
sh AS (SELECT query_id, chunk_id, count(*) AS score FROM qt JOIN tf USING (term) GROUP BY ALL),
b AS (SELECT query_id, chunk_id, rank AS rank_b FROM (SELECT *, CAST({ROW} AS INT) AS rank FROM sh) WHERE rank <= 20)
SELECT query_id, chunk_id, round(coalesce(1.0 / (60 + rank_a), 0) + coalesce(1.0 / (60 + rank_b), 0), 6) AS score, rank_a, rank_b FROM a FULL JOIN b USING (query_id, chunk_id)""",
    "graph_boost": _GRAPH + "SELECT query_id, chunk_id, score + CAST(0.25 AS DOUBLE) * coalesce(edge_score, CAST(0 AS DOUBLE)) AS score, CAST(rank AS INT) AS rank FROM l LEFT JOIN ed ON src = query_id AND dst = chunk_id WHERE rank <= 10",
    "dead_end_escape": _GRAPH
    + """, fr AS (SELECT query_id, min(rank) AS rank FROM l ANTI JOIN sv USING (query_id, chunk_id) WHERE rank <= 10 GROUP BY query_id),
hp AS (SELECT src AS query_id, min(ord) AS rank FROM ed WHERE (src, dst) NOT IN (SELECT (query_id, chunk_id) FROM sv) GROUP BY src)
SELECT query_id, l.chunk_id, l.score, CASE WHEN fr.rank IS NOT NULL THEN 'fresh' WHEN hp.rank IS NOT NULL THEN 'graph' ELSE 'repeat' END AS route
FROM l LEFT JOIN fr USING (query_id) LEFT JOIN hp USING (query_id) WHERE l.rank = coalesce(fr.rank, hp.rank, 1)""",
    "variant_search": f"""WITH i AS (SELECT min(p_partkey) AS chunk_id, p_name AS question FROM part GROUP BY p_name),
k AS (SELECT key, chunk_id, sum(w) AS w FROM (SELECT unnest(list_filter(string_split_regex(lower(trim(question)), '\\s+'), lambda t: length(t) >= 2)) AS key, chunk_id, CASE WHEN chunk_id % 2 = 0 THEN 5 ELSE 2 END AS w FROM i
  UNION ALL SELECT substr(lower(trim(question)), 1, 50), chunk_id, CASE WHEN chunk_id % 2 = 0 THEN 10 ELSE 4 END FROM i) GROUP BY ALL),
t AS (SELECT p_partkey AS query_id, unnest(list_filter(string_split_regex(lower(trim(p_name)), '\\s+'), lambda t: length(t) >= 2)) AS term FROM part WHERE p_partkey % 50 = 0),
s AS (SELECT query_id, chunk_id, CAST(sum(CASE WHEN key = term THEN 3 ELSE 1 END * w) AS BIGINT) AS score FROM t JOIN k ON starts_with(key, term) OR starts_with(term, key) GROUP BY ALL)
SELECT * FROM (SELECT *, CAST({ROW} AS INT) AS rank FROM s) WHERE rank <= 5""",
    "fuzzy_faq": f"""WITH r AS (SELECT * FROM (VALUES {_VALUES(FAQS)}) v(faq_id, grp, keyword)),
t AS (SELECT p_partkey AS query_id, lower(trim(p_name)) AS txt, list_filter(string_split_regex(lower(trim(p_name)), '[\\s,;:—/-]+'), lambda w: length(w) >= 2) AS tk FROM part),
h AS (SELECT query_id, faq_id, grp, max(CASE WHEN contains(keyword, ' ') THEN CAST(contains(txt, keyword) AS INT) ELSE CAST(len(list_filter(tk, lambda w: w = keyword OR (length(w) >= 4 AND length(keyword) >= 4 AND (starts_with(w, keyword) OR starts_with(keyword, w)))
  OR (length(w) >= 5 AND length(keyword) >= 5 AND levenshtein(w, keyword) <= CASE WHEN length(w) >= 7 AND length(keyword) >= 7 THEN 2 ELSE 1 END))) > 0 AS INT) END) AS hit FROM t, r GROUP BY ALL),
f AS (SELECT query_id, faq_id, round(avg(hit), 6) AS fraction FROM h GROUP BY ALL)
SELECT query_id, min(faq_id) AS faq_id, CAST(1 AS DOUBLE) AS fraction FROM f WHERE fraction >= 1 GROUP BY query_id""",
    "pattern_routing": f"""WITH {BM25}, l AS (SELECT * FROM (SELECT *, {ROW} AS rank FROM bm) WHERE rank <= 20),
r AS (SELECT * FROM (VALUES {_VALUES(ROUTES)}) v(route, pattern, hint, boost)),
a AS (SELECT DISTINCT query_id, route FROM q JOIN r ON regexp_matches(lower(query), pattern)),
h AS (SELECT doc_id AS chunk_id, route, boost FROM documents JOIN r ON contains(lower(CAST(doc_id AS VARCHAR) || ' ' || string_split(text, chr(10))[1]), hint)),
x AS (SELECT query_id, chunk_id, exp(sum(ln(boost))) AS factor FROM a JOIN h USING (route) GROUP BY ALL)
SELECT query_id, chunk_id, round(score * coalesce(factor, 1.0), 4) AS score FROM l LEFT JOIN x USING (query_id, chunk_id)""",
    "recall_at_1": f"""WITH {BM25}, b AS (SELECT query_id, chunk_id FROM (SELECT *, {ROW} AS rank FROM bm) WHERE rank = 1),
h AS (SELECT contains(' ' || array_to_string(tk, ' ') || ' ', ' ' || array_to_string({TOK.format("query")}, ' ') || ' ') AS hit FROM b JOIN q USING (query_id) JOIN d USING (chunk_id))
SELECT count(*) AS queries, CAST(sum(CAST(hit AS BIGINT)) AS BIGINT) AS hits, round(avg(CAST(hit AS INT)), 6) AS recall FROM h""",
}
