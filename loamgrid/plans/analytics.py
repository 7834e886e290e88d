"""Events, sessions, sync, profiles, doses, topics and conversation state over the given tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from loamgrid.functions import understanding as U
from loamgrid.operators import analytics as A
from loamgrid.operators import decide as D
from loamgrid.operators import many_lists as L
from loamgrid.operators import retrieval as R
from loamgrid.operators import sessions as S
from loamgrid.plans.retrieval import table
from loamgrid.plans.understanding import CATEGORIES
from loamgrid.shared import written
from loamgrid.sources import bundle as B

DOSES = [(1, 5.0, 15.0, "1 tablet"), (2, 15.0, 25.0, "2 tablets"), (3, 25.0, 35.0, "3 tablets"), (4, 35.0, None, "4 tablets")]
WARNINGS = [(1, None, 2, "refer newborn"), (2, 3, 6, "half dose")]
GROUPS = [("1-URGENT", "critical"), ("2-HIGH", "critical"), ("3-MEDIUM", "routine"), ("5-LOW", "routine")]
TOPICS = [(1, "the of"), (2, "erth"), (3, "and"), (4, "tion"), (5, "de la"), (6, "der")]
MOODS = [("panic", "was"), ("confused", "erst"), ("affirm", "ly")]
TREE = [(1, "yes", 2), (1, "no", 3), (2, "yes", 4), (2, "no", 5), (3, "yes", 6)]


def event_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), (F.col("event_id") % 3 == 0).alias("synced"), (F.col("event_id") % 2).cast("int").alias("attempts"))


def event_build(spark, sf_dir):
    return A.build_events(table(spark, sf_dir, "events"), "salt")


def session_build(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return A.sessions(e.select(F.col("user_id").alias("session"), "ts", F.col("event_type").alias("topic"))).withColumn("lasted", A.duration_text(F.col("seconds"))).drop("started")


def fifo_batch(spark, sf_dir):
    return A.next_batch(event_rows(spark, sf_dir), 500).select("id", "attempts")


def ack_prefix(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    return A.acknowledge(rows, A.next_batch(rows, 500), 120).select("id", "synced", "attempts")


def sync_summary(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    return A.sync_summary(A.acknowledge(rows, A.next_batch(rows, 500), 120))


def throttle_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    reports = e.select(F.col("event_type").alias("kind"), "ts", F.col("event_id").alias("id"))
    return A.throttled(reports, 3600).select("kind", "id")


def query_log_ring(spark, sf_dir):
    return A.ring(table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("id"), "event_type")).select("id", "event_type")


def quality_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    present = [F.when(F.col("text").rlike(p), F.lit(name)) for name, p in (("license", "[Ll]icen[sc]e"), ("secret", "token ="), ("digits", "[0-9]{4}"), ("list", "\\|"))]
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.array_compact(F.array(*present)).alias("aspects"))
    labels = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("src"), F.col("quality").alias("dst"))
    return A.bundle_report(chunks, labels)


def dataset_stats(spark, sf_dir):
    return A.text_profile(table(spark, sf_dir, "documents"), "text")


def value_counts_pct(spark, sf_dir):
    return A.value_counts(table(spark, sf_dir, "documents"), "source")


def top_categories(spark, sf_dir):
    return A.value_counts(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), "o_orderpriority", 10)


def domain_rollup(spark, sf_dir):
    return A.rollup_groups(table(spark, sf_dir, "orders"), "o_orderpriority", spark.createDataFrame(GROUPS, "value string, grp string"))


def dq_checks(spark, sf_dir):
    return A.quality_checks(table(spark, sf_dir, "documents"), "doc_id", {"lang": ["en", "fr", "de", "es"]}, ["text", "source"])


def category_sample(spark, sf_dir):
    return A.sample_per_category(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 3).select("o_orderkey", "o_orderpriority")


def scorecard(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return D.scorecard(labels.select("lang", (F.col("quality") == 1).alias("found"), (F.length("text") > 500).alias("has"), (F.col("toxic") == 0).alias("clean")), "lang")


def _people(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("weight_kg"), (F.col("p_partkey") % 12).cast("int").alias("age_months"))


def dose_bracket(spark, sf_dir):
    rules = spark.createDataFrame(DOSES, "ord int, min_kg double, max_kg double, dose string")
    return D.brackets(_people(spark, sf_dir), rules, "weight_kg", "min_kg", "max_kg").drop("ord")


def age_override(spark, sf_dir):
    doses = spark.createDataFrame(DOSES, "ord int, min_kg double, max_kg double, dose string")
    warnings = spark.createDataFrame(WARNINGS, "ord int, min_months int, max_months int, warning string")
    return D.dose(_people(spark, sf_dir), doses, warnings).select("p_partkey", "advice")


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", U.sentiment(F.col("text"), MOODS).alias("mood"), U.category(F.col("text"), CATEGORIES[:0] + [("la", "la "), ("the", "the "), ("der", "der ")]).alias("topic"))


def sentiment_mode3(spark, sf_dir):
    return S.mode_of_recent(_turns(spark, sf_dir), "mood").select("conv_id", "turn", "dominant")


def turn_buffer8(spark, sf_dir):
    out = S.turn_buffer(_turns(spark, sf_dir), "mood")
    return out.select("conv_id", "turn", F.array_join("buffer", ",").alias("buffer"), "before", "n_turns")


def topic_stack(spark, sf_dir):
    return S.topic_stack(_turns(spark, sf_dir), "topic").select("conv_id", "turn", F.array_join("stack", ",").alias("stack"))


def slot_ttl(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("said", F.when(F.col("mood") == "panic", F.col("turn")))
    return t.select("conv_id", "turn", S.slot_with_ttl(F.col("said"), 2).alias("slot"))


def _topics(spark):
    return spark.createDataFrame(TOPICS, "ord int, topic string")


def topic_cascade(spark, sf_dir):
    q = _turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"), F.col("topic").alias("chunk_topic"), (F.col("turn") / 8).alias("score"), F.when(F.col("turn") > 0, F.col("mood")).alias("current_topic"))
    return D.topic_cascade(q, _topics(spark))


def drift(spark, sf_dir):
    before = F.lag("text").over(S.by_turn())
    t = _turns(spark, sf_dir).withColumn("before", before)
    return t.select("conv_id", "turn", D.drift(F.col("text"), F.col("before"), F.array("topic")).alias("drifted"))


def gap_detect(spark, sf_dir):
    t = _turns(spark, sf_dir)
    needed = t.select(F.col("conv_id").alias("query_id"), F.explode(F.split(F.lit("dosage,referral,treatment,costs,storage,danger_signs"), ",")).alias("aspect")).distinct()
    covered = t.select(F.col("conv_id").alias("query_id"), F.element_at(F.array(*map(F.lit, ["dosage", "treatment", "costs", "none"])), (F.col("turn") % 4 + 1).cast("int")).alias("aspect"))
    return D.gaps(needed, covered)


def fallback_topic(spark, sf_dir):
    q = _turns(spark, sf_dir).filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return R.fallback_topic(q, [topic for _, topic in sorted(TOPICS)], ["the", "and"])


def answer_select(spark, sf_dir):
    t = _turns(spark, sf_dir)
    intent = F.when(F.col("mood") == "panic", "DETAIL").when(F.col("mood") == "affirm", "REFERRAL").otherwise("CLINICAL")
    part = lambda k: F.nullif(F.get(F.split("text", "\\."), k), F.lit(""))
    chosen = D.answer_field(F.col("intent"), {"DETAIL": [part(2), part(0)], "REFERRAL": [part(3), F.lit("Refer if in doubt.")]}, [part(0), F.lit("No answer.")])
    return t.withColumn("intent", intent).select("conv_id", "turn", chosen.alias("answer"))


def generation_decision(spark, sf_dir):
    t = _turns(spark, sf_dir)
    tier = F.when(F.col("turn") > 5, "LOW").otherwise("HIGH")
    return t.select("conv_id", "turn", D.generation(tier, U.word_count(F.col("text")), F.size(F.split("text", "\n")), F.contains(F.col("text"), F.lit("|"))).alias("decision"))


def golden_set(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a = docs.select("doc_id", F.col("text").alias("answer"), F.array(F.substring_index("text", "\n", 1), F.element_at(F.array(F.lit("the"), F.lit("der"), F.lit("la")), (F.col("doc_id") % 3 + 1).cast("int"))).alias("facts"), F.when(F.col("doc_id") % 4 == 0, "").otherwise("some").alias("evidence"))
    return D.golden(a).select("doc_id", "correct")


def chips(spark, sf_dir):
    """Follow-ups of a turn: what is missing first, then the topics before; three at most."""
    stack = S.topic_stack(_turns(spark, sf_dir), "topic")
    missing = F.when(F.col("mood") == "panic", F.array(F.lit("What should I do now?"))).otherwise(F.array(F.lit("Tell me more")))
    return stack.select("conv_id", "turn", F.array_join(F.slice(F.array_distinct(F.concat(missing, F.transform("stack", lambda t: F.concat(F.lit("About "), t)))), 1, 3), "; ").alias("chips"))


def tree_walk(spark, sf_dir):
    """Paths from region through nation to the number of customers there, and what each says on the way."""
    for name in ("region", "nation", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"lg_{name}")
    return spark.sql(
        """WITH RECURSIVE edges AS (SELECT concat('r', r_regionkey) src, concat('n', n_nationkey) dst, n_name label FROM lg_region JOIN lg_nation ON n_regionkey = r_regionkey
        UNION ALL SELECT concat('n', c_nationkey), concat('s', c_nationkey, c_mktsegment), c_mktsegment FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM lg_customer)),
        walk(node, path, depth) AS (SELECT concat('r', r_regionkey), r_name, 0 FROM lg_region UNION ALL SELECT dst, concat(path, ' > ', label), depth + 1 FROM walk JOIN edges ON src = node)
        SELECT node, path, depth FROM walk"""
    )


def session_replay(spark, sf_dir):
    """Every conversation answered turn by turn from the documents, never the same one twice while there is another."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    asked = turns.select("conv_id", place.cast("long").alias("turn"), F.col("text").alias("query")).withColumns({"query_id": F.monotonically_increasing_id(), "depth": F.col("turn") + 1})
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = written(asked, "asked")
    # At most n documents are served before place n, so n + 1 of its list are enough.
    lists = L.many_lists(asked, docs, "depth").select("query_id", "chunk_id", "score")
    return S.replay(asked.select("conv_id", "turn", "query_id"), lists, None, None)


def bundle_scan(spark, sf_dir):
    """Every document as a zipped bundle of its own, with a good chunk, one without content and a line that isn't JSON; opened again and read by the chunk scan, which drops the last two."""
    chunk = lambda content: F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("faq").alias("type"), content.alias("content"), F.array("source").alias("aspects")), {"ignoreNullFields": "false"})
    lines = F.concat_ws("\n", chunk(F.struct(F.struct(F.col("text").alias("answer")).alias("en"))), F.lit("not json"), chunk(F.lit(None).cast("struct<en:string>")))

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((path.as_py(), B.zipped([("content/chunks.jsonl", text.as_buffer().to_pybytes())])) for batch in batches for path, text in zip(batch["path"], batch["text"], strict=True))
        return B.in_batches(rows, ["path", "content"])

    bundles = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), lines.alias("text")).mapInArrow(zipped, "path string, content binary")
    found = B.chunks(B.unzipped(bundles))
    return found.select(F.col("id").cast("long").alias("doc_id"), F.length(F.get_json_object("content", "$.en.answer")).cast("long").alias("n_chars"), F.get("aspects", 0).alias("aspect"))


QUERIES = {
    f.__name__: f
    for f in (
        event_build, session_build, fifo_batch, ack_prefix, sync_summary, throttle_errors, query_log_ring, quality_report, dataset_stats, value_counts_pct, top_categories, domain_rollup, dq_checks, category_sample, scorecard,
        dose_bracket, age_override, sentiment_mode3, turn_buffer8, topic_stack, slot_ttl, topic_cascade, drift, gap_detect, fallback_topic, answer_select, generation_decision, golden_set, chips, tree_walk, session_replay, bundle_scan,
    )
}

_ROWS = "e AS (SELECT event_id AS id, ts AS created_at, event_id % 3 = 0 AS synced, event_id % 2 AS attempts FROM events), b AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS place FROM (SELECT * FROM e WHERE NOT synced ORDER BY created_at, id LIMIT 500))"
_ACK = f"WITH {_ROWS}, a AS (SELECT id, synced OR coalesce(place <= 120, false) AS synced, CAST(attempts + CASE WHEN place > 120 THEN 1 ELSE 0 END AS INT) AS attempts FROM e LEFT JOIN b USING (id))"
_MOOD = "CASE WHEN regexp_matches(lower(trim(text)), 'was') THEN 'panic' WHEN regexp_matches(lower(trim(text)), 'erst') THEN 'confused' WHEN regexp_matches(lower(trim(text)), 'ly') THEN 'affirm' ELSE 'calm' END"
_TOPIC = "CASE WHEN contains(lower(text), 'la ') THEN 'la' WHEN contains(lower(text), 'the ') THEN 'the' WHEN contains(lower(text), 'der ') THEN 'der' ELSE 'general' END"
_T = f"t AS (SELECT conv_id, turn, role, text, {_MOOD} AS mood, {_TOPIC} AS topic FROM conversations)"
_TOK = "list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: length(w) >= {1})"
_TV = ", ".join(f"({o}, '{t}')" for o, t in TOPICS)
_STACK = f"WITH {_T}, c AS (SELECT *, CASE WHEN lag(topic) OVER w IS NULL OR lag(topic) OVER w <> topic THEN topic END AS ch FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), k AS (SELECT *, list_slice(list_reverse(list(ch) FILTER (ch IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn)), 1, 5) AS stack FROM c)"

ORACLES = {
    "bundle_scan": "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, source AS aspect FROM documents",
    "event_build": "SELECT event_id, sha256(CAST(user_id AS VARCHAR) || 'salt') AS user_hash, event_type, len(string_split_regex(trim(props), '\\s+')) AS n_words, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "session_build": """WITH s AS (SELECT user_id AS session, CAST(floor((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000) AS BIGINT) AS seconds, count(*) AS messages, count(DISTINCT event_type) AS topics FROM events GROUP BY user_id)
SELECT *, CASE WHEN seconds < 60 THEN CAST(seconds AS VARCHAR) || 's' ELSE CAST(seconds // 60 AS VARCHAR) || 'm ' || CAST(seconds % 60 AS VARCHAR) || 's' END AS lasted FROM s""",
    "fifo_batch": "SELECT event_id AS id, CAST(event_id % 2 AS INT) AS attempts FROM events WHERE event_id % 3 <> 0 ORDER BY ts, event_id LIMIT 500",
    "ack_prefix": _ACK + " SELECT * FROM a",
    "sync_summary": _ACK + " SELECT count(*) AS total, count(*) FILTER (NOT synced) AS unsynced, CAST(sum(attempts) AS BIGINT) AS attempts, round(count(*) FILTER (synced) / count(*), 6) AS success_rate FROM a",
    "throttle_errors": """WITH RECURSIVE r AS (SELECT event_type AS kind, epoch_us(ts) AS t, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT kind, t, id, n, t AS last, true AS ok FROM r WHERE n = 1 UNION ALL SELECT r.kind, r.t, r.id, r.n, CASE WHEN r.t - w.last >= 3600000000 THEN r.t ELSE w.last END, r.t - w.last >= 3600000000 FROM w JOIN r ON r.kind = w.kind AND r.n = w.n + 1)
SELECT kind, id FROM w WHERE ok""",
    "query_log_ring": "SELECT event_id AS id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "quality_report": """WITH c AS (SELECT CAST(regexp_matches(text, '[Ll]icen[sc]e') AS INT) + CAST(contains(text, 'token =') AS INT) + CAST(regexp_matches(text, '[0-9]{4}') AS INT) + CAST(contains(text, '|') AS INT) AS n FROM documents), e AS (SELECT count(*) AS edges FROM labels WHERE toxic = 1),
a AS (SELECT count(*) AS chunks, count(*) FILTER (n = 0) AS none, count(*) FILTER (n = 1) AS one, count(*) FILTER (n >= 3) AS three_up FROM c) SELECT *, round(edges / chunks, 6) AS mean_edges FROM a, e""",
    "dataset_stats": """WITH t AS (SELECT text, length(text) AS c, len(string_split_regex(trim(text), '\\s+')) AS w FROM documents)
SELECT count(*) AS n, count(DISTINCT text) AS distinct_texts, round(avg(c), 4) AS mean_chars, round(median(c), 4) AS median_chars, min(c) AS min_chars, max(c) AS max_chars, round(avg(w), 4) AS mean_words, round(median(w), 4) AS median_words, min(w) AS min_words, max(w) AS max_words FROM t""",
    "value_counts_pct": "SELECT source AS value, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM documents), 4) AS percent FROM documents GROUP BY source",
    "top_categories": "SELECT o_orderpriority AS value, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'), 4) AS percent FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY n DESC, value LIMIT 10",
    "domain_rollup": "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'critical' WHEN '3-MEDIUM' THEN 'routine' WHEN '5-LOW' THEN 'routine' ELSE 'other' END AS grp, count(*) AS n, count(DISTINCT o_orderpriority) AS n_values FROM orders GROUP BY 1",
    "dq_checks": "SELECT CAST(count(*) FILTER (doc_id IS NULL) + count(*) FILTER (text IS NULL) + count(*) FILTER (lang IS NULL) + count(*) FILTER (source IS NULL) + count(*) FILTER (n_chars IS NULL) AS BIGINT) AS nulls, count(doc_id) = count(DISTINCT doc_id) AS key_unique, bool_and(lang IN ('en', 'fr', 'de', 'es')) AS lang_in_domain, bool_and(trim(text) <> '') AS text_not_empty, bool_and(trim(source) <> '') AS source_not_empty FROM documents",
    "category_sample": "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k FROM orders) WHERE k <= 3",
    "scorecard": "SELECT lang, count(*) AS cases, round(avg(CAST(quality = 1 AS INT) + CAST(length(text) > 500 AS INT) + CAST(toxic = 0 AS INT)), 6) AS points FROM labels JOIN documents USING (doc_id) GROUP BY lang",
    "dose_bracket": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS weight_kg, CAST(p_partkey % 12 AS INT) AS age_months, CASE WHEN p_size BETWEEN 5 AND 15 THEN '1 tablet' WHEN p_size BETWEEN 15 AND 25 THEN '2 tablets' WHEN p_size BETWEEN 25 AND 35 THEN '3 tablets' WHEN p_size >= 35 THEN '4 tablets' END AS dose FROM part",
    "age_override": "SELECT p_partkey, CASE WHEN p_partkey % 12 <= 2 THEN 'refer newborn' WHEN p_partkey % 12 BETWEEN 3 AND 6 THEN 'half dose' WHEN p_size BETWEEN 5 AND 15 THEN '1 tablet' WHEN p_size BETWEEN 15 AND 25 THEN '2 tablets' WHEN p_size BETWEEN 25 AND 35 THEN '3 tablets' WHEN p_size >= 35 THEN '4 tablets' ELSE 'See the whole dosing table.' END AS advice FROM part",
    "sentiment_mode3": f"""WITH {_T}, r AS (SELECT conv_id, turn, list(mood) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM t)
SELECT conv_id, turn, CASE WHEN len(m) = 3 AND m[2] = m[3] THEN m[2] ELSE m[1] END AS dominant FROM r""",
    "turn_buffer8": f"WITH {_T} SELECT conv_id, turn, array_to_string(list(mood) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), ',') AS buffer, lag(mood) OVER (PARTITION BY conv_id ORDER BY turn) AS before, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS n_turns FROM t",
    "topic_stack": _STACK + " SELECT conv_id, turn, array_to_string(stack, ',') AS stack FROM k",
    "slot_ttl": f"WITH {_T}, s AS (SELECT conv_id, turn, max(CASE WHEN mood = 'panic' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM t) SELECT conv_id, turn, CASE WHEN turn - last <= 2 THEN last END AS slot FROM s",
    "topic_cascade": f"""WITH {_T}, q AS (SELECT conv_id * 1000 + turn AS query_id, lower(text) AS low, {_TOK.format("text", 2)} AS qt, topic, turn / 8 AS score, CASE WHEN turn > 0 THEN mood END AS cur FROM t),
p AS (SELECT ord, topic AS name, {_TOK.format("topic", 2)} AS tt FROM (VALUES {_TV}) v(ord, topic)),
n AS (SELECT query_id, arg_min(name, ord) AS named FROM q JOIN p ON contains(low, lower(name)) OR (len(tt) > 0 AND list_has_all(qt, tt)) GROUP BY query_id)
SELECT query_id, coalesce(named, CASE WHEN list_has_any(qt, {_TOK.format("topic", 2)}) OR score > 0.6 OR cur IS NULL THEN topic END, cur) AS primary_topic FROM q LEFT JOIN n USING (query_id)""",
    "drift": f"""WITH {_T}, b AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t)
SELECT conv_id, turn, CASE WHEN before IS NULL THEN false ELSE NOT list_has_any({_TOK.format("text", 2)}, {_TOK.format("before", 2)}) AND lower(topic) <> lower(before) END AS drifted FROM b""",
    "gap_detect": """WITH n AS (SELECT DISTINCT conv_id AS query_id, unnest(['dosage', 'referral', 'treatment', 'costs', 'storage', 'danger_signs']) AS aspect FROM conversations),
c AS (SELECT conv_id AS query_id, ['dosage', 'treatment', 'costs', 'none'][CAST(turn % 4 + 1 AS INT)] AS aspect FROM conversations),
g AS (SELECT query_id, aspect, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(list_position(['danger_signs', 'treatment', 'dosage', 'referral', 'diagnosis', 'prevention'], aspect), 999), aspect) AS rank FROM n ANTI JOIN c USING (query_id, aspect))
SELECT query_id, aspect, CAST(rank AS INT) AS rank FROM g WHERE rank <= 3""",
    "fallback_topic": f"""WITH q AS (SELECT conv_id * 1000 + turn AS query_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and'))[1] AS word, list_distinct({_TOK.format("text", 2)}) AS qt FROM conversations WHERE role = 'user'),
p AS (SELECT ord, topic, list_distinct({_TOK.format("topic", 2)}) AS tt FROM (VALUES {_TV}) v(ord, topic)),
s AS (SELECT query_id, topic, ord, coalesce(lower(topic) = word, false) AS exact, len(list_intersect(qt, tt)) / (len(qt) + len(tt) - len(list_intersect(qt, tt))) AS alike FROM q, p)
SELECT query_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, alike DESC, ord) AS k FROM s) WHERE k = 1""",
    "answer_select": f"""WITH {_T}, p AS (SELECT *, string_split(text, '.') AS s FROM t) SELECT conv_id, turn, CASE mood WHEN 'panic' THEN coalesce(nullif(s[3], ''), nullif(s[1], '')) WHEN 'affirm' THEN coalesce(nullif(s[4], ''), 'Refer if in doubt.') ELSE coalesce(nullif(s[1], ''), 'No answer.') END AS answer FROM p""",
    "generation_decision": "SELECT conv_id, turn, CASE WHEN turn > 5 THEN 'fallback' WHEN contains(text, '|') THEN 'direct' WHEN len(string_split_regex(trim(text), '\\s+')) > 80 OR len(string_split(text, chr(10))) > 3 THEN 'generate' ELSE 'direct' END AS decision FROM conversations",
    "golden_set": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN regexp_matches(lower(text), 'don''t have|do not have|not available|no information') ELSE contains(lower(text), lower(string_split(text, chr(10))[1])) AND contains(lower(text), ['the', 'der', 'la'][CAST(doc_id % 3 + 1 AS INT)]) END AS correct FROM documents",
    "chips": _STACK + ", x AS (SELECT conv_id, turn, list_concat([CASE WHEN mood = 'panic' THEN 'What should I do now?' ELSE 'Tell me more' END], list_transform(stack, lambda y: 'About ' || y)) AS a FROM k) SELECT conv_id, turn, array_to_string(list_slice(list_filter(a, lambda w, i: list_position(a, w) = i), 1, 3), '; ') AS chips FROM x",
    "tree_walk": """WITH RECURSIVE edges AS (SELECT concat('r', r_regionkey) AS src, concat('n', n_nationkey) AS dst, n_name AS label FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT concat('n', c_nationkey), concat('s', c_nationkey, c_mktsegment), c_mktsegment FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)),
walk(node, path, depth) AS (SELECT concat('r', r_regionkey), r_name, 0 FROM region UNION ALL SELECT dst, concat(path, ' > ', label), depth + 1 FROM walk JOIN edges ON src = node) SELECT node, path, depth FROM walk""",
}
