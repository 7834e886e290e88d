"""Queries on whole searches, evidence and generated texts; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import evidence as E
from loamgrid.functions import rules as L
from loamgrid.functions import variation as G
from loamgrid.operators import analytics as A
from loamgrid.operators import generate as N
from loamgrid.operators import prefixes as X
from loamgrid.operators import respond as S
from loamgrid.operators import retrieval as R
from loamgrid.plans import retrieval as PR
from loamgrid.plans.retrieval import table
from loamgrid.sources import integrity as I

SLOTS = {"hello": ["Hello", "Abeg", "Good day"], "please": ["please", "pls", "biko"]}
TYPOS = {"the": ["teh", "thee"], "der": ["dre"], "les": ["lse", "ls"], "que": ["qe"]}
WORDS = {"and": ["plus", "come"], "to": ["go"], "un": ["wan", "won"]}


def text_variations(spark, sf_dir):
    """Each turn of a conversation as a template of two to four questions."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("{hello}, "), "text", F.lit(" for {weight}kg {please}?")).alias("template"), F.concat("role", F.lit(": {dose}mg at {weight}kg")).alias("response"))
    return N.generated(t, SLOTS, TYPOS, WORDS, keys=["conv_id", "turn"]).select("conv_id", "turn", "nth", "kind", F.md5("query").alias("query_md5"), "response")


def evidence_text(spark, sf_dir):
    """Documents as chunks: lines are fields, and what is asked of them, whether dosing rules are known, and the weight go by doc_id and lengths."""
    line, n = F.split("text", "\n"), F.col("n_chars")
    rest = F.array_join(F.slice(line, 2, 1_000_000), "\n")
    rules = F.array(F.struct(F.lit("weight").alias("basis"), F.array(F.struct((n % 10).cast("double").alias("min_kg"), F.when(n % 3 > 0, (n % 10 + 5.5)).alias("max_kg"), F.col("source").alias("dose")), F.struct(F.lit(None).cast("double").alias("min_kg"), F.lit(4.0).alias("max_kg"), F.col("lang").alias("dose"))).alias("brackets")))
    fields = F.struct(
        F.when(n % 2 == 0, rest).alias("answer"), F.when(n % 3 == 0, line[0]).alias("definition"), F.when(n % 5 == 0, F.lit("The provided text does not contain it")).alias("coverage"), F.when(n % 4 == 0, rules).alias("dosage_rules"),
        F.when(n % 7 < 3, rest).alias("procedure"), F.when(n % 11 == 0, line[0]).alias("referral"), F.col("source").alias("side_effects"),
    )
    docs = table(spark, sf_dir, "documents")
    intent = F.element_at(F.array(*map(F.lit, [*E.FIELDS, "OTHER"])), (F.col("doc_id") % 6 + 1).cast("int"))
    content = F.to_json(F.struct(fields.alias("en")))
    chunk = docs.select("doc_id", content.alias("content"), intent.alias("intent"), F.when(n % 9 > 0, line[0]).alias("title"), F.array(F.lit("side_effects"), F.lit("answer"), F.lit("none")).alias("aspects"), "source", F.when(n % 2 == 0, rest).alias("answer"), F.when(n % 8 == 0, n).alias("weight"))
    said = E.evidence(F.col("content"), F.col("intent"), F.col("title"), F.col("aspects"), F.col("source"))
    out = chunk.select("doc_id", "intent", said.alias("said"), E.generation(F.col("content"), F.col("answer"), F.col("weight")).alias("g"))
    return out.select("doc_id", "intent", F.length("said").alias("n_chars"), F.md5("said").alias("evidence_md5"), "g.generate", "g.reason")


def respond_record(spark, sf_dir):
    """Passages over documents by words and by vectors of equal numbers: what each search answers, and why."""
    words = PR.word_lists(spark, sf_dir, 10)
    vectors = PR.vector_lists(spark, sf_dir).withColumn("query_id", F.col("query_id") / 50)
    vectors = vectors.select(F.col("query_id").cast("long"), "chunk_id", "score", "rank")
    served = words.filter("(query_id % 2 = 0 and rank <= 3) or query_id % 4 = 0").select("query_id", "chunk_id").unionByName(vectors.filter("query_id % 4 = 0").select("query_id", "chunk_id"))
    edges = vectors.filter("rank > 5").select(F.col("query_id").alias("src"), F.col("chunk_id").alias("dst"), F.col("rank").alias("ord"), F.col("score").alias("edge_score"))
    edges = edges.unionByName(words.filter("rank = 2").select(F.col("query_id").alias("src"), (F.col("chunk_id") + 100_000_000).alias("dst"), F.lit(99).alias("ord"), F.lit(None).cast("double").alias("edge_score")))
    last = words.select("query_id").distinct().withColumn("last_chunk", F.col("query_id"))
    out = S.respond(words, vectors, last, served, edges)
    return out.select("query_id", "chunk_id", "score", "route", "diagnostics.*")


def prefix_search(spark, sf_dir):
    """The first ten documents that hold the first word of a passage and a word that begins with the first two letters of its third one."""
    words = F.split(F.lower("text"), "[^\\p{L}\\p{N}]+")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(words[0], F.lit(" "), F.substring(words[2], 1, 2)).alias("query"))
    return X.prefix_search(asked, PR.chunks(spark, sf_dir))


def variant_union(spark, sf_dir):
    """Turns as questions of two sources that overlap, indexed as one: each key's weight by chunk, added up over chunks."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chunk_id"), "turn", "text")
    lines = t.filter("turn % 2 = 0").select("chunk_id", F.col("text").alias("primary_question"), F.split("text", "\n").alias("question_variants"))
    rows = t.filter("turn % 3 = 0").select("chunk_id", F.col("text").alias("primary_question"), F.lit(None).cast("array<string>").alias("question_variants"))
    return R.variant_index(R.variant_sources(lines, rows)).groupBy("key").agg(F.count(F.lit(1)).alias("chunks"), F.sum("weight").alias("weight"))


def quality_sections(spark, sf_dir):
    """Documents as chunks with aspects by their whole texts, conversations as links, sources and languages as coverage."""
    has = lambda name, pattern: F.when(F.col("text").rlike(pattern), F.lit(name))
    aspects = F.array_compact(F.array(has("dosage", "[0-9]{3}"), has("definition", "[Ll]icen[sc]e|the "), has("referral", "\\|"), has("other", "[#*]"), has("coverage", "token =")))
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(" "), F.col("doc_id"))).alias("title"), aspects.alias("aspects"))
    edges = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("src"), F.col("turn").alias("dst"))
    return A.quality_sections(chunks, edges, docs.select(F.col("source").alias("topic"), F.col("lang").alias("aspect")).distinct())


def bundle_integrity(spark, sf_dir):
    """Documents as bundles in blocks of 500 bytes: every 7th block was damaged on its way, every 11th did not come; their states after the first try, and what there is after the rest was fetched."""
    own = I.blocks(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content")), 500)
    listed = I.manifest(own)
    place = F.col("bundle").cast("long") + F.col("block")
    came = own.filter(place % 11 != 0).withColumn("bytes", F.when(place % 7 == 0, F.concat(F.col("bytes"), F.lit(b"x"))).otherwise(F.col("bytes")))
    own, came = I.digested(own), I.digested(came)
    first = I.checked(came, listed)
    states = first.groupBy("bundle").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("whole", "damaged", "missing")])
    whole = I.resumed(came, own.join(I.wanted(came, listed), ["bundle", "block"], "left_semi"), listed)
    return states.join(I.root(I.manifest(whole)), "bundle")


QUERIES = {f.__name__: f for f in (text_variations, evidence_text, respond_record, prefix_search, variant_union, quality_sections, bundle_integrity)}


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in items) + "]"


def _u(step: str, row: str = "conv_id || ':' || turn || ':' || nth") -> str:
    return f"(CAST(('0x' || substr(md5('1:' || {row} || ':' || {step}), 1, 8)) AS BIGINT) / 4294967296.0)"


def _of(options, step: str) -> str:
    return f"{_list(options)}[CAST(floor({_u(step)} * {len(options)}) AS INT) + 1]"


def _variations() -> str:
    filled = "replace('{hello}, ' || text || ' for {weight}kg {please}?', '{weight}', CAST(weight AS VARCHAR))"
    for name, options in SLOTS.items():
        filled = f"replace({filled}, '{{{name}}}', {_of(options, f"'slot {name}'")})"
    mixed = "q"
    for word, options in WORDS.items():
        mixed = f"CASE WHEN {_u(f"'mixes {word}'")} < 0.5 THEN regexp_replace({mixed}, '\\b{word}\\b', {_of(options, f"'mix {word}'")}, 'gi') ELSE {mixed} END"
    typo = "m"
    for word, options in reversed(TYPOS.items()):
        typo = f"CASE WHEN contains(lower(m), '{word}') THEN replace(lower(m), '{word}', {_of(options, f"'typo {word}'")}) ELSE {typo} END"
    share = lambda own, s: f"CASE kind WHEN '{own}' THEN {s} WHEN 'mixed' THEN {{0}} ELSE 0 END"
    words = "list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')"
    kept = f"list_filter({words}, lambda w, i: {_u("'word ' || (i - 1)")} >= 0.2)"
    return f"""WITH n AS (SELECT *, unnest(range(1, 3 + CAST(floor({_u("'number'", "conv_id || ':' || turn")} * 3) AS INT))) AS nth FROM conversations),
w AS (SELECT *, {_of(N.WEIGHTS, "'weight'")} AS weight, {_of(G.KINDS, "'kind'")} AS kind FROM n),
f AS (SELECT *, {filled} AS q FROM w),
m AS (SELECT *, CASE WHEN {_u("'mix'")} < {share("pidgin", 0.6).format(0.3)} THEN {mixed} ELSE q END AS m FROM f),
t AS (SELECT *, CASE WHEN {_u("'typo'")} < {share("typo", 0.5).format(0.3)} THEN {typo} ELSE m END AS t FROM m),
s AS (SELECT *, CASE WHEN {_u("'fragment'")} < {share("fragmented", 0.8).format(0.15)} THEN regexp_replace(array_to_string(CASE WHEN len({words}) > 3 THEN {kept} ELSE {words} END, ' '), '[?.]', '', 'g') ELSE t END AS s FROM t)
SELECT conv_id, turn, nth, kind, md5(s) AS query_md5, role || ': ' || weight * {N.DOSE_PER_KG} || 'mg at ' || weight || 'kg' AS response FROM s QUALIFY row_number() OVER (PARTITION BY lower(s) ORDER BY conv_id, turn, nth) = 1"""


_NL = "chr(10)"


def _evidence() -> str:
    bad = lambda x: "(" + " OR ".join(f"contains(lower({x}), '{p}')" for p in L.COMPILER_ERRORS) + ")"
    say = lambda name: f"CASE WHEN {name} <> '' AND NOT {bad(name)} THEN '{(name[0].upper() + name[1:]).replace('_', ' ')}:' || {_NL} || {name} END"
    number = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
    dose = f"CASE WHEN n_chars % 4 = 0 THEN 'Dosage:' || {_NL} || 'By weight:' || {_NL} || '  ' || n_chars % 10 || '-' || CASE WHEN n_chars % 3 > 0 THEN {number('(n_chars % 10 + CAST(5.5 AS DOUBLE))')} ELSE '∞' END || 'kg: ' || source || {_NL} || '  0-4kg: ' || lang END"
    part = {"dosage_rules": dose} | {f: say(f) for f in ("answer", "definition", "coverage", "procedure", "referral", "danger_signs", "side_effects")}
    body = {intent: [part[f] for f in fields] + [part["side_effects"]] + ([part["answer"]] if "answer" not in fields else []) for intent, fields in [*E.FIELDS.items(), ("OTHER", E.OTHER_FIELDS)]}
    case = " ".join(f"WHEN '{k}' THEN concat_ws({_NL} || {_NL}, CASE WHEN n_chars % 9 > 0 AND a <> '' THEN 'Topic: ' || a END, {', '.join(v)}, 'Source: ' || source)" for k, v in body.items())
    whole = lambda x: f"(length({x}) > 50 AND NOT {bad(x)})"
    outcome = f"""CASE WHEN n_chars % 8 = 0 THEN 'dose is computed' WHEN {whole("answer")} AND len(regexp_extract_all(answer, '(?m)^[•\\-*]\\s')) > 3 AND len(regexp_extract_all(answer, '[.!?]\\s')) < 2 THEN 'list' WHEN {whole("answer")} THEN 'answer'
WHEN {whole("procedure")} THEN 'procedure' WHEN {whole("referral")} THEN 'referral' WHEN {whole("definition")} THEN 'definition' ELSE 'no answer' END"""
    return f"""WITH l AS (SELECT *, string_split(text, {_NL})[1] AS a, array_to_string(string_split(text, {_NL})[2:], {_NL}) AS r, {_list([*E.FIELDS, "OTHER"])}[CAST(doc_id % 6 + 1 AS INT)] AS intent FROM documents),
c AS (SELECT *, CASE WHEN n_chars % 2 = 0 THEN r END AS answer, CASE WHEN n_chars % 3 = 0 THEN a END AS definition, CASE WHEN n_chars % 5 = 0 THEN 'The provided text does not contain it' END AS coverage, CASE WHEN n_chars % 7 < 3 THEN r END AS procedure, CASE WHEN n_chars % 11 = 0 THEN a END AS referral, CAST(NULL AS VARCHAR) AS danger_signs, source AS side_effects FROM l),
e AS (SELECT doc_id, intent, CASE intent {case} END AS said, {outcome} AS reason FROM c)
SELECT doc_id, intent, length(said) AS n_chars, md5(said) AS evidence_md5, reason IN ('list', 'no answer') AS generate, reason FROM e"""


_RESPOND = f"""WITH {PR.BM25}, {PR.COS},
w AS (SELECT * FROM (SELECT *, {PR.ROW} AS rank FROM bm) WHERE rank <= 10), v AS (SELECT query_id // 50 AS query_id, chunk_id, score, rank FROM cr WHERE rank <= 10),
sv AS (SELECT query_id, chunk_id FROM w WHERE (query_id % 2 = 0 AND rank <= 3) OR query_id % 4 = 0 UNION SELECT query_id, chunk_id FROM v WHERE query_id % 4 = 0),
ed AS (SELECT query_id, chunk_id, rank AS ord, score AS edge_score FROM v WHERE rank > 5 UNION ALL SELECT query_id, chunk_id + 100000000, 99, NULL FROM w WHERE rank = 2),
tops AS (SELECT query_id, max(wt) AS top_bm25, max(vt) AS top_vector, max(v2) AS second FROM (SELECT query_id, score AS wt, NULL AS vt, NULL AS v2 FROM w WHERE rank = 1 UNION ALL SELECT query_id, NULL, CASE WHEN rank = 1 THEN score END, CASE WHEN rank = 2 THEN score END FROM v WHERE rank <= 2) GROUP BY query_id),
g AS (SELECT *, CASE WHEN second > 0 THEN (top_vector - second) / second END AS m FROM tops),
u AS (SELECT *, CASE WHEN top_bm25 IS NOT NULL THEN coalesce(top_vector >= CAST(0.3 AS DOUBLE) AND coalesce(m >= CAST(0.1 AS DOUBLE), true), false) ELSE top_vector IS NOT NULL END AS use FROM g),
c AS (SELECT *, coalesce(top_bm25 >= 1.5, false) OR (use AND coalesce(top_vector >= CAST(0.3 AS DOUBLE), false)) AS ok FROM u),
fu AS (SELECT query_id, chunk_id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM w UNION ALL SELECT query_id, chunk_id, rank FROM v SEMI JOIN (SELECT query_id FROM c WHERE use) q USING (query_id)) GROUP BY ALL),
fl AS (SELECT fu.*, sv.chunk_id IS NOT NULL AS old, coalesce(edge_score, 0) AS boost, row_number() OVER (PARTITION BY fu.query_id ORDER BY fu.score DESC, fu.chunk_id) AS k FROM fu LEFT JOIN sv USING (query_id, chunk_id) LEFT JOIN ed USING (query_id, chunk_id)),
hop AS (SELECT query_id, arg_min(chunk_id, ord) AS hop, arg_min(coalesce(edge_score, 0.5), ord) AS hop_score FROM ed ANTI JOIN sv USING (query_id, chunk_id) SEMI JOIN w USING (query_id) GROUP BY query_id),
pick AS (SELECT query_id, coalesce(min(k) FILTER (NOT old), 0) AS fresh FROM fl GROUP BY query_id),
r AS (SELECT c.*, CASE WHEN NOT ok THEN 'none' WHEN fresh > 0 THEN 'fresh' WHEN hop IS NOT NULL THEN 'graph' ELSE 'repeat' END AS route, fresh, hop, hop_score FROM c LEFT JOIN pick USING (query_id) LEFT JOIN hop USING (query_id)),
x AS (SELECT r.*, CASE route WHEN 'graph' THEN hop WHEN 'none' THEN NULL ELSE fl.chunk_id END AS chunk_id, CASE route WHEN 'graph' THEN hop_score WHEN 'none' THEN NULL ELSE round(fl.score + CAST(0.25 AS DOUBLE) * boost, 6) END AS score FROM r LEFT JOIN fl ON fl.query_id = r.query_id AND fl.k = CASE WHEN fresh > 0 THEN fresh ELSE 1 END)
SELECT query_id, chunk_id, score, route, top_bm25, top_vector, score AS fused, round(m, 6) AS margin, use AS vector_gate_passed, NOT ok AS confidence_gate_fired FROM x"""

_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_PREFIX = f"""WITH q AS (SELECT item_id AS query_id, string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+') AS w FROM benchmark), a AS (SELECT query_id, w[1] AS one, substr(w[3], 1, 2) AS two FROM q),
p AS (SELECT DISTINCT doc_id AS chunk_id, unnest({_WORDS}) AS word FROM documents),
h AS (SELECT DISTINCT query_id, x.chunk_id FROM a JOIN p x ON x.word = one JOIN p y ON y.chunk_id = x.chunk_id AND starts_with(y.word, two))
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS INT) AS rank FROM h QUALIFY rank <= 10"""
_UNION = """WITH v AS (SELECT conv_id, text AS q, 5 AS w FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, text, 5 FROM conversations WHERE turn % 3 = 0 UNION ALL SELECT conv_id, unnest(string_split(text, chr(10))), 2 FROM conversations WHERE turn % 2 = 0),
k AS (SELECT unnest(list_filter(string_split_regex(lower(trim(q)), '\\s+'), lambda t: length(t) >= 2)) AS key, conv_id, w FROM v WHERE trim(q) <> '' UNION ALL SELECT substr(lower(trim(q)), 1, 50), conv_id, 2 * w FROM v WHERE trim(q) <> '')
SELECT key, count(DISTINCT conv_id) AS chunks, CAST(sum(w) AS BIGINT) AS weight FROM k GROUP BY key"""
_SECTIONS = f"""WITH c AS (SELECT doc_id, source, lang, list_filter([CASE WHEN regexp_matches(text, '[0-9]{{3}}') THEN 'dosage' END, CASE WHEN regexp_matches(text, '[Ll]icen[sc]e|the ') THEN 'definition' END, CASE WHEN contains(text, '|') THEN 'referral' END, CASE WHEN regexp_matches(text, '[#*]') THEN 'other' END, CASE WHEN contains(text, 'token =') THEN 'coverage' END], lambda x: x IS NOT NULL) AS a FROM documents),
m AS (SELECT 'chunks' AS section, unnest(list_filter(['all', CASE WHEN len(a) = 0 THEN 'zero aspects' END, CASE WHEN a = ['definition'] THEN 'only definition' END, CASE WHEN len(a) >= 3 THEN 'three or more' END, CASE WHEN list_has_any(a, {_list(A.USABLE)}) THEN 'usable gaps' END], lambda x: x IS NOT NULL)) AS item FROM c UNION ALL SELECT 'aspects', unnest(a) FROM c)
SELECT section, item, count(*) AS n FROM m GROUP BY ALL
UNION ALL SELECT 'edges', 'all', count(*) FROM conversations UNION ALL SELECT 'edges', 'chunks with edges', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'topics', source, count(DISTINCT lang) FROM documents GROUP BY source
UNION ALL SELECT 'rich', CASE WHEN doc_id % 2 = 0 THEN source || ' ' || doc_id ELSE CAST(doc_id AS VARCHAR) END || ': [' || array_to_string(a, ', ') || ']', row_number() OVER (ORDER BY doc_id) FROM c WHERE len(a) >= 3 QUALIFY row_number() OVER (ORDER BY doc_id) <= {A.NAMED}"""
_INTEGRITY = """WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), b AS (SELECT doc_id, unnest(range(greatest(CAST(ceil(length(h) / 1000) AS BIGINT), 1))) AS block, h FROM h),
s AS (SELECT doc_id, block, sha256(unhex(substr(h, block * 1000 + 1, 1000))) AS d, CASE WHEN (doc_id + block) % 11 = 0 THEN 'missing' WHEN (doc_id + block) % 7 = 0 THEN 'damaged' ELSE 'whole' END AS state FROM b)
SELECT CAST(doc_id AS VARCHAR) AS bundle, count(*) FILTER (state = 'whole') AS whole, count(*) FILTER (state = 'damaged') AS damaged, count(*) FILTER (state = 'missing') AS missing, sha256(string_agg(d, '' ORDER BY block)) AS version FROM s GROUP BY doc_id"""

ORACLES = {
    "text_variations": _variations(),
    "evidence_text": _evidence(),
    "respond_record": _RESPOND,
    "prefix_search": _PREFIX,
    "variant_union": _UNION,
    "quality_sections": _SECTIONS,
    "bundle_integrity": _INTEGRITY,
}
