"""The whole tables of the clinic over conversations: local words, spellings, phrases, short forms, symptoms and drug classes.

The conversations know no such words, so each turn is given some: a rule of the row picks them from the tables
themselves, and the SQL evaluates every entry of the tables on every text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import clinical as C
from loamgrid.functions import predicates as P
from loamgrid.functions import rules as L
from loamgrid.functions import understanding as U
from loamgrid.operators import retrieval as R
from loamgrid.operators import sessions as PS
from loamgrid.plans import retrieval as PR
from loamgrid.plans import understanding as PU
from loamgrid.plans.retrieval import table

#: What turns are made to say of symptoms and wishes.
SIGNS = [
    "breathing fast", "chest indrawing", "cannot breathe", "coughing blood", "noisy", "refusing to feed", "feeding poorly", "not able to swallow", "hot body", "high temperature", "cold skin", "watery stool", "stools with blood", "throwing up", "cannot keep milk down",
    "tummy ache", "belly swell", "shaking", "not moving", "bulging fontanel", "yellow eyes", "eyes yellow", "pale", "rash", "puffy face", "sunken eyes", "no tears", "skin pinch", "too much blood", "bleeding heavily", "bleeding after birth", "water broke", "head stuck", "weak cry",
    "cord pus", "high blood pressure", "thin", "big belly with thin legs", "what should I do", "how to treat it", "when should we refer", "which drug", "how much dose", "danger signs", "first aid", "nothing of that kind",
]
VOCABULARY = sorted({w for meaning in C.LOCAL_WORDS.values() for w in meaning.split() if len(w) > 3})
FILLERS = ["with", "from", "that"]
PHRASES = [p for p, _ in C.LOCAL_PHRASES]
KEYS = [*C.WORDS, "unknown"]
SHORT = [*L.EXPANSIONS, "rdt/anc", "tb-act"]
#: What answers begin and end with: failures in other cases of letters, and ways of asking back or not.
BEFORE = ["The answer is:", "I can help with dosing.  Tell me", "I can help. Tell me", "It DOES NOT contain any Meaningful information.", "Tell me more", "Please share more.", "What specific area is it?", "Can you provide more details?", "Tell me what type", "So the provided text does not contain it;"]
AFTER = ["", "Should I go on?", "Would you like me to list the doses of all drugs that the patient was given on the ward, one by one?", "want me to stop? No", "Want me to stop?", "That is all!", "No meaningful information to process", "and tell me more about your patient", "I should know."]
TERMS = [t.replace(".*", " and ") for terms in C.DRUG_CLASSES.values() for t in terms]


def _pick(options: list[str], by: int):
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.col("conv_id") * 31 + F.col("turn") * by, F.lit(len(options))) + 1).cast("int"))


def planted(spark, sf_dir):
    """Turns (conv_id, turn, text, said): said has a phrase before the text, and words, a short form and a symptom after it."""
    said = F.concat_ws(" ", _pick(PHRASES, 7), "text", _pick(KEYS, 3), F.concat(F.upper(_pick(KEYS, 11)), F.lit("?")), _pick(SHORT, 5), _pick(SIGNS, 1))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", said.alias("said"))


def clinical_normalize(spark, sf_dir):
    return planted(spark, sf_dir).select("conv_id", "turn", F.md5(U.normalize(F.col("said"), C.LOCAL_PHRASES, C.WORDS)).alias("normalized_md5"))


def clinical_narrative(spark, sf_dir):
    return planted(spark, sf_dir).select("conv_id", "turn", U.narrative_terms(F.col("said"), C.SYMPTOMS + C.ACTIONS, FILLERS, VOCABULARY).alias("terms"))


def clinical_synonyms(spark, sf_dir):
    return planted(spark, sf_dir).select("conv_id", "turn", F.md5(U.expand_synonyms(F.col("said"))).alias("expanded_md5"))


def clinical_rewrite(spark, sf_dir):
    """Intent, gap, complaint and age follow from the turn."""
    k = F.col("turn") % 5
    intent = F.when(k == 0, "HEADING_LOOKUP").when(k == 1, "CLINICAL").when(k == 2, "DETAIL").otherwise("AFFIRM")
    said = P.rewritten(F.col("said"), intent, F.when(F.col("turn") % 2 == 0, "danger signs"), F.when(F.col("turn") % 3 == 0, "fever"), F.when(F.col("conv_id") % 2 == 0, F.col("turn") * 10), phrases=C.LOCAL_PHRASES, words=C.WORDS, expansions=L.EXPANSIONS)
    return planted(spark, sf_dir).select("conv_id", "turn", F.md5(said).alias("rewritten_md5"))


def answer_checks(spark, sf_dir):
    """Turns as answers that fail, ask back or are plain, by what a rule of the row has them say before and after their text."""
    said = F.concat_ws(" ", _pick(BEFORE, 1), F.when(F.col("turn") % 3 > 0, F.col("text")), _pick(AFTER, 7))
    c = F.col("said")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said")).select("conv_id", "turn", P.compiler_error(c).alias("failed"), P.deflection(c).alias("deflects"), P.clinical_presence(c, VOCABULARY).alias("clinical"))


def session_topics(spark, sf_dir):
    """The category of what each turn says, whole, and what its conversation keeps of a complaint since the category last changed."""
    turns = planted(spark, sf_dir).select("conv_id", "turn", F.nullif(U.category(F.col("said")), F.lit("general")).alias("topic"), F.when(F.length("said") % 3 == 0, F.col("turn")).alias("complaint"))
    return PS.cleared_on_shift(turns, "topic", "complaint").select("conv_id", "turn", "topic", "shifted", "kept")


def drug_class_boost(spark, sf_dir):
    """Passages that name a drug class, over documents that name one too, by the words of the passage alone."""
    term = lambda key, by: F.element_at(F.array(*map(F.lit, TERMS)), (F.pmod(F.col(key) * by, F.lit(len(TERMS))) + 1).cast("int"))
    asked = PR.passages(spark, sf_dir).select("query_id", F.concat_ws(" ", "query", F.when(F.col("query_id") % 3 > 0, term("query_id", 7))).alias("query"))
    kind = F.element_at(F.array(*map(F.lit, [*C.BOOSTED_TYPES, "calculator"])), (F.col("doc_id") % 5 + 1).cast("int"))
    title = F.when(F.col("doc_id") % 4 == 0, "Dosage of it").otherwise(F.substring_index("text", "\n", 1))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), kind.alias("type"), title.alias("title"), F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", "text", term("doc_id", 3))).otherwise(F.col("text")).alias("body"))
    classes = spark.createDataFrame([(name, t) for name, terms in C.DRUG_CLASSES.items() for t in terms], "class string, term string")
    return R.class_boost(PR.word_lists(spark, sf_dir, 20).drop("rank"), asked, docs, classes, C.GENERIC_TITLE, C.BOOSTED_TYPES)


QUERIES = {f.__name__: f for f in (clinical_normalize, clinical_narrative, clinical_synonyms, clinical_rewrite, answer_checks, session_topics, drug_class_boost)}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_text, items)) + "]"


def _map(items: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in items.items()) + "}"


def _at(options: list[str], by: int, row: str = "conv_id * 31 + turn * {}") -> str:
    return f"{_list(options)}[CAST(({row.format(by)}) % {len(options)} + 1 AS INT)]"


_SAID = f"t AS (SELECT conv_id, turn, concat_ws(' ', {_at(PHRASES, 7)}, text, {_at(KEYS, 3)}, upper({_at(KEYS, 11)}) || '?', {_at(SHORT, 5)}, {_at(SIGNS, 1)}) AS said FROM conversations)"
_BARE = "regexp_replace(lower({0}), '[^a-z0-9_]', '', 'g')"


def _normalized(x: str) -> str:
    for phrase, meaning in C.LOCAL_PHRASES:
        x = f"regexp_replace({x}, '\\b{phrase}\\b', {_text(meaning)}, 'gi')"
    word = f"CASE WHEN length(regexp_replace(w, '[^A-Za-z0-9_]', '', 'g')) < 3 THEN w ELSE coalesce({_map(C.WORDS)}[lower(regexp_replace(w, '[^A-Za-z0-9_]', '', 'g'))], w) END"
    return f"array_to_string(list_transform(string_split_regex({x}, '\\s+'), lambda w: {word}), ' ')"


def _expanded(x: str) -> str:
    parts = "list_filter(string_split_regex(w, '[-/]'), lambda p: length(p) >= 2)"
    found = f"flatten(list_transform(list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: length(w) >= 2), lambda w: CASE WHEN len({parts}) > 1 THEN {parts} ELSE [{_BARE.format('w')}] END))"
    more = f"list_filter(flatten(list_transform(f, lambda w: coalesce(string_split({_map(L.EXPANSIONS)}[w], ' '), []))), lambda w: NOT list_contains(f, w))"
    once = f"list_filter({more}, lambda w, i: list_position({more}, w) = i)"
    return f"(SELECT CASE WHEN len({more}) > 0 THEN x || ' ' || array_to_string({once}, ' ') ELSE x END FROM (SELECT {x} AS x, {found} AS f))"


def _rewrite() -> str:
    age = f"regexp_matches(lower(said), '\\b({'|'.join(L.PEDIATRIC)})\\b')"
    added = "CASE WHEN turn % 5 <> 2 AND turn % 2 = 0 THEN ' danger signs' ELSE '' END || CASE WHEN turn % 5 = 0 THEN ' what is overview definition' ELSE '' END || CASE WHEN turn % 3 = 0 THEN ' fever' ELSE '' END"
    added += f" || CASE WHEN conv_id % 2 = 0 AND {age} THEN CASE WHEN turn * 10 < 24 THEN ' infant neonate' ELSE ' child' END ELSE '' END"
    return f"""WITH {_SAID}, n AS (SELECT *, regexp_replace({_normalized('said')} || {added}, '[-/]', ' ', 'g') AS y FROM t), e AS (SELECT conv_id, turn, {_expanded('y')} AS z FROM n),
w AS (SELECT conv_id, turn, string_split_regex(z, '\\s+') AS w, list_transform(string_split_regex(z, '\\s+'), lambda v: {_BARE.format('v')}) AS b FROM e)
SELECT conv_id, turn, md5(array_to_string(list_filter(w, lambda v, i: b[i] <> '' AND list_position(b, b[i]) = i), ' ')) AS rewritten_md5 FROM w"""


def _deflects() -> str:
    low = "lower(trim(said))"
    last = "trim(coalesce(list_filter(string_split_regex(low, '[.!]\\s*'), lambda x: trim(x) <> '')[-1], ''))"
    phrases = "|".join(L.DEFLECTIONS)
    return f"""(SELECT regexp_matches(low, '^i can help with .+\\.\\s*tell me') OR (len(string_split_regex(low, '\\s+')) < 60 AND regexp_matches(low, 'tell me (more|what|which|about)')) OR regexp_matches(low, {_text(phrases)})
OR regexp_matches({last}, '\\b(?:should i|want me to|would you like me to)\\b.{{0,60}}\\?$') FROM (SELECT {low} AS low))"""


_ANSWER = f"t AS (SELECT conv_id, turn, concat_ws(' ', {_at(BEFORE, 1)}, CASE WHEN turn % 3 > 0 THEN text END, {_at(AFTER, 7)}) AS said FROM conversations)"
_FAILED = " OR ".join(f"contains(lower(said), {_text(p)})" for p in L.COMPILER_ERRORS)
_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(lower(said), '{PU.re2(p)}') THEN '{name}'" for name, p in L.CATEGORIES) + " END"

_TOLD = ", ".join(f"CASE WHEN regexp_matches(lower(said), {_text(p)}) THEN {_list(terms)} ELSE [] END" for p, terms in C.SYMPTOMS + C.ACTIONS)
_CLASSES = ", ".join(f"({_text(name)}, {_text(t)})" for name, terms in C.DRUG_CLASSES.items() for t in terms)

ORACLES = {
    "clinical_normalize": f"WITH {_SAID} SELECT conv_id, turn, md5({_normalized('said')}) AS normalized_md5 FROM t",
    "clinical_narrative": f"""WITH {_SAID}, a AS (SELECT conv_id, turn, flatten([{_TOLD}, list_filter(list_filter(string_split_regex(regexp_replace(lower(said), '[^a-z0-9_\\s]', '', 'g'), '\\s+'), lambda w: length(w) >= 3), lambda w: list_contains({_list(VOCABULARY)}, w) AND NOT list_contains({_list(FILLERS)}, w))]) AS a FROM t)
SELECT conv_id, turn, array_to_string(list_filter(a, lambda w, i: list_position(a, w) = i), ' ') AS terms FROM a""",
    "clinical_synonyms": f"WITH {_SAID} SELECT conv_id, turn, md5({_expanded('said')}) AS expanded_md5 FROM t",
    "clinical_rewrite": _rewrite(),
    "answer_checks": f"""WITH {_ANSWER} SELECT conv_id, turn, {_FAILED} AS failed, {_deflects()} AS deflects, list_has_any(list_filter(string_split_regex(regexp_replace(lower(said), '[^a-z0-9_\\s]', '', 'g'), '\\s+'), lambda w: length(w) >= 2), {_list(VOCABULARY)}) AS clinical FROM t""",
    "session_topics": f"""WITH {_SAID}, c AS (SELECT conv_id, turn, nullif({_TOPIC}, 'general') AS topic, CASE WHEN length(said) % 3 = 0 THEN turn END AS complaint FROM t),
s AS (SELECT *, coalesce(topic <> last_value(topic IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS shifted FROM c),
p AS (SELECT *, sum(CAST(shifted AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM s)
SELECT conv_id, turn, topic, shifted, last_value(complaint IGNORE NULLS) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM p""",
    "drug_class_boost": f"""WITH {PR.BM25}, l AS (SELECT * FROM (SELECT *, {PR.ROW} AS rank FROM bm) WHERE rank <= 20), r AS (SELECT * FROM (VALUES {_CLASSES}) v(class, term)),
a AS (SELECT item_id AS query_id, lower(concat_ws(' ', text, CASE WHEN item_id % 3 > 0 THEN {_at(TERMS, 7, 'item_id * {}')} END)) AS said FROM benchmark), nm AS (SELECT DISTINCT query_id, class FROM a JOIN r ON contains(said, term)),
d2 AS (SELECT doc_id AS chunk_id, {_list([*C.BOOSTED_TYPES, "calculator"])}[CAST(doc_id % 5 + 1 AS INT)] AS type, lower(CASE WHEN doc_id % 4 = 0 THEN 'Dosage of it' ELSE string_split(text, chr(10))[1] END) AS title, lower(concat_ws(' ', text, CASE WHEN doc_id % 2 = 0 THEN {_at(TERMS, 3, 'doc_id * {}')} END)) AS body FROM documents),
says AS (SELECT DISTINCT chunk_id, class FROM d2 JOIN r ON CASE WHEN contains(term, '*') THEN regexp_matches(title || ' ' || body, term) ELSE contains(title || ' ' || body, term) END WHERE type <> 'calculator'),
hit AS (SELECT DISTINCT query_id, chunk_id FROM nm JOIN says USING (class))
SELECT query_id, chunk_id, score * CASE WHEN query_id NOT IN (SELECT query_id FROM nm) OR type = 'calculator' THEN CAST(1 AS DOUBLE) WHEN hit.chunk_id IS NOT NULL THEN CAST(1.4 AS DOUBLE) WHEN regexp_matches(title, '{C.GENERIC_TITLE}') THEN CAST(0.6 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS score
FROM l LEFT JOIN hit USING (query_id, chunk_id) JOIN d2 USING (chunk_id)""",
}
