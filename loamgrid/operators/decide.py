"""What follows retrieval: confidence, topics, drift, gaps, doses, answers, grounding and evaluation, for many queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import tokens as T

# Aspects in the order in which missing ones are offered.
ASPECT_PRIORITY = "danger_signs treatment dosage referral diagnosis prevention".split()

CONFIDENCE_SQL = (
    "CASE WHEN gate_fired THEN least(0.4, round(greatest(coalesce(least(1, greatest(0, (vector_top - 0.3) / 0.4)) * CASE WHEN margin < 0.1 THEN 0.5 ELSE 1 END, 0), coalesce(least(1, greatest(0, (bm25_top - 1.5) / 4.5)), 0)), 6))"
    " ELSE round(greatest(coalesce(least(1, greatest(0, (vector_top - 0.3) / 0.4)) * CASE WHEN margin < 0.1 THEN 0.5 ELSE 1 END, 0), coalesce(least(1, greatest(0, (bm25_top - 1.5) / 4.5)), 0)), 6) END"
)


def with_confidence(signals: DataFrame) -> DataFrame:
    """Adds confidence (0 to 1) and tier to (vector_top, margin, bm25_top, gate_fired); a signal that is null counts nothing."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    v = clamp((F.col("vector_top") - 0.3) / 0.4) * F.when(F.col("margin") < 0.1, 0.5).otherwise(1.0)
    score = F.round(F.greatest(F.coalesce(F.when(F.col("vector_top").isNotNull(), v), F.lit(0.0)), F.coalesce(F.when(F.col("bm25_top").isNotNull(), clamp((F.col("bm25_top") - 1.5) / 4.5)), F.lit(0.0))), 6)
    out = signals.withColumn("confidence", F.when(F.col("gate_fired"), F.least(F.lit(0.4), score)).otherwise(score))
    return out.withColumn("tier", F.when(F.col("confidence") >= 0.8, "HIGH").when(F.col("confidence") >= 0.65, "MEDIUM").otherwise("LOW"))


def brackets(people: DataFrame, rules: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Adds the columns of the first rule (least ord) whose bounds, both inclusive, hold the value; an open bound is null. rules is a table fixed with the drug; people without a rule keep nulls.

    Rules are few, so the join is a broadcast one; the value itself need not be unique.
    """
    added = [c for c in rules.columns if c not in (low, high)]
    inside = (F.col(value) >= F.coalesce(F.col(low), F.lit(float("-inf")))) & (F.col(value) <= F.coalesce(F.col(high), F.lit(float("inf"))))
    values = people.select(value).filter(F.col(value).isNotNull()).distinct()
    first = values.join(F.broadcast(rules), inside).groupBy(value).agg(F.min(F.struct("ord", *[c for c in added if c != "ord"])).alias("r"))
    return people.join(first, value, "left").select(*people.columns, *[F.col(f"r.{c}").alias(c) for c in added])


def dose(people: DataFrame, by_weight: DataFrame, by_age: DataFrame) -> DataFrame:
    """Adds advice: an age warning if one holds, else the dose of the weight's bracket, else a request for the weight."""
    aged = brackets(people, by_age, "age_months", "min_months", "max_months").drop("ord")
    out = brackets(aged, by_weight, "weight_kg", "min_kg", "max_kg").drop("ord")
    return out.withColumn("advice", F.coalesce("warning", "dose", F.lit("See the whole dosing table.")))


def topic_cascade(queries: DataFrame, topics: DataFrame, most: float = 0.6) -> DataFrame:
    """(query_id, primary_topic): the first topic named by the query (as a whole, or by all its tokens); else the chunk's topic if the query shares a token with it, its score is over `most` or there is no current topic; else the current topic.

    queries: (query_id, query, chunk_topic, score, current_topic); topics: (ord, topic), a rule table.
    """
    q = queries.withColumns({"low": F.lower("query"), "qt": T.intent_tokens(F.col("query"))})
    named = F.contains(F.col("low"), F.lower("topic")) | ((F.size("tt") > 0) & (F.size(F.array_except("tt", "qt")) == 0))
    t = F.broadcast(topics.withColumn("tt", T.intent_tokens(F.col("topic"))))
    first = q.select("query_id", "low", "qt").join(t, named).groupBy("query_id").agg(F.min(F.struct("ord", "topic")).alias("t")).select("query_id", F.col("t.topic").alias("named"))
    own = F.arrays_overlap("qt", T.intent_tokens(F.col("chunk_topic"))) | (F.col("score") > most) | F.col("current_topic").isNull()
    return q.join(first, "query_id", "left").select("query_id", F.coalesce("named", F.when(F.coalesce(own, F.lit(False)), F.col("chunk_topic")), F.col("current_topic")).alias("primary_topic"))


def drift(query: Column, current: Column, chunk_topics: Column) -> Column:
    """Whether a query has left its topic: no token in common, and the topic isn't among the chunk's."""
    apart = ~F.coalesce(F.arrays_overlap(T.intent_tokens(query), T.intent_tokens(current)), F.lit(False))
    return F.when(current.isNull(), F.lit(False)).otherwise(apart & ~F.coalesce(F.exists(chunk_topics, lambda t: F.lower(t) == F.lower(current)), F.lit(False)))


def gaps(needed: DataFrame, covered: DataFrame, priority: list[str] = ASPECT_PRIORITY, k: int = 3) -> DataFrame:
    """(query_id, aspect, rank): aspects of the query's topic that aren't covered, in order of priority, then of name; the first k. needed, covered: (query_id, aspect)."""
    left = needed.distinct().join(covered, ["query_id", "aspect"], "left_anti")
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col("aspect")), F.lit(0)), F.lit(999))
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(place, "aspect"))).filter(F.col("rank") <= k)


def truncated(text: Column, most_words: int = 120, sentences: int = 2, bullets: int = 4, bullet_words: int = 12) -> Column:
    """A long text as its first sentences and short bullets of the next ones."""
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    # Without the tail that ends no sentence, in which the pattern would be tried from every character to the end.
    tail = F.length(F.regexp_extract(F.reverse(text), "^[^.!?]*", 0))
    said = F.regexp_extract_all(F.substring(text, F.lit(1), F.length(text) - tail), F.lit("[^.!?]+[.!?]+"), 0)
    rest = F.filter(F.transform(F.slice(said, sentences + 1, bullets), lambda s: F.trim(s)), lambda s: s != "")
    short = F.transform(rest, lambda s: F.concat(F.lit("• "), F.regexp_replace(F.array_join(F.slice(F.split(s, "\\s+"), 1, bullet_words), " "), "[.!?]+$", "")))
    spoken = F.trim(F.array_join(F.slice(said, 1, sentences), " "))
    long = F.when(F.size(said) == 0, text).when(F.size(rest) > 0, F.concat(spoken, F.lit("\n\nKey points:\n"), F.array_join(short, "\n"))).otherwise(spoken)
    return F.when(F.size(words) <= most_words, text).otherwise(long)


# What a claim is made of, as patterns between ASCII word boundaries, and capitalised words that aren't names.
BEGIN, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
CLAIM_PATTERNS = [
    f"(?i){BEGIN}\\d+(?:\\.\\d+)?\\s*(?:mg/kg|ml/kg|mg|ml|g|kg|IU|mcg|units?){END}",
    f"{BEGIN}(?:IM|IV|PO|SC){END}",
    f"(?i){BEGIN}\\d+\\s*-\\s*\\d+\\s*(?:kg|months?|years?|weeks?){END}",
    f"(?i){BEGIN}for\\s+\\d+\\s+(?:days?|weeks?|months?){END}",
    f"(?i){BEGIN}(?:once|twice|three\\s+times)\\s+(?:daily|per\\s+day){END}",
    f"(?i){BEGIN}\\d+\\s+days?{END}",
]
CAPITALISED = f"{BEGIN}[A-Z](?:[a-z]+)?(?:\\s+[A-Z](?:[a-z]+)?)*{END}"
COMMON_CAPITALISED = "Give Use Administer Children For The This Continue Treatment Suitable".split()


def key_terms(text: Column) -> Column:
    """The claims of a text: capitalised names without common words, doses, routes, ranges, durations, frequencies; each once."""
    names = F.filter(F.regexp_extract_all(text, F.lit(CAPITALISED), 0), lambda w: F.length(w) > 1)
    names = F.filter(F.transform(names, lambda w: F.array_join(F.filter(F.split(w, "\\s+"), lambda p: ~p.isin(COMMON_CAPITALISED)), " ")), lambda w: w != "")
    return F.array_distinct(F.concat(names, *[F.regexp_extract_all(text, F.lit(p), 0) for p in CLAIM_PATTERNS]))


def grounding(claims: Column, evidence: Column) -> Column:
    """Share of the claims that the evidence has, in lower case; 1 without claims."""
    low = F.lower(evidence)
    return F.when(F.size(claims) == 0, F.lit(1.0)).otherwise(F.round(F.size(F.filter(claims, lambda c: F.contains(low, F.lower(c)))) / F.size(claims), 6))


def answer_field(intent: Column, fields: dict[str, list[Column]], default: list[Column]) -> Column:
    """The first field that isn't null, in the order that the intent asks for."""
    return reduce(lambda rest, item: F.when(intent == item[0], F.coalesce(*item[1])).otherwise(rest), fields.items(), F.coalesce(*default))


def generation(tier: Column, words: Column, lists: Column, tables: Column) -> Column:
    """Whether an answer is to be written anew: direct if short or tabular, none at low confidence."""
    return F.when(tier == "LOW", "fallback").when(tables, "direct").when((words > 80) | (lists > 3), "generate").otherwise("direct")


def golden(answers: DataFrame) -> DataFrame:
    """Adds correct: every required fact is in the answer, or the answer refuses where there is no evidence. answers: (answer, facts, evidence)."""
    low = F.lower("answer")
    refuses = low.rlike("don't have|do not have|not available|no information")
    has = F.forall("facts", lambda f: F.contains(low, F.lower(f)))
    return answers.withColumn("correct", F.coalesce(F.when(F.coalesce(F.trim("evidence"), F.lit("")) == "", refuses).otherwise(has), F.lit(False)))


def scorecard(results: DataFrame, by: str) -> DataFrame:
    """Mean of 0 to 3 points by category: found, has what it must, lacks what it must not. results: (by, found, has, clean), booleans."""
    points = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("found", "has", "clean")), F.lit(0))
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(points), 6).alias("points"))
