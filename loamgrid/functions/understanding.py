"""Query understanding as Column expressions over rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions import rules as L
from loamgrid.functions import tokens as T


def whole_word(words: list[str] | str) -> str:
    """A pattern for any of the words between characters that aren't ASCII word characters."""
    body = words if isinstance(words, str) else "|".join(words)
    return f"(?<![a-z0-9_])(?:{body})(?![a-z0-9_])"


def _low(text: Column) -> Column:
    return F.lower(F.trim(text))


def first_match(text: Column, cascade: list[tuple[str, str]], default: Column) -> Column:
    """The label of the first pattern that is found."""
    return reduce(lambda rest, rule: F.when(text.rlike(rule[1]), rule[0]).otherwise(rest), reversed(cascade), default)


def detect_language(text: Column, markers: dict[str, list[str]] = L.LANGUAGE_MARKERS, least: int = 2, default: str = "en") -> Column:
    """The language with most markers in the text as parts of words, the earlier of equals; at least `least`, else the default."""
    counts = {lang: sum((F.contains(_low(text), F.lit(m)).cast("int") for m in words), F.lit(0)) for lang, words in markers.items()}
    top = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    return reduce(lambda rest, item: F.when((top >= least) & (item[1] == top), item[0]).otherwise(rest), reversed(counts.items()), F.lit(default))


def language_mode(text: Column) -> Column:
    pidgin, english = _low(text).rlike(whole_word("|".join([*L.PIDGIN_WORDS, "how\\s+far"]))), _low(text).rlike(whole_word(L.ENGLISH_WORDS))
    return F.when(pidgin & english, "mixed").when(pidgin, "pidgin").when(english, "english").otherwise("other")


def ambiguous(text: Column) -> Column:
    """A short heading rather than a question."""
    low = F.lower(text)
    return (F.size(T.intent_tokens(text)) <= 5) & ~low.rlike(whole_word(L.VERBS)) & ~F.trim(low).rlike(L.QUESTION_START)


def classify_intent(text: Column, cascade: list[tuple[str, str]] = L.INTENTS) -> Column:
    return first_match(_low(text), cascade, F.when(ambiguous(text), "HEADING_LOOKUP").otherwise("CLINICAL"))


def sentiment(text: Column, cascade: list[tuple[str, str]] = L.SENTIMENTS) -> Column:
    return first_match(_low(text), cascade, F.lit("calm"))


def category(topic: Column, cascade: list[tuple[str, str]] = L.CATEGORIES) -> Column:
    return first_match(F.lower(F.coalesce(topic, F.lit(""))), cascade, F.lit("general"))


def analytics_intent(intent: Column) -> Column:
    return reduce(lambda rest, item: F.when(intent == item[0], item[1]).otherwise(rest), L.INTENT_GROUPS.items(), F.lit("general_inquiry"))


def any_of(text: Column, patterns: list[str] = L.OUT_OF_SCOPE) -> Column:
    return reduce(lambda a, p: a | F.lower(text).rlike(p), patterns, F.lit(False))


def correction(text: Column) -> Column:
    """What a correcting message names instead; null if it is none."""
    low = _low(text)
    told, turned, plain = F.regexp_extract(low, L.CORRECTED, 1), low.rlike(L.CORRECTS), F.regexp_extract(low, L.DENIES, 1)
    return F.coalesce(F.when(turned, F.nullif(F.trim(told), F.lit(""))), F.nullif(F.trim(plain), F.lit("")))


def age_months(amount: Column, unit: Column) -> Column:
    """Months, halves rounded up; units by their first letters."""
    n = amount.cast("double")
    half_up = lambda c: F.floor(c + 0.5).cast("long")
    u = F.lower(unit)
    return F.when(u.rlike("^y"), half_up(n * 12)).when(u.rlike("^w"), half_up(n / 4.345)).when(u.rlike("^d"), half_up(n / 30.44)).otherwise(half_up(n))


def weight_kg(amount: Column, unit: Column) -> Column:
    """Kilograms; grams by their first letter."""
    return F.when(F.lower(unit).rlike("^g"), amount.cast("double") / 1000).otherwise(amount.cast("double"))


def slots(text: Column) -> Column:
    """(age_months, age_label, weight_kg) as the message tells them; null where it doesn't."""
    low = F.lower(text)
    amount, unit = F.regexp_extract(low, L.AGE, 1), F.regexp_extract(low, L.AGE, 2)
    told = amount != ""
    spoken = [(low.rlike(whole_word(p)) & (~low.rlike(whole_word(but)) if but else F.lit(True)), label, n) for p, but, label, n in L.AGE_WORDS]
    by = lambda k: reduce(lambda rest, w: F.when(w[0], F.lit(w[k])).otherwise(rest), reversed(spoken), F.lit(None))
    weight = F.nullif(F.regexp_extract(low, L.WEIGHT, 1), F.lit("")).cast("double")
    months = F.when(told, age_months(amount, unit)).otherwise(by(2).cast("long"))
    return F.struct(months.alias("age_months"), F.when(told, F.concat_ws(" ", amount, unit)).otherwise(by(1)).alias("age_label"), weight.alias("weight_kg"))


def expand_synonyms(text: Column, expansions: dict[str, str] = L.EXPANSIONS) -> Column:
    """The text and, after it, the expansions of its tokens that it lacks, each once, in order."""
    table = F.create_map(*[F.lit(x) for k, v in expansions.items() for x in (k, v)])
    added = lambda found: F.flatten(F.transform(found, lambda t: F.coalesce(F.split(F.element_at(table, t), " "), F.array().cast("array<string>"))))
    said = lambda text, fresh: F.when(F.size(fresh) > 0, F.concat(text, F.lit(" "), F.array_join(fresh, " "))).otherwise(text)
    return T.let(text, lambda x: T.let(T.synonym_tokens(x), lambda found: T.let(F.array_except(added(found), found), lambda fresh: said(x, fresh))))


def dedupe_terms(text: Column) -> Column:
    """Every token once, by its word characters in lower case; those without any go."""
    bare = lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9_]", "")

    def firsts(tokens: Column, words: Column) -> Column:
        once = F.array_distinct(F.filter(words, lambda w: w != ""))
        return F.array_join(F.transform(once, lambda w: F.get(tokens, (F.array_position(words, w) - 1).cast("int"))), " ")

    return T.let(F.split(text, "\\s+"), lambda tokens: T.let(F.transform(tokens, bare), lambda words: firsts(tokens, words)))


def normalize(text: Column, phrases: list[tuple[str, str]], words: dict[str, str]) -> Column:
    """Phrases are replaced one after another, later ones see what earlier ones made; then single tokens by their word characters, unless they have under three."""
    out = reduce(lambda t, p: F.regexp_replace(t, f"(?i)(?<![A-Za-z0-9_]){p[0]}(?![A-Za-z0-9_])", p[1]), phrases, text)
    table = F.create_map(*[F.lit(x) for item in words.items() for x in item])
    clean = lambda t: F.regexp_replace(t, "[^A-Za-z0-9_]", "")
    return F.array_join(F.transform(F.split(out, "\\s+"), lambda t: F.when(F.length(clean(t)) < 3, t).otherwise(F.coalesce(F.element_at(table, F.lower(clean(t))), t))), " ")


def narrative(text: Column, fillers: list[str], vocabulary: list[str]) -> Column:
    """Whether a query tells a story: over five tokens, few of the vocabulary, many fillers."""
    found = T.narrative_tokens(text)
    share = lambda words: F.size(F.filter(found, lambda t: t.isin(words))) / F.size(found)
    return (F.size(found) > 5) & (share(vocabulary) < 0.3) & (share(fillers) > 0.4) & (F.size(found) >= 7)


def narrative_terms(text: Column, patterns: list[tuple[str, list[str]]], fillers: list[str], vocabulary: list[str]) -> Column:
    """The terms of all patterns that are found, then single tokens of the vocabulary; each once."""
    low = F.lower(text)
    none = F.array().cast("array<string>")
    told = [F.when(low.rlike(p), F.array(*map(F.lit, terms))).otherwise(none) for p, terms in patterns]
    single = F.filter(T.narrative_tokens(text, 3), lambda t: t.isin(vocabulary) & ~t.isin(fillers))
    return F.array_join(F.array_distinct(F.concat(*told, single)), " ")


def tone(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("urgent|emergency|help|now|quick"), "urgent").when(low.rlike("worried|scared|afraid|anxious"), "reassuring").when(F.length(text) < 50, "direct").otherwise("formal")


def english_script(text: Column, most: float = 0.3) -> Column:
    """Whether at most this share of the characters that aren't white space is beyond Latin letters."""
    solid = F.regexp_replace(text, "\\s", "")
    odd = F.regexp_replace(solid, "[\\x00-ɏ]", "")
    return F.when(F.length(solid) == 0, F.lit(True)).otherwise(F.length(odd) / F.length(solid) <= most)


def clean_topic(text: Column) -> Column:
    """Without leading section numbers."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "^\\s*\\d+(\\.\\d+)*[.)]?\\s+", ""), "^\\s*[A-Za-z][.)]\\s+", ""))


def chip(text: Column, most: int = 40) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def hashed(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(value, F.lit(salt)), 256)


def word_count(text: Column) -> Column:
    return F.size(F.split(F.trim(text), "\\s+"))


def with_rules(df: DataFrame, text: str) -> DataFrame:
    """df with language, mode, intent, sentiment, category, ambiguous, out_of_scope and tone of a text column."""
    c = F.col(text)
    return df.withColumns({"language": detect_language(c), "mode": language_mode(c), "intent": classify_intent(c), "sentiment": sentiment(c), "category": category(c), "ambiguous": ambiguous(c), "out_of_scope": any_of(c), "tone": tone(c)})
