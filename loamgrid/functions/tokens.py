"""The tokenisers, each as a Column expression; operators differ in which one they use.

A word character is an ASCII letter, digit or underscore; white space is what splits tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "\\s+"

# Words that don't count when a query is compared with a stored query.
PROXY_STOP_WORDS = (
    "what whats how when where why who which is are was were be been am do does did the an of to for in on "
    "it its my me we us our you your that this these those overview definition about tell"
).split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def _spaced(text: Column) -> Column:
    """No-break spaces count as white space, as in the source of the rules."""
    return F.replace(text, F.lit("\u00a0"), F.lit(" "))


def lowered(text: Column) -> Column:
    return F.lower(_spaced(text))


def split_lower(text: Column) -> Column:
    return F.split(lowered(text), SPACE)


def at_least(tokens: Column, n: int) -> Column:
    return F.filter(tokens, lambda t: F.length(t) >= n)


def bare(text: Column) -> Column:
    """Lower case without anything but word characters and white space."""
    return F.regexp_replace(lowered(text), "[^a-z0-9_\\s]", "")


def hybrid_tokens(text: Column) -> Column:
    """For scoring against postings: repeated tokens stay."""
    return at_least(F.split(bare(text), SPACE), 2)


def proxy_tokens(text: Column) -> Column:
    """For comparing queries: hybrid tokens without stop words, each once."""
    return F.array_distinct(F.array_except(hybrid_tokens(text), F.array(*map(F.lit, PROXY_STOP_WORDS))))


def intent_tokens(text: Column) -> Column:
    """For intents, topics and drift: punctuation stays."""
    return at_least(split_lower(text), 2)


def variant_tokens(text: Column) -> Column:
    return at_least(F.split(F.lower(F.trim(_spaced(text))), SPACE), 2)


def topic_tokens(text: Column, stop_words: list[str]) -> Column:
    return F.filter(split_lower(text), lambda t: (F.length(t) > 2) & ~t.isin(stop_words))


def fallback_tokens(text: Column) -> Column:
    return at_least(split_lower(text), 2)


def fuzzy_tokens(text: Column) -> Column:
    """For corrections: the tokens as they are; those of under three word characters are left alone by the caller."""
    return F.split(_spaced(text), SPACE)


def narrative_tokens(text: Column, n: int = 2) -> Column:
    return at_least(F.split(bare(text), SPACE), n)


def synonym_tokens(text: Column) -> Column:
    """Tokens of two or more letters; one with a hyphen or slash gives its parts if there are two or more."""
    parts = lambda t: at_least(F.split(t, "[-/]"), 2)
    return F.flatten(F.transform(intent_tokens(text), lambda t: F.when(F.size(parts(t)) > 1, parts(t)).otherwise(F.array(F.regexp_replace(t, "[^a-z0-9_]", "")))))


def faq_tokens(text: Column) -> Column:
    return at_least(F.split(F.lower(F.trim(_spaced(text))), "[\\s,;:\\-—/]+"), 2)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
