"""Texts varied at random, the same way each time: every choice is drawn from a hash of a seed, the row and the step.

Nothing depends on the order in which rows are read or on how often a task runs, so lost tasks come back the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of variation.
KINDS = ["clean", "typo", "pidgin", "fragmented", "mixed"]


def draw(seed: int, step: str | Column, *row: Column) -> Column:
    """A number from 0 (inclusive) to 1: the first 8 hex digits of the md5 of seed, row and step, in units of 2 ** -32."""
    parts = [F.lit(str(seed)), *[c.cast("string") for c in row], F.lit(step) if isinstance(step, str) else step]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / float(2**32)


def chosen(options: list, u: Column) -> Column:
    """The option at a drawn number."""
    return F.get(F.array(*map(F.lit, options)), F.floor(u * len(options)).cast("int"))


def filled(template: Column, slots: dict[str, list[str]], seed: int, *row: Column) -> Column:
    """The template with each {name} replaced by one of its options, the same one wherever the name stands."""
    for name, options in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), chosen(options, draw(seed, f"slot {name}", *row)))
    return template


def mistyped(text: Column, typos: dict[str, list[str]], share: Column, seed: int, *row: Column) -> Column:
    """With the share's chance, the first of the words of typos that the text holds is written in another way throughout, and the text in lower case."""
    low, out = F.lower(text), text
    for word, variants in reversed(typos.items()):
        out = F.when(F.contains(low, F.lit(word)), F.replace(low, F.lit(word), chosen(variants, draw(seed, f"typo {word}", *row)))).otherwise(out)
    return F.when(draw(seed, "typo", *row) < share, out).otherwise(text)


def mixed_with(text: Column, words: dict[str, list[str]], share: Column, seed: int, *row: Column, each: float = 0.5) -> Column:
    """With the share's chance, every word of words, each with its own chance, is replaced where it stands as a word, in any case of letters."""
    out = text
    for word, variants in words.items():
        replaced = F.regexp_replace(out, F.lit(f"(?i)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])"), chosen(variants, draw(seed, f"mix {word}", *row)))
        out = F.when(draw(seed, f"mixes {word}", *row) < each, replaced).otherwise(out)
    return F.when(draw(seed, "mix", *row) < share, out).otherwise(text)


def fragmented(text: Column, share: Column, seed: int, *row: Column, gone: float = 0.2) -> Column:
    """With the share's chance, a text of over three words loses each with a chance of `gone`, and question marks and full stops are cut."""
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w, i: draw(seed, F.concat(F.lit("word "), i.cast("string")), *row) >= gone)
    rest = F.regexp_replace(F.array_join(F.when(F.size(words) > 3, kept).otherwise(words), " "), "[?.]", "")
    return F.when(draw(seed, "fragment", *row) < share, rest).otherwise(text)


def varied(text: Column, typos: dict[str, list[str]], words: dict[str, list[str]], seed: int, *row: Column) -> Column:
    """(kind, text): a text in one of five ways: as it is, with typos, with words of another speech, in fragments, or all of these."""
    kind = chosen(KINDS, draw(seed, "kind", *row))
    share = lambda own, mixed: F.when(kind == own, {"typo": 0.5, "pidgin": 0.6, "fragmented": 0.8}[own]).when(kind == "mixed", mixed).otherwise(0.0)
    out = mixed_with(text, words, share("pidgin", 0.3), seed, *row)
    out = mistyped(out, typos, share("typo", 0.3), seed, *row)
    return F.struct(kind.alias("kind"), fragmented(out, share("fragmented", 0.15), seed, *row).alias("text"))
