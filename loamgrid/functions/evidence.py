"""What a chunk holds on a question, as one text: the fields that its intent asks for, other aspects, and the source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.functions.predicates import compiler_error
from loamgrid.functions.rendering import in_language
from loamgrid.functions.tokens import let

# The fields of an intent, in order, and those of any other intent.
FIELDS = {
    "DEFINE": ["definition", "answer"],
    "SCOPE": ["coverage", "answer"],
    "DETAIL": ["dosage_rules", "answer", "procedure"],
    "PROCEDURE": ["procedure", "answer"],
    "REFERRAL": ["referral", "danger_signs", "answer"],
}
OTHER_FIELDS = ["answer", "definition"]
# Dosing rules in a chunk.
RULES = "array<struct<basis: string, brackets: array<struct<min_kg: double, max_kg: double, dose: string>>>>"
# Fields that answer on their own, and the length from which a text does.
COMPLETE, LEAST = ["procedure", "referral", "definition"], 50


def told(text: Column) -> Column:
    """The text, null where it is empty or says that it failed."""
    return F.when((F.length(text) > 0) & ~compiler_error(text), text)


def titled(field: Column) -> Column:
    """A field's name with a capital and spaces."""
    return F.concat(F.upper(F.substring(field, 1, 1)), F.replace(F.substr(field, F.lit(2)), F.lit("_"), F.lit(" ")))


def number(x: Column) -> Column:
    """A number without a fraction of zero."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def dosing(rules: Column) -> Column:
    """Dosing rules as lines: each basis, and under it a line per bracket; an open upper end is infinite."""
    end = lambda x, other: F.coalesce(number(x), F.lit(other))
    bracket = lambda b: F.concat(F.lit("  "), end(b["min_kg"], "0"), F.lit("-"), end(b["max_kg"], "∞"), F.lit("kg: "), F.coalesce(b["dose"], F.lit("")))
    lines = lambda r: F.concat(F.array(F.concat(F.lit("By "), r["basis"], F.lit(":"))), F.transform(r["brackets"], bracket))
    whole = F.filter(rules, lambda r: r["basis"].isNotNull() & r["brackets"].isNotNull())
    return F.array_join(F.flatten(F.transform(whole, lines)), "\n")


def fields_of(intent: Column) -> Column:
    names = lambda x: F.array(*map(F.lit, x))
    out = names(OTHER_FIELDS)
    for name, fields in FIELDS.items():
        out = F.when(intent == name, names(fields)).otherwise(out)
    return out


def evidence(content: Column, intent: Column, title: Column, aspects: Column, document: Column) -> Column:
    """The evidence text of a chunk for an intent; content is JSON by language, of which English counts.

    Its parts, with an empty line between them: the topic; the intent's fields, texts under their names and dosing rules
    as lines; the aspects' fields that these leave out; the source. What is empty, no text, or says that it failed is
    left out. Without English content the text is empty.
    """
    wanted = fields_of(intent)
    more = F.filter(F.array_except(F.coalesce(aspects, F.array().cast("array<string>")), wanted), lambda a: a != "dosage_rules")
    label = lambda name, x: F.concat(F.lit(name), F.nullif(x, F.lit("")))

    def said(held: Column, field: Column) -> Column:
        def one(value: Column) -> Column:
            structured = F.startswith(value, F.lit("[")) | F.startswith(value, F.lit("{"))
            rules = F.when((field == "dosage_rules") & F.startswith(value, F.lit("[")), F.concat(F.lit("Dosage:\n"), let(F.from_json(value, RULES), dosing)))
            return F.when(structured, rules).otherwise(F.concat(titled(field), F.lit(":\n"), told(value)))

        return let(F.try_element_at(held, field), one)

    def whole(held: Column) -> Column:
        parts = F.concat(F.array(label("Topic: ", title)), F.transform(F.concat(wanted, more), lambda f: said(held, f)), F.array(label("Source: ", document)))
        return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n")

    return let(in_language(content, "en"), lambda body: F.when(body.isNull(), "").otherwise(let(F.from_json(body, "map<string, string>"), whole)))


def generation(content: Column, answer: Column, weight: Column) -> Column:
    """(generate, reason) of a chunk: whether its answer needs to be put into words, and why.

    Not without English content, with dosing rules and a known weight, with an answer of over LEAST characters that
    isn't a mere list (over three bullets and under two sentence ends), or with a field that answers on its own.
    """
    whole = (F.length(answer) > LEAST) & ~compiler_error(answer)
    bullets, ends = F.regexp_count(answer, F.lit("(?m)^[•\\-*]\\s")), F.regexp_count(answer, F.lit("[.!?]\\s"))
    outcome = lambda yes, why: F.struct(F.lit(yes).alias("generate"), F.lit(why).alias("reason"))

    def judged(held: Column) -> Column:
        field = lambda name: F.try_element_at(held, F.lit(name))
        out = F.when(held.isNull(), outcome(False, "no content")).when((F.length(field("dosage_rules")) > 0) & weight.isNotNull(), outcome(False, "dose is computed"))
        out = out.when(whole & (bullets > 3) & (ends < 2), outcome(True, "list")).when(whole, outcome(False, "answer"))
        for name in COMPLETE:
            out = out.when((F.length(field(name)) > LEAST) & ~compiler_error(field(name)), outcome(False, name))
        return out.otherwise(outcome(True, "no answer"))

    return let(F.from_json(in_language(content, "en"), "map<string, string>"), judged)
