"""Chunks as readable text: one renderer for each of the six chunk types, over typed nested content, and whole decision trees by depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgrid.functions.tokens import let

# The content of the six chunk types.
FAQ = "question string, answer string, details string"
DRUG_TABLE = "drug_name string, rows array<struct<weight_range string, dose string, route string, frequency string, duration string>>, watch_for array<string>, refer_if array<string>"
DECISION_TREE = "entry_node string, nodes map<string, struct<question string, options array<struct<label string, next string>>, action string, refer string>>"
PROTOCOL = "title string, steps array<string>, notes string"
DANGER_SIGN = "sign string, severity string, immediate_action string, refer_urgency string, handover_info string"
CALCULATOR = "title string, inputs array<struct<label string>>, output_unit string"

# What renderers say around the content.
NO_CONTENT = "No content available in this language."
NO_TREE = "Decision tree is not available in this language."
OPTIONS, ACTION, REFER = "Tap an option to continue:", "✅ ", "🚨 "
WATCH_FOR, REFER_IF = "⚠️ Watch for:", "🏥 Refer immediately if:"
EMERGENCY, URGENT, IMMEDIATE = "🚨 EMERGENCY", "⚠️ URGENT", "Immediate action:"
REFER_WHEN, HANDOVER = "Refer: ", "Tell the facility: "
NOTES, CALCULATE, ENTER = "💡 ", "📐 ", "Enter the required value:"
RESULT = ("Result will show in ", ".")


def _lines(*parts: Column) -> Column:
    """Lines of all parts in order; a part is an array of lines, or null for none."""
    return F.array_join(F.filter(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]), lambda x: x.isNotNull()), "\n")


def _line(*parts: str | Column) -> Column:
    """One line of texts and columns; a null column is an empty text."""
    return F.array(F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _if(said: Column, *lines: Column) -> Column:
    """The lines, after an empty one, where a text is there and not empty."""
    return F.when(F.coalesce(F.length(said), F.lit(0)) > 0, F.concat(_line(""), *lines))


def _list(items: Column, title: str) -> Column:
    """A titled list after an empty line, where there are items."""
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, F.concat(_line(""), _line(title), F.transform(items, lambda x: F.concat(F.lit("  – "), F.coalesce(x, F.lit(""))))))


def _numbered(items: Column) -> Column:
    return F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(x, F.lit(""))))


def faq(c: Column) -> Column:
    """The question, the answer and its details, each if there."""
    question = F.when(F.length(c["question"]) > 0, _line(c["question"]))
    return _lines(question, _if(c["answer"], _line(c["answer"])), _if(c["details"], _line(c["details"])))


def drug_table(c: Column) -> Column:
    """A line per weight range, then what to watch for and when to refer."""
    said = lambda x: F.coalesce(x, F.lit(""))
    row = lambda r: F.concat(F.lit("• "), said(r["weight_range"]), F.lit(": "), said(r["dose"]), F.lit(" — "), said(r["route"]), F.lit(", "), said(r["frequency"]), F.lit(", for "), said(r["duration"]))
    return _lines(_line(c["drug_name"], " Dosing"), _line(""), F.transform(c["rows"], row), _list(c["watch_for"], WATCH_FOR), _list(c["refer_if"], REFER_IF))


def decision_tree(c: Column) -> Column:
    """The entry node: its question with numbered options, else its action, else its referral."""
    entry = F.try_element_at(c["nodes"], c["entry_node"])
    there = lambda x: F.coalesce(F.length(x), F.lit(0)) > 0
    asked = F.concat(_line(entry["question"], "\n"), _line(OPTIONS), F.coalesce(_numbered(F.transform(entry["options"], lambda o: o["label"])), F.array().cast("array<string>")))
    said = F.when(there(entry["question"]), _lines(asked)).when(there(entry["action"]), F.concat(F.lit(ACTION), entry["action"])).when(there(entry["refer"]), F.concat(F.lit(REFER), entry["refer"])).otherwise("")
    return F.when(entry.isNull(), NO_TREE).otherwise(said)


def protocol(c: Column) -> Column:
    """The title, numbered steps and notes."""
    return _lines(_line(c["title"]), _line(""), _numbered(c["steps"]), _if(c["notes"], _line(NOTES, c["notes"])))


def danger_sign(c: Column) -> Column:
    """The sign under its severity, what to do at once, whether to refer and what to tell."""
    label = F.when(c["severity"] == "emergency", EMERGENCY).otherwise(URGENT)
    head = F.concat(_line(label, ": ", c["sign"]), _line(""), _line(IMMEDIATE), _line(c["immediate_action"]))
    return _lines(head, _if(c["refer_urgency"], _line(REFER_WHEN, c["refer_urgency"])), _if(c["handover_info"], _line(HANDOVER, c["handover_info"])))


def calculator(c: Column) -> Column:
    """The title, the inputs to enter and the unit of the result."""
    return _lines(_line(CALCULATE, c["title"]), _line(""), _line(ENTER), F.transform(c["inputs"], lambda x: F.concat(F.lit("• "), F.coalesce(x["label"], F.lit("")))), _line(""), _line(RESULT[0], c["output_unit"], RESULT[1]))


RENDERERS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "faq": (FAQ, faq),
    "drug_table": (DRUG_TABLE, drug_table),
    "decision_tree": (DECISION_TREE, decision_tree),
    "protocol": (PROTOCOL, protocol),
    "danger_sign": (DANGER_SIGN, danger_sign),
    "calculator": (CALCULATOR, calculator),
}


def in_language(content: Column, language: Column | str, fallback: str = "en") -> Column:
    """One language's body, as JSON, of a JSON object keyed by language; the fallback's where that is missing or null."""
    key = F.lit(language) if isinstance(language, str) else language
    body = lambda bodies, key: F.nullif(F.try_element_at(bodies, key), F.lit("null"))
    return let(F.from_json(content, "map<string, string>"), lambda bodies: F.coalesce(body(bodies, key), body(bodies, F.lit(fallback))))


def rendered(kind: Column, content: Column, language: Column | str = "en") -> Column:
    """The text of a chunk of a type and its content (JSON, keyed by language); another type's body is given as it stands.

    Content that isn't JSON, or has neither the language nor English, is told to be missing.
    """

    def said(body: Column) -> Column:
        out = F.when(body.isNull(), NO_CONTENT)
        for name, (schema, renderer) in RENDERERS.items():
            out = out.when(kind == name, let(F.from_json(body, schema), renderer))
        return out.otherwise(body)

    return let(in_language(content, language), said)


def tree_outline(body: Column) -> Column:
    """Every node of a decision tree (JSON) from its entry on, one line each, indented by its depth: the label that leads there, and what the node says.

    A fold along the tree with a stack: as many steps as the tree has options and its entry. A node that has been told
    before, and one that does not exist, is named by its label alone, so trees that share nodes or run in circles end.
    """
    return let(F.from_json(body, DECISION_TREE), _outlined)


def _outlined(c: Column) -> Column:
    frame = "array<struct<node string, label string, depth int>>"
    n_options = F.aggregate(F.map_values(c["nodes"]), F.lit(0), lambda a, x: a + F.greatest(F.size(F.coalesce(x["options"], F.array().cast("array<struct<label string, next string>>"))), F.lit(0)))
    begin = F.struct(
        F.array(F.struct(c["entry_node"].alias("node"), F.lit("").alias("label"), F.lit(0).alias("depth"))).cast(frame).alias("stack"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("lines")
    )

    def step(a: Column) -> Column:
        top = F.get(a["stack"], F.lit(0))
        node = F.when(F.array_contains(a["seen"], top["node"]), F.lit(None)).otherwise(F.try_element_at(c["nodes"], top["node"]))
        says = F.coalesce(F.nullif(node["question"], F.lit("")), F.concat(F.lit(ACTION), F.nullif(node["action"], F.lit(""))), F.concat(F.lit(REFER), F.nullif(node["refer"], F.lit(""))), F.lit(""))
        line = F.concat(F.repeat(F.lit("  "), top["depth"]), F.array_join(F.filter(F.array(top["label"], says), lambda x: x != ""), ": "))
        below = F.transform(F.coalesce(node["options"], F.array().cast("array<struct<label string, next string>>")), lambda o: F.struct(o["next"].alias("node"), o["label"].alias("label"), (top["depth"] + 1).alias("depth")))
        stack = F.concat(below.cast(frame), F.slice(a["stack"], 2, 1_000_000))
        return F.struct(stack.alias("stack"), F.array_append(a["seen"], top["node"]).alias("seen"), F.array_append(a["lines"], line).alias("lines"))

    lines = F.aggregate(F.sequence(F.lit(0), n_options), begin, lambda a, _: F.when(F.size(a["stack"]) == 0, a).otherwise(step(a)), lambda a: a["lines"])
    return F.when(c["nodes"].isNotNull() & c["entry_node"].isNotNull(), F.array_join(lines, "\n"))
