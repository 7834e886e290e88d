"""Projections of chunk content (JSON text) into artifacts, drug tables and decision trees, and look-ups in them.

chunks: (id, type, content, document), content being a JSON object.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = "array<struct<minKg:double,maxKg:double,dose:string,notes:string>>"
NODES = "map<string,struct<type:string,question:string,title:string,instruction:string,linkedDrug:string,urgency:string,options:array<struct<id:string,label:string,next:string>>>>"


def field(name: str, default: Column | str | None = None) -> Column:
    """A field of the content as text, the default where it is missing."""
    found = F.get_json_object("content", f"$.{name}")
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def artifacts(chunks: DataFrame, sources: DataFrame, publisher: str = "FMOH", year: int = 2024) -> DataFrame:
    """(id, title, publisher, year, topics): the sources that the manifest names if there are any, else protocol and faq chunks with defaults for what they lack. sources: (id, title, publisher, year)."""
    named = sources.select("id", "title", "publisher", F.col("year").cast("int"), F.array().cast("array<string>").alias("topics"))
    topics = F.from_json(field("topics"), "array<string>")
    own = chunks.filter(F.col("type").isin("protocol", "faq")).select(
        "id",
        field("title", F.col("id").cast("string")).alias("title"),
        field("publisher", publisher).alias("publisher"),
        field("year", str(year)).cast("int").alias("year"),
        F.when(F.size(F.coalesce(topics, F.array())) > 0, topics).otherwise(F.slice(F.json_object_keys("content"), 1, 5)).alias("topics"),
    )
    return named if not sources.isEmpty() else own


def drug_tables(chunks: DataFrame) -> DataFrame:
    """(id, name, route, form, frequency, duration, ranges, document) of the drug_table chunks, with defaults."""
    return chunks.filter("type = 'drug_table'").select(
        "id",
        field("name", F.col("id").cast("string")).alias("name"),
        field("route", "oral").alias("route"),
        field("form", "tablet").alias("form"),
        field("frequency", "once daily").alias("frequency"),
        field("duration", "5 days").alias("duration"),
        F.coalesce(F.from_json(field("weightRanges"), RANGES), F.array().cast(RANGES)).alias("ranges"),
        "document",
    )


def decision_trees(chunks: DataFrame) -> DataFrame:
    """(id, name, entry, node, node_type, question, options): one row per node of the decision_tree chunks; the entry is the first node if none is named, a node without a type is a branch."""
    trees = chunks.filter("type = 'decision_tree'").select("id", field("name", F.col("id").cast("string")).alias("name"), F.coalesce(field("entryNode"), F.get(F.json_object_keys(field("nodes")), 0), F.lit("")).alias("entry"), F.from_json(field("nodes"), NODES).alias("nodes"))
    return trees.select("id", "name", "entry", F.explode("nodes").alias("node", "n")).select("id", "name", "entry", "node", F.coalesce("n.type", F.lit("branch")).alias("node_type"), "n.question", F.coalesce(F.size("n.options"), F.lit(0)).alias("n_options"))


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the given ids; ids: one column named key."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def chunks_or_fallback(chunks: DataFrame, table: DataFrame, most: int = 5000) -> DataFrame:
    """chunks, or the first `most` rows of the table (id, ...) by id if there are none; both have the same columns."""
    return table.orderBy("id").limit(most) if chunks.isEmpty() else chunks


def _said(x) -> str:
    if isinstance(x, dict):
        x = list(x.values())
    return x if isinstance(x, str) else " ".join(map(_said, x)) if isinstance(x, list) else ""


def all_text(content: Column) -> Column:
    """All strings of a JSON value, whatever its shape, in order, with spaces between; empty if it isn't JSON."""

    def one(text: str | None) -> str:
        try:
            return _said(json.loads(text or "null"))
        except ValueError:
            return ""

    @F.pandas_udf("string")
    def found(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in contents:
            yield batch.map(one)

    return found(content)
