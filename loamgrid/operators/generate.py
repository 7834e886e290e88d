"""Synthetic questions from templates: filled, varied and made unique, the same ones in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions import variation as G

# The weights that a template's {weight} stands for, and the dose per kg of a response's {dose}.
WEIGHTS, DOSE_PER_KG = [5, 8, 10, 12, 15, 18, 20, 25, 30], 15


def generated(templates: DataFrame, slots: dict[str, list[str]], typos: dict[str, list[str]], words: dict[str, list[str]], *, keys: list[str], least: int = 2, most: int = 4, seed: int = 1) -> DataFrame:
    """Questions from templates (keys, template, response): the keys, nth, kind, query and response, each query once.

    A template has least to most variations, by draw. Its slots and {weight} are filled, the response's {weight} and
    {dose} follow, and the query is varied. Of queries that are equal but for case the one of the least keys and nth
    stays. keys name a row: rows of equal keys draw alike. Null templates have no queries; a null response stays null.
    """
    key = [F.col(k) for k in keys]
    number = F.lit(least) + F.floor(G.draw(seed, "number", *key) * (most - least + 1)).cast("int")
    rows = templates.filter(F.col("template").isNotNull()).withColumn("nth", F.explode(F.sequence(F.lit(1), number)))
    row = [*key, F.col("nth")]
    weight = G.chosen(WEIGHTS, G.draw(seed, "weight", *row))
    rows = rows.withColumns({"weight": weight, "filled": F.replace(G.filled(F.col("template"), slots, seed, *row), F.lit("{weight}"), weight.cast("string"))})
    rows = rows.withColumn("varied", G.varied(F.col("filled"), typos, words, seed, *row))
    said = lambda c, name, value: F.replace(c, F.lit(name), value.cast("string"))
    rows = rows.withColumn("response", said(said(F.col("response"), "{weight}", F.col("weight")), "{dose}", F.col("weight") * DOSE_PER_KG))
    first = F.min(F.struct(*keys, "nth", "varied.kind", F.col("varied.text").alias("query"), "response")).alias("first")
    return rows.groupBy(F.sha2(F.lower("varied.text").cast("binary"), 256).alias("same")).agg(first).select("first.*")
