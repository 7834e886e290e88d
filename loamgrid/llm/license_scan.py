"""License scan by diagonal voting (DataFrame functions only).

Every rolling run of k words of every document is joined by hash to its places in a list of templates: phrases and
notices of any length, up to whole licence texts. Hits on one diagonal (place in the document less place in the
template) stand for one occurrence; hits of neighbouring diagonals are merged, so that a few inserted or missing words
do no harm. A merged span drifts by a quarter of its template at most, and is verified: only hits whose words stand in
both texts in the same order count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import text_of, written

# The phrases whose exact places count, and the label of each.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Well-known notices and licence texts, and the label of each.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0-header",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
}

SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
OUTPUT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _lowered(text: Column) -> Column:
    """A to Z in lower case, the rest as it is: letters that only their small form makes ASCII keep apart."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(odd, F.translate(text, capitals, capitals.lower())).otherwise(F.lower(text))


def _templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """One row per pair of neighbouring words of each template, and one (template -1) that every document hits."""
    rows = [(k, label, base, len(text.split())) + (i, *text.split()[i : i + 2]) for k, (text, label, base) in enumerate([*((t, x, True) for t, x in phrases.items()), *((t, x, False) for t, x in notices.items())]) for i in range(len(text.split()) - 1)]
    pairs = spark.createDataFrame(rows, "template int, label string, base boolean, length int, at int, w1 string, w2 string")
    anchor = spark.range(1).selectExpr("-1 template", "cast(null as string) label", "false base", "1 length", "0 at", "cast(null as string) w1", "cast(null as string) w2", "0L h")
    return pairs.withColumn("h", F.xxhash64("w1", "w2")).unionByName(anchor)


def _rising(places: Column) -> Column:
    """As many values as the longest rising sequence among places has: of each length so far the least last value."""
    step = lambda ends, x: F.concat(F.filter(ends, lambda e: e < x), F.array(x), F.slice(F.filter(ends, lambda e: e >= x), 2, 1_000_000))
    return F.aggregate(places, F.array().cast("array<int>"), step)


def license_scan(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, least: float = 0.75, apart: int = 3
) -> DataFrame:
    """One row per row of docs: doc_id and the columns of OUTPUT.

    A phrase counts where all its words stand one after another (n_base places; first_word and last_word are their
    smallest and largest starts). A notice is found where at least the share `least` of its word pairs is hit, in the
    notice's order, on diagonals that differ by a quarter of its length at most (by `apart` if that is more); the words
    themselves are compared, not only hashes. labels holds the labels of both, score the largest share found (0 if none). Null and empty texts give zeros, empty label
    strings and null places; rows with equal or null ids stay apart; other columns of docs are not carried, whatever their names.
    """
    spark = docs.sparkSession
    words = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.array_remove(F.split(_lowered(text_of(text)), SPLIT), "").alias("words"))
    n = F.size("words")
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1)))).otherwise(F.array().cast("array<bigint>"))
    rolling = words.withColumns({"n_words": n.cast("long"), "hashes": F.concat(F.array(F.lit(0).cast("long")), pairs)})
    rolling = rolling.select("row", "doc_id", "n_words", "words", F.posexplode("hashes").alias("at1", "h"))
    # The templates are a fixed list of a few hundred rows.
    hits = rolling.join(F.broadcast(_templates(spark, phrases or PHRASES, notices or NOTICES)), "h")
    same = (F.get("words", F.col("at1") - 1) == F.col("w1")) & (F.get("words", F.col("at1")) == F.col("w2"))
    hits = hits.filter((F.col("template") < 0) | same)
    one = ["row", "doc_id", "n_words", "template", "label", "base", "length"]
    voted = hits.groupBy(*one, (F.col("at1") - 1 - F.col("at")).alias("diagonal")).agg(F.sort_array(F.collect_list("at")).alias("hit"))
    voted = voted.filter((F.col("template") < 0) | (F.size("hit") >= F.when(F.col("base"), F.col("length") - 1).otherwise(2)))
    voted = written(voted, "voted")
    exact = voted.filter((F.col("template") < 0) | F.col("base")).select(*one, F.col("diagonal").cast("long").alias("start"), F.when(F.col("base"), 1.0).otherwise(0.0).alias("share"))
    slack = F.greatest(F.lit(apart), F.ceil(F.col("length") / 4)).cast("int")
    loose = voted.filter((F.col("template") >= 0) & ~F.col("base")).withColumn("slack", slack).withColumn("scaled", F.col("diagonal") / F.col("slack"))
    near = "sum(size(hit)) over (partition by row, template order by scaled range between current row and 1.000001D following) as votes"
    begins = loose.selectExpr("*", near).filter(F.col("votes") >= least * (F.col("length") - 1)).withColumn("begin", F.col("diagonal"))
    # Diagonals meet the beginnings that reach them by stretches of the slack.
    stretch = F.floor(F.col("diagonal") / F.col("slack"))
    begins = begins.select(*one, "begin", "slack", F.explode(F.array(stretch, stretch + 1)).alias("stretch"))
    reached = begins.join(loose.select("row", "template", "diagonal", "hit", stretch.alias("stretch")), ["row", "template", "stretch"]).filter((F.col("diagonal") >= F.col("begin")) & (F.col("diagonal") <= F.col("begin") + F.col("slack")))
    points = F.transform("hit", lambda at: F.struct((F.col("diagonal") + at).alias("place"), (-at).alias("back")))
    merged = reached.groupBy(*one, "begin").agg(F.sort_array(F.flatten(F.collect_list(points))).alias("points"))
    spans = merged.withColumn("share", F.size(_rising(F.transform("points", lambda p: -p["back"]))) / (F.col("length") - 1)).filter(F.col("share") >= least)
    spans = exact.unionByName(spans.select(*one, F.col("begin").cast("long").alias("start"), "share"))
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    place = F.when(F.col("base"), F.col("start"))
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(place).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        labels(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        labels("label").alias("labels"),
        F.max("share").alias("score"),
    ).select("doc_id", *OUTPUT)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    rows = ", ".join(f"({k}, '{t}', '{label}', {base})" for k, (t, label, base) in enumerate([*((t, x, "true") for t, x in PHRASES.items()), *((t, x, "false") for t, x in NOTICES.items())]))
    return rf"""
WITH t AS (SELECT k, string_split(txt, ' ') AS tw, label, base FROM (VALUES {rows}) v(k, txt, label, base)),
tp AS (SELECT k, label, base, len(tw) AS n, i AS tpos, tw[i] AS w1, tw[i + 1] AS w2 FROM (SELECT *, unnest(range(1, len(tw))) AS i FROM t)),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, i, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d)),
h AS (SELECT r, k, label, base, n, i - tpos AS diag, tpos FROM p JOIN tp USING (w1, w2)),
v AS (SELECT r, k, label, base, n, diag, list(DISTINCT tpos) AS hit FROM h GROUP BY ALL HAVING len(list(DISTINCT tpos)) >= CASE WHEN base THEN n - 1 ELSE 2 END),
q AS (SELECT *, greatest(3, CAST(ceil(n / 4) AS INT)) AS slack FROM v WHERE NOT base),
b AS (SELECT *, sum(len(hit)) OVER (PARTITION BY r, k ORDER BY diag / slack RANGE BETWEEN CURRENT ROW AND 1.000001 FOLLOWING) AS votes FROM q),
u AS (SELECT b.r, b.k, b.label, b.n, b.diag AS start, q.diag, unnest(q.hit) AS tpos FROM b JOIN q ON b.r = q.r AND b.k = q.k AND q.diag BETWEEN b.diag AND b.diag + b.slack WHERE b.votes >= 0.75 * (b.n - 1)),
z AS (SELECT r, k, label, n, start, list([tpos] ORDER BY diag + tpos, -tpos) AS pts FROM u GROUP BY r, k, label, n, start),
y AS (SELECT r, label, start, len(list_reduce(pts, lambda e, x: list_concat(list_concat(list_filter(e, lambda i: i < x[1]), x), list_slice(list_filter(e, lambda i: i >= x[1]), 2, 100000)))) / (n - 1) AS share FROM z),
s AS (SELECT r, label, true AS base, diag AS start, 1.0 AS share FROM v WHERE base UNION ALL SELECT r, label, false, start, share FROM y),
f AS (SELECT r, CAST(count(*) FILTER (base) AS BIGINT) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM s WHERE share >= 0.75 GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN f USING (r)"""


ORACLE = _oracle()
