"""A whole search for many queries at once: both ranked lists, gates, fusion, graph boost and escape, with one nested record each.

The lists are short, so a query's entries meet in one row, and every stage after that is an expression on it: one
grouping for the whole run, in place of one or two for every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.operators import retrieval as R

# The constant of fusion, the weight of a graph edge, the score of an edge without one, the vector gate and the floors.
FUSION, EDGE_WEIGHT, EDGE_DEFAULT = 60, 0.25, 0.5
LEAST_VECTOR, LEAST_MARGIN, LEAST_BM25 = 0.3, 0.10, 1.5


def _by_score(entries: Column) -> Column:
    """Best score first, then the smaller chunk_id."""
    return F.array_sort(entries, lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).otherwise(F.when(a["chunk_id"] < b["chunk_id"], -1).when(a["chunk_id"] > b["chunk_id"], 1).otherwise(0)))


def respond(words: DataFrame, vectors: DataFrame, last: DataFrame, served: DataFrame, edges: DataFrame, *, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, route, diagnostics), one row per query that either list has.

    words and vectors: (query_id, chunk_id, score); the best k of each count. last: (query_id, last_chunk); served:
    (query_id, chunk_id); edges: (src, dst, ord, edge_score). Vectors are fused with words if they pass their gate, or
    if there are no words. Where neither signal reaches its floor, chunk_id is null and the route `none`; else it is the
    best fused entry that was not served (`fresh`), else the first such neighbour of the last chunk (`graph`), else the
    best one (`repeat`). diagnostics: the best of each list, the fused score of the answer, the margin, and whether the
    gate passed and the floor stopped the search.
    """
    listed = lambda df, kind: R.ranked(df.select("query_id", "chunk_id", "score"), "query_id", k=k).withColumn("kind", F.lit(kind))
    entries = listed(words, "w").unionByName(listed(vectors, "v"))
    boosts = last.join(R.first_edges(edges).withColumnRenamed("src", "last_chunk"), "last_chunk").select("query_id", F.col("dst").alias("chunk_id"), F.col("edge_score").alias("boost"))
    flagged = entries.join(served.select("query_id", "chunk_id").distinct().withColumn("old", F.lit(True)), ["query_id", "chunk_id"], "left").join(boosts, ["query_id", "chunk_id"], "left")
    hops = last.join(edges.withColumnsRenamed({"src": "last_chunk", "dst": "chunk_id"}), "last_chunk").join(served, ["query_id", "chunk_id"], "left_anti")
    hop = hops.groupBy("query_id").agg(F.min(F.struct("ord", "chunk_id", "edge_score")).alias("hop"))
    entry = F.struct("kind", "rank", "chunk_id", "score", F.coalesce("old", F.lit(False)).alias("old"), F.coalesce("boost", F.lit(0.0)).alias("boost"))
    rows = flagged.groupBy("query_id").agg(F.collect_list(entry).alias("all")).join(hop, "query_id", "left")

    of = lambda kind: _by_score(F.filter("all", lambda x: x["kind"] == kind))
    rows = rows.withColumns({"w": of("w"), "v": of("v")})
    top = lambda c, i=0: F.get(F.col(c), F.lit(i))["score"]
    margin = F.when(top("v", 1) > 0, (top("v") - top("v", 1)) / top("v", 1))
    passed = (top("v") >= LEAST_VECTOR) & F.coalesce(margin >= LEAST_MARGIN, F.lit(True))
    use = F.when(F.size("w") > 0, F.coalesce(passed, F.lit(False))).otherwise(F.size("v") > 0)
    rows = rows.withColumns({"margin": margin, "use": use})
    confident = R.confident(top("w"), F.col("use"), top("v"), LEAST_BM25, LEAST_VECTOR)
    used = F.concat("w", F.when(F.col("use"), F.col("v")).otherwise(F.slice("v", 1, 0)))
    rows = rows.withColumns({"confident": confident, "used": used})

    def fused(chunk: Column) -> Column:
        own = F.filter("used", lambda x: x["chunk_id"] == chunk)
        score = F.round(F.aggregate(own, F.lit(0.0), lambda a, x: a + 1 / (F.lit(FUSION) + x["rank"])), 6)
        return F.struct(score.alias("score"), chunk.alias("chunk_id"), own[0]["old"].alias("old"), own[0]["boost"].alias("boost"))

    rows = rows.withColumn("fused", _by_score(F.transform(F.array_distinct(F.transform("used", lambda x: x["chunk_id"])), fused)))
    boosted = lambda x, route: F.struct(x["chunk_id"].alias("chunk_id"), (x["score"] + EDGE_WEIGHT * x["boost"]).alias("score"), F.lit(route).alias("route"))
    fresh = F.get(F.filter("fused", lambda x: ~x["old"]), F.lit(0))
    linked = F.struct(F.col("hop.chunk_id").alias("chunk_id"), F.coalesce("hop.edge_score", F.lit(EDGE_DEFAULT)).alias("score"), F.lit("graph").alias("route"))
    best = F.get("fused", F.lit(0))
    chosen = F.when(fresh.isNotNull(), boosted(fresh, "fresh")).when(F.col("hop").isNotNull(), linked).otherwise(boosted(best, "repeat"))
    rows = rows.withColumn("chosen", F.when(F.col("confident"), chosen))
    found = F.struct(
        top("w").alias("top_bm25"), top("v").alias("top_vector"), F.round("chosen.score", 6).alias("fused"), F.round("margin", 6).alias("margin"), F.col("use").alias("vector_gate_passed"), (~F.col("confident")).alias("confidence_gate_fired"),
    )
    return rows.select("query_id", "chosen.chunk_id", F.round("chosen.score", 6).alias("score"), F.coalesce("chosen.route", F.lit("none")).alias("route"), found.alias("diagnostics"))
