"""Approximate nearest neighbours: an inverted file of vectors by cell, stored, read back and probed.

Cells are the nearest of a set of centres. The centres are fitted on a bounded sample by k-means that splits dense parts
further, so cells hold like numbers of rows; every row is then indexed under its cell. A query looks only at the cells
whose centres are nearest to it, as many as the sample shows to be enough. Large cells are searched in parts, and of
vectors that are equal only the first ids are compared, since no other can be among the nearest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.operators.retrieval import ranked

#: Rows of the sample that centres are fitted on, and sampled rows per centre at the least.
MOST_SAMPLE, PER_CENTRE = 32_768, 16
#: Branches of one split, and rounds of k-means in it.
BRANCHES, ROUNDS = 32, 12
#: Vectors and queries of a cell that are compared in one task.
MOST_VECTORS, MOST_QUERIES = 20_000, 2_000


@dataclass
class Index:
    """An inverted file: rows is (chunk_id, embedding, cell), centres one unit vector per cell, probes the cells looked at by default."""

    rows: DataFrame
    centres: np.ndarray
    probes: int


def new_name() -> str:
    return uuid.uuid4().hex


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of unit vectors by cosine; each starts at a point, and one that nothing is nearest to goes to the worst-served point."""
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(ROUNDS):
        alike = points @ centres.T
        own = alike.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        sums[empty] = points[np.argsort(alike.max(axis=1), kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


def _split(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres at the most, dealt out by the number of points in each branch; equal points need but one."""
    k = min(k, len(points))
    if k <= 1 or (points == points[0]).all():
        return _unit(points.mean(axis=0, keepdims=True))
    if k <= BRANCHES:
        return _kmeans(points, k, rng)
    own = (points @ _kmeans(points, BRANCHES, rng).T).argmax(axis=1)
    parts = [points[own == b] for b in range(BRANCHES) if (own == b).any()]
    return np.concatenate([_split(p, max(1, round(k * len(p) / len(points))), rng) for p in parts])


def _enough_probes(points: np.ndarray, centres: np.ndarray, k: int, goal: float) -> int:
    """The least number of cells that hold the goal's share of the k nearest sampled points, over a part of the sample as queries."""
    own, asked = (points @ centres.T).argmax(axis=1), np.arange(0, len(points), max(1, len(points) // 500))
    nearest = np.argpartition(-(points[asked] @ points.T), min(k, len(points) - 1), axis=1)[:, :k]
    order = np.argsort(-(points[asked] @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(asked), 0), axis=1)
    needed = np.sort(np.take_along_axis(place, own[nearest], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(goal * len(needed))))]) + 1


def build_index(vectors: DataFrame, folder: str, *, cells: int | None = None, k: int = 10, goal: float = 0.95, seed: int = 7) -> Index:
    """Fits cells on a sample of vectors (chunk_id, embedding), writes every row under its cell to folder and opens it.

    The sample is drawn by a hash of chunk_id, about MOST_SAMPLE rows or all of a smaller table; cells: about the square
    root of the rows by default, and no more than the sample bears. probes is measured on the sample so that a query
    finds the goal's share of its k nearest. Rows without a vector or of another length than most in the sample are
    indexed under no cell (null), and no search finds them. An empty table gives an index of no cells.
    """
    n = vectors.count()
    drawn = vectors.filter(F.col("embedding").isNotNull() & (F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-n // MOST_SAMPLE)))) == 0))
    sample = drawn.select("chunk_id", "embedding").toPandas().sort_values("chunk_id")["embedding"]
    size = int(sample.map(len).mode().iloc[0]) if len(sample) else 0
    points = _unit(np.array([v for v in sample if len(v) == size], float).reshape(-1, max(1, size)))
    wanted = cells or max(1, round(n**0.5))
    rng = np.random.default_rng(seed)
    centres = _split(points, max(1, min(wanted, len(points) // PER_CENTRE)), rng) if len(points) else np.zeros((0, 1))
    probes = _enough_probes(points, centres, k, goal) if len(points) else 0

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = pd.Series([None] * len(batch), dtype="Int64")
            fits = batch["embedding"].map(lambda v: v is not None and len(v) == size and size > 0).to_numpy(bool)
            if fits.any():
                cell[fits] = (_unit(np.array(batch["embedding"][fits].tolist(), float)) @ centres.T).argmax(axis=1)
            yield batch.assign(cell=cell)

    rows = vectors.select("chunk_id", "embedding")
    placed = rows.mapInPandas(dealt, T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType())]))
    spread = placed.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(1 + n // max(1, len(centres)) // MOST_VECTORS)))
    spread.sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{folder}/rows")  # a probe skips row groups of other cells
    about = vectors.sparkSession.createDataFrame([(json.dumps(centres.tolist()), probes)], "centres string, probes long")
    about.coalesce(1).write.mode("overwrite").parquet(f"{folder}/about")
    return open_index(vectors.sparkSession, folder)


def open_index(spark: SparkSession, folder: str) -> Index:
    about = spark.read.parquet(f"{folder}/about").first()
    return Index(spark.read.parquet(f"{folder}/rows"), np.array(json.loads(about["centres"]), float), about["probes"])


def nearest(index: Index, queries: DataFrame, *, k: int = 10, probes: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best of each query (query_id, embedding) in the cells it probes, by cosine, ties to the smaller chunk_id.

    Cosines are those of the exact search. A cell meets its queries in parts of at most about MOST_VECTORS vectors and
    MOST_QUERIES queries, each of which sends on k rows a query. Queries of another length or without a vector find
    nothing. With probes as large as the number of cells the search is exact.
    """
    centres, probes = index.centres, probes or index.probes
    size = centres.shape[1] if len(centres) else -1
    asked = queries.filter(F.size("embedding") == size).select("query_id", F.col("embedding").alias("qv"))

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some = batch.iloc[at : at + 1000]
                alike = _unit(np.array(some["qv"].tolist(), float)) @ centres.T
                best = np.argsort(-alike, axis=1, kind="stable")[:, :probes]
                yield some.loc[some.index.repeat(best.shape[1])].assign(cell=best.ravel())

    cell = T.StructField("cell", T.LongType())
    q = asked.mapInPandas(probed, T.StructType([*asked.schema.fields, cell]))
    first = Window.partitionBy("cell", "embedding").orderBy("chunk_id")
    v = index.rows.filter(F.col("cell").isNotNull()).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k).drop("nth")
    # At most one row per cell, and the number of cells is bounded by the sample.
    split = lambda df, name, most: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    parts = split(v, "v_parts", MOST_VECTORS).join(split(q, "q_parts", MOST_QUERIES), "cell")
    part = lambda column, parts: F.pmod(F.xxhash64(column), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = q.join(F.broadcast(parts), "cell").withColumn("q_part", part("query_id", "q_parts")).withColumn("v_part", every("v_parts"))
    right = v.join(F.broadcast(parts), "cell").withColumn("v_part", part("chunk_id", "v_parts")).withColumn("q_part", every("q_parts"))
    key = ["cell", "v_part", "q_part"]

    def compared(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        b = b.sort_values("chunk_id", ignore_index=True)
        m = np.array(b["embedding"].tolist(), float).reshape(len(b), -1)
        norms = np.linalg.norm(m, axis=1)
        for at in range(0, len(a) if len(b) else 0, 256):
            some = a.iloc[at : at + 256]
            x = np.array(some["qv"].tolist(), float)
            scores = np.round(x @ m.T / (np.linalg.norm(x, axis=1)[:, None] * norms[None, :] + 1e-10), 6)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": some["query_id"].repeat(best.shape[1]).to_numpy(), "chunk_id": b["chunk_id"].to_numpy()[best.ravel()], "score": np.take_along_axis(scores, best, axis=1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})

    found = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", index.rows.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])
    hits = left.select(*key, "query_id", "qv").groupBy(*key).cogroup(right.select(*key, "chunk_id", "embedding").groupBy(*key)).applyInPandas(compared, found)
    return ranked(hits, "query_id", k=k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (queries, wanted, hit, recall): the share of the exact lists' rows that were found; equal scores at the end of a list count for each other."""
    last = exact.groupBy("query_id").agg(F.min("score").alias("last"), F.count(F.lit(1)).alias("n"))
    good = last.join(found, "query_id", "left").groupBy("query_id", "n").agg(F.count(F.when(F.col("score") >= F.col("last"), 1)).alias("hit"))
    return good.agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("wanted"), F.sum(F.least("n", "hit")).alias("hit")).withColumn("recall", F.round(F.col("hit") / F.col("wanted"), 6))
