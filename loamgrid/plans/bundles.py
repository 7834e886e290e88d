"""Queries on bundle files that Spark writes from the tables and reads back; with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loamgrid.plans.retrieval import table
from loamgrid.shared import numbered, shared_dir
from loamgrid.sources import vector_file as V

ROWS_PER_FILE = 100_000


def vector_import(spark, sf_dir):
    """Embeddings written as vector files by label and imported with checks.

    Planted: norms of 1.2, files of other dimensions, records out of place, files with too few records, chunks that nothing is known of.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    placed = numbered(e, "label", ["vec_id"]).select("*", (F.col("idx") % ROWS_PER_FILE).alias("ord"), F.concat("label", F.lit("-"), F.floor(F.col("idx") / ROWS_PER_FILE).cast("string"), F.lit(".bin")).alias("file"))
    scaled = F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: (x * 1.2).cast("float"))).otherwise(F.col("embedding"))
    folder = f"{shared_dir(spark)}/loamgrid-{uuid.uuid4().hex}/vectors"
    V.write_vectors(placed.select("file", "ord", F.when(F.col("label") % 5 == 3, F.slice(scaled, 1, 63)).otherwise(scaled).alias("embedding")), folder)
    known = placed.filter((F.col("label") % 5 != 4) | (F.col("vec_id") % 11 > 0))
    records = known.select("file", F.when(F.col("vec_id") % 13 == 0, F.col("ord") + 1_000_000).otherwise(F.col("ord")).alias("ord"), F.col("vec_id").alias("chunk_id"))
    chunks = placed.filter("vec_id % 3 > 0").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("v"), "vec_id").alias("title"), F.lit("vector").alias("type"), F.col("label").alias("text"))
    imported, rejects = V.import_vectors(spark, folder, records, chunks, dimensions=64)
    good = imported.select("file", "ord", "chunk_id", "title", "type", F.round(F.col("embedding")[63].cast("double"), 6).alias("last_value"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(rejects, allowMissingColumns=True)


QUERIES = {f.__name__: f for f in (vector_import,)}

ORACLES = {
    "vector_import": f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings),
f AS (SELECT *, i % {ROWS_PER_FILE} AS ord, label || '-' || i // {ROWS_PER_FILE} || '.bin' AS file, CASE WHEN label % 5 = 4 THEN vec_id % 11 > 0 ELSE true END AS listed FROM p),
j AS (SELECT file, CASE WHEN any_value(label) % 5 = 3 THEN 'dimension' WHEN count(*) FILTER (listed) < count(*) THEN 'count' END AS bad FROM f GROUP BY file),
r AS (SELECT f.*, CASE WHEN vec_id % 7 = 0 THEN 'norm' WHEN vec_id % 13 = 0 THEN 'record' END AS reason FROM f JOIN j USING (file) WHERE bad IS NULL)
SELECT file, NULL AS ord, NULL AS chunk_id, NULL AS title, NULL AS type, NULL AS last_value, bad AS reason FROM j WHERE bad IS NOT NULL
UNION ALL SELECT file, ord, NULL, NULL, NULL, NULL, reason FROM r WHERE reason IS NOT NULL
UNION ALL SELECT file, ord, vec_id, CASE WHEN vec_id % 3 > 0 THEN 'v' || vec_id ELSE CAST(vec_id AS VARCHAR) END, CASE WHEN vec_id % 3 > 0 THEN 'vector' ELSE '' END, round(CAST(embedding[64] AS DOUBLE), 6), NULL FROM r WHERE reason IS NULL""",
}
