"""Queries on answers and slots as they flow, in one batch and as streams over the same table; with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loamgrid.plans.retrieval import table
from loamgrid.shared import shared_dir
from loamgrid.streaming import flow as W

MOST = 3


def _chunks(turns):
    """Each turn as a chunk of its conversation's answer; what it is follows from the length of its text."""
    n = F.length("text")
    kind = F.when(n % 13 == 0, "complete").when(n % 7 == 0, "other").otherwise("chunk")
    return turns.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("ord"), kind.alias("kind"), "text", F.lit("2024-01-01").cast("timestamp").alias("ts"))


def _slots(turns):
    n = F.length("text")
    return turns.select("conv_id", "turn", F.when(n % 5 == 0, F.concat("role", F.lit(" "), n)).alias("slot"))


def _stream(spark, sf_dir, name):
    path = f"{sf_dir}/{name}.parquet"
    # As a pattern, since a table may be one file, which a stream does not take for its folder.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _drained(rows):
    """What a stream has given when all its input is read, as a table in the shared folder."""
    folder = f"{shared_dir(rows.sparkSession)}/loamgrid-{uuid.uuid4().hex}"
    query = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/out")


def capped_answers(spark, sf_dir):
    """Conversations as answers that end at their third chunk or where they are complete."""
    out = W.capped_answers(_chunks(table(spark, sf_dir, "conversations")), MOST)
    return out.select("answer_id", "chunks", "finish", F.md5("text").alias("text_md5"))


def streamed_answers(spark, sf_dir):
    """The same as a stream: answers that have ended."""
    out = _drained(W.streamed_answers(_chunks(_stream(W.with_state_store(spark), sf_dir, "conversations")), MOST))
    return out.select("answer_id", "chunks", "finish", F.md5("text").alias("text_md5"))


def streamed_slots(spark, sf_dir):
    """What the last turn told of, for two turns after it, as a stream."""
    return _drained(W.streamed_slots(_slots(_stream(W.with_state_store(spark), sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (capped_answers, streamed_answers, streamed_slots)}

_CAPPED = f"""WITH t AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations), k AS (SELECT *, CASE WHEN n % 13 = 0 THEN 'complete' WHEN n % 7 = 0 THEN 'other' ELSE 'chunk' END AS kind FROM t),
b AS (SELECT *, coalesce(sum(CASE kind WHEN 'chunk' THEN 1 WHEN 'complete' THEN {MOST} ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
a AS (SELECT conv_id AS answer_id, count(*) FILTER (kind = 'chunk') AS chunks, bool_or(kind = 'complete') AS complete, coalesce(string_agg(text, '' ORDER BY turn) FILTER (kind = 'chunk'), '') AS text FROM b WHERE before < {MOST} GROUP BY conv_id),
f AS (SELECT answer_id, chunks, CASE WHEN complete THEN 'complete' WHEN chunks >= {MOST} THEN 'cut' ELSE 'open' END AS finish, md5(text) AS text_md5 FROM a)
SELECT * FROM f"""

ORACLES = {
    "capped_answers": _CAPPED,
    "streamed_answers": _CAPPED + " WHERE finish <> 'open'",
    "streamed_slots": f"""WITH t AS (SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 THEN role || ' ' || length(text) END AS slot FROM conversations),
l AS (SELECT *, max(CASE WHEN slot IS NOT NULL THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS since, last_value(slot IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM t)
SELECT conv_id, turn, CASE WHEN turn - since <= {W.TURNS} THEN last END AS slot FROM l""",
}
