"""Sending what arrives to a receiver, in order, exactly once, over failures, partial acceptance and restarts.

Arrived rows are numbered and kept batch by batch; a pointer tells how far the receiver has taken them. Both, and a log
of requests, are tables of one folder, one version per micro-batch. A version follows from the version before, the rows
that arrived and the receiver's answers, so a micro-batch that is repeated after a crash makes the same requests under
the same keys, and a receiver that remembers the keys takes nothing twice. Nothing that has arrived is written again:
while sending is not allowed, only the pointer stands still.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loamgrid.shared import numbered

# Rows of one request, and the time between syncs.
MOST, EVERY = 500, "5 minutes"
POINTER = "version long, batch long, place long, failures long"
REQUESTS = "version long, key string, batch long, first long, last long, accepted long, failed boolean"

#: Takes the key of a request and its rows; gives how many it accepted, the first ones, or None if the request failed.
Send = Callable[[str, list], int | None]


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the folder, empty where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _placed(schema: T.StructType, *more: str) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(name, T.LongType()) for name in ("place", *more)]])


def sync(
    rows: DataFrame, send: Send, folder: str, *, order: list[str], name: str = "sync", most: int = MOST, requests: int = 1, allowed: Callable[[], bool] = lambda: True, online: Callable[[], bool] = lambda: True, **trigger
) -> StreamingQuery:
    """Starts sending the rows of a stream as they arrive: at most so many requests of so many rows per micro-batch.

    allowed and online are asked before a micro-batch's requests (consent and network); if either says no, rows are kept
    for later. Rows go out by micro-batch and, within one, by order. If a request fails or is accepted in part, its rest
    leads the next micro-batch, and no further request is made in this one. An error that send raises ends the stream;
    started again, it makes the same request. name: two syncs of one name cannot run at the same time. trigger: as for
    writeStream.trigger, every five minutes by default. rows has no column place.
    """
    spark, schema = rows.sparkSession, rows.schema

    def head(at: int, place: int, newest: int) -> tuple[int, int, list]:
        """The next rows to send, at most `most`: from the pointer's batch, or from the next one that has rows left."""
        while True:
            own = spark.read.schema(_placed(schema)).parquet(f"{folder}/arrived/batch={at}")
            found = own.filter((F.col("place") >= place) & (F.col("place") < place + most)).orderBy("place").collect()
            if found or at >= newest:
                return at, place, found
            at, place = at + 1, 0

    def step(batch: DataFrame, number: int) -> None:
        placed = numbered(batch.withColumn("all", F.lit("")), "all", order).withColumnRenamed("idx", "place").select(*schema.names, "place")
        placed.write.mode("overwrite").parquet(f"{folder}/arrived/batch={number}")
        last = _table(spark, f"{folder}/pointer", POINTER).filter(F.col("version") < number).orderBy(F.desc("version")).first()
        at, place, failures = (last["batch"], last["place"], last["failures"]) if last else (0, 0, 0)
        log, more = [], requests if allowed() and online() else 0
        while len(log) < more:
            at, place, found = head(at, place, number)
            if not found:
                break
            key = f"{name}-{number}-{len(log)}"
            took = send(key, found)
            accepted = max(0, min(len(found), took or 0))
            log.append((number, key, at, place, place + len(found), accepted, took is None))
            place, failures = place + accepted, failures + 1 if took is None else 0
            if accepted < len(found):
                break
        spark.createDataFrame(log, REQUESTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/requests/of={number}")
        # The pointer comes last: without it the micro-batch is done again.
        spark.createDataFrame([(number, at, place, failures)], POINTER).coalesce(1).write.mode("overwrite").parquet(f"{folder}/pointer/of={number}")

    writer = rows.writeStream.foreachBatch(step).queryName(name).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"processingTime": EVERY})).start()


def status(spark: SparkSession, folder: str) -> DataFrame:
    """One row (version, batch, place, failures): how far the receiver has taken the rows, and how often it has failed since."""
    return _table(spark, f"{folder}/pointer", POINTER).orderBy(F.desc("version")).limit(1)


def ledger(spark: SparkSession, folder: str, schema: T.StructType, most: int = MOST) -> DataFrame:
    """Everything that has arrived, with batch, place, synced and attempts: the failed requests that a row was in.

    most: rows of a request, as given to sync; requests meet their rows by stretches of that length.
    """
    arrived = spark.read.schema(_placed(schema, "batch")).parquet(f"{folder}/arrived")
    upto = status(spark, folder).select(F.col("batch").alias("__at"), F.col("place").alias("__upto")).first()
    at, place = (upto["__at"], upto["__upto"]) if upto else (0, 0)
    synced = (F.col("batch") < at) | ((F.col("batch") == at) & (F.col("place") < place))
    stretch = lambda c: F.floor(c / most).cast("long")
    failed = _table(spark, f"{folder}/requests", REQUESTS).filter("failed").groupBy("batch", "first", "last").agg(F.count(F.lit(1)).alias("n"))
    failed = failed.withColumn("stretch", F.explode(F.sequence(stretch(F.col("first")), stretch(F.col("last") - 1))))
    keyed = arrived.withColumns({"synced": synced, "stretch": stretch(F.col("place"))})
    within = (F.col("place") >= F.col("first")) & (F.col("place") < F.col("last"))
    hits = keyed.select("batch", "place", "stretch").join(failed, ["batch", "stretch"]).filter(within).groupBy("batch", "place").agg(F.sum("n").alias("attempts"))
    return keyed.drop("stretch").join(hits, ["batch", "place"], "left").withColumn("attempts", F.coalesce("attempts", F.lit(0).cast("long")))
