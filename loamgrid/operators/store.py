"""The usage store as tables: what may be added, how its rows are read, what is cleared, feedback, and module routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consented(sessions: DataFrame, preferences: DataFrame, user: str = "user_id") -> DataFrame:
    """The sessions of users who consent, to be appended; preferences: (user, consent), one row per user."""
    return sessions.join(preferences.filter("consent").select(user), user, "left_semi")


def appended(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The table with the rows whose key it lacks; the first of equal keys stays."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def mapped_rows(rows: DataFrame, flags: list[str], lists: list[str]) -> DataFrame:
    """Stored rows as they are used: 0 and 1 as booleans, JSON text as arrays (empty where it isn't any)."""
    none = F.array().cast("array<string>")
    return rows.withColumns({c: F.col(c) == 1 for c in flags} | {c: F.coalesce(F.from_json(c, "array<string>"), none) for c in lists})


def cleared(table: DataFrame, before=None, column: str = "ts") -> DataFrame:
    """What is left after a clean-up: nothing, or what isn't older than `before`."""
    return table.limit(0) if before is None else table.filter(F.col(column) >= before)


def feedback(rows: DataFrame) -> DataFrame:
    """Feedback as it is sent: (chunk_id, rating, latency_ms, query_sha256): ratings other than 1, -1 and 0 are left out, latency in whole milliseconds, halves up, and the query as a hash only."""
    return rows.filter(F.col("rating").isin(1, -1, 0)).select("chunk_id", "rating", F.floor(F.col("latency") + 0.5).cast("long").alias("latency_ms"), F.sha2("query", 256).alias("query_sha256"))


def collisions(modules: DataFrame) -> DataFrame:
    """(kind, value, n): module ids and intents that are registered more than once; modules: (module, intent)."""
    ids = modules.select("module", "intent").groupBy("module").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("intent").alias("n")).filter(F.col("rows") > F.col("n"))
    intents = modules.groupBy("intent").agg(F.countDistinct("module").alias("n")).filter("n > 1")
    return ids.select(F.lit("module").alias("kind"), F.col("module").alias("value"), F.col("rows").alias("n")).unionByName(intents.select(F.lit("intent").alias("kind"), F.col("intent").alias("value"), "n"))


def routed(requests: DataFrame, modules: DataFrame, default: str) -> DataFrame:
    """requests with the module of their intent, the first by name of several; the default where there is none."""
    first = modules.groupBy("intent").agg(F.min("module").alias("module"))
    return requests.join(first, "intent", "left").withColumn("module", F.coalesce("module", F.lit(default)))
