"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix (DataFrame functions only).

Rows fall into many source partitions. How many rows each partition sends to each shard is drawn from the multivariate
hypergeometric law given the partition and shard sizes, by halving the set of partitions again and again. Each
partition permutes its rows and sends them off in that order; each shard permutes what it received.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import text_of, without, written

OUTPUT = ["shard", "slot"]
#: Most copies of a row that are numbered at once.
STEP = 100_000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))


def _hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of draws items out of total are among the good ones: the inverse of the distribution at u.

    Weights follow the ratio of neighbouring probabilities over mean plus or minus nine deviations and twenty; what lies outside has a share below 1e-17.
    """
    mean = draws * good / total
    reach = 9 * F.sqrt(mean * (total - good) / total) + 20
    low = F.greatest(F.lit(0).cast("long"), draws - (total - good), F.floor(mean - reach))
    high = F.least(draws, good, F.ceil(mean + reach))

    def pick(b: Column) -> Column:
        ratio = lambda k: (good - k) * (draws - k) / ((k + 1) * (total - good - draws + k + 1).cast("double"))
        steps = F.sequence(b["low"], b["high"])
        begin = lambda *more: F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), *more)
        whole = F.aggregate(steps, begin(), lambda a, k: F.struct((a["w"] * ratio(k)).alias("w"), (a["sum"] + a["w"]).alias("sum")), lambda a: a["sum"])

        def found(goal: Column) -> Column:
            step = lambda a, k: F.struct(
                (a["w"] * ratio(k)).alias("w"), (a["sum"] + a["w"]).alias("sum"), F.when(a["sum"] + a["w"] <= goal, a["n"] + 1).otherwise(a["n"]).alias("n")
            )
            return F.aggregate(steps, begin(F.lit(0).cast("long").alias("n")), step, lambda a: F.least(b["high"], b["low"] + a["n"]))

        return _let(whole * u, found)

    return F.when((total <= 0) | (draws <= 0) | (good <= 0), F.lit(0).cast("long")).otherwise(_let(F.struct(low.alias("low"), high.alias("high")), pick))


def _left_share(n_left: Column, room: Column, shards: int, *salt: Column) -> Column:
    """What the left half of the partitions sends to each shard, given the room that both halves share in each."""
    whole = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)

    def step(a: Column, j: Column) -> Column:
        here = F.get(room, j)
        return _let(
            _hypergeometric(a["rest"], here, a["draws"], _unit(*salt, j)),
            lambda k: F.struct((a["rest"] - here).alias("rest"), (a["draws"] - k).alias("draws"), F.concat(a["out"], F.array(k)).alias("out")),
        )

    begin = F.struct(whole(room).alias("rest"), n_left.alias("draws"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), begin, step, lambda a: a["out"])


def communication_matrix(counts: DataFrame, parts: int, shards: int, seed: int) -> DataFrame:
    """counts has (part, n); the result has, for each of the parts (a power of two), sent: the rows for shards 0, 1, ... in order.

    Every row sums to n, every column to the shard's size; shard sizes differ by one at most.
    """
    spark = counts.sparkSession
    whole = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    n = spark.range(parts).withColumnRenamed("id", "part").join(counts, "part", "left")
    blocks = n.agg(F.transform(F.sort_array(F.collect_list(F.struct("part", F.coalesce("n", F.lit(0).cast("long")).alias("n")))), lambda x: x["n"]).alias("n"))
    blocks = blocks.select(F.lit(0).cast("long").alias("part"), "n", whole(F.col("n")).alias("rows"))
    fair = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.floor(F.col("rows") / shards) + (j < F.col("rows") % shards).cast("long"))
    blocks = blocks.select("part", "n", fair.alias("room"))
    for level in range(parts.bit_length() - 1):
        half = parts >> (level + 1)
        blocks = blocks.withColumns({"nl": F.slice("n", 1, half), "nr": F.slice("n", half + 1, half)})
        blocks = blocks.withColumn("left", _left_share(whole(F.col("nl")), F.col("room"), shards, F.lit(seed), F.lit(level), F.col("part")))
        right = F.zip_with("room", "left", lambda a, b: a - b)
        side = lambda which, counts, room: F.struct((F.col("part") * 2 + which).alias("part"), counts.alias("n"), room.alias("room"))
        blocks = blocks.select(F.inline(F.array(side(0, F.col("nl"), F.col("left")), side(1, F.col("nr"), right))))
        if level in (3, 7):
            blocks = blocks.repartition(2 ** (level + 1), "part")
    return blocks.select("part", F.col("room").alias("sent"))


def hypergeometric_shuffle(docs: DataFrame, *, shards: int = 16, seed: int = 7, parts: int | None = None) -> DataFrame:
    """The rows of docs in uniformly random order over the shards: adds shard (0 up) and slot (gapless from 0 in each shard).

    Shard sizes differ by one at most. A row's place depends on its own values, on seed and on the row counts, so a
    recomputed task gives the same places. Rows equal in every column are first counted and then numbered, which
    spreads any number of them; they are interchangeable. Nulls are values like others; an empty table gives an empty
    one; input columns named shard or slot give way. Columns must be groupable (no maps). parts: source partitions, a
    power of two; by default at least 256 and about one per 100,000 rows.
    """
    docs = without(docs, *OUTPUT)
    names = docs.columns
    # Copies are numbered in two steps, so that no array is longer than STEP or the number of copies by STEP.
    rows = docs.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / STEP))))
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.col("__k") * STEP + 1, F.least(F.col("__n"), (F.col("__k") + 1) * STEP)))).drop("__n", "__k")
    if parts is None:
        parts = max(256, 1 << math.ceil(math.log2(max(1, docs.count() / 100_000))))
    key = lambda use: F.xxhash64(F.lit(seed), F.lit(use), *names, "__copy")
    rows = rows.withColumns({"part": F.pmod(key("part"), F.lit(parts)), "__first": key("first"), "__second": key("second")}).drop("__copy")
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    matrix = communication_matrix(counts, parts, shards, seed)
    sums = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice("sent", 1, k), F.lit(0).cast("long"), lambda a, v: a + v))
    ranked = rows.selectExpr("*", "row_number() over (partition by part order by __first) as __rank")
    sent = ranked.join(matrix.select("part", sums.alias("__upto")), "part").withColumn("shard", F.size(F.filter("__upto", lambda c: c < F.col("__rank"))))
    pieces = max(16, parts // 8)
    sent = written(sent.select(*names, "shard", "__second", F.pmod(F.shiftright("__second", 20), F.lit(pieces)).alias("__piece")), "sent")
    begins = sent.groupBy("shard", "__piece").agg(F.count(F.lit(1)).alias("n")).selectExpr("shard", "__piece", "sum(n) over (partition by shard order by __piece) - n as __begin")
    placed = sent.selectExpr("*", "row_number() over (partition by shard, __piece order by __second) as __rank").join(begins, ["shard", "__piece"])
    return placed.select(*names, "shard", (F.col("__begin") + F.col("__rank") - 1).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = text_of()
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = hypergeometric_shuffle(rows, shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
