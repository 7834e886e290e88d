"""Tables in the folder that driver and executors share, and broadcasts of a checked size."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one in local mode if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, with its lineage cut, readable after the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/loamgrid-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes a table that `written` made, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/loamgrid-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """df, marked for broadcasting if it has at most most_rows rows (counted here); otherwise Spark shuffles it as it sees fit."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def numbered(rows: DataFrame, group: str, order: list[str], rows_per_part: int = 50_000) -> DataFrame:
    """rows with idx (long, from 0), the place of a row in its group by order (nulls first), as a written table.

    A range partition of the whole order gives each task neighbouring rows; groups are numbered inside a partition and
    begin where the partitions before them end, so a group of any size is numbered by many tasks. Rows equal in group and
    order are dealt by a number of their own. Columns named tie, part, begin or k give way; group is never null.
    """
    rows = written(rows.drop("tie", "part", "begin", "k", "idx").withColumn("tie", F.monotonically_increasing_id()), "rows")
    parts = max(8, min(20_000, math.ceil(rows.count() / rows_per_part)))
    dealt = written(rows.repartitionByRange(parts, group, *order, "tie").withColumn("part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("k")).selectExpr(group, "part", f"sum(k) over (partition by {group} order by part) - k as begin")
    inside = dealt.selectExpr("*", f"row_number() over (partition by {group}, part order by {', '.join([*order, 'tie'])}) - 1 as k")
    placed = written(inside.join(sizes, [group, "part"]).withColumn("idx", F.col("begin") + F.col("k")).drop("tie", "part", "begin", "k"), "numbered")
    removed(rows)
    removed(dealt)
    return placed
