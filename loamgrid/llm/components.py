"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import removed, written


def components(links: DataFrame) -> DataFrame:
    """links has (a, b); the result has (node, root): root is the least node of the component, for every node that is linked.

    Each round takes the least label among a node and its neighbours, then that label's own label; a path of n nodes takes about log n rounds. Every round is written to the shared folder, where it takes the place of the one before.
    """
    both = written(links.filter(F.col("a") != F.col("b")).select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter(F.col("a") != F.col("b")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(seen, labels.node == seen.a).select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = written(lower.join(up, "root", "left").select("node", F.least("root", "above").alias("root"), "old"), "labels")
        settled = new.filter(F.col("root") != F.col("old")).isEmpty()
        removed(labels)
        labels = new.select("node", "root")
        if settled:
            removed(both)
            return labels
