"""State along an order, in many tasks: each row maps the state before it to the state after it, and such maps compose.

Rows are numbered in their groups and dealt into aligned blocks. A block composes its rows' maps to one; blocks of
blocks do the same until a group has a single one. On the way down each block learns the state that enters it, and the
rows of a lowest block are walked from there. No task sees more than one block, however long a group is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.shared import numbered, written

BLOCK = 256


def scanned(rows: DataFrame, group: str, order: list[str], step: Column, initial: Column, *, apply: Callable[[Column, Column], Column], compose: Callable[[Column, Column], Column], block: int = BLOCK) -> DataFrame:
    """The rows with before and after: the state before and after each row of its group, in ascending order.

    step: the row's map; apply(map, state) gives the state after it; compose(f, g) is the map of f, then g. initial: the
    state before the first row of a group. A null map changes nothing. Equal rows follow each other; null groups are a
    group of their own; columns before and after give way.
    """
    rows = rows.drop("before", "after")
    kept = F.struct(*[F.col(c).alias(c) for c in rows.columns])
    keyed = rows.select(F.struct(F.col(group).alias("key")).alias("grp"), *[F.col(c).alias(f"ord{i}") for i, c in enumerate(order)], step.alias("map"), kept.alias("row"))
    nodes = numbered(keyed, "grp", [f"ord{i}" for i in range(len(order))]).select("grp", "idx", "map", "row")
    then = lambda f, g: F.when(f.isNull(), g).when(g.isNull(), f).otherwise(compose(f, g))
    after = lambda m, state: F.when(m.isNull(), state).otherwise(apply(m, state))
    levels, more = [], ["row"]
    while True:
        blocks = nodes.groupBy("grp", F.floor(F.col("idx") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "map", *more)), lambda a, b: (a["idx"] - b["idx"]).cast("int")).alias("rows"))
        levels.append(written(blocks, f"blocks{len(levels)}"))
        maps = F.transform("rows", lambda x: x["map"])
        nodes, more = levels[-1].select("grp", F.col("block").alias("idx"), F.aggregate(F.slice(maps, 2, block), maps[0], then).alias("map")), []
        if (levels[-1].agg(F.max("block")).first()[0] or 0) == 0:
            break
    top = levels[-1].withColumn("state", initial)

    def walked(blocks: DataFrame, *named: Column) -> DataFrame:
        begin = F.struct(F.col("state").alias("state"), F.array().cast(f"array<struct<before:{kind},after:{kind}>>").alias("out"))

        def walk(a: Column, x: Column) -> Column:
            state = after(x["map"], a["state"])
            return F.struct(state.alias("state"), F.array_append(a["out"], F.struct(a["state"].alias("before"), state.alias("after"))).alias("out"))

        states = F.aggregate("rows", begin, walk, lambda a: a["out"])
        return blocks.select("grp", F.inline(F.arrays_zip(F.col("rows"), states.alias("states")))).select("grp", *named)

    kind = top.schema["state"].dataType.simpleString()
    for lower in reversed(levels[:-1]):
        entering = walked(top, F.col("rows.idx").alias("block"), F.col("states.before").alias("state"))
        top = lower.join(written(entering, "entering"), ["grp", "block"])
    return walked(top, F.col("rows.row").alias("row"), F.col("states.before").alias("before"), F.col("states.after").alias("after")).select("row.*", "before", "after")
