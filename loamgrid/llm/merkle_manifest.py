"""A Merkle tree over the rows of a dataset, one subtree per source, with a proof for every row.

Nodes of a level are dealt into aligned blocks of 256. A block keeps its nodes as one hex string, 64 characters a node;
fixed-width substrings of it are the runs of 16 whose hashes are the parents, and those, one string again, give the
block's own node of the step above. The substrings on both sides of a node inside its run are its siblings. The steps
go up until each source has one node; the same steps over the sources' roots end in the root. Proofs go down again:
what a block has above it is joined to the block once, and unfolded for its nodes inside the row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import removed, written

OUTPUT = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
#: Children of a node, hex characters of a digest, and nodes of a block: two levels of the tree.
FAN, WIDTH = 16, 64
BLOCK = FAN * FAN
#: One pair of sibling segments per level: the hex strings of the nodes before and after in the run.
SEGMENTS = "array<struct<before:string,after:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def digest(value: Column) -> Column:
    """Lower-case hex sha256 of a string's UTF-8 bytes."""
    return F.sha2(value.cast("binary"), 256)


def leaf_of(*fields: Column) -> Column:
    """The hash of a row: each field `-` if null, else its UTF-8 byte count, a colon and its value."""
    written_out = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in written_out]))


def _runs(level: Column) -> Column:
    """The runs of a level string: up to 16 digests each."""
    last = F.floor((F.length(level) - 1) / (FAN * WIDTH)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda r: F.substring(level, r * (FAN * WIDTH) + 1, F.lit(FAN * WIDTH)))


def _flanks(run: Column, at: Column) -> Column:
    """What stands before and after the digest at a place of a run."""
    before = F.substring(run, F.lit(1), (at * WIDTH).cast("int"))
    return F.struct(before.alias("before"), F.substring(run, ((at + 1) * WIDTH + 1).cast("int"), F.lit(FAN * WIDTH)).alias("after"))


def fold(node: Column, segments: Column) -> Column:
    """The root that a node and its siblings, level by level, lead to."""
    return F.aggregate(segments, node, lambda a, s: digest(F.concat(s["before"], a, s["after"])))


def _placed(rows: DataFrame, group: str, order: list[str], rows_per_part: int) -> DataFrame:
    """rows, a written table, with idx (long, from 0), the place of a row in its group by order, and total, the group's size.

    A range partition of the whole order gives each task neighbouring rows; groups are numbered inside a partition and
    begin where the partitions before them end, so a group of any size is numbered by many tasks.
    """
    parts = max(8, min(20_000, math.ceil(rows.count() / rows_per_part)))
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, group, *order, "tie")
    dealt = written(dealt.withColumn("part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.selectExpr(group, "part", f"sum(n) over (partition by {group} order by part) - n as begin", f"sum(n) over (partition by {group}) as total")
    inside = dealt.selectExpr("*", f"row_number() over (partition by {group}, part order by {', '.join(order)}, tie) - 1 as k")
    placed = inside.join(sizes, [group, "part"]).withColumn("idx", F.col("begin") + F.col("k")).drop("part", "tie", "k", "begin")
    placed = written(placed, "placed")
    removed(dealt)
    removed(rows)
    return placed


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """(grp, block, total, level, up, rows): the blocks of nodes (grp, idx, total, node), the columns more kept in rows."""
    gathered = nodes.groupBy("grp", F.floor(F.col("idx") / BLOCK).alias("block"), "total").agg(F.sort_array(F.collect_list(F.struct("idx", "node", *more))).alias("rows"))
    level = gathered.withColumn("level", F.array_join(F.transform("rows", lambda x: x["node"]), ""))
    above = lambda x: F.array_join(F.transform(_runs(x), digest), "")
    up = F.when(F.col("total") > 1, above(F.col("level"))).otherwise(F.lit(None).cast("string"))
    return level.withColumn("up", up)


def _parents(blocks: DataFrame) -> DataFrame:
    """The nodes of the step above: the hash of a block's parents, its one parent if the group has no more, or its one node."""
    top = F.when(F.col("total") > FAN, digest(F.col("up"))).when(F.col("total") > 1, F.col("up")).otherwise(F.col("level"))
    return blocks.select("grp", F.col("block").alias("idx"), F.ceil(F.col("total") / BLOCK).alias("total"), top.alias("node"))


def _segments(runs: Column, up: Column, total: Column, at: Column) -> Column:
    """The siblings, inside a block, of the node at a place of the block: none, one level or two."""
    lower = _flanks(F.get(runs, F.floor(at / FAN).cast("int")), at % FAN)
    upper = _flanks(up, F.floor(at / FAN))
    return F.when(total > FAN, F.array(lower, upper)).when(total > 1, F.array(lower)).otherwise(F.array().cast(SEGMENTS))


def _unfolded(blocks: DataFrame, use: Callable[[Column, Column], Column]) -> DataFrame:
    """One row per node of blocks with (tag, above): use(row of rows, its siblings up to the root) as the columns of a struct."""
    levels = blocks.select("grp", "tag", "above", "total", "up", "rows", _runs(F.col("level")).alias("runs"))
    segments = lambda x: F.concat(_segments(F.col("runs"), F.col("up"), F.col("total"), x["idx"] % BLOCK), F.col("above"))
    return levels.select("grp", "tag", F.inline(F.transform("rows", lambda x: _let(segments(x), lambda s: use(x, s)))))


def _steps(nodes: DataFrame, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each step, lowest first, and the tops: (grp, node), one row per group."""
    most, steps = nodes.agg(F.max("total")).first()[0] or 0, []
    for k in range(max(1, math.ceil(math.log(max(2, most), BLOCK) - 1e-9))):
        steps.append(written(_blocks(nodes, *(more if k == 0 else ())), f"step{k}"))
        nodes = _parents(steps[-1])
    return steps, nodes.select("grp", "node")


def _down(steps: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """The lowest step's blocks with what stands above them: (tag, above) as given for each group (nothing by default), above led on to the block."""
    top = steps[-1].join(above, "grp") if above else steps[-1].withColumns({"tag": F.lit(""), "above": F.array().cast(SEGMENTS)})
    for below in reversed(steps[:-1]):
        paths = written(_unfolded(top, lambda x, s: F.struct(x["idx"].alias("block"), s.alias("above"))), "paths")
        top = below.join(paths, ["grp", "block"])
    return top


def merkle_manifest(
    docs: DataFrame, *, fields: list[str], group: str = "source", order: str = "doc_id", tampered: dict[str, Column] | None = None, rows_per_part: int = 50_000, segments: bool = False
) -> DataFrame:
    """One row per row of docs: order, group, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of the fields. In each group leaves ascend by order, equal ones by their hash; a run of 16 nodes
    has the hash of its digests for parent until one node, the subroot, is left; subroots, by group (null first, by
    bytes), lead to the root likewise. proof_sha256 is the hash of all siblings up to the root; folded_root comes of the
    row as tampered has it (column name to new value; by default untouched) and the original siblings; verified tells
    whether it is the root. segments: also give the siblings, one (before, after) pair per level.

    Nulls are written as `-`, and a null group is a group of its own; repeated rows are leaves beside each other with
    equal hashes and proofs of their own; an empty table gives an empty one; other columns are left behind. Only digests
    are shuffled, no texts.
    """
    changed = {name: (tampered or {}).get(name, F.col(name)) for name in fields}
    touched = F.exists(F.array(*[~F.col(name).eqNullSafe(value) for name, value in changed.items()]), lambda x: x)
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # null first, then by bytes
    leaves = docs.select(F.col(order).alias("ord"), F.col(group).alias("value"), key.alias("grp"), leaf_of(*map(F.col, fields)).alias("node"), F.when(touched, leaf_of(*changed.values())).alias("other"))
    steps, subroots = _steps(_placed(written(leaves, "leaves"), "grp", ["ord", "node"], rows_per_part), "ord", "value", "other")
    tops = subroots.select(F.lit("all").alias("grp"), F.col("grp").alias("own"), "node")
    high, roots = _steps(_placed(written(tops, "subroots"), "grp", ["own"], rows_per_part), "own")
    root = F.lit(next((r["node"] for r in roots.collect()), None)).cast("string")  # one row, or none of an empty table
    groups = _unfolded(_down(high), lambda x, s: F.struct(x["own"].alias("own"), x["node"].alias("node"), s.alias("above")))
    blocks = _down(steps, written(groups.select(F.col("own").alias("grp"), F.col("node").alias("tag"), "above"), "groups"))

    def proven(x: Column, s: Column) -> Column:
        proof = F.array_join(F.transform(s, lambda pair: F.concat(pair["before"], pair["after"])), "")
        found = [x["ord"].alias(order), x["value"].alias(group), x["node"].alias("leaf"), digest(proof).alias("proof_sha256"), fold(F.coalesce(x["other"], x["node"]), s).alias("folded_root")]
        return F.struct(*found, *([s.alias("segments")] if segments else []))

    more = ["segments"] if segments else []
    return _unfolded(blocks, proven).select(order, group, "leaf", F.col("tag").alias("subroot"), root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"), *more)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = merkle_manifest(docs, fields=FIELDS, tampered={"text": F.when(hit, lowered).otherwise(F.col("text"))})
    return out.select("doc_id", *OUTPUT)


#: crc32 of the decimal doc_id, bit by bit.
CRC = """summed AS (
    SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, [ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)))) AS crc
    FROM documents
)"""


def _oracle(levels: int = 6, high: int = 4) -> str:
    """DuckDB SQL with the tree's levels written out, for up to 16 ** levels rows of a source and 16 ** high sources."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    lowered = "CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    steps = []

    def tree(name: str, levels: int) -> None:
        for k in range(levels):
            steps.append(f"{name}_r{k} AS (SELECT g, i // 16 AS r, string_agg(h, '' ORDER BY i) AS s, any_value(n) AS n FROM {name}{k} GROUP BY g, i // 16)")
            steps.append(f"{name}{k + 1} AS (SELECT g, r AS i, CASE WHEN n > 1 THEN sha256(s) ELSE s END AS h, (n + 15) // 16 AS n FROM {name}_r{k})")

    def proofs(name: str, tree: str, levels: int) -> None:
        for k in range(levels):
            before, after = "substr(s, 1, (p.i % 16)::INT * 64)", "substr(s, (p.i % 16)::INT * 64 + 65)"
            steps.append(
                f"{name}{k + 1} AS (SELECT p.* REPLACE (p.i // 16 AS i, CASE WHEN r.n > 1 THEN proof || {before} || {after} ELSE proof END AS proof, CASE WHEN r.n > 1 THEN sha256({before} || fold || {after}) ELSE fold END AS fold) "
                f"FROM {name}{k} p JOIN {tree}_r{k} r ON r.g IS NOT DISTINCT FROM p.g AND r.r = p.i // 16)"
            )

    steps.append(f"hashed AS (SELECT doc_id, source AS g, sha256(concat({', '.join(map(field, FIELDS))})) AS h, sha256(concat({', '.join(map(field, FIELDS[:-1]))}, {field('changed')})) AS t FROM (SELECT *, {lowered} AS changed FROM summed))")
    steps.append("a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed)")
    tree("a", levels)
    steps.append(f"b0 AS (SELECT 0 AS g, g AS source, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM a{levels})")
    tree("b", high)
    steps.append("p0 AS (SELECT doc_id, g, i, h AS leaf, t AS fold, '' AS proof FROM a0)")
    proofs("p", "a", levels)
    steps.append(f"q0 AS (SELECT doc_id, b0.g, b0.i, leaf, fold, proof, b0.h AS subroot FROM p{levels} p JOIN b0 ON b0.source IS NOT DISTINCT FROM p.g)")
    proofs("q", "b", high)
    return f"WITH {CRC}, {', '.join(steps)} SELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b.h AS verified FROM q{high} q JOIN b{high} b ON b.g = q.g"


ORACLE = _oracle()
