"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts with the same set of shingles form one class from the start; only one of each goes on. A forest of sorted prefix
trees holds the signatures. All start with prefixes of full depth; what shares one in some tree is compared by whole
signatures. From the similarities of the neighbours that a signature has found, the chance that one like them was found
at this depth tells its recall; signatures short of the target go on with prefixes one value shorter, the others only
answer them. At the least depth even a pair at the threshold has been found with the target recall. The links found give
groups that hold all candidates. Inside each group all pairs are verified on the shingles themselves. Large groups are
cut into blocks and compared block against block, so that no task holds a whole group and no pair is ever a row.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import broadcast_if_small, text_of, without, written
from loamgrid.llm.components import components
from loamgrid.llm.shingles import shingle_sets, signature

OUTPUT = ["class_id", "n_links", "kept"]
TREES, DEPTH = 16, 8
ALIKE = "array<struct<row:long,root:long,n:double,of:double>>"


def found_at(similarity: float | np.ndarray, depth: int, trees: int = TREES) -> float | np.ndarray:
    """The chance that a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that pairs at the threshold share in some tree with at least this probability: none need be shorter."""
    while depth > 1 and found_at(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def _roots(n: int, pairs: Iterator[tuple[int, np.ndarray]]) -> list[int]:
    """For each of n members the least member that it hangs together with."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, linked in pairs:
        for j in linked.tolist():
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def _others(i: int, side: np.ndarray, own: bool) -> np.ndarray:
    """Which members i is to be compared with: later ones if this is a block with itself (own), else those of the other block, which may be empty."""
    if own:
        return np.arange(i + 1, len(side))
    return np.flatnonzero(side) if not side[i] else np.zeros(0, np.int64)


def _alike(members: list[dict], own: bool, least: float, threshold: float, depth: int) -> list[dict]:
    """For each member that has neighbours, signatures that agree in at least the share `least`: the least of its group (root), how many neighbours it has (n) and how many there should be by the chances of finding such at this depth (of). Two members neither of which is open are not compared."""
    prints = np.array([np.frombuffer(m["sig"], ">u4") for m in members])
    side, open_ = np.array([m["side"] for m in members], bool), np.array([m["open"] for m in members], bool)
    n, of = np.zeros(len(members)), np.zeros(len(members))

    def found() -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(members)):
            j = _others(i, side, own)
            j = j if open_[i] else j[open_[j]]
            if len(j):
                same = (prints[j] == prints[i]).mean(axis=1)
                j, same = j[same >= least], same[same >= least]
                weight = 1 / found_at(np.maximum(same, threshold), depth)
                n[i], of[i] = n[i] + len(j), of[i] + weight.sum()
                n[j] += 1
                of[j] += weight
            yield i, j

    roots = _roots(len(members), found())
    return [{"row": members[k]["row"], "root": members[r]["row"], "n": float(n[k]), "of": float(of[k])} for k, r in enumerate(roots) if n[k]]


def _verified(members: list[dict], own: bool, threshold: float) -> list[dict]:
    """For each member its links (copies of the other text counted) and the least member that it hangs together with."""
    sets = [np.frombuffer(m["shingles"], "<u8") for m in members]
    side = np.array([m["side"] for m in members], bool)
    sizes, copies = np.array([len(s) for s in sets]), np.array([m["copies"] for m in members])
    links = np.zeros(len(members), np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]

    def found() -> Iterator[tuple[int, np.ndarray]]:
        for i, values_i in enumerate(sets):
            j = _others(i, side, own)
            if not len(j):
                continue
            begin, end = np.searchsorted(values, values_i, "left"), np.searchsorted(values, values_i, "right")
            n = end - begin
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(sets))[j]
            j = j[shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9]
            links[i] += copies[j].sum()
            links[j] += copies[i]
            yield i, j

    roots = _roots(len(members), found())
    return [{"row": m["row"], "links": int(n), "root": members[r]["row"]} for m, n, r in zip(members, links, roots, strict=True)]


def _in_blocks(df: DataFrame, group: str, blocks: Column, *carried: str) -> DataFrame:
    """df, each row once for every pair of blocks of its group that its own block is in; groups of these have members, with side: whether a member is of the second block, and own: whether the pair is a block with itself."""
    own = df.withColumns({"__n": blocks.cast("int")}).withColumn("__own", F.pmod(F.xxhash64("row"), F.col("__n")).cast("int"))
    own = own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    member = F.struct("row", *carried, (F.col("__own") > F.col("__other")).cast("int").alias("side"))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    return own.groupBy(group, low.alias("__low"), high.alias("__high")).agg(F.sort_array(F.collect_list(member)).alias("members")).withColumn("own", F.col("__low") == F.col("__high"))


def ngram_join(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    carry: list[str] | None = None,
    k: int = 5,
    threshold: float = 0.8,
    recall: float = 0.999,
    margin: float = 0.15,
    block: int = 512,
    block_shingles: int = 500_000,
    most_broadcast: int = 300_000,
) -> DataFrame:
    """The rows of docs with class_id, n_links and kept; carry names the input columns to keep (all by default).

    Two texts are linked if their sets of k-word shingles have a Jaccard similarity of at least threshold; words are
    runs of letters and digits in lower case, and a shorter text is one shingle. class_id: the least doc_id among all
    texts that links hold together. n_links: the number of other rows that a row is linked to, copies included. kept:
    true for one row of each class. A text that is null, empty or without words has no links and is its own class;
    rows with equal ids are told apart; a class whose ids are all null has a null class_id. A signature is
    looked up with ever shorter prefixes until neighbours like those that it has would be found with probability recall;
    one without neighbours goes on until a pair at the threshold would be. One with close twins may so stop early and
    finds a pair near the threshold with less (0.989 of all links on planted pairs of twins). A pair looked up is in a group unless its
    signatures agree in less than threshold - margin (over four deviations off); similarities are exact. Blocks bound what a task holds: block
    members or block_shingles shingles a side. Columns named as in OUTPUT give way.
    """
    docs = without(docs, *OUTPUT)
    carry = carry or docs.columns
    depth = prefix_depth(threshold, recall)

    def parts(texts: Iterator[pd.Series]) -> Iterator[list[str]]:
        """Lists of few texts, so that their shingles take little memory."""
        for batch in texts:
            for i in range(0, len(batch), 500):
                yield batch.iloc[i : i + 500].tolist()

    @F.pandas_udf("key binary, n long, sig binary")
    def signed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in parts(texts):
            rows = [(hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest(), len(s), signature(s, TREES * DEPTH).tobytes()) if len(s) else (None, 0, None) for s in shingle_sets(batch, k)]
            yield pd.DataFrame(rows, columns=["key", "n", "sig"])

    @F.pandas_udf("binary")
    def shingled(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in parts(texts):
            yield pd.Series([s.astype("<u8").tobytes() for s in shingle_sets(batch, k)], dtype=object)

    def alike_at(d: int):
        def alike(groups: pd.Series, own: pd.Series) -> pd.Series:
            return pd.Series([_alike(list(g), o, threshold - margin, threshold, d) for g, o in zip(groups, own, strict=True)], dtype=object)

        return F.pandas_udf(alike, ALIKE)

    def verified(groups: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([_verified(list(g), o, threshold) for g, o in zip(groups, own, strict=True)], dtype=object)

    body = text_of(text)
    digest = [F.xxhash64(body), F.xxhash64(F.lit(1), body)]
    rows = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)], F.col(doc_id).alias("id"), digest[0].alias("t1"), digest[1].alias("t2"), signed(body).alias("s"))
    rows = written(rows.select("*", F.monotonically_increasing_id().alias("row"), "s.*").drop("s"), "signed")
    worded = rows.filter(F.col("key").isNotNull())
    reps = written(worded.groupBy("key", "sig", "n").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("id")), "sets")

    # The forest: leaves that share the least prefix with another one, each tree sorted by its signatures' values; what shares none is alone.
    width = DEPTH * 4
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("sig", t * width + 1, width).alias("path")) for t in range(TREES)])
    leaves = reps.select("row", F.inline(trees)).withColumn("node", F.xxhash64("tree", F.substring("path", 1, 4 * depth)))
    shared = leaves.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    shared = written(shared, "shared")
    forest = leaves.join(broadcast_if_small(shared, most_broadcast), "node").drop("node")
    forest = written(forest.repartitionByRange("tree", "path").sortWithinPartitions("tree", "path"), "forest")
    signs = written(reps.select("row", "sig").join(forest.select("row").distinct(), "row"), "signs")
    closed = None  # rows whose recall is reached
    links = []
    for d in range(DEPTH, depth - 1, -1):
        here = forest.select("row", F.xxhash64("tree", F.substring("path", 1, 4 * d)).alias("node"))
        here = here.withColumn("open", F.lit(True)) if closed is None else here.join(closed, "row", "left").withColumn("open", F.col("reached").isNull()).drop("reached")
        # Subtrees of equal members in several trees are one; those without an open member have nothing left to find.
        subtrees = here.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.expr("bit_xor(xxhash64(row))").alias("x"), F.min("row").alias("low"), F.max("row").alias("high"), F.bool_or("open").alias("any")).filter("size > 1 and any")
        subtrees = written(subtrees.groupBy("size", "x", "low", "high").agg(F.min("node").alias("node")).select("node", "size"), "subtrees")
        inside = here.join(broadcast_if_small(subtrees, most_broadcast), "node").join(signs, "row")
        made = _in_blocks(inside, "node", F.ceil(F.col("size") / block), "sig", "open").select(F.explode(alike_at(d)("members", "own")).alias("l")).select("l.*")
        made = written(made, "alike")
        links.append(made.filter("row <> root").select(F.col("row").alias("a"), F.col("root").alias("b")))
        # A neighbour met in several trees counts several times in both sums, which leaves their share what it is.
        done = made.groupBy("row").agg((F.sum("n") >= recall * F.sum("of")).alias("reached")).filter("reached")
        closed = done if closed is None else closed.unionByName(done).distinct()
        closed = written(closed, "closed")
    compared = functools.reduce(DataFrame.unionByName, links)
    groups = components(compared)

    # Exact similarities inside each group.
    sized = groups.join(reps.select(F.col("row").alias("node"), "n", "copies"), "node")
    totals = sized.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("all"))
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("all") / block_shingles))
    members = sized.join(totals, "root").select(F.col("node").alias("row"), "root", "copies", blocks.alias("blocks"))
    texts = rows.select("row", "t1", "t2").join(members, "row")
    found = docs.select(digest[0].alias("t1"), digest[1].alias("t2"), body.alias("body")).join(broadcast_if_small(texts.select("t1", "t2").distinct(), most_broadcast), ["t1", "t2"], "left_semi")
    sets = found.groupBy("t1", "t2").agg(F.first("body").alias("body")).select("t1", "t2", shingled("body").alias("shingles"))
    held = texts.join(sets, ["t1", "t2"]).select("row", "root", "copies", "blocks", "shingles")
    checked = _in_blocks(held, "root", F.col("blocks"), "copies", "shingles").select(F.explode(F.pandas_udf(verified, "array<struct<row:long,links:long,root:long>>")("members", "own")).alias("v")).select("v.*")
    checked = written(checked, "checked")
    links = checked.groupBy("row").agg(F.sum("links").alias("links"))
    classes = components(checked.select(F.col("row").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "row")

    # Classes of sets, then of rows.
    whole = reps.select("key", "row", "copies", "id").join(classes, "row", "left").join(links, "row", "left").withColumn("root", F.coalesce("root", "row"))
    whole = written(whole.select("key", "id", "root", "row", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    named = whole.groupBy("root").agg(F.min("id").alias("class_id"))
    final = whole.join(named, "root").select("key", "class_id", "n_links", "root")
    names = [F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)]
    out = worded.select("key", "row", *[f"__c{i}" for i in range(len(carry))]).join(final, "key").select(*names, "class_id", "n_links", (F.col("row") == F.col("root")).alias("kept"))
    alone = rows.filter(F.col("key").isNull()).select(*names, F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
