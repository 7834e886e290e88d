"""Whether bundles are whole: digests of fixed blocks, checked and fetched block by block, and what a bundle is capable of.

A bundle in transit is a table of blocks (bundle, block, bytes). Its manifest holds one digest per block and one of all
of them, so a check names the blocks that are damaged or missing, and a download goes on with those alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.sources import bundle as B

#: Bytes of a block.
BLOCK = 1 << 20
BLOCKS = "bundle string, block long, bytes binary"


def blocks(archives: DataFrame, size: int = BLOCK) -> DataFrame:
    """(bundle, block, bytes) of archives (path, content): content in blocks of so many bytes, the last one shorter; an empty file is one empty block."""
    last = F.floor((F.greatest(F.octet_length("content"), F.lit(1)) - 1) / size)
    numbered = archives.select(F.col("path").alias("bundle"), "content", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("block"))
    return numbered.select("bundle", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("bytes"))


def digested(pieces: DataFrame) -> DataFrame:
    """Blocks with size and sha256, computed where they lie, so that a plan that asks for no bytes moves none."""
    if "sha256" in pieces.columns:
        return pieces
    return pieces.withColumns({"size": F.octet_length("bytes"), "sha256": F.sha2("bytes", 256)})


def manifest(pieces: DataFrame) -> DataFrame:
    """(bundle, block, size, sha256) of blocks."""
    return digested(pieces).select("bundle", "block", "size", "sha256")


def root(listed: DataFrame) -> DataFrame:
    """(bundle, version) of a manifest: one digest over its blocks' digests in order; equal versions need no download."""
    return listed.groupBy("bundle").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "sha256"))), lambda b: b["sha256"]), "").cast("binary"), 256).alias("version"))


def checked(pieces: DataFrame, listed: DataFrame) -> DataFrame:
    """(bundle, block, state) of every block of a manifest, and of blocks that it lacks: whole, damaged, missing or unknown.

    Only digests meet; of blocks that came more than once, one whole copy is enough.
    """
    had = manifest(pieces).select("bundle", "block", F.col("sha256").alias("had")).distinct()
    both = listed.select("bundle", "block", "sha256").join(had, ["bundle", "block"], "full_outer")
    state = F.max(F.when(F.col("sha256").isNull(), 0).when(F.col("had").isNull(), 1).when(F.col("had") != F.col("sha256"), 2).otherwise(3))
    return both.groupBy("bundle", "block").agg(F.element_at(F.array(*map(F.lit, ("unknown", "missing", "damaged", "whole"))), state + 1).alias("state"))


def wanted(pieces: DataFrame, listed: DataFrame) -> DataFrame:
    """(bundle, block) that a download still has to fetch."""
    return checked(pieces, listed).filter(F.col("state").isin("missing", "damaged")).select("bundle", "block")


def resumed(pieces: DataFrame, fetched: DataFrame, listed: DataFrame) -> DataFrame:
    """The whole blocks (bundle, block, bytes, size, sha256) of a manifest among those had and those fetched, one copy of each."""
    both = digested(pieces).unionByName(digested(fetched))
    good = both.join(listed.select("bundle", "block", "sha256"), ["bundle", "block", "sha256"], "left_semi")
    return good.dropDuplicates(["bundle", "block"]).select("bundle", "block", "bytes", "size", "sha256")


def assembled(pieces: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, content) of the bundles all of whose blocks are whole; a bundle is one value and must fit a task."""
    bad = checked(pieces, listed).filter("state != 'whole' and state != 'unknown'").select("bundle").distinct()
    good = resumed(pieces, pieces.limit(0), listed).join(bad, "bundle", "left_anti")

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [group["bundle"].iloc[0]], "content": [b"".join(group.sort_values("block")["bytes"])]})

    return good.groupBy("bundle").applyInPandas(joined, "path string, content binary")


def capabilities(files: DataFrame) -> DataFrame:
    """One row per bundle: schema (an error if it isn't known) and whether it has vectors, a word index, a link graph, coverage, acronym and heading chunks, and query proxies.

    The manifest's own word on the word index counts before what is there.
    """
    text = B._text(files, "manifest.json")
    told = text.select("bundle", F.get_json_object("text", "$.retrievalCapabilities.hasLexicalIndex").alias("told"))
    mark = lambda df, name: df.select("bundle", F.lit(name).alias("has")).distinct()
    extra = B._text(files, "content/chunks.jsonl").select("bundle", F.explode(F.split("text", "\n")).alias("line"))
    flag = lambda name: extra.filter(F.get_json_object("line", f"$.extra_metadata.{name}") == "true")

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch["head"].map(lambda h: len(h) == 8 and int.from_bytes(h[:4], "little") * int.from_bytes(h[4:], "little"))
            yield batch.loc[(rows > 0) & (batch["size"] >= 8 + 4 * rows), ["bundle"]]

    heads = files.filter(F.col("path") == "index/embeddings.bin").select("bundle", F.substring("bytes", 1, 8).alias("head"), F.octet_length("bytes").alias("size"))
    marks = [
        mark(heads.mapInPandas(sized, "bundle string"), "vectors"), mark(B.postings(files), "words"), mark(B.edges(files), "graph"), mark(B.coverage(files), "coverage"),
        mark(flag("is_acronym_entry"), "acronyms"), mark(flag("is_heading_entry"), "headings"), mark(B.proxies(files), "proxies"),
    ]
    found = marks[0]
    for m in marks[1:]:
        found = found.unionByName(m)
    had = found.groupBy("bundle").agg(F.collect_set("has").alias("has"))
    base = B.manifests(files).select("bundle", "schema").join(told, "bundle", "left").join(had, "bundle", "left")
    has = lambda name: F.coalesce(F.array_contains("has", name), F.lit(False))
    return base.select("bundle", "schema", has("vectors").alias("vectors"), F.coalesce(F.col("told").cast("boolean"), has("words")).alias("words"), *[has(n).alias(n) for n in ("graph", "coverage", "acronyms", "headings", "proxies")])
