"""Benchmark decontamination by SimHash over item-sized windows (DataFrame functions only).

The words of a document lie on a grid of blocks of four. Every run of blocks that an item can fill gets a SimHash
fingerprint of its blocks; counters are kept in bit planes, so that one expression counts all 64 bits at once. An item is
fingerprinted at all four places that it can have on the grid, so an exact copy meets its own fingerprint wherever it
stands. Fingerprints are cut into four index blocks; two that differ in at most seven bits agree in one of them but for
one bit, and the item's side asks for every such value, so the join on index blocks finds all within the radius. What it
finds is verified on the weighted shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import broadcast_if_small, text_of, written

SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Words of a block of the grid, most blocks of a window, index blocks of a fingerprint.
BLOCK, MOST, PARTS = 4, 14, 4
#: Bits in which a window's fingerprint may differ from an item's: one in each index block and one less.
RADIUS = 2 * PARTS - 1
WIDTH = 64 // PARTS
#: Bit planes of the counters, which go up to MOST.
PLANES = MOST.bit_length()


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(text_of(text)), SPLIT), "")


def _blocks(words: str) -> Column:
    """The hash of each full block; never null, or Catalyst would test it for null far below, words and all."""
    n = F.floor(F.size(words) / BLOCK).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(words, i * BLOCK + k) for k in range(BLOCK)]))
    return F.when(n > 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _with_fingerprints(df: DataFrame, blocks: str, first: Column, sizes: list[int]) -> DataFrame:
    """Adds __f2, __f3, ...: the SimHash of so many blocks from the first on, for each of the sizes; a bit is set where more than half of the blocks have it.

    Plane c of the counters holds bit c of all 64 counts; adding a block is a chain of carries.
    """
    kept = df.columns
    zero = F.lit(0).cast("long")
    most = max(sizes)
    df = df.select("*", *[F.coalesce(F.get(blocks, first + i), zero).alias(f"__x{i}") for i in range(most)], *[zero.alias(f"__c{c}") for c in range(PLANES)])
    for i in range(most):
        planes, carry = [], F.col(f"__x{i}")
        for c in range(PLANES):
            planes.append(F.col(f"__c{c}").bitwiseXOR(carry).alias(f"__c{c}"))
            carry = F.col(f"__c{c}").bitwiseAND(carry)
        done = []
        df = df.select(*kept, *[f"__x{k}" for k in range(i + 1, most)], *planes)
        if i + 1 in sizes:
            over, least = F.lit(-1).cast("long"), (i + 1) // 2 + 1
            for c in range(PLANES):
                over = F.col(f"__c{c}").bitwiseAND(over) if least >> c & 1 else F.col(f"__c{c}").bitwiseOR(over)
            name = f"__f{i + 1}"
            done = [name]
            df = df.withColumn(name, over)
        kept = [*kept, *done]
    return df.select(*kept)


def _keys(print_: Column, blocks: Column, flips: bool) -> Column:
    """Keys of the index blocks, told apart by window size and number; flips: also all that differ in one bit."""
    mask = F.lit((1 << WIDTH) - 1).cast("long")
    values = [F.shiftrightunsigned(print_, p * WIDTH).bitwiseAND(mask) for p in range(PARTS)]
    key = lambda p, v: F.shiftleft(blocks.cast("long") * PARTS + p, WIDTH).bitwiseOR(v)
    changed = [0, *[1 << b for b in range(WIDTH)]] if flips else [0]
    return F.array(*[key(p, v.bitwiseXOR(F.lit(x).cast("long")) if x else v) for p, v in enumerate(values) for x in changed])


def _known(items: DataFrame) -> DataFrame:
    """(key, print, of, m, ahead, blocks) of every item (of, m, item) at each place that it can have on the grid; ahead: its words before the window.

    A window holds all blocks of the item (of a stretch of MOST blocks, if it is longer), all but the first or the last, or one half of them: a change within the item leaves one half as it is.
    """
    here = items.withColumn("__base", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("m") - MOST * BLOCK), F.lit(MOST * BLOCK))))
    here = here.withColumn("__off", F.explode(F.array(*map(F.lit, range(BLOCK)))))
    here = here.withColumn("__all", F.least(F.lit(MOST), F.floor((F.col("m") - F.col("__base") - F.col("__off")) / BLOCK).cast("int")))
    n, half = F.col("__all"), F.floor(F.col("__all") / 2).cast("int")
    parts = [(F.lit(0), n), (F.lit(1), n - 1), (F.lit(0), n - 1), (F.lit(0), half), (n - half, half)]
    laid = here.select("of", "m", "item", F.col("__base") + F.col("__off"), F.inline(F.array(*[F.struct(skip.alias("skip"), size.alias("blocks")) for skip, size in parts]))).toDF("of", "m", "item", "base", "skip", "blocks")
    laid = laid.filter(F.col("blocks") >= 2).withColumn("ahead", F.col("base") + F.col("skip") * BLOCK)
    laid = laid.withColumn("__w", F.slice("item", F.col("ahead") + 1, F.col("blocks") * BLOCK)).withColumn("__b", _blocks("__w"))
    sizes = list(range(2, MOST + 1))
    marked = _with_fingerprints(laid.select("of", "m", "ahead", "blocks", "__b"), "__b", F.lit(0), sizes)
    marked = marked.withColumn("print", F.element_at(F.array(*[F.col(f"__f{w}") for w in sizes]), F.col("blocks") - 1))
    return marked.select("of", "m", "ahead", "blocks", "print").distinct().select(F.explode(_keys(F.col("print"), F.col("blocks"), True)).alias("key"), "print", "of", "m", "ahead", "blocks")


def _shingle_texts(words: str, k: int) -> Column:
    """The k-word shingles of a list of words; all its words if they are fewer."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.array_join(F.slice(words, i + 1, k), " "))).otherwise(F.array(F.array_join(words, " ")))


def _shortened(texts: DataFrame, k: int, least: float) -> DataFrame:
    """(of, m, run, size, alone): items (of, m, item) less as many words at their ends as leave the share `least` of their shingles; such a run counts where it is a whole document."""
    most = F.floor((F.col("m") - k + 1) * (1 - least) + 1e-9).cast("int")
    less = F.flatten(F.transform(F.sequence(F.lit(1), most), lambda d: F.transform(F.sequence(F.lit(0), d), lambda a: F.slice("item", a + 1, F.col("m") - d))))
    cut = texts.filter(most >= 1).select("of", "m", F.explode(less).alias("words"))
    return cut.select("of", "m", F.xxhash64("words").alias("run"), F.size("words").alias("size"), F.lit(True).alias("alone"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    carry: list[str] | None = None,
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = 5,
    least: float = 0.8,
    most_broadcast: int = 500_000,
) -> DataFrame:
    """One row per row of docs and benchmark item found in it: the carried columns (doc_id), item_id, start and
    n_words of the best window (in words from 0; the first of equals) and its similarity.

    Words are runs of letters and digits in lower case. A window has the item's number of words (fewer only if the
    document ends before). Candidates are the windows in which the fingerprint of the blocks inside, of all but the
    first or last, or of one half, differs from the item's in at most RADIUS bits; a pair counts if the weighted
    Jaccard similarity of the k-word shingles (weight: number of times a shingle stands there) is at least `least`. An
    item of so few shingles that one other word brings it under `least` must stand there word by word and is looked for
    by a hash of all its words, or of all but some at its ends where the document is no more than that; items of fewer
    than k words must stand there whole. Null and empty texts match nothing.
    Rows equal in the carried columns and the text are reported once; items of equal text are all reported; a null
    item_id is reported as null. Carried columns may have any name but those of the result, before which they give way.
    Fingerprints of the items and places found are broadcast up to most_broadcast rows (counted), joined by shuffle
    beyond. Texts are told apart by two 64-bit hashes.
    """
    carry = [c for c in (carry or ["doc_id"]) if c.lower() not in ("item_id", "start", "n_words", "similarity")]
    hidden = [f"__carried{i}" for i in range(len(carry))]
    items = benchmark.select(F.col(item_id).alias("item_id"), _words(item_text).alias("item")).filter(F.size("item") > 0).withColumns({"of": F.xxhash64("item"), "m": F.size("item")})
    items = written(items, "items")
    short = k + (1 + least) / max(1 - least, 1e-9) - 1 - 1e-6  # of fewer words than this an item is matched exactly
    texts = items.select("of", "m", "item").distinct()
    lengths = sorted(r[0] for r in items.filter(F.col("m") < short).select("m").distinct().collect())  # under `short` numbers
    known = written(_known(texts.filter(F.col("m") >= short)), "known")
    sizes = sorted(r[0] for r in known.select("blocks").distinct().collect())  # MOST numbers at most

    # One pass over the words of all texts.
    key = {"__k1": F.xxhash64(text_of(text)), "__k2": F.xxhash64(F.lit(1), text_of(text))}
    worded = docs.select(*[v.alias(c) for c, v in key.items()], _words(text).alias("__words")).withColumn("__n", F.size("__words"))
    own = ["__k1", "__k2", "of", "m", "start"]
    found = []
    if sizes:
        # Outer explodes throughout: for others Catalyst infers a filter on the size, which it pushes below the words.
        # Written first: the planner looks through the long chain of carries again and again, and must not find the words below it.
        laid = written(worded.select("__k1", "__k2", "__n", _blocks("__words").alias("__b")), "blocks").withColumn("__size", F.size("__b"))
        laid = laid.withColumn("__j", F.explode_outer(F.sequence(F.lit(0), F.col("__size"))))
        marked = _with_fingerprints(laid, "__b", F.col("__j"), sizes).drop("__b")
        # One row per size; unpivoting also keeps the planner's constraints out of the long chain of carries.
        named = {f"__f{w}": str(w) for w in sizes}
        marked = marked.withColumnsRenamed(named).unpivot(["__k1", "__k2", "__n", "__j", "__size"], list(named.values()), "__w", "__print")
        marked = marked.withColumn("__w", F.col("__w").cast("int")).filter(F.col("__j") + F.col("__w") <= F.col("__size"))
        keyed = marked.withColumn("key", F.explode(_keys(F.col("__print"), F.col("__w"), False)))
        met = keyed.join(broadcast_if_small(known.drop("blocks"), most_broadcast), "key").filter(F.bit_count(F.col("__print").bitwiseXOR(F.col("print"))) <= RADIUS)
        start = F.greatest(F.lit(0), F.least(F.col("__j") * BLOCK - F.col("ahead"), F.col("__n") - F.col("m")))
        found.append(met.select("__k1", "__k2", "of", "m", start.alias("start")))
    if lengths:
        # All runs of these lengths, and short documents as they are, in one pass; a document's own run may be an item less some words at its ends.
        held = texts.filter(F.col("m") < short).select("of", "m", F.col("of").alias("run"), F.col("m").alias("size"), F.lit(False).alias("alone"))
        known_runs = written(held.unionByName(_shortened(texts.filter(F.col("m") < short), k, least)), "runs")
        run = lambda size: lambda i: F.struct(F.lit(size).alias("size"), i.alias("start"), F.xxhash64(F.slice("__words", i + 1, size)).alias("run"))
        none = F.array().cast("array<struct<size:int,start:int,run:bigint>>")
        runs = [F.when(F.col("__n") >= m, F.transform(F.sequence(F.lit(0), F.col("__n") - m), run(m))).otherwise(none) for m in lengths]
        whole = F.struct(F.col("__n").alias("size"), F.lit(0).alias("start"), F.xxhash64("__words").alias("run"))
        runs.append(F.when((F.col("__n") > 0) & (F.col("__n") < short), F.array(whole)).otherwise(none))
        spread = worded.select("__k1", "__k2", "__n", F.inline_outer(F.concat(*runs)))
        met = spread.join(broadcast_if_small(known_runs, most_broadcast), ["run", "size"]).filter(~F.col("alone") | (F.col("size") == F.col("__n")))
        found.append(met.select("__k1", "__k2", "of", "m", "start"))
    places = docs.sparkSession.createDataFrame([], "__k1 long, __k2 long, of long, m int, start int")
    for df in found:
        places = places.unionByName(df)
    places = written(places.groupBy(*own).agg(F.count(F.lit(1)).alias("__hits")).drop("__hits"), "places")

    # Exact similarities where something was found.
    hits = docs.withColumns(key).select(*[F.col(c).alias(n) for c, n in zip(carry, hidden, strict=True)], "__k1", "__k2", text_of(text).alias("__text"))
    hits = hits.join(broadcast_if_small(places, most_broadcast), ["__k1", "__k2"]).withColumn("__words", _words("__text"))
    who = [*hidden, "__k1", "__k2"]
    windows = hits.select(*who, "of", "m", "start", F.slice("__words", F.col("start") + 1, F.col("m")).alias("__window")).distinct()
    pairs = windows.join(broadcast_if_small(items, most_broadcast), ["of", "m"]).withColumns({"__a": _shingle_texts("__window", k), "__b": _shingle_texts("item", k)})
    pairs = pairs.withColumn("__all", F.array_union("__a", "__b"))
    count = lambda c, s: F.size(c) - F.size(F.array_remove(c, s))
    added = lambda f: F.aggregate("__all", F.lit(0), lambda x, s: x + f(count("__a", s), count("__b", s)))
    pairs = pairs.withColumn("similarity", added(F.least) / added(F.greatest))
    # The threshold comes after the aggregation: as a filter before it, Catalyst would push it into the join, arrays and all.
    best = F.max_by(F.struct("start", F.size("__window").alias("n_words"), "similarity"), F.struct("similarity", (-F.col("start")).alias("first")))
    chosen = pairs.groupBy(*who, "item_id", "of").agg(best.alias("best")).filter(F.col("best.similarity") >= least)
    return chosen.select(*[F.col(n).alias(c) for c, n in zip(carry, hidden, strict=True)], "item_id", "best.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
