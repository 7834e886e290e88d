"""Best-fit packing of token sequences, certified by lower bounds.

Documents are encoded, closed with an end token and cut into pieces of at most limit tokens. The pieces are dealt into
partitions in order of length, so that each gets the same mix, and each partition is packed by best-fit decreasing. Dual feasible functions bound the number of
sequences from below: a partition that meets its bound is certified and keeps all its sequences but the emptiest, which
bears the rounding of the bound. Partitions above their bound, and those emptiest sequences, exchange their pieces: they
are dealt anew and packed again, as long as that needs fewer sequences.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import free_names, removed, text_of, without, written

PIECES = ["piece", "start", "length", "ids"]
PLACES = ["sequence_id", "offset", "certified"]
#: How a byte-level vocabulary file without a pattern of its own splits text before the merges (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bits of a sequence id below the partition, and below the round.
BIN_BITS, PART_BITS = 24, 58
#: Sequences that a partition must have tokens for, so that one loose sequence of each is little.
LEAST_BINS = 64
#: Bound functions of the rounding family that are tried.
ROUNDINGS = 64


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file, whose ids ascend with its merges."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, split = whole["model"], whole["pre_tokenizer"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    ranks = {bytes(spelled[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if split["type"] != "ByteLevel" or split["add_prefix_space"] or whole["normalizer"] or merged != sorted(merged):
        raise ValueError(f"{path} is no plain byte-level BPE with ids in the order of its merges")
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, path: str, *, limit: int = 2048, end: int = 0, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The token pieces of docs: the columns in carry (all by default), piece (from 0), start, length and ids.

    A document is its ids as the tokenizers library gives them for the file at path (there on every machine; special
    strings in a text are special tokens), then the id end. Only one of more than limit tokens is cut: all its pieces
    but the first are full, and the first takes the rest. ids: little-endian unsigned 32-bit integers. A null text
    counts as empty and is one piece of one token; repeated rows are encoded one by one; input columns named as the new
    ones give way.
    """
    docs = without(docs, *PIECES)
    carry = [*(carry or docs.columns)]
    fields = [T.StructField(name, kind) for name, kind in zip(PIECES, (T.LongType(), T.LongType(), T.LongType(), T.BinaryType()), strict=True)]

    @F.pandas_udf(T.ArrayType(T.StructType(fields)))
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode
        for batch in texts:
            out = []
            for t in batch:
                ids = np.array([*encode(t, allowed_special="all", disallowed_special=()), end], "<u4")
                bounds = [0, *range((len(ids) - 1) % limit + 1, len(ids) + 1, limit)]
                out.append([{"piece": k, "start": a, "length": b - a, "ids": ids[a:b].tobytes()} for k, (a, b) in enumerate(zip(bounds, bounds[1:]))])
            yield pd.Series(out)

    return docs.select(*carry, F.inline(cut(text_of(text))))


def lower_bound(counts: np.ndarray) -> int:
    """A number of bins that no packing can stay below; counts[x] items are of size x, the last index is a bin's room.

    The largest of the volumes under three families of dual feasible functions (Fekete and Schepers): with small items
    left out against large ones, rounded to shares of k + 1, and with middle items counted by how many fit a bin.
    """
    room = len(counts) - 1
    sizes = np.arange(room + 1, dtype=np.int64)
    volume, number = np.cumsum(sizes * counts), np.cumsum(counts)
    best = -(-int(volume[-1]) // room)
    small = np.arange(1, room // 2 + 1)
    left = volume[room - small] - volume[small - 1] + room * (number[-1] - number[room - small])
    best = max(best, -(-int(left.max(initial=0)) // room))
    for k in range(1, ROUNDINGS + 1):
        exact = (k + 1) * sizes % room == 0
        weight = np.where(exact, k * sizes, room * ((k + 1) * sizes // room))  # in 1 / (k * room)
        best = max(best, -(-int(weight @ counts) // (k * room)))
    held, half = np.flatnonzero(counts), room // 2
    above = held[held > half]
    for least in held[(held > 0) & (held <= half)]:
        fit = room // int(least)
        weight = int(number[half] - number[least - 1]) + int((fit - (room - above) // least) @ counts[above])  # in 1 / fit
        best = max(best, -(-weight // fit))
    return best


def best_fit_decreasing(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, the items in descending order of size; counts as for lower_bound.

    The fullest bin with enough room takes as many items of a size as it can hold, as it stays the fullest.
    """
    room = len(counts) - 1
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    there = np.zeros(room + 1, bool)
    bins, offsets, n = [], [], 0
    for size in np.flatnonzero(counts)[::-1].tolist():
        rest = int(counts[size])
        while rest:
            left = size + int(np.argmax(there[size:]))
            if there[left]:
                b = open_bins[left].pop()
                there[left] = bool(open_bins[left])
            else:
                b, left, n = n, room, n + 1
            take = min(rest, left // size)
            bins += [b] * take
            offsets += range(room - left, room - left + take * size, size)
            left, rest = left - take * size, rest - take
            if left:
                open_bins[left].append(b)
                there[left] = True
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def _dealt(rows: DataFrame, parts: int, round_: int) -> DataFrame:
    """rows (row, length) with part: of neighbours in order of length, each part gets one, in an order of the round's own."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() * 7919
        for batch in batches:
            place = at + np.arange(len(batch))
            turn = (place // parts + 1) * (2 * round_ + 1) * 2_654_435_761 >> 16  # each stretch of neighbours begins with another part
            yield batch[["row", "length"]].assign(part=(place + turn) % parts)
            at += len(batch)

    if parts == 1:
        return rows.select("row", "length", F.lit(0).cast("long").alias("part"))
    mixed = rows.withColumn("mix", F.xxhash64(F.lit(round_), "row"))
    return mixed.repartitionByRange("length", "mix").sortWithinPartitions("length", "mix").mapInPandas(deal, "row long, length long, part long")


def _packed(limit: int, round_: int):
    """Packs one partition; see best_fit_packing."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        counts = np.bincount(group["length"], minlength=limit + 1)
        bins, offsets = best_fit_decreasing(counts)
        filled = np.bincount(bins, weights=group["length"])
        certified = len(filled) == lower_bound(counts)
        begin = (round_ << PART_BITS) + (int(group["part"].iloc[0]) << BIN_BITS)
        loose = bins == int(np.argmin(filled)) if certified else np.ones(len(bins), bool)
        new = np.zeros(len(bins), np.int64)
        new[np.unique(bins, return_index=True)[1]] = 1
        return pd.DataFrame({"row": group["row"], "length": group["length"], "sequence_id": begin + bins, "offset": offsets, "certified": certified, "loose": loose, "first": new})

    return pack


def best_fit_packing(items: DataFrame, *, limit: int = 2048, length: str = "length", per_part: int = 8192, rounds: int = 12) -> DataFrame:
    """The rows of items with sequence_id, offset (gapless from 0 in each sequence) and certified (its partition met the bound).

    length: tokens of each row, 1 to limit; another value, or null, raises an error. No sequence exceeds limit. Rows of
    the full length are sequences of their own. The others are dealt into partitions of about per_part rows (more if they are so short
    that these would not fill LEAST_BINS sequences), packed, and
    exchanged as the module tells, for at most so many rounds; an exchange that saves no sequence is undone and ends
    them. Equal rows are packed one by one; an empty table gives an empty one; input columns named as the new ones give way.
    """
    items = without(items, *PLACES)
    (row,) = free_names(items, "row")
    base = written(items.withColumn(row, F.monotonically_increasing_id()), "items")
    size = F.col(length).cast("long")
    fits = F.when(size.between(1, limit), size).otherwise(F.raise_error(F.lit(f"lengths must lie between 1 and {limit}")).cast("long"))
    open_rows = base.select(F.col(row).alias("row"), fits.alias("length")).filter(F.col("length") < limit)
    places, was, before = [], None, None
    for k in range(min(rounds, 31)):
        n, volume = open_rows.agg(F.count(F.lit(1)), F.sum("length")).first()
        parts = max(1, min(math.ceil(n / per_part), (volume or 0) // (LEAST_BINS * limit)))
        packed = _dealt(open_rows, parts, k).groupBy("part").applyInPandas(_packed(limit, k), "row long, length long, sequence_id long, offset long, certified boolean, loose boolean, first long")
        packed = written(packed, f"round{k}")
        bins = packed.agg(F.sum("first"), F.sum(F.when(F.col("loose"), F.col("first")))).first()
        if was is not None and (bins[0] or 0) >= was:
            removed(packed)
            break
        places.append(packed.filter(~F.col("loose")))
        before, was, open_rows = packed.filter("loose"), bins[1] or 0, packed.filter("loose").select("row", "length")
        if parts == 1:
            break
    placed = functools.reduce(DataFrame.unionByName, [*places, before]).select(F.col("row").alias(row), *PLACES)
    alone = base.filter(size == limit).withColumns({"sequence_id": -1 - F.col(row), "offset": F.lit(0).cast("long"), "certified": F.lit(True)})
    return base.filter(size < limit).join(placed, row).unionByName(alone).drop(row)


def sequences(packed: DataFrame, *, ids: str = "ids") -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, of rows that carry their ids."""
    in_order = F.sort_array(F.collect_list(F.struct("offset", F.col(ids).alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.aggregate(in_order, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), carry=["doc_id"])
    cut = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return best_fit_packing(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
