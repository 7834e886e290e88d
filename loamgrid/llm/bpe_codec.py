"""BPE encoding and decoding by tree concatenation.

A piece of text without a split point is cut in halves again and again, down to leaves of a few letters; the halves are
encoded on their own, those of very long pieces in parallel as rows of their own. Two encoded halves are joined by
encoding a window around the join anew; the window grows until its first token is one that the left half has there and
its last one that the right half has there. Tokens next to each other that are right in one encoding are right in any,
so the result is exact.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.bpe import BEYOND, Memory, Vocabulary, spelled, vocabulary
from loamgrid.llm.common import text_of, without, written

OUTPUT = ["ids", "decoded"]
#: White space for str.split that the pieces don't take for such.
ODD = re.compile("[\\x1c-\\x1f]")
NEVER = 1 << 60


class Codec:
    """Encodes pieces; leaf is the length up to which a string is merged whole."""

    def __init__(self, v: Vocabulary, leaf: int = 6):
        self.v, self.leaf = v, leaf
        self.rank = {pair: k for k, pair in enumerate(v.merges)}
        self.letters = np.array([v.letters.get(k, "") for k in range(max(v.letters) + 1)], dtype=object)
        self.body = [t.removesuffix(v.suffix) for t in self.letters]
        #: Ids of the words between white space, of texts whose pieces no special string and no wide character decides.
        self.words = Memory(lambda word: b"".join(map(self.pieces.__getitem__, self.v.pieces(word))), most=100_000)
        self.pieces = Memory(self.piece, most=250_000)
        #: Short strings, and windows of one token on each side of a join.
        self.leaves = Memory(lambda key: self.merged(*key), most=150_000)
        self.borders = Memory(lambda key: self.window([key[0]], [key[1]], key[2]), most=150_000)

    def whole(self, letters: str, last: bool) -> list[int]:
        return self.leaves[letters, last] if len(letters) <= 2 * self.leaf else self.merged(letters, last)

    def merged(self, letters: str, last: bool) -> list[int]:
        """The ids of a string by the merges in order of rank, the leftmost of equals first; last: it ends the word."""
        parts, rank = list(letters), self.rank.get
        if last and parts:
            parts[-1] += self.v.suffix
        while True:
            least, at = NEVER, -1
            for i, pair in enumerate(zip(parts, parts[1:])):
                r = rank(pair, NEVER)
                if r < least:
                    least, at = r, i
            if at < 0:
                return [self.v.ids[t] for t in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def window(self, a: list[int], b: list[int], at_end: bool) -> list[int]:
        return self.whole("".join([self.body[t] for t in (*a, *b)]), at_end)

    def joined(self, a: list[int], b: list[int], last: bool) -> list[int]:
        """The encoding of what a and b stand for together; last: b ends the word."""
        if not a or not b:
            return a or b
        take = 1
        while True:
            i, j = min(take, len(a)), min(take, len(b))
            at_end = last and j == len(b)
            window = self.borders[a[-1], b[0], at_end] if take == 1 else self.window(a[-i:], b[:j], at_end)
            left = i == len(a) or window[0] == a[-i]
            right = j == len(b) or window[-1] == b[j - 1]
            if left and right and len(window) > 1 or (i == len(a) and j == len(b)):
                return a[: len(a) - i] + window + b[j:]
            take *= 2

    def halves(self, letters: str, last: bool) -> list[int]:
        """The ids of a piece, or of its part that goes on."""
        if len(letters) <= self.leaf:
            return self.whole(letters, last)
        mid = len(letters) // 2
        return self.joined(self.halves(letters[:mid], False), self.halves(letters[mid:], last), last)

    def tree(self, leaves: list[list[int]]) -> list[int]:
        """The ids of a piece whose leaves are encoded already, the last with the mark of the word's end."""
        row = [(ids, k == len(leaves) - 1) for k, ids in enumerate(leaves)]
        while len(row) > 1:
            row = [(self.joined(row[k][0], row[k + 1][0], row[k + 1][1]), row[k + 1][1]) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)]
        return row[0][0]

    def piece(self, piece: str) -> bytes:
        ids = self.halves(spelled(piece), True)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "<|" not in text and not ODD.search(text) and (text.isascii() or not BEYOND.search(text.lower())):
            return b"".join(map(self.words.__getitem__, text.split()))
        out = []
        for special, pieces in self.v.segments(text):
            out += [struct.pack("<I", special)] if special is not None else map(self.pieces.__getitem__, pieces)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, special ones too, as the library puts them together for a file without a decoder."""
        return " ".join(self.letters[np.frombuffer(ids, "<u4")].tolist())


@functools.cache
def codec(path: str) -> Codec:
    return Codec(vocabulary(path))


def _parts(v: Vocabulary, text: str, leaf: int) -> Iterator[tuple[int, int, bool, str]]:
    """(piece, leaf, last leaf, letters) of a text; (piece, -1, True, content) for a special token."""
    n = 0
    for special, pieces in v.segments(text):
        if special is not None:
            yield n, -1, True, v.letters[special]
            n += 1
        for piece in pieces:
            letters = spelled(piece)
            for k in range(0, len(letters), leaf):
                yield n, k // leaf, k + leaf >= len(letters), letters[k : k + leaf]
            n += 1


def bpe_encode(docs: DataFrame, path: str, *, text: str = "text", carry: list[str] | None = None, most_unsplit: int = 4096) -> DataFrame:
    """The rows of docs with ids (binary, little-endian unsigned 32-bit integers) and decoded (the text they decode to).

    path: the vocabulary file, there on every machine. carry: the input columns to keep (all by default). The result
    equals that of the library, special strings in a text included. A text with a stretch of more than most_unsplit
    characters without white space is cut into leaves of that length at most, encoded as rows of their own and joined
    as a tree; all others are encoded where they are. A null text counts as empty: no ids, an empty string. Rows with
    equal ids are encoded one by one; input columns named ids or decoded give way.
    """
    docs = without(docs, *OUTPUT)
    carry = [c for c in (carry or docs.columns)]
    kept = [F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)]
    long_stretch = text_of(text).rlike(f"[^ \\t-\\r]{{{most_unsplit + 1}}}") & (F.length(text_of(text)) > most_unsplit)

    @F.pandas_udf("ids binary, decoded string")
    def whole(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for batch in texts:
            for k in range(0, len(batch), 500):  # small results, small memory
                ids = [c.encode(t) for t in batch.iloc[k : k + 500]]
                yield pd.DataFrame({"ids": ids, "decoded": [c.decode(x) for x in ids]})
        c.words.clear()  # the worker lives on and may serve other stages

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for batch in batches:
            for row, t in zip(batch["__row"], batch["body"], strict=True):
                parts = [(row, *p) for p in _parts(v, t, most_unsplit)]
                for k in range(0, len(parts), 10_000):
                    yield pd.DataFrame(parts[k : k + 10_000], columns=["__row", "piece", "leaf", "last", "letters"])

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for batch in batches:
            ids = [[c.v.special[s]] if leaf < 0 else c.halves(s, last) for leaf, last, s in zip(batch["leaf"], batch["last"], batch["letters"], strict=True)]
            yield batch[["__row", "piece", "leaf"]].assign(ids=[np.array(x, "<u4").tobytes() for x in ids])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        c, out = codec(path), []
        for _, piece in group.sort_values(["piece", "leaf"]).groupby("piece", sort=True):
            out += c.tree([np.frombuffer(x, "<u4").tolist() for x in piece["ids"]])
        ids = np.array(out, "<u4").tobytes()
        return pd.DataFrame({"__row": [group["__row"].iloc[0]], "ids": [ids], "decoded": [c.decode(ids)]})

    short = docs.filter(~long_stretch).select(*carry, whole(text_of(text)).alias("__out")).select(*carry, "__out.*")
    numbered = written(docs.filter(long_stretch).select(*kept, text_of(text).alias("body")).withColumn("__row", F.monotonically_increasing_id()), "long")
    rows = numbered.select("__row", "body").mapInPandas(cut, "__row long, piece long, leaf long, last boolean, letters string")
    rows = rows.repartition("__row", "piece", "leaf").mapInPandas(leaves, "__row long, piece long, leaf long, ids binary")
    whole_rows = rows.groupBy("__row").applyInPandas(joined, "__row long, ids binary, decoded string")
    long = numbered.drop("body").join(whole_rows, "__row").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], *OUTPUT)
    return short.unionByName(long)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
