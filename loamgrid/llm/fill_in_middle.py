"""Fill-in-middle: texts cut at two token boundaries and put in prefix-suffix-middle or suffix-prefix-middle order.

The ends of a text's tokens are a set of code-point offsets, held as a Roaring-style set: the offsets are dealt by their
high 16 bits into containers, and each container is a sorted array, a bitmap or a list of runs, whichever is smallest.
Cumulative cardinalities lead from a rank to its container, and a select inside the container to the offset, so both
cuts are two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import free_names, text_of, without

OUTPUT = ["n", "form", "prefix_chars", "middle_chars", "output"]
SENTINELS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
TOKEN = "[A-Za-z]+|[^A-Za-z]"
#: Code points that one container covers.
SPAN = 1 << 16
#: Bytes of a bitmap container.
BITMAP = SPAN // 8


def token_ends(text: str) -> np.ndarray:
    """The offsets (code points) at which the tokens of a text end, ascending."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    lower = codes | 32
    letter = (lower >= 97) & (lower <= 122) & (codes < 128)
    inside = letter[:-1] & letter[1:]  # a letter that another follows ends no token
    return np.flatnonzero(np.append(~inside, np.ones(min(1, len(codes)), bool))) + 1


class BoundarySet:
    """A set of offsets: containers by the high 16 bits, with cumulative cardinalities.

    kinds: `array` (sorted low halves), `bitmap` (a bit for each low half) or `run` (first low half and length less one
    of each run of neighbours).
    """

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        self.keys = high[np.append(0, cuts)] if len(offsets) else high
        self.containers = [self.container((part & (SPAN - 1)).astype("<u2")) for part in np.split(offsets, cuts)] if len(offsets) else []
        self.upto = np.cumsum([0, *(np.diff(np.append(np.append(0, cuts), len(offsets))) if len(offsets) else [])])

    @staticmethod
    def container(low: np.ndarray) -> tuple[str, np.ndarray]:
        """The smallest of the three forms of sorted low halves."""
        wide = low.astype(np.int64)
        begins = np.flatnonzero(np.append(True, np.diff(wide) > 1))
        lengths = np.diff(np.append(begins, len(low)))
        if 4 * len(begins) <= min(2 * len(low), BITMAP):
            return "run", np.column_stack([low[begins], lengths - 1]).astype("<u2")
        if 2 * len(low) <= BITMAP:
            return "array", low
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        return "bitmap", np.packbits(bits, bitorder="little")

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.upto, k, side="right")) - 1
        kind, body = self.containers[at]
        return (int(self.keys[at]) << 16) + self.local(kind, body, k - int(self.upto[at]))

    @staticmethod
    def local(kind: str, body: np.ndarray, k: int) -> int:
        """The k-th low half of a container."""
        if kind == "array":
            return int(body[k])
        if kind == "run":
            before = np.cumsum(body[:, 1].astype(np.int64) + 1)
            run = int(np.searchsorted(before, k, side="right"))
            return int(body[run, 0]) + k - (int(before[run - 1]) if run else 0)
        before = np.cumsum(np.bitwise_count(body).astype(np.int64))
        byte = int(np.searchsorted(before, k, side="right"))
        rest = k - (int(before[byte - 1]) if byte else 0)
        return 8 * byte + int(np.flatnonzero(np.unpackbits(body[byte : byte + 1], bitorder="little"))[rest])


def _cuts(text: str, *draws: int) -> tuple[int, int, int]:
    """(tokens, offset of the first cut, offset of the second) for two draws, each taken modulo the tokens plus one."""
    ends = BoundarySet(token_ends(text))
    n = len(ends)
    return n, *(ends.select(k - 1) if k else 0 for k in sorted(int(h) % (n + 1) for h in draws))


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in ("n", "first", "second")]))
def cut_offsets(texts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Tokens of each text and the code-point offsets of its two cuts."""
    for batch in texts:
        yield pd.DataFrame([_cuts(*row) for row in zip(*batch, strict=True)], columns=["n", "first", "second"]).astype("int64")


def rebuilt(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    part = F.split(output, "|".join(SENTINELS.values()), -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, *, key: str = "doc_id", seed: int = 1, text: str = "text", share: int = 90, spm_share: int = 20) -> DataFrame:
    """The rows of docs with n (tokens), form, prefix_chars, middle_chars (code points; null if plain) and output.

    Four draws from a hash of seed and key choose two of the n + 1 places between tokens, whether a text is turned at all
    (share in a hundred) and which of those stand suffix first (spm_share in a hundred). A text that is empty or holds a
    sentinel stays plain, and so does one whose key is null, as there is nothing to draw from. A null text counts as
    empty. Equal rows are turned alike, rows of one key by the same draws; whole texts are read, whatever their length.
    Input columns named as the new ones give way.
    """
    docs = without(docs, *OUTPUT)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)
    draw = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    body, turn, way, cut = free_names(docs, "body", "turn", "way", "cut")
    draws = [F.coalesce(draw(i), F.lit(0).cast("long")) for i in range(2)]
    cuts = docs.withColumns({body: text_of(text), turn: draw(2) % 100, way: draw(3) % 100}).withColumn(cut, cut_offsets(body, *draws))
    held = F.exists(F.array(*map(F.lit, SENTINELS.values())), lambda s: F.contains(F.col(body), s))
    plain = (F.col(body) == "") | held | F.col(turn).isNull() | (F.col(turn) >= share)
    form = F.when(plain, "plain").when(F.col(way) < spm_share, "spm").otherwise("psm")
    formed = cuts.select(*docs.columns, body, cut, F.col(cut)["n"].alias("n"), form.alias("form"))
    first, second, turned = F.col(cut)["first"], F.col(cut)["second"], F.col("form") != "plain"
    piece = lambda begin, length: F.substring(F.col(body), begin.cast("int"), length.cast("int"))
    prefix, middle, suffix = piece(F.lit(1), first), piece(first + 1, second - first), piece(second + 1, F.length(body))
    p, s, m = map(F.lit, SENTINELS.values())
    psm, spm = F.concat(p, prefix, s, suffix, m, middle), F.concat(s, suffix, p, prefix, m, middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col(body))
    return formed.select(*docs.columns, "n", "form", F.when(turned, first).alias("prefix_chars"), F.when(turned, second - first).alias("middle_chars"), output.alias("output"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_in_middle(docs)
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(rebuilt(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = f"""
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || doc_id::VARCHAR) AS digest, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS tokens FROM documents
), drawn AS (
    SELECT *, len(tokens) AS n, [('0x' || substr(digest, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM hashed
), cut AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
    SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE body END) AS output_sha256,
    sha256(body) AS restored_sha256
FROM parts
"""
