"""Best-fit packing: bounds against exhaustive search, ids against the library, the query against its contract."""

import random
import sys
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamgrid.llm import packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def optimum(items, room):
    """The least number of bins, by search."""
    items, best = sorted(items, reverse=True), len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {v: k for k, v in enumerate(bins) if v + items[i] <= room}.values():
            go(i + 1, [v + items[i] * (j == k) for j, v in enumerate(bins)])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_bounds_and_packing_against_search():
    rng, met = random.Random(0), 0
    for _ in range(300):
        room = rng.choice([1, 2, 7, 10, 20, 31])
        items = sorted((rng.randint(1, room) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(items, minlength=room + 1)
        bins, offsets = packing.best_fit_decreasing(counts)
        least = optimum(items, room)
        assert packing.lower_bound(counts) <= least <= bins.max() + 1
        met += packing.lower_bound(counts) == least
        filled = []
        for size in items:  # best fit, one by one
            fits = [(room - v - size, k) for k, v in enumerate(filled) if v + size <= room]
            k = min(fits)[1] if fits else len(filled)
            filled[k : k + 1] = [(filled[k] if fits else 0) + size]
        assert sorted(np.bincount(bins, weights=items)) == sorted(filled)
    assert met > 290


def test_ids_equal_the_library():
    library, own = Tokenizer.from_file(PATH), packing.encoding(PATH)
    rng = random.Random(2)
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1 {chr(c)} " for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    bits = ["<|endoftext|>", " ", "  ", "\n", "'s", "'S", "12", "é", "\U0001f600", "ab", " ", " ", "<|", "|>", "!!"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(5000)] + ["x" * 30_000, " " * 30_000 + "y", "ab" * 20_000]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text, allowed_special="all", disallowed_special=()) == want.ids, text[:80]
    with pytest.raises((ValueError, KeyError)):
        packing.encoding(public_tokenizers.path("word_bpe_49k.json"))


def test_query_keeps_its_contract(spark):
    table = pd.read_parquet(f"{SF}/documents.parquet")
    out = packing.op11_best_fit_packing(spark, SF).toPandas()
    library = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in zip(table["doc_id"], table["text"], strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    check(out, packing.lower_bound(np.bincount(out["length"], minlength=2049)) + 1)


def check(out, most):
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() <= 2048
    assert out["sequence_id"].nunique() <= most, (out["sequence_id"].nunique(), most)


@pytest.mark.parametrize("sizes", ["any", "large", "thirds", "ones"])
def test_many_partitions_need_hardly_more_than_the_bound(spark, sizes):
    rng = np.random.default_rng(4)
    drawn = {"any": rng.integers(1, 2049, 6000), "large": np.append(rng.integers(1000, 2049, 3000), rng.integers(1, 300, 3000)), "thirds": np.full(6000, 683), "ones": np.ones(5000, int)}[sizes]
    rows = spark.createDataFrame(pd.DataFrame({"length": drawn, "row": 1, "offset": "x"}))
    out = packing.best_fit_packing(rows, per_part=300).toPandas()
    assert len(out) == len(drawn) and set(out.columns) == {"length", "row", "sequence_id", "offset", "certified"}
    bound = packing.lower_bound(np.bincount(drawn, minlength=2049))
    whole = int(packing.best_fit_decreasing(np.bincount(drawn, minlength=2049))[0].max()) + 1
    assert bound <= whole
    check(out, whole * 1.003 + 1)


def test_odd_rows(spark):
    schema = "doc_id long, text string, ids string, sequence_id string, extra string"
    long = "word of the long text " * 4000 + "é" * 3000
    docs = spark.createDataFrame([(1, None, "x", "y", "z"), (2, "", "x", "y", "z"), (None, "a", "x", "y", "z"), (3, long, "x", "y", "z"), (3, long, "x", "y", "z"), (3, "a", "x", "y", None)], schema)
    cut = packing.pieces(docs, PATH, limit=100)
    out = packing.best_fit_packing(cut, limit=100)
    got = out.collect()
    assert sorted(out.columns) == ["certified", "doc_id", "extra", "ids", "length", "offset", "piece", "sequence_id", "start", "text"]
    assert {r.length for r in got if not r.text} == {1} and all(r.length == 100 for r in got if r.piece)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(out).collect()}
    assert all(whole[r.sequence_id][r.offset : r.offset + r.length].tolist() == np.frombuffer(r.ids, "<u4").tolist() for r in got)
    assert sum(map(len, whole.values())) == sum(r.length for r in got) and max(map(len, whole.values())) <= 100
    assert packing.best_fit_packing(packing.pieces(docs.limit(0), PATH)).count() == 0
    for bad in (0, 101, None):
        with pytest.raises(Exception, match="lengths must lie"):
            packing.best_fit_packing(spark.createDataFrame([(bad,)], "length int"), limit=100).collect()
    assert packing.best_fit_packing(spark.range(3).select(F.lit(100).alias("length")), limit=100).select("sequence_id").distinct().count() == 3
