"""Prefix look-up, unions of variants, report sections, block integrity and capabilities against plain Python."""

import random

import pytest

from loamgrid.operators import analytics as A
from loamgrid.operators import prefixes as P
from loamgrid.operators import retrieval as R
from loamgrid.sources import bundle as B
from loamgrid.sources import integrity as I


def test_prefix_pairs_equal_all_pairs(spark):
    rng = random.Random(6)
    make = lambda n: ["".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(0, 5))) for _ in range(n)]
    terms, words = [*make(150), None, "ab", "ab"], [*make(400), None, "abab"]
    got = P.prefix_pairs(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()
    want = {(t, w) for t in terms for w in words if None not in (t, w) and (t.startswith(w) or w.startswith(t))} - {(t, "") for t in terms if t}
    assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == want
    assert P.prefix_pairs(spark.createDataFrame([], "term string"), spark.createDataFrame([("a",)], "word string")).count() == 0


def test_prefix_search(spark):
    chunks = spark.createDataFrame([(k, t) for k, t in enumerate(["Fever in children", "FEVERISH child", "cough", "a child's fever", None, "fever, chilly"])], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "feve"), (2, "fever chil"), (3, "child fev"), (4, "!!"), (5, None), (6, "Chil"), (7, "fever fever")], "query_id int, query string")
    got = {}
    for r in P.prefix_search(asked, chunks, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {1: [0, 1, 3], 2: [0, 3, 5], 3: [1, 3], 6: [0, 1, 3], 7: [0, 3, 5]}


def test_variants_of_two_sources_add_up(spark):
    schema = "chunk_id int, primary_question string, question_variants array<string>"
    lines = spark.createDataFrame([(1, "red gear", ["gear"]), (2, None, [" ", "bolt"])], schema)
    rows = spark.createDataFrame([(1, "red gear", None)], schema)
    index = R.variant_index(R.variant_sources(lines, rows))
    assert {(r.key, r.chunk_id): r.weight for r in index.collect()} == {("red", 1): 10, ("gear", 1): 16, ("red gear", 1): 20, ("bolt", 2): 6} | {("gear", 1): 10 + 2 + 4}


def test_report_sections(spark):
    chunks = [(1, "One", ["definition"]), (2, None, []), (3, "", ["dosage", "dosage", "x"]), (4, "Four", None), (5, "Five", ["coverage", "a", "b", "c"])]
    got = {(r.section, r.item): r.n for r in A.quality_sections(spark.createDataFrame(chunks, "chunk_id int, title string, aspects array<string>"), spark.createDataFrame([(1, 2), (1, 3)], "src int, dst int"), spark.createDataFrame([("t", "a"), ("t", "b")], "topic string, aspect string")).collect()}
    assert got == {
        ("chunks", "all"): 5, ("chunks", "zero aspects"): 2, ("chunks", "only definition"): 1, ("chunks", "three or more"): 2, ("chunks", "usable gaps"): 2, ("aspects", "definition"): 1, ("aspects", "dosage"): 2, ("aspects", "x"): 1, ("aspects", "coverage"): 1,
        ("aspects", "a"): 1, ("aspects", "b"): 1, ("aspects", "c"): 1, ("edges", "all"): 2, ("edges", "chunks with edges"): 1, ("topics", "t"): 2, ("rich", "3: [dosage, dosage, x]"): 1, ("rich", "Five: [coverage, a, b, c]"): 2,
    }


def test_a_damaged_block_is_named_and_fetched_again(spark):
    archives = spark.createDataFrame([("a.zip", bytes(range(256)) * 10), ("b.zip", b""), ("c.zip", b"x" * 100)], "path string, content binary")
    own = I.blocks(archives, 100)
    listed = I.manifest(own)
    rows = [(r.bundle, r.block, bytes(r.bytes)) for r in own.collect()]
    assert len(rows) == 26 + 1 + 1 and b"".join(b for _, _, b in sorted(rows)[:26]) == bytes(range(256)) * 10
    came = [(n, k, b"?" + b[1:] if (n, k) == ("a.zip", 3) else b) for n, k, b in rows if (n, k) not in (("a.zip", 20), ("c.zip", 0))] + [("a.zip", 99, b"?")]
    came = spark.createDataFrame([*came, came[0]], I.BLOCKS)
    bad = {(r.bundle, r.block): r.state for r in I.checked(came, listed).collect() if r.state != "whole"}
    assert bad == {("a.zip", 3): "damaged", ("a.zip", 20): "missing", ("c.zip", 0): "missing", ("a.zip", 99): "unknown"}
    assert {r.path for r in I.assembled(came, listed).collect()} == {"b.zip"}
    asked = {(r.bundle, r.block) for r in I.wanted(came, listed).collect()}
    assert asked == set(bad) - {("a.zip", 99)}
    fetched = spark.createDataFrame([(n, k, b) for n, k, b in rows if (n, k) in asked], I.BLOCKS)
    whole = I.resumed(came, fetched, listed)
    assert sorted(map(tuple, I.root(I.manifest(whole)).collect())) == sorted(map(tuple, I.root(listed).collect()))
    assert {r.path: bytes(r.content) for r in I.assembled(whole, listed).collect()} == {r.path: bytes(r.content) for r in archives.collect()}


def test_capabilities(spark, tmp_path):
    import numpy as np

    full = [("manifest.json", b'{"schema_version": "3.0.2"}'), ("content/chunks.jsonl", b'{"id": "a", "extra_metadata": {"is_acronym_entry": true}}\n{"id": "b"}'), ("index/embeddings.bin", B.vector_bytes(np.ones((2, 3)))), ("index/lexical.json", b'{"en": {"index": {"x": [{"chunk_id": "a", "score": 1}]}}}'), ("index/gap_graph.json", b'{"a": [{"to": "b", "score": 1}]}')]
    bare = [("manifest.json", b'{"version": "4.0", "retrievalCapabilities": {"hasLexicalIndex": true}}'), ("index/embeddings.bin", B.vector_bytes(np.ones((2, 3)))[:-1])]
    (tmp_path / "a.zip").write_bytes(B.zipped(full))
    (tmp_path / "b.zip").write_bytes(B.zipped(bare))
    got = {r.schema: r.asDict() for r in I.capabilities(B.entries(spark, f"{tmp_path}/*.zip")).drop("bundle").collect()}
    assert {k for k, v in got["3.0"].items() if v is True} == {"vectors", "words", "graph", "acronyms"}
    assert {k for k, v in got["4.0"].items() if v is True} == {"words"}
    (tmp_path / "c.zip").write_bytes(B.zipped([("manifest.json", b'{"version": "2.3"}')]))
    with pytest.raises(Exception, match="unsupported bundle version"):
        I.capabilities(B.entries(spark, f"{tmp_path}/*.zip")).collect()
