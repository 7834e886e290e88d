"""Merkle manifest and fill-in-middle: against DuckDB, against plain Python, and on the odd cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import fill_in_middle as fim
from loamgrid.llm import merkle_manifest as merkle
from tests.compare import oracle, rows

SF = "/root/testdata/sf0.001"


def test_queries_equal_their_sql(spark):
    for name, module in (("op12_merkle_manifest", merkle), ("op13_fill_in_middle", fim)):
        assert rows(getattr(module, name)(spark, SF).toPandas()) == rows(oracle(module.ORACLE, SF)), name


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    """(root, siblings of each node up to the root) of a list of digests."""
    if len(nodes) <= 1:
        return (nodes[0] if nodes else None), [[] for _ in nodes]
    runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
    root, above = climb([sha("".join(r)) for r in runs])
    return root, [[("".join(nodes[i // 16 * 16 : i]), "".join(nodes[i + 1 : i // 16 * 16 + 16])), *above[i // 16]] for i in range(len(nodes))]


def expected(docs):
    """{(source, place in it): (doc_id, leaf, subroot, root, siblings)} of (doc_id, source, text) rows."""
    written = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    groups = {}
    for doc_id, source, text in docs:
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, sha("".join(map(written, (doc_id, source, text))))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([leaf for *_, leaf in sorted(groups[s])]) for s in order}
    root, above = climb([trees[s][0] for s in order])
    return [(d if known else None, s, leaf, trees[s][0], root, [*own, *above[k]]) for k, s in enumerate(order) for (known, d, leaf), own in zip(sorted(groups[s]), trees[s][1], strict=True)]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2, None: 1}, {"a": 16, "b": 17, None: 15}, {"x": 256, "é": 257, "z": 300, **{f"s{k}": 1 for k in range(20)}}, {"one": 4100}])
def test_merkle_equals_plain_python(spark, sizes):
    rng = random.Random(3)
    docs = [(rng.choice([None, *range(2000)]) if rng.random() < 0.1 else 5000 + k, s, rng.choice([None, "", f"Text É {k}", "same"])) for s, n in sizes.items() for k in range(n)]
    docs += docs[:3]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, source string, text string, leaf string, idx int").repartition(3)
    out = merkle.merkle_manifest(df, fields=["doc_id", "source", "text"], tampered={"text": F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text"))}, rows_per_part=40, segments=True).collect()
    want = expected(docs)
    proof = lambda segments: sha("".join(b + a for b, a in segments))
    key = lambda *x: repr(x)
    assert sorted(key(r.doc_id, r.source, r.leaf, r.subroot, r.root, r.proof_sha256) for r in out) == sorted(key(d, s, leaf, sub, root, proof(path)) for d, s, leaf, sub, root, path in want)
    changed = {(d, s) for d, s, text in docs if text and text != text.lower() and d is not None and d % 2 == 0}
    assert all(r.verified == (r.folded_root == r.root) == ((r.doc_id, r.source) not in changed) for r in out if r.doc_id is None or r.doc_id >= 5000)
    assert all(proof(r.segments) == r.proof_sha256 for r in out)


def test_merkle_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(None, None, None)], "doc_id long, source string, text string")
    r = merkle.merkle_manifest(df, fields=["doc_id", "source", "text"]).first()
    assert r.leaf == r.subroot == r.root == r.folded_root == sha("---") and r.proof_sha256 == sha("") and r.verified
    assert merkle.merkle_manifest(df.limit(0), fields=["doc_id"]).count() == 0


def test_boundary_set_selects_like_a_sorted_list():
    rng = np.random.default_rng(5)
    sparse, dense = np.unique(rng.integers(0, 400_000, 3000)), np.flatnonzero(rng.random(200_000) < 0.5)
    runs = np.concatenate([np.arange(10, 50_000), np.arange(70_000, 190_000), np.arange(200_000, 200_003)])
    kinds = set()
    for offsets in (sparse, dense, runs, np.array([65_535, 65_536]), np.array([], np.int64)):
        held = fim.BoundarySet(offsets)
        kinds |= {kind for kind, _ in held.containers}
        assert len(held) == len(offsets)
        assert all(held.select(int(k)) == offsets[k] for k in (*rng.integers(0, max(1, len(offsets)), 300), 0, len(offsets) - 1) if len(offsets))
        with pytest.raises(IndexError):
            held.select(len(offsets))
    assert kinds == {"array", "bitmap", "run"}
    for text in ("", "a", "ab c", "é x\nYz\U0001f600q", "[]{}az@`"):
        assert fim.token_ends(text).tolist() == [m.end() for m in re.finditer(fim.TOKEN, text)]


def turned(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the definition."""
    text, tokens = text or "", re.findall(fim.TOKEN, text or "")
    digest = sha(f"1:{doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    if doc_id is None or not text or any(s in text for s in fim.SENTINELS.values()) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if h[3] % 100 < 20 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(tokens), "spm" if h[3] % 100 < 20 else "psm", len(prefix), len(middle), output


def test_fill_in_middle_equals_the_definition(spark):
    rng = random.Random(1)
    texts = [None, "", "one", "tell <P> me", "a<", "é\U0001f600 <\n>M> b", "long " * 300_000 + "end", "é" * 200_000] + ["".join(rng.choice(["ab", "Z", " ", "\n", "é", "<", ">", "S", "7"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    docs = [*enumerate(texts), (None, "no key"), (3, "repeated"), (3, "repeated")]
    df = spark.createDataFrame([(*d, "x", 7, "y") for d in docs], "doc_id long, text string, output string, n int, _body string")
    out = fim.fill_in_middle(df).withColumn("back", fim.rebuilt(F.col("output"), F.col("form"))).collect()
    key = lambda doc_id, text, *rest: (repr(doc_id), text or "", *map(repr, rest))
    assert sorted(key(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out) == sorted(key(d, t, *turned(d, t)) for d, t in docs)
    assert all(r.back == (r.text or "") and r._body == "y" for r in out) and {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0
