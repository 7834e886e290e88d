"""Evidence, whole searches and generated texts against their parts and plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from loamgrid.functions import evidence as E
from loamgrid.functions import variation as G
from loamgrid.operators import generate as N
from loamgrid.operators import respond as S
from loamgrid.operators import retrieval as R

LONG = "A text that is surely longer than fifty characters, and it ends here."
RULES = [{"basis": "weight", "brackets": [{"min_kg": 5, "max_kg": 10, "dose": "one"}, {"max_kg": 12.5, "dose": "two"}, {"min_kg": 13, "dose": "three"}]}, {"basis": "age"}]


def test_evidence(spark):
    body = {"answer": LONG, "definition": "The PROVIDED text does not contain it", "procedure": "Wash.\nDry.", "dosage_rules": RULES, "side_effects": "rash", "list": ["x"], "empty": ""}
    rows = [(1, json.dumps({"en": body}), "DETAIL", "Fever", ["side_effects", "answer", "list", "empty", "none"], "Guide"), (2, json.dumps({"en": body}), "DEFINE", None, None, ""), (3, json.dumps({"fr": body}), "DEFINE", "T", [], "Guide"), (4, json.dumps({"en": {"dosage_rules": "as needed"}}), "DETAIL", "T", [], None), (5, None, "DETAIL", "T", [], "Guide")]
    df = spark.createDataFrame(rows, "k int, content string, intent string, title string, aspects array<string>, document string")
    got = {r.k: r.said for r in df.select("k", E.evidence(*map(F.col, ("content", "intent", "title", "aspects", "document"))).alias("said")).collect()}
    dosing = "Dosage:\nBy weight:\n  5-10kg: one\n  0-12.5kg: two\n  13-∞kg: three"
    assert got == {1: f"Topic: Fever\n\n{dosing}\n\nAnswer:\n{LONG}\n\nProcedure:\nWash.\nDry.\n\nSide effects:\nrash\n\nSource: Guide", 2: f"Answer:\n{LONG}", 3: "", 4: "Topic: T\n\nDosage rules:\nas needed", 5: ""}


def test_generation(spark):
    cases = [({"dosage_rules": RULES}, None, 5.0, (False, "dose is computed")), ({"x": "y"}, LONG, None, (False, "answer")), ({"x": "y"}, "• a\n• b\n- c\n* d" + " x" * 30, None, (True, "list")), ({"x": "y"}, "No meaningful information to process" + "!" * 40, None, (True, "no answer")), ({"referral": LONG, "definition": LONG}, "short", None, (False, "referral")), ({}, None, None, (True, "no answer"))]
    df = spark.createDataFrame([(k, json.dumps({"en": body}), answer, weight) for k, (body, answer, weight, _) in enumerate(cases)] + [(99, '{"fr": {}}', LONG, 1.0)], "k int, content string, answer string, weight double")
    got = {r.k: tuple(r.g) for r in df.select("k", E.generation(F.col("content"), F.col("answer"), F.col("weight")).alias("g")).collect()}
    assert got == {k: want for k, (*_, want) in enumerate(cases)} | {99: (False, "no content")}


@pytest.fixture(scope="module")
def lists(spark):
    schema = "query_id int, chunk_id int, score double"
    words = [(q, q * 10 + i, 5.0 - i) for q in range(1, 6) for i in range(4)] + [(7, 1, 0.4)]
    vectors = [(1, 12, 0.9), (1, 77, 0.5), (2, 20, 0.5), (2, 21, 0.49), (6, 5, 0.35), (6, 4, 0.35), (7, 1, 0.2), (3, 30, 0.7)]
    served = [(1, 12), (1, 10), *[(3, 30 + i) for i in range(4)], *[(4, 40 + i) for i in range(4)]]
    last, edges = [(1, 900), (3, 901), (4, 902)], [(900, 11, 1, 0.8), (900, 11, 2, 0.1), (901, 30, 0, 0.9), (901, 333, 1, None), (902, 40, 0, 0.5)]
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    return make(words, schema), make(vectors, schema), make(last, "query_id int, last_chunk int"), make(served, "query_id int, chunk_id int"), make(edges, "src int, dst int, ord int, edge_score double")


def test_a_whole_search_equals_its_stages(lists):
    words, vectors, last, served, edges = lists
    got = {r.query_id: r for r in S.respond(*lists).collect()}
    policy = {r.query_id: r for r in R.gate_policy(words, vectors).collect()}
    used = R.gate_policy(words, vectors).filter("use_vector").select("query_id")
    fused = R.rrf(words, vectors.join(used, "query_id", "left_semi")).select("query_id", "chunk_id", "score")
    sure = R.gate_policy(words, vectors).filter("confident").select("query_id")
    escaped = {r.query_id: r for r in R.dead_end_escape(R.graph_boost(fused, last, edges).drop("rank"), served, last, edges).join(sure, "query_id", "left_semi").collect()}
    plain = {r.query_id: r for r in R.dead_end_escape(fused, served, last, edges).collect()}
    assert set(got) == set(policy) == {1, 2, 3, 4, 5, 6, 7}
    for q, r in got.items():
        d, p = r.diagnostics, policy[q]
        assert (d.top_bm25, d.top_vector, d.margin, d.vector_gate_passed, d.confidence_gate_fired) == (p.bm25_top, p.vector_top, p.margin, p.use_vector, not p.confident)
        assert (r.route == "none") == (q not in escaped) == (r.chunk_id is None)
        if q in escaped:
            assert (r.route, r.chunk_id) == (plain[q].route, plain[q].chunk_id)
            boost = 0.2 if (q, r.chunk_id) == (1, 11) else 0.225 if (q, r.route) == (3, "repeat") else 0.125 if (q, r.route) == (4, "repeat") else 0
            assert r.score == d.fused == pytest.approx(plain[q].score + boost, abs=2e-6)
    assert {q: r.route for q, r in got.items()} == {1: "fresh", 2: "fresh", 3: "graph", 4: "repeat", 5: "fresh", 6: "fresh", 7: "none"}
    assert (got[1].chunk_id, got[3].chunk_id, got[3].score, got[4].chunk_id) == (11, 333, 0.5, 40)


def test_generated_texts_are_the_same_in_every_run(spark):
    rows = [(k, "{hello} my pikin and the {drug}? It is {weight}kg." if k % 3 else "Same text.", "Give {dose}mg for {weight}kg" if k % 2 else None) for k in range(60)] + [(99, None, "x"), (5, "{hello} again", "y")]
    df = spark.createDataFrame(rows, "id int, template string, response string")
    make = lambda d, seed=3: sorted(map(tuple, N.generated(d, {"hello": ["Hi", "Abeg"], "drug": ["para", "ors"]}, {"the": ["teh"]}, {"and": ["plus"]}, keys=["id"], seed=seed).collect()), key=repr)
    got = make(df)
    assert got == make(df.repartition(7).orderBy(F.desc("id"))) and got != make(df, 4)
    queries = [q.lower() for _, _, _, q, _ in got]
    assert len(queries) == len(set(queries)) and not any("{" in q for q in queries) and {k for _, _, k, _, _ in got} == set(G.KINDS)
    assert all(r is None or r == "y" or int(r.split("mg")[0][5:]) == 15 * int(r.split("for ")[1][:-2]) for *_, r in got)
    assert any("teh" in q for q in queries) and any("plus" in q for q in queries) and 99 not in {i for i, *_ in got}
