"""Rendering, closings, scans and neighbours against plain Python on odd and planted rows."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import rendering as X
from loamgrid.operators import closings as C
from loamgrid.operators import neighbours as N
from loamgrid.operators import retrieval as R
from loamgrid.operators.scans import scanned
from loamgrid.plans import answers, retrieval

SF = "/root/testdata/sf0.001"

RENDERED = [
    ("faq", {"question": "What is it?", "answer": "A fever.", "details": "It passes."}, "What is it?\n\nA fever.\n\nIt passes."),
    ("faq", {"answer": "A \"fever\"\nof é."}, "\nA \"fever\"\nof é."),
    ("faq", {"question": "", "details": ""}, ""),
    ("drug_table", {"drug_name": "Red", "rows": [{"weight_range": "5-10kg", "dose": "2", "route": "oral", "frequency": "daily", "duration": "3 days"}], "watch_for": ["rash"], "refer_if": ["fits", "coma"]}, "Red Dosing\n\n• 5-10kg: 2 — oral, daily, for 3 days\n\n⚠️ Watch for:\n  – rash\n\n🏥 Refer immediately if:\n  – fits\n  – coma"),
    ("drug_table", {"drug_name": "Red", "watch_for": []}, "Red Dosing\n"),
    ("decision_tree", {"entry_node": "a", "nodes": {"a": {"question": "Hot?", "options": [{"label": "Yes", "next": "b"}, {"label": "No", "next": "c"}]}, "b": {"action": "x"}}}, "Hot?\n\nTap an option to continue:\n1. Yes\n2. No"),
    ("decision_tree", {"entry_node": "b", "nodes": {"b": {"action": "Cool down", "refer": "never"}}}, "✅ Cool down"),
    ("decision_tree", {"entry_node": "b", "nodes": {"b": {"refer": "To town"}}}, "🚨 To town"),
    ("decision_tree", {"entry_node": "z", "nodes": {"b": {"refer": "To town"}}}, X.NO_TREE),
    ("protocol", {"title": "Wash", "steps": ["wet", "dry"], "notes": "slowly"}, "Wash\n\n1. wet\n2. dry\n\n💡 slowly"),
    ("danger_sign", {"sign": "Fits", "severity": "emergency", "immediate_action": "Lay down", "refer_urgency": "now", "handover_info": "times"}, "🚨 EMERGENCY: Fits\n\nImmediate action:\nLay down\n\nRefer: now\n\nTell the facility: times"),
    ("danger_sign", {"sign": "Cough", "severity": "urgent", "immediate_action": "Wait"}, "⚠️ URGENT: Cough\n\nImmediate action:\nWait"),
    ("calculator", {"title": "BMI", "inputs": [{"id": "w", "label": "Weight", "type": "n"}, {"label": "Height"}], "output_unit": "kg/m2"}, "📐 BMI\n\nEnter the required value:\n• Weight\n• Height\n\nResult will show in kg/m2."),
    ("unknown", {"k": 1}, '{"k":1}'),
]


def test_six_renderers(spark):
    rows = [(k, kind, json.dumps({"en": body}, ensure_ascii=False, separators=(",", ":"))) for k, (kind, body, _) in enumerate(RENDERED)]
    rows += [(100, "faq", None), (101, "faq", "no json"), (102, "faq", '{"ha":{"question":"Q"},"en":{"question":"E"}}'), (103, "faq", '{"ha":null,"en":{"question":"E"}}'), (104, "faq", '{"fr":{"question":"F"}}')]
    got = {r.k: r.said for r in spark.createDataFrame(rows, "k int, kind string, content string").select("k", X.rendered(F.col("kind"), F.col("content"), "ha").alias("said")).collect()}
    assert [got[k] for k in range(len(RENDERED))] == [want for *_, want in RENDERED]
    assert [got[k] for k in range(100, 105)] == [X.NO_CONTENT, X.NO_CONTENT, "Q", "E", X.NO_CONTENT]


def outlined(tree):
    """The outline by recursion over a stack."""
    lines, seen, stack = [], set(), [(tree["entry_node"], "", 0)]
    while stack:
        name, label, depth = stack.pop(0)
        node = {} if name in seen else tree["nodes"].get(name, {})
        seen.add(name)
        says = node.get("question") or ("✅ " + node["action"] if node.get("action") else "🚨 " + node["refer"] if node.get("refer") else "")
        lines.append("  " * depth + ": ".join(x for x in (label, says) if x))
        stack = [(o["next"], o["label"], depth + 1) for o in node.get("options", [])] + stack
    return "\n".join(lines)


def test_tree_outline_ends_and_equals_recursion(spark):
    rng, trees = random.Random(4), []
    for _ in range(40):
        names = [f"n{i}" for i in range(rng.randint(1, 9))]
        nodes = {n: {"question": rng.choice(["", f"{n}?"]), rng.choice(["action", "refer"]): f"do {n}", "options": [{"label": f"to {m}", "next": m} for m in rng.sample([*names, "lost"], rng.randint(0, min(3, len(names))))]} for n in names}
        trees.append({"entry_node": "n0", "nodes": nodes})
    rows = [(k, json.dumps(t, ensure_ascii=False)) for k, t in enumerate(trees)] + [(99, "{}"), (100, None)]
    got = {r.k: r.said for r in spark.createDataFrame(rows, "k int, body string").select("k", X.tree_outline(F.col("body")).alias("said")).collect()}
    assert [got[k] for k in range(40)] == [outlined(t) for t in trees] and got[99] is None and got[100] is None


def test_scan_equals_a_serial_fold(spark):
    """Maps "after `seen` comes `same`, else `else`" over groups of one block, several blocks and several levels; gaps in the order; null maps."""
    rng, rows = random.Random(9), []
    for g, n in {"a": 1, "b": 7, "c": 300, None: 40}.items():
        for t in sorted(rng.sample(range(5000), n)):
            rows.append((g, t, *(rng.choice("xyz") for _ in range(3)), rng.random() < 0.2))
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "g string, t int, seen string, same string, other string, none boolean").repartition(3)
    step = F.when(~F.col("none"), F.struct("seen", "same", "other"))
    apply = lambda m, s: F.when(s.eqNullSafe(m["seen"]), m["same"]).otherwise(m["other"])
    compose = lambda f, g: F.struct(f["seen"].alias("seen"), apply(g, f["same"]).alias("same"), apply(g, f["other"]).alias("other"))
    got = scanned(df, "g", ["t"], step, F.lit("x"), apply=apply, compose=compose, block=4).collect()
    state, want = {}, {}
    for g, t, seen, same, other, none in rows:
        before = state.get(g, "x")
        state[g] = before if none else same if before == seen else other
        want[g, t] = (before, state[g])
    assert len(got) == len(rows) and {(r.g, r.t): (r.before, r.after) for r in got} == want
    assert scanned(df.limit(0), "g", ["t"], step, F.lit("x"), apply=apply, compose=compose).count() == 0


def test_closings_never_repeat_and_equal_a_serial_fold(spark):
    rng, rows = random.Random(2), []
    for conv in range(6):
        for t in sorted(rng.sample(range(400), 60 if conv else 350)):
            rows.append((conv, t, rng.choice(["DEFINE", "SCOPE", "AFFIRM", "URGENT", "GREETING", "DETAIL", None]), rng.choice([None, [], ["dosage"], ["odd", "dosage"]]), rng.choice([None, "", "rice"]), rng.choice([True, False, None])))
    df = spark.createDataFrame(rows, "conv_id int, turn int, intent string, gaps array<string>, topic string, patient boolean")
    got = {(r.conv_id, r.turn): r.closing for r in C.closings(df, draw=F.col("turn") * 7).collect()}
    last = {}
    for conv, turn, intent, gaps, topic, patient in rows:
        if intent == "GREETING":
            want = ""
        elif intent == "URGENT":
            want = C.URGENT
        else:
            own = C.BY_GAP.get(gaps[0], C.OTHER_GAP) if gaps else C.AFFIRMED if intent == "AFFIRM" else C.PATIENT if patient else C.BY_INTENT.get(intent, C.OTHER_INTENT).replace("{topic}", topic or "this")
            pool = C.GAP_ALTERNATES if gaps else C.INTENT_ALTERNATES.get(intent, C.PATIENT_ALTERNATES + C.GENERIC_ALTERNATES)
            want = own
            if last.get(conv) == own:
                want = pool[turn * 7 % len(pool)]
                want = C.LAST_RESORT if want == last[conv] else want
            assert want != last.get(conv)
            last[conv] = want
        assert got[conv, turn] == want


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 24))).round(3)
    x[1000:2000] = x[7]  # a third of all rows is one vector
    return [(k, v.tolist()) for k, v in enumerate(x)] + [(9000, None), (9001, [1.0, 2.0]), (9002, [0.0] * 24)]


def test_neighbours_against_brute_force(spark, clouds, tmp_path):
    v = spark.createDataFrame(clouds, "chunk_id long, embedding array<double>")
    N.build_index(v, str(tmp_path), cells=40)
    index = N.open_index(spark, str(tmp_path))  # read back
    assert index.rows.count() == len(clouds) and {r.chunk_id for r in index.rows.filter("cell is null").collect()} == {9000, 9001}
    q = v.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = R.cosine_lists(q, v, 10)
    found = N.nearest(index, q)
    assert index.probes < len(index.centres)
    assert N.recall(found, exact).first().recall >= 0.9
    every = N.nearest(index, q, probes=len(index.centres))
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.select(every.columns).collect()))
    N.MOST_VECTORS, N.MOST_QUERIES, kept = 50, 5, (N.MOST_VECTORS, N.MOST_QUERIES)
    try:
        assert sorted(map(tuple, N.nearest(index, q).collect())) == sorted(map(tuple, found.collect()))
    finally:
        N.MOST_VECTORS, N.MOST_QUERIES = kept
    empty = N.build_index(v.limit(0), str(tmp_path / "empty"))
    assert N.nearest(empty, q).count() == 0 and N.nearest(index, q.limit(0)).count() == 0


def test_neighbour_query_finds_nine_in_ten(spark):
    got = answers.ann_topk(spark, SF)
    assert N.recall(got.select("query_id", "chunk_id", "score"), retrieval.vector_lists(spark, SF)).first().recall >= 0.9
