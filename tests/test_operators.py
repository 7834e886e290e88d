"""Boundaries that the given tables don't have."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loamgrid.functions import tokens as T
from loamgrid.functions import understanding as U
from loamgrid.operators import analytics as A
from loamgrid.operators import decide as D
from loamgrid.operators import retrieval as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "vector, margin, bm25, fired, score, tier",
    [(0.65, 0.25, 5.0, False, 0.875, "HIGH"), (0.63, 0.20, None, False, 0.825, "HIGH"), (None, None, 6.5, False, 1.0, "HIGH"), (None, None, 4.5, False, 0.666667, "MEDIUM"), (0.45, 0.05, None, False, 0.1875, "LOW"), (0.70, 0.30, 6.0, True, 0.40, "LOW"), (None, None, None, False, 0.0, "LOW")],
)
def test_confidence(spark, vector, margin, bm25, fired, score, tier):
    df = spark.createDataFrame([(vector, margin, bm25, fired)], "vector_top double, margin double, bm25_top double, gate_fired boolean")
    got = D.with_confidence(df).first()
    assert abs(got["confidence"] - score) < 1e-6 and got["tier"] == tier


def test_gate_boundaries(spark):
    rows = [(1, 1, 0.33), (1, 2, 0.30), (2, 1, 0.3), (3, 1, 0.29), (4, 1, 0.5), (4, 2, -0.1), (5, 1, 0.5), (5, 2, 0.5)]
    got = {r["query_id"]: r["passed"] for r in R.vector_gate(spark.createDataFrame(rows, "query_id int, chunk_id int, score double")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False}


def test_cosine_in_blocks_of_queries(spark):
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(40)]
    queries, chunks = spark.createDataFrame(rows, "query_id long, embedding array<double>"), spark.createDataFrame(rows[:9], "chunk_id long, embedding array<double>")
    got = [sorted(tuple(r) for r in R.cosine_lists(queries, chunks, 100, most_queries=m).collect()) for m in (40, 16)]
    assert len(got[0]) == 360 and got[0] == got[1]
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5 + 1e-10), 6)
    want = {q: sorted(((-cosine(a, b), c) for c, b in rows[:9]))[:4] for q, a in rows}
    best = R.cosine_lists(queries, chunks.repartition(3), 4).collect()
    assert {(r.query_id, r["rank"]): (-r.score, r.chunk_id) for r in best} == {(q, i + 1): x for q, xs in want.items() for i, x in enumerate(xs)}
    owned = chunks.withColumn("owner", F.col("chunk_id") % 3).union(spark.createDataFrame([(99, [-1.0, -1.0, -1.0], 7), (98, None, 0), (97, [1.0], 0)], "chunk_id long, embedding array<double>, owner long"))
    got = {(r.query_id, r.chunk_id): r.score for r in R.cosine_lists(queries, owned, 2, owner="owner").collect()}
    for q, a in rows:
        most = {o: max(cosine(a, b) for c, b in rows[:9] if c % 3 == o) for o in range(3)}
        assert {o: got[q, o] for o in most if (q, o) in got} == {o: most[o] for o in sorted((o for o in most if most[o] > 0), key=lambda o: (-most[o], o))[:2]}


def test_repeated_tokens_and_postings_count(spark):
    queries = spark.createDataFrame([(1, "fever fever dose")], "query_id int, query string")
    postings = spark.createDataFrame([("fever", "a", 2.0), ("fever", "a", 8.0), ("dose", "b", 1.0)], "term string, chunk_id string, score double")
    scores = R.bm25(queries, postings)
    assert {(r.chunk_id, r.score) for r in scores.collect()} == {("a", 20.0), ("b", 1.0)}
    got = {r.chunk_id: r.score for r in R.rare_term_anchor(queries, postings, scores).collect()}
    assert got == {"a": 26.0, "b": 1.3}


def test_graph_boost_keeps_the_order(spark):
    lists = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.4)], "query_id int, chunk_id string, score double")
    last = spark.createDataFrame([(1, "z")], "query_id int, last_chunk string")
    edges = spark.createDataFrame([("z", "b", 0, 1.0), ("z", "b", 1, 9.0)], "src string, dst string, ord int, edge_score double")
    assert [(r.chunk_id, r.rank) for r in R.graph_boost(lists, last, edges).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert R.graph_boost(lists, last, edges, rerank=True).orderBy("rank").first()["chunk_id"] == "b"


def test_brackets(spark):
    people = spark.createDataFrame([(4.9,), (5.0,), (15.0,), (999.0,), (None,)], "w double")
    rules = spark.createDataFrame([(1, 5.0, 15.0, "a"), (2, 15.0, 25.0, "b"), (3, 25.0, None, "c")], "ord int, lo double, hi double, dose string")
    assert {(r.w, r.dose) for r in D.brackets(people, rules, "w", "lo", "hi").collect()} == {(4.9, None), (5.0, "a"), (15.0, "a"), (999.0, "c"), (None, None)}


def test_throttle_restarts_with_each_accepted_report(spark):
    start = dt.datetime(2024, 1, 1)
    at = [0, 299, 300, 599, 601, 5000]
    rows = [("e", start + dt.timedelta(seconds=s), k) for k, s in enumerate(at)]
    got = A.throttled(spark.createDataFrame(rows, "kind string, ts timestamp, id long"), 300).collect()
    assert sorted(r.id for r in got) == [0, 2, 4, 5]


def test_throttle_across_ranges(spark):
    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=s), i) for k in ("a", None) for i, s in enumerate(sorted(rng.randrange(40_000) for _ in range(600)))]
    want = []
    for k in ("a", None):
        last = None
        for kind, ts, i in rows:
            if kind == k and (last is None or (ts - last).total_seconds() >= 300):
                want.append((str(k), i))
                last = ts
    df = spark.createDataFrame(rows, "kind string, ts timestamp, id long")
    for windows, fan in ((1, 2), (1, 5), (3, 2), (3, 64), (64, 64)):
        assert sorted((str(r.kind), r.id) for r in A.throttled(df, 300, windows, fan).collect()) == sorted(want)
    sparse = [("a", start + dt.timedelta(seconds=s), i) for i, s in enumerate(sorted(rng.sample(range(400_000), 150)))]
    want, last = [], None
    for _, ts, i in sparse:
        if last is None or (ts - last).total_seconds() >= 300:
            want.append(i)
            last = ts
    for windows, fan in ((1, 2), (2, 3)):
        assert sorted(r.id for r in A.throttled(spark.createDataFrame(sparse, "kind string, ts timestamp, id long"), 300, windows, fan).collect()) == want


def test_ack_none_and_all(spark):
    rows = spark.createDataFrame([(k, dt.datetime(2024, 1, 1), False, 0) for k in range(4)], "id long, created_at timestamp, synced boolean, attempts int")
    batch = A.next_batch(rows, 3)
    assert A.acknowledge(rows, batch, 0).filter("synced").count() == 0
    done = A.acknowledge(rows, batch, 3)
    assert sorted(r.id for r in done.filter("synced").collect()) == [0, 1, 2] and done.agg(F.sum("attempts")).first()[0] == 0
    assert A.sync_summary(rows.limit(0)).first()["success_rate"] == 1.0


def test_intents_and_language(spark):
    assert one(spark, U.classify_intent(F.lit("what is the dose"))) == "DETAIL"
    assert one(spark, U.classify_intent(F.lit("Blood pressure"))) == "AFFIRM"
    assert one(spark, U.classify_intent(F.lit("fever rash"))) == "HEADING_LOOKUP"
    assert one(spark, U.detect_language(F.lit("level of the clinical unit"))) == "yo"
    assert one(spark, U.detect_language(F.lit("hm"))) == "en"
    assert one(spark, U.correction(F.lit("no I meant TB"))) == "tb"


def test_tokens(spark):
    assert one(spark, T.hybrid_tokens(F.lit("Don't a go GO"))) == ["dont", "go", "go"]
    assert one(spark, T.synonym_tokens(F.lit("HIV-positive x TB/HIV, ok!"))) == ["hiv", "positive", "tb", "hiv,", "ok"]
    assert one(spark, U.expand_synonyms(F.lit("tb dose"))) == "tb dose tuberculosis coinfection"
    assert one(spark, U.dedupe_terms(F.lit("Fever fever! -- dose"))) == "Fever dose"
    assert one(spark, D.grounding(F.array(F.lit("Fever"), F.lit("5mg")), F.lit("a fever"))) == 0.5


def test_edge_words(spark):
    assert one(spark, D.key_terms(F.lit("Give Coartem 10mg/kg IM for 3 days, 15-25kg once daily"))) == ["Coartem", "10mg/kg", "25kg", "IM", "15-25kg", "for 3 days", "once daily", "3 days"]


def test_clinical_tables(spark):
    from loamgrid.functions import clinical as C

    say = lambda t: one(spark, U.normalize(F.lit(t), C.LOCAL_PHRASES, C.WORDS))
    assert say("My pikin dey hot, complicated malaria") == "My child fever, severe malaria"
    assert say("uncomplicated malarya! no") == "uncomplicated malaria no"
    assert one(spark, U.narrative_terms(F.lit("the baby is throwing up and has loose stools"), C.SYMPTOMS, ["the"], ["baby"])) == "diarrhea watery stool vomiting baby"


@pytest.mark.parametrize("linked", [False, True])
def test_replay_answers_every_turn(spark, tmp_path, linked):
    from loamgrid.operators import sessions as S

    n = 12 if linked else 1100
    asked = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit(7).alias("query_id"))
    lists = spark.range(n - 2).select(F.lit(7).alias("query_id"), F.col("id").alias("chunk_id"), (1.0 / (F.col("id") + 1)).alias("score"))
    edges = spark.createDataFrame([(n - 3, 5000, 0, 0.5)], "src long, dst long, ord int, edge_score double") if linked else None

    def keep(df):
        df.write.mode("append").parquet(str(tmp_path / "done"))
        return spark.read.schema(df.schema).parquet(str(tmp_path / "done"))

    got = [(r.turn, r.chunk_id, r.route) for r in S.replay(asked, lists, edges, keep).orderBy("turn").collect()]
    end = [(n - 2, 5000, "graph"), (n - 1, 0, "repeat")] if linked else [(n - 2, 0, "repeat"), (n - 1, 0, "repeat")]
    assert got == [(k, k, "fresh") for k in range(n - 2)] + end
