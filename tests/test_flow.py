"""Capped answers and slots with a life in turns: streams against batches and plain Python, over several micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loamgrid.operators import sessions as PS
from loamgrid.streaming import flow as W
from tests.test_streaming import drained

START = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    W.with_state_store(spark)
    yield
    spark.conf.set(key, before)


def in_files(spark, folder, rows, schema, size):
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def test_capped_answers(spark, tmp_path):
    rng, rows, want = random.Random(3), [], {}
    for t in range(120):
        rows.append((rng.randrange(6), t, rng.choice(["chunk", "chunk", "chunk", "chunk", "other", "complete"]), rng.choice([f"<{t}>", "é", None]), START + dt.timedelta(seconds=t)))
    rows += [(50, 200, "chunk", "late", START + dt.timedelta(seconds=130)), (60, 201, "other", None, START + dt.timedelta(seconds=131)), (99, 300, "complete", None, START + dt.timedelta(days=1)), (99, 301, "chunk", "x", START + dt.timedelta(days=2))]
    for answer in {r[0] for r in rows}:
        text, n, finish = "", 0, "open"
        for _, _, kind, part, _ in (r for r in rows if r[0] == answer):
            text, n = (text + (part or ""), n + 1) if kind == "chunk" else (text, n)
            if kind == "complete" or n == 5:
                finish = "complete" if kind == "complete" else "cut"
                break
        want[answer] = (n, finish, text)
    schema = "answer_id long, ord long, kind string, text string, ts timestamp"
    batch = {r.answer_id: (r.chunks, r.finish, r.text) for r in W.capped_answers(spark.createDataFrame(rows, schema).repartition(3), 5).collect()}
    assert batch == want and {f for _, f, _ in want.values()} == {"open", "cut", "complete"}
    stream = drained(W.streamed_answers(in_files(spark, tmp_path, rows, schema, 40), 5), "answers", tmp_path / "state").collect()
    assert {r.answer_id: (r.chunks, r.finish, r.text) for r in stream} == want and len(stream) == len(want)


def test_slots_expire_by_turns(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted((conv, t, rng.choice([None, None, None, "fever", "cough"])) for conv in range(5) for t in range(24))
    rows.sort(key=lambda r: r[1])
    schema = "conv_id long, turn long, slot string"
    batch = spark.createDataFrame(rows, schema).select("conv_id", "turn", PS.slot_with_ttl(F.col("slot"), W.TURNS).alias("slot"))
    stream = drained(W.streamed_slots(in_files(spark, tmp_path, rows, schema, 30)), "slots", tmp_path / "state")
    got = sorted(map(tuple, stream.collect()), key=repr)
    assert got == sorted(map(tuple, batch.collect()), key=repr) and len(got) == 120
    assert any(slot is None for *_, slot in got) and any(slot for *_, slot in got)
