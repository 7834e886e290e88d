import datetime as dt

from loamgrid.streaming import sessions as S


def drained(df, name, folder):
    """What comes out once all input is read; a query that doesn't end in two minutes fails."""
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_conversation_state_goes_on_across_batches(spark, tmp_path):
    schema = "conv_id long, turn long, mood string, topic string, ts timestamp"
    start = dt.datetime(2024, 1, 1)
    moods = ["calm", "panic", "panic", "calm", "affirm"]
    for k, mood in enumerate(moods):
        spark.createDataFrame([(1, k, mood, "ab"[k % 2], start + dt.timedelta(minutes=k)), (2 + k, 0, mood, None, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    out = drained(S.conversation_state(source), "state_rows", tmp_path / "state").collect()
    rows = {r.turn: r for r in out if r.conv_id == 1}
    assert len(out) == 10 and rows[4].n_turns == 5 and sorted(rows[4].buffer.split(",")) == sorted(moods)


def test_idle_conversations_are_forgotten(spark, tmp_path):
    schema = "conv_id long, turn long, mood string, topic string, ts timestamp"
    start = dt.datetime(2024, 1, 1)
    for k, (conv, hours) in enumerate([(1, 0), (2, 5), (2, 6), (1, 7)]):
        spark.createDataFrame([(conv, k, "calm", "a", start + dt.timedelta(hours=hours))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {(r.conv_id, r.turn): r.n_turns for r in drained(S.conversation_state(source), "idle_rows", tmp_path / "state").collect()}
    assert out == {(1, 0): 1, (2, 1): 1, (2, 2): 2, (1, 3): 1}


def test_throttle(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("e", start + dt.timedelta(seconds=s), k) for k, s in enumerate([0, 299, 300, 599, 601])]
    spark.createDataFrame(rows, "kind string, ts timestamp, id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("kind string, ts timestamp, id long").parquet(str(tmp_path / "in"))
    assert sorted(r.id for r in drained(S.throttled(source), "throttle_rows", tmp_path / "state").collect()) == [0, 2, 4]
