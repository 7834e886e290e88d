"""Structured Streaming: conversation state, throttled reports and windowed counts as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loamgrid.operators.sessions import most_frequent

STATE = "turns int, buffer array<string>, moods array<string>, topics array<string>"
OUT = "conv_id long, turn long, n_turns int, buffer array<string>, recent array<string>, stack array<string>"


def conversation_state(turns: DataFrame, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """One row per incoming turn (conv_id, turn, mood, topic, ts) with the state after it: the last 8 moods, the dominant of the last 3, the last 5 topics.

    State is kept per conversation and dropped once the watermark (`late` behind the newest ts) has passed the conversation's newest turn by idle; within a micro-batch turns are taken in order. A null ts counts as the watermark's own time.
    """
    number, unit = idle.split()
    idle_ms = int(float(number) * {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")] * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, buffer, moods, topics = state.get if state.exists else (0, [], [], [])
        buffer, moods, topics, rows = list(buffer), list(moods), list(topics), []
        now = pd.concat(list(batches)).sort_values("turn")
        for r in now.itertuples():
            n += 1
            buffer, moods = [*buffer, r.mood][-8:], [*moods, r.mood][-3:]
            if not topics or topics[0] != r.topic:
                topics = [r.topic, *topics][:5]
            rows.append((key[0], r.turn, n, buffer, moods, topics))
        state.update((n, buffer, moods, topics))
        newest = 0 if now["ts"].isna().all() else int(now["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "n_turns", "buffer", "recent", "stack"])

    dated = turns.withWatermark("ts", late).groupBy("conv_id")
    out = dated.applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("conv_id", "turn", "n_turns", F.array_join("buffer", ",").alias("buffer"), most_frequent(F.col("recent")).alias("dominant"), F.array_join("stack", ",").alias("stack"))


def throttled(reports: DataFrame, seconds: int = 300) -> DataFrame:
    """At most one report per kind in a window that starts anew with each accepted one; reports (kind, ts, id) of a kind arrive in order of time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        for batch in batches:
            batch, keep = batch.sort_values(["ts", "id"]), []
            for ts in batch["ts"]:
                fresh = last is None or (ts - last).total_seconds() >= seconds
                last = ts if fresh else last
                keep.append(fresh)
            yield batch.loc[keep, ["kind", "ts", "id"]]
        state.update((last.isoformat(),))

    return reports.groupBy("kind").applyInPandasWithState(step, "kind string, ts timestamp, id long", "last string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and type with a watermark for late ones: an extension, the rules know no event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))

