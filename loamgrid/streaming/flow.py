"""Answers that arrive in chunks, cut at a number of chunks, and slots that live for a number of turns; as streams and as batches.

The streams keep one small state per key with transformWithState, which needs the RocksDB state store (`with_state_store`).
The batch forms give the same rows over a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loamgrid.operators.scans import scanned

# Fixed value: turns for which a complaint outlives the turn that told it.
TURNS = 2
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "answer_id long, chunks long, finish string, text string"
SLOT = "conv_id long, turn long, slot string"


def with_state_store(spark: SparkSession) -> SparkSession:
    """spark with the state store that these streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class Cap(StatefulProcessor):
    """Chunks so far as a list, and their number (-1: done). An answer ends at its most-th chunk or where it is complete; what comes later is dropped."""

    def __init__(self, most: int, idle_ms: int):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count, self.parts = handle.getValueState("count", "n long"), handle.getListState("parts", "text string")

    def _ended(self, key: tuple, finish: str) -> pd.DataFrame:
        parts = [p[0] for p in self.parts.get()] if self.parts.exists() else []
        self.parts.clear()
        return pd.DataFrame({"answer_id": [key[0]], "chunks": [len(parts)], "finish": [finish], "text": ["".join(p or "" for p in parts)]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.count.get()[0] if self.count.exists() else 0
        batch = pd.concat(list(rows)).sort_values("ord", kind="stable")
        for kind, text in zip(batch["kind"], batch["text"], strict=True):
            if n < 0:
                break
            if kind == "chunk":
                n += 1
                self.parts.appendValue((text,))
            if kind == "complete" or n >= self.most:
                n = -1
                yield self._ended(key, "complete" if kind == "complete" else "cut")
        self.count.update((n,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        newest = batch["ts"].max()
        at = max(timerValues.getCurrentWatermarkInMs(), 0 if pd.isna(newest) else int(newest.timestamp() * 1000))
        self.handle.registerTimer(at + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """An answer that nothing has come of for so long: what there is of it, and its state goes."""
        if self.count.get()[0] >= 0:
            yield self._ended(key, "open")
        self.count.clear()

    def close(self) -> None:
        pass


def streamed_answers(chunks: DataFrame, most: int, *, idle: int = 600, late: str = "10 minutes") -> DataFrame:
    """(answer_id, chunks, finish, text) of a stream of (answer_id, ord, kind, text, ts), a row for each answer as it ends.

    kind: chunk, complete, or anything else, which changes nothing. finish: complete, cut (the most-th chunk has come) or
    open (nothing has come for idle seconds after its newest ts, by a watermark late behind). Chunks of an answer come in
    order from one micro-batch to the next, and are put in order inside one. An answer that goes on after its state has
    gone begins anew.
    """
    return chunks.withWatermark("ts", late).groupBy("answer_id").transformWithStateInPandas(Cap(most, idle * 1000), ANSWER, "append", "eventTime")


def capped_answers(chunks: DataFrame, most: int) -> DataFrame:
    """The rows of streamed_answers over a whole table (answer_id, ord, kind, text), answers without an end as `open`.

    A chunk counts if fewer than most came before it and nothing was complete; that running number is a sum that stays
    at most, so it is scanned in blocks, and an answer of any length takes many tasks.
    """
    step = F.when(F.col("kind") == "chunk", F.lit(1)).when(F.col("kind") == "complete", F.lit(most)).cast("int")
    so_far = lambda a, b: F.least(a + b, F.lit(most))
    counted = scanned(chunks.select("answer_id", "ord", "kind", "text"), "answer_id", ["ord"], step, F.lit(0), apply=so_far, compose=so_far)
    part = F.when(F.col("kind") == "chunk", F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))
    ended = counted.filter(F.col("before") < most).groupBy("answer_id").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max(F.col("kind") == "complete").alias("complete"))
    finish = F.when(F.col("complete"), "complete").when(F.size("parts") >= most, "cut").otherwise("open")
    return ended.select("answer_id", F.size("parts").cast("long").alias("chunks"), finish.alias("finish"), F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))


class Slot(StatefulProcessor):
    """Turns so far, and a slot's value with the turn that set it; a slot older than the turns allowed is cleared."""

    def __init__(self, turns: int):
        self.turns = turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("slot", "value string, turn long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        value, since = self.held.get() if self.held.exists() else (None, 0)
        batch, out = pd.concat(list(rows)).sort_values("turn", kind="stable"), []
        for turn, told in zip(batch["turn"], batch["slot"], strict=True):
            if told is not None and told == told:
                value, since = told, turn
            elif value is not None and turn - since > self.turns:
                value = None
            out.append((key[0], turn, value))
        if value is None:
            self.held.clear()
        else:
            self.held.update((value, int(since)))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "slot"])

    def close(self) -> None:
        pass


def streamed_slots(turns: DataFrame, lives: int = TURNS) -> DataFrame:
    """(conv_id, turn, slot) of a stream of turns (conv_id, turn, slot): what the last turn set, for so many turns after it.

    The state is gone when the slot is. Turns of a conversation come in order from one micro-batch to the next.
    """
    return turns.groupBy("conv_id").transformWithStateInPandas(Slot(lives), SLOT, "append", "none")
