"""Sync loses and repeats nothing over failures, partial acceptance, closed gates and crashes."""

import pytest

from loamgrid.streaming import sync as S

SCHEMA = "id long, created long, body string"


class Receiver:
    """Remembers its answers by key; plan: what it does with each new request (None fails, a number accepts so many, an error is raised after accepting all)."""

    def __init__(self, plan):
        self.plan, self.answers, self.taken, self.sizes = list(plan), {}, [], []

    def __call__(self, key, rows):
        if key in self.answers:
            return self.answers[key]
        self.sizes.append(len(rows))
        do = self.plan.pop(0) if self.plan else len(rows)
        accepted = len(rows) if isinstance(do, Exception) else do
        self.answers[key] = accepted
        self.taken += [r.id for r in rows[: accepted or 0]]
        if isinstance(do, Exception):
            raise do
        return accepted


def arrive(spark, folder, ids):
    spark.createDataFrame([(k, -k % 7, f"b{k}") for k in ids], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def run(spark, folder, receiver, **more):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    q = S.sync(source, receiver, str(folder / "sync"), order=["created", "id"], most=10, availableNow=True, **more)
    try:
        assert q.awaitTermination(240)
        if q.exception():
            raise q.exception()
    finally:
        q.stop()


def test_failures_and_parts_and_crashes(spark, tmp_path):
    receiver = Receiver([None, 4, 10, RuntimeError("line cut"), None, 0, 7])
    arrive(spark, tmp_path, range(25))
    run(spark, tmp_path, receiver, requests=3)  # fails at once
    assert receiver.taken == [] and S.status(spark, str(tmp_path / "sync")).first().failures == 1
    arrive(spark, tmp_path, range(25, 30))
    run(spark, tmp_path, receiver, requests=3)  # four, then no more in this micro-batch
    assert len(receiver.taken) == 4
    arrive(spark, tmp_path, range(30, 50))
    with pytest.raises(Exception, match="line cut"):
        run(spark, tmp_path, receiver, requests=3)  # ten, then a crash after the receiver took the next ones
    run(spark, tmp_path, receiver, requests=3)  # the same keys again
    for k in range(6):
        arrive(spark, tmp_path, [50 + k])
        run(spark, tmp_path, receiver, requests=20)
    order = lambda ids: sorted(ids, key=lambda k: (-k % 7, k))
    assert receiver.taken == [*order(range(25)), *order(range(25, 30)), *order(range(30, 50)), *range(50, 56)]
    own = S.ledger(spark, str(tmp_path / "sync"), spark.createDataFrame([], SCHEMA).schema, most=10).collect()
    assert len(own) == 56 and all(r.synced for r in own) and len({r.id for r in own}) == 56
    assert sum(r.attempts for r in own) == sum(n for n, a in zip(receiver.sizes, receiver.answers.values(), strict=True) if a is None) > 0


def test_closed_gates_keep_everything(spark, tmp_path):
    receiver, gates = Receiver([]), {"consent": False, "net": True}
    go = lambda: run(spark, tmp_path, receiver, requests=9, allowed=lambda: gates["consent"], online=lambda: gates["net"])
    for k, (consent, net) in enumerate([(False, True), (True, False), (True, True)]):
        gates.update(consent=consent, net=net)
        arrive(spark, tmp_path, [10 * k, 10 * k + 1])
        go()
        assert len(receiver.taken) == (6 if consent and net else 0)
    assert sorted(receiver.taken) == [0, 1, 10, 11, 20, 21]
