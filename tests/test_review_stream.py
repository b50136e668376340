"""Review outcomes in event time: the stream, under every order of arrival, against the batch operator."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Row

from saldo.operators.ingest import review
from saldo.streaming import review as R

T0 = dt.datetime(2026, 8, 22, 10, 0, 0)


def actions(rng, n):
    return [(f"c{rng.randrange(n)}", rng.randrange(4), rng.choice(["approve", "reject"]), T0 + dt.timedelta(seconds=rng.randrange(40) / 4)) for _ in range(n)]


def batch(spark, rows):
    df = review(spark.createDataFrame(rows, R.ACTION))
    return sorted((r.callback_id, r.candidate_id, r.action, r.ts, r.outcome) for r in df.collect())


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Items(Value):
    def get(self):
        return iter(self.v)

    def appendValue(self, v):
        self.v = [*(self.v or []), v]


class Keyed:
    """Runs a processor as the engine does: rows by key, then the timers that the watermark has passed."""

    def __init__(self, make, field):
        self.make, self.field, self.keys = make, field, {}

    def of(self, key):
        if key not in self.keys:
            p, timers = self.make(), set()
            handle = type("Handle", (), {"getListState": lambda *a: Items(), "getValueState": lambda *a: Value(), "registerTimer": lambda _, t: timers.add(t)})()
            p.init(handle)
            self.keys[key] = p, timers
        return self.keys[key]

    def step(self, rows, watermark):
        out = []
        for row in rows:
            p, _ = self.of(row[self.field])
            out += list(p.handleInputRows((row[self.field],), iter([row]), None))
        for key, (p, timers) in list(self.keys.items()):
            for t in sorted(x for x in timers if x <= watermark):
                timers.discard(t)
                out += list(p.handleExpiredTimer((key,), None, type("T", (), {"getExpiryTimeInMs": lambda _, t=t: t})()))
        return out

    def left(self):
        return sum(p.held.exists() + p.kept.exists() for p, _ in self.keys.values())


def test_any_order_of_arrival(spark):
    rng = random.Random(1)
    rows = actions(rng, 40)
    want = batch(spark, rows)
    assert {w[4] for w in want} == {"applied", "replay", "idempotent", "locked"}
    for _ in range(100):
        rng.shuffle(rows)
        guard, decide, got, at = Keyed(lambda: R.Guard(60_000), "callback_id"), Keyed(lambda: R.Decide(60_000), "candidate_id"), [], 0
        settled = 0
        while at < len(rows) or settled < 2:
            part = [Row(callback_id=c, candidate_id=i, action=a, ts=t) for c, i, a, t in rows[at : at + rng.randrange(1, 9)]]
            at += len(part)
            # rows may arrive as late as any: nothing is passed before the end
            mark = 0 if at < len(rows) else R.due_at(T0) + 20_000 + settled * 200_000
            settled += at >= len(rows)
            got += decide.step(guard.step(part, mark), mark)
        assert sorted(map(tuple, got)) == want
        assert guard.left() == decide.left() == 0  # what is decided leaves


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, R.ROCKSDB)
    yield spark
    spark.conf.unset(key)


def test_stream_gives_what_the_batch_gives(rocksdb, tmp_path):
    spark, rng = rocksdb, random.Random(7)
    rows = actions(rng, 30)
    want = batch(spark, rows)
    for run in range(2):
        rng.shuffle(rows)
        src = tmp_path / f"in{run}"
        src.mkdir()
        late = T0 + dt.timedelta(hours=2)
        files = [rows[:11], rows[11:20], rows[20:], [("end", 99, "approve", late)], [("end2", 98, "approve", late)]]
        for n, part in enumerate(files):
            (src / f"{n}.json").write_text("\n".join(json.dumps({"callback_id": c, "candidate_id": i, "action": a, "ts": t.isoformat() + "Z"}) for c, i, a, t in part))
        stream = spark.readStream.schema(R.ACTION).option("maxFilesPerTrigger", 1).json(str(src))
        q = (R.review_stream(stream, late="10 minutes").writeStream.format("memory").queryName(f"reviewed{run}").option("checkpointLocation", str(tmp_path / f"ck{run}"))
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination(180)
        assert q.exception() is None
        assert sorted((r.callback_id, r.candidate_id, r.action, r.ts, r.outcome) for r in spark.table(f"reviewed{run}").collect()) == want
