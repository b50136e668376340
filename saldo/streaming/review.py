"""Review actions in event time: outcomes don't depend on the order in which actions arrive.

Actions wait in keyed state until the watermark has passed them, are then settled in the order of their time, and the state of what is
decided leaves after a retention. Needs the RocksDB state store.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ACTION = "callback_id string, candidate_id long, action string, ts timestamp"
GUARDED = f"{ACTION}, replay boolean"
OUTCOME = f"{ACTION}, outcome string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def due_at(ts: dt.datetime) -> int:
    """The first millisecond after a row's time, at which it can be settled: then every row of its millisecond is known."""
    return int(ts.timestamp() * 1000) + 1


class _InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them and settles them in their order; forgets a key `retention` after its last row."""

    HELD: str
    KEPT: str

    def __init__(self, retention_ms: int):
        self.retention = retention_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.HELD)
        self.kept = handle.getValueState("kept", self.KEPT)

    def handleInputRows(self, key, rows, timerValues):
        for row in rows:
            self.held.appendValue(self.pack(row))
            self.handle.registerTimer(due_at(row.ts))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows = [Row(**dict(zip(self.names, r, strict=True))) for r in self.held.get()] if self.held.exists() else []
        due = sorted((r for r in rows if due_at(r.ts) <= now), key=self.order)
        wait = [r for r in rows if due_at(r.ts) > now]
        kept = self.kept.get() if self.kept.exists() else None
        if due:
            out, kept = self.settle(key[0], due, kept)
            forget = now + self.retention
            self.kept.update((*kept, forget))
            self.handle.registerTimer(forget)
            self.held.clear()
            for r in wait:
                self.held.appendValue(self.pack(r))
            yield from out
        elif not wait and kept is not None and now >= kept[-1]:
            self.held.clear()
            self.kept.clear()

    def close(self) -> None:
        pass


class Guard(_InOrder):
    """By callback: its first action stands, later ones are replays."""

    HELD, KEPT = "candidate_id long, action string, ts timestamp", "seen boolean, forget long"
    names = ("candidate_id", "action", "ts")

    def pack(self, row):
        return (row.candidate_id, row.action, row.ts)

    def order(self, row):
        return (row.ts, row.candidate_id)

    def settle(self, callback_id, rows, kept):
        return [Row(callback_id=callback_id, candidate_id=r.candidate_id, action=r.action, ts=r.ts, replay=bool(n or kept)) for n, r in enumerate(rows)], (True,)


class Decide(_InOrder):
    """By candidate: the first action wins, the same again is idempotent, the other is locked; replays decide nothing."""

    HELD, KEPT = "callback_id string, action string, ts timestamp, replay boolean", "winner string, forget long"
    names = ("callback_id", "action", "ts", "replay")

    def pack(self, row):
        return (row.callback_id, row.action, row.ts, row.replay)

    def order(self, row):
        return (row.ts, row.callback_id)

    def settle(self, candidate_id, rows, kept):
        winner, out = kept[0] if kept else None, []
        for r in rows:
            if r.replay:
                what = "replay"
            elif winner is None:
                winner, what = r.action, "applied"
            else:
                what = "idempotent" if r.action == winner else "locked"
            out.append(Row(callback_id=r.callback_id, candidate_id=candidate_id, action=r.action, ts=r.ts, outcome=what))
        return out, (winner,)


def review_stream(actions: DataFrame, late: str = "10 minutes", retention: str = "7 days") -> DataFrame:
    """Outcome of each review action (callback_id, candidate_id, action, ts timestamp) of a stream, as the batch `review` gives it for
    all of them, in whatever order they arrive within `late`; later ones are dropped by the watermark.

    An outcome is told when the watermark passes its action. State of a callback or candidate leaves `retention` after its last action:
    by then its buttons must be gone.
    """
    keep = int(dt.timedelta(**{(u := retention.split())[1].rstrip("s") + "s": float(u[0])}).total_seconds() * 1000)
    told = actions.select("callback_id", "candidate_id", "action", "ts").filter(F.col("callback_id").isNotNull() & F.col("candidate_id").isNotNull()).withWatermark("ts", late)
    guarded = told.groupBy("callback_id").transformWithState(Guard(keep), GUARDED, "Append", "EventTime", eventTimeColumnName="ts")
    return guarded.groupBy("candidate_id").transformWithState(Decide(keep), OUTCOME, "Append", "EventTime", eventTimeColumnName="ts")
