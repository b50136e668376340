"""Replay guard of a stream of signed requests: every request gets an outcome, reservations leave when no request can meet them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from saldo.operators.guard import TOLERANCE, admits, check

TOLD = "request_id string, nonce string, received long, outcome string"


class Reserve(StatefulProcessor):
    """By shard of nonces: the time that each nonce's newest reservation names. What no request can meet any more is pruned as requests
    come, so a shard holds the nonces of some twenty minutes."""

    def init(self, handle) -> None:
        self.reserved = handle.getMapState("reserved", "nonce string", "sent long")

    def handleInputRows(self, key, rows, timerValues):
        latest = 0
        for r in sorted(rows, key=lambda r: (r.received, r.request_id)):
            reserved = self.reserved.getValue((r.nonce,))[0] if self.reserved.containsKey((r.nonce,)) else None
            ok = admits(reserved, r.received)
            if ok:
                self.reserved.updateValue((r.nonce,), (r.sent,))
            latest = r.received
            yield Row(request_id=r.request_id, nonce=r.nonce, received=r.received, outcome="VALID" if ok else "NONCE_REPLAY")
        # requests may be received out of order between batches, by as much as their times may be off
        for nonce in [n for n, sent in self.reserved.iterator() if admits(sent[0], latest - 2 * TOLERANCE)]:
            self.reserved.removeKey(nonce)

    def close(self) -> None:
        pass


def guard_stream(requests: DataFrame, secret: str, shards: int = 64) -> DataFrame:
    """(request_id, nonce, received, outcome) of a stream of requests (request_id, received, timestamp, nonce, body, signature).

    Headers, freshness and signature are checked first, by expressions; only verified requests come to the state of their nonces. Needs the
    RocksDB state store.
    """
    told = check(requests, secret).select("request_id", "nonce", "received", "sent", "fault")
    refused = told.filter("fault is not null").selectExpr("request_id", "nonce", "received", "fault as outcome")
    verified = told.filter("fault is null").drop("fault").withColumn("shard", F.pmod(F.xxhash64("nonce"), F.lit(shards)))
    return verified.groupBy("shard").transformWithState(Reserve(), TOLD, "Append", "None").unionByName(refused)
