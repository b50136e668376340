"""Signed requests: each check, expiry of reservations, and the stream against the batch."""

import hashlib
import hmac
import json
import random

import pytest

from saldo.operators import guard as A
from saldo.streaming import replays as S
from saldo.streaming.review import ROCKSDB

FIELDS = "request_id string, received long, timestamp string, nonce string, body string, signature string"
NOW = 1_787_000_000_000


def request(i, received=NOW, timestamp=None, nonce="n", body="b", signature=None, secret="key"):
    timestamp = str(received) if timestamp is None else timestamp
    return (i, received, timestamp, nonce, body, hmac.new(secret.encode(), f"{timestamp}.{nonce}.{body or ''}".encode(), hashlib.sha256).hexdigest() if signature is None else signature)


def outcomes(spark, rows, secret="key"):
    return {r.request_id: r.outcome for r in A.verify(spark.createDataFrame(rows, FIELDS), secret, ["request_id"]).collect()}


def test_each_check(spark):
    rows = [request("ok", nonce="a"), request("upper", nonce="b", body=None), request("blank", nonce=""), request("unsigned", signature=""), request("when", timestamp="x1"), request("edge", timestamp=str(NOW - 300_000), nonce="c"),
            request("old", timestamp=str(NOW - 300_001), nonce="d"), request("new", timestamp=str(NOW + 300_001), nonce="e"), request("forged", nonce="f", secret="other"), request("tail", timestamp=f" {NOW}ms", nonce="g")]
    rows[1] = (*rows[1][:5], rows[1][5].upper())
    assert outcomes(spark, rows) == {"ok": "VALID", "upper": "VALID", "blank": "MISSING_HEADERS", "unsigned": "MISSING_HEADERS", "when": "INVALID_TIMESTAMP", "edge": "VALID", "old": "EXPIRED_TIMESTAMP", "new": "EXPIRED_TIMESTAMP",
                                     "forged": "INVALID_SIGNATURE", "tail": "VALID"}
    assert set(outcomes(spark, rows, " ").values()) == {"UNCONFIGURED_SECRET"}
    assert A.verify(spark.createDataFrame([], FIELDS), "key", ["request_id"]).collect() == []


@pytest.mark.parametrize("secret", ["", "k", "k" * 64, "é" * 80])
def test_hmac(spark, secret):
    df = spark.createDataFrame([("text ü",), ("",)], "m string").select("m", A.hmac_sha256(secret, "m" and A.F.col("m")).alias("h"))
    assert all(r.h == hmac.new(secret.encode(), r.m.encode(), hashlib.sha256).hexdigest() for r in df.collect())


def test_a_reservation_expires_and_failures_reserve_nothing(spark):
    at = lambda s: NOW + s * 1000
    rows = [request("forged", at(0), secret="other"), request("first", at(1)), request("again", at(2)), request("still", at(601)), request("expired", at(602)), request("after", at(700)),
            request("late", at(1203), timestamp=str(at(1203) - 300_000)), request("sooner", at(1504))]
    # "late" reserves the time it names, so its reservation ends earlier
    assert outcomes(spark, rows) == {"forged": "INVALID_SIGNATURE", "first": "VALID", "again": "NONCE_REPLAY", "still": "NONCE_REPLAY", "expired": "VALID", "after": "NONCE_REPLAY", "late": "VALID", "sooner": "VALID"}


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted((request(f"r{i}", NOW + rng.randrange(2_000_000), nonce=f"n{rng.randrange(6)}", secret=rng.choice(["key", "key", "key", "bad"])) for i in range(60)), key=lambda r: r[1])
    names = [c.split()[0] for c in FIELDS.split(", ")]
    (tmp_path / "in").mkdir()
    for n in range(4):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows[n * 15 : n * 15 + 15]))
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        try:
            q = (S.guard_stream(spark.readStream.schema(FIELDS).json(str(tmp_path / "in")), "key").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
                 .trigger(availableNow=True).start())
            assert q.awaitTermination(60)
            assert q.exception() is None
        finally:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.request_id: r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == outcomes(spark, rows) and set(got.values()) == {"VALID", "NONCE_REPLAY", "INVALID_SIGNATURE"}
