import datetime as dt
import hashlib
import hmac
import json

import pytest

from saldo.sources import files as S
from saldo.streaming import ingest as N


def write(path, rows):
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{len(list(path.iterdir()))}.json").write_text("\n".join(json.dumps(r) for r in rows))


def message(i, nonce=None, ts="2026-08-22T10:00:00Z"):
    return {"message_id": f"m{i}", "source": "mail", "sender": "x@bca.co.id", "subject": "n", "body": f"Pembayaran QRIS Rp {i}.000", "ts": ts, "nonce": nonce or f"n{i}"}


def run(q):
    q.awaitTermination(60)
    assert q.exception() is None


def test_ingest_is_exactly_once(spark, tmp_path):
    src, table, ck = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "ck")
    write(src, [message(1), message(2), message(1)])
    run(N.ingest(N.read_messages(spark, str(src)), table, ck))
    write(src, [message(2), message(3)])
    run(N.ingest(N.read_messages(spark, str(src)), table, ck))
    run(N.ingest(N.read_messages(spark, str(src)), table, ck))
    rows = spark.read.parquet(table).collect()
    assert sorted(r.message_id for r in rows) == ["m1", "m2", "m3"] and {r.event_kind for r in rows} == {"MERCHANT_PAYMENT"}


def collect(spark, df, name, tmp_path, mode="append"):
    run(df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    return spark.table(name).collect()


def test_guard_window_and_freshness(spark, tmp_path):
    write(tmp_path / "in", [message(1, "a"), message(2, "a"), message(3, "b", "2026-09-01T00:00:00Z")])
    m = N.read_messages(spark, str(tmp_path / "in"))
    assert len(collect(spark, N.guard_replays(m), "guarded", tmp_path)) == 2
    assert len(collect(spark, N.in_window(m, "2026-08-01", "2026-09-01"), "windowed", tmp_path)) == 2
    assert [(r.source, r.n) for r in collect(spark, N.source_freshness(m), "fresh", tmp_path, "complete")] == [("mail", 3)]
    assert len(collect(spark, N.daily_counts(m), "daily", tmp_path, "complete")) == 2


def test_signature_and_precheck(spark):
    good = hmac.new(b"key", b"5.n.body", hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("5", "n", "body", good), ("5", "n", "body!", good), ("5", "n", None, None)], "ts string, nonce string, body string, signature string")
    assert [r.signature_ok for r in N.signed(df, "key").collect()] == [True, False, False]
    with pytest.raises(RuntimeError, match="closed month"):
        N.precheck((True, "schema"), (False, "closed month"))


def test_files(spark, tmp_path):
    (tmp_path / "seed.csv").write_text("﻿canonical_id,date,time,transaction_type,amount,account_from,account_to,description,category,status\nA,2026-01-02,,Odd,-5,x,,d,c,\nA,2026-01-03,,Income,7,x,,d,c,Confirmed\nB,nope,,Income,1.5,,y,it's,c,Confirmed\n")
    rows = {r.canonical_id: r for r in S.read_seed_csv(spark, str(tmp_path / "seed.csv")).collect()}
    assert set(rows) == {"A", "B"} and rows["A"].transaction_type == "Expense" and rows["A"].amount == 5 and rows["B"].date is None
    df = spark.createDataFrame([(1, "it's", None)], "id long, name string, n int")
    assert S.insert_statements(df, "t").first().sql == "INSERT OR IGNORE INTO t (id, name, n) VALUES (1, 'it''s', NULL);"
    manifest = S.write_sql_dump(spark, {"a": df, "b": df.limit(0)}, str(tmp_path / "dump")).orderBy("position").collect()
    assert [(r.table, r.rows) for r in manifest] == [("a", 1), ("b", 0)]
    for v in range(4):
        S.snapshot(df, str(tmp_path / "snap"), v, keep=2)
    assert sorted(p.name for p in (tmp_path / "snap").iterdir() if p.name.startswith("v=")) == ["v=0000000002", "v=0000000003"]
    S.write_json_lines(S.payload(df, "id", "name"), str(tmp_path / "j"))
    back = S.read_payload(spark.read.json(str(tmp_path / "j")).select("payload"), "payload", "id long, name string").first()
    assert (back.id, back.name) == (1, "it's")
    state = spark.createDataFrame([("mail", dt.datetime(2026, 1, 1), "a")], "source string, ts timestamp, cursor string")
    new = spark.createDataFrame([("mail", dt.datetime(2026, 1, 2), "b"), ("chat", dt.datetime(2026, 1, 1), "c")], "source string, ts timestamp, cursor string")
    assert {r.source: r.cursor for r in S.merge_state(state, new, "source", "ts").collect()} == {"mail": "b", "chat": "c"}
