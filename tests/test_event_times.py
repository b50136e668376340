"""Queries that count in seconds, on events between whole ones, against their SQL."""

import duckdb
import pytest

from saldo import plans  # noqa: F401
from saldo.plans.registry import QUERIES, SQL


def both(spark, folder, name, events):
    """Rows of the query and of its SQL over events (event_id, ts, user_id)."""
    path = str(folder / "events.parquet")
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, CAST(? AS TIMESTAMP), ?, 'view', 1.5, '{\"k\": 1}')", events)
    con.execute(f"COPY events TO '{path}' (FORMAT parquet)")
    return {tuple(r) for r in QUERIES[name](spark, str(folder)).collect()}, set(con.execute(SQL[name]).fetchall())


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_a_session_gap_counts_the_seconds_that_begin_in_it(spark, tmp_path, zone):
    events = [(1, "2024-03-10 01:00:00.9", 1), (2, "2024-03-10 02:00:01.1", 1), (3, "2024-03-10 03:00:01.9", 1), (4, "2024-03-10 03:00:01.9", 1), (5, "2024-01-01 10:00:00.1", 2), (6, "2024-01-01 11:00:00.9", 2), (7, "2024-01-01 12:00:01", 2)]
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got, want = both(spark, tmp_path, "activity_sessions", events)
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert got == want == {(1, True), (2, True), (3, False), (4, False), (5, True), (6, False), (7, True)}


def test_a_request_is_received_in_the_nearest_millisecond(spark, tmp_path):
    # 2 and 4 come near the end of a quarter of an hour, 6 and 7 near that of a reservation: 2 and 6 are taken to the next millisecond
    events = [(2, "2023-12-31 23:59:59.9996", 1), (3, "2024-01-01 00:00:10", 1), (4, "2024-01-01 00:14:59.9994", 1), (5, "2024-01-01 00:15:10", 1), (20, "2024-01-01 01:00:00", 1), (6, "2024-01-01 01:10:02.0005", 1), (21, "2024-01-01 02:00:00", 1), (7, "2024-01-01 02:10:03.0004", 1)]
    got, want = both(spark, tmp_path, "request_guard", events)
    replays = {3, 7}
    assert got == want == {(e[0], "NONCE_REPLAY" if e[0] in replays else "VALID") for e in events}
