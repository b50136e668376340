import datetime as dt
import json
import random
import time

import pytest

from saldo.operators.backfill import page_plan, progress
from saldo.sources.mailbox import Pages, following, mailbox

SCHEMA = "id long, thread long, ts timestamp, trusted boolean, failed boolean"


def some_messages(n, failed=()):
    rng = random.Random(4)
    start = dt.datetime(2025, 1, 1)
    return [(i, rng.randrange(n // 3), start + dt.timedelta(minutes=rng.randrange(100 * 24 * 60)), rng.random() < 0.9, i in failed) for i in range(n)]


def by_hand(rows, size, first, last):
    """The loop: months in order, pages in order, up to the first that fails."""
    out, stop = [], None
    for month in sorted({r[2].strftime("%Y-%m") for r in rows}):
        if not first <= month <= last:
            continue
        inside = {}
        for r in rows:
            if r[3] and r[2].strftime("%Y-%m") == month:
                inside.setdefault(r[1], []).append(r)
        order = sorted(inside, key=lambda t: (-max(r[2] for r in inside[t]).timestamp(), t))
        for p in range(0, len(order), size):
            page = [r for t in order[p : p + size] for r in inside[t]]
            bad = sum(r[4] for r in page)
            threads = len(order[p : p + size])
            cursor = (month, p + size) if threads == size else (following(month), 0)
            if stop:
                state, cursor = "waiting", stop
            elif bad:
                state, cursor = "stopped", (month, p)
                stop = cursor
            else:
                state = "done"
            out.append((month, p // size, threads, len(page), bad, state, *cursor))
    return out


@pytest.mark.parametrize("failed", [(), (300, 7), tuple(range(0, 900, 250))])
def test_progress_is_the_loop(spark, failed):
    rows = some_messages(900, failed)
    df = spark.createDataFrame([*rows, (901, None, rows[0][2], True, True), (902, 5, None, True, None)], SCHEMA)
    got = progress(page_plan(df, 7), "2025-01", "2025-03", 7).orderBy("month", "page").collect()
    assert [tuple(r) for r in got] == by_hand(rows, 7, "2025-01", "2025-03")
    assert progress(page_plan(df.limit(0), 7), "2025-01", "2025-03", 7).collect() == []


def files(folder):
    """Built inside a function, so that it is sent to the tasks by value."""

    class Files:
        """A mailbox in one file a month, which notes each page that is fetched."""

        def __init__(self, folder):
            self.folder = str(folder)

        def _threads(self, month):
            try:
                with open(f"{self.folder}/{month}.json") as f:
                    return json.load(f)
            except FileNotFoundError:
                return []

        def threads(self, month):
            return len(self._threads(month))

        def fetch(self, month, offset, size):
            with open(f"{self.folder}/fetched", "a") as f:
                f.write(f"{month} {offset}\n")
            return [(m, dt.datetime.fromisoformat(ts)) for thread in self._threads(month)[offset : offset + size] for m, ts in thread]

    return Files(folder)


def test_offsets():
    class Counts:
        def threads(self, month):
            return {"2025-01": 50, "2025-03": 3}.get(month, 0)

    pages = Pages(Counts(), None, "2025-01", "2025-04", 25)
    seen = [pages.latestOffset() for _ in range(5)]
    assert [(o["month"], o["offset"]) for o in seen] == [("2025-01", 25), ("2025-03", 0), ("2025-05", 0), ("2025-05", 0), ("2025-05", 0)]
    assert [(p.month, p.offset) for p in pages.partitions(pages.initialOffset(), seen[-1])] == [("2025-01", 0), ("2025-01", 25), ("2025-03", 0)]
    with pytest.raises(ValueError, match="not within"):
        pages.step({"month": "2025-01", "offset": 51})
    assert following("2025-12") == "2026-01"


def test_a_crash_repeats_its_page_only(spark, tmp_path):
    box, table, ck = tmp_path / "box", str(tmp_path / "t"), str(tmp_path / "ck")
    box.mkdir()
    # 12 threads in January, each with a message that reaches into March; none in February; 5 in March
    january = [[(i, f"2025-01-{i + 1:02d}T10:00:00"), (100 + i, "2025-03-02T00:00:00")] for i in range(12)]
    march = [[(100 + i, "2025-03-02T00:00:00"), (i, f"2025-01-{i + 1:02d}T10:00:00")] for i in range(5)]
    (box / "2025-01.json").write_text(json.dumps(january))
    (box / "2025-03.json").write_text(json.dumps(march))
    source = mailbox(files(box), "id long, ts timestamp", lambda m: m[1].strftime("%Y-%m"), "2025-01", "2025-03", 5)
    spark.dataSource.register(source)
    state = {"broken": True}

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        if number == 1 and state["broken"]:
            raise RuntimeError("the sink is gone")

    def start():
        return spark.readStream.format("mailbox").load().writeStream.foreachBatch(sink).option("checkpointLocation", ck).trigger(processingTime="0 seconds").start()

    q = start()
    with pytest.raises(Exception, match="the sink is gone"):
        q.awaitTermination(60)
    state["broken"] = False
    q = start()
    until = time.time() + 60
    while time.time() < until and "2025-04" not in str([p["sources"][0]["endOffset"] for p in q.recentProgress]):
        time.sleep(0.2)
    q.stop()
    rows = spark.read.parquet(table).collect()
    assert sorted(r.id for r in rows) == [*range(12), *range(100, 105)]
    fetched = (box / "fetched").read_text().splitlines()
    assert fetched == ["2025-01 0", "2025-01 5", "2025-01 5", "2025-01 10", "2025-03 0"]
    q = start()  # all is done: nothing is fetched again
    time.sleep(3)
    q.stop()
    assert (box / "fetched").read_text().splitlines() == fetched
