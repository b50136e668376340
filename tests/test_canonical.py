"""Canonicalization against messages taken one after the other, and commits that are there whole or not at all."""

import json
import random
import re
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException

from saldo.operators import canonical as C
from saldo.streaming import commits as K

MESSAGE = "n long, source string, external_id string, reference string, order_id string, event_id string, event_kind string, financial_class string, direction string, amount decimal(18,2), merchant string, evidence_role string"
NAMES = [c.split()[0] for c in MESSAGE.split(", ")]


def fits(row, event):
    if row["evidence_role"] != "PRIMARY_PAYMENT":
        return True
    clean = lambda x: (lambda t: "" if t == "qris merchant" else t)(re.sub("[^a-z0-9]+", " ", (x or "").lower()).strip())
    a, b = clean(row["merchant"]), clean(event["merchant"])
    return all(row[c] == event[c] for c in ("event_kind", "financial_class", "direction", "amount")) and (not a or not b or a == b)


class Ledger:
    """The store of the message-by-message way."""

    def __init__(self):
        self.raws, self.events, self.evidence = {}, [], set()

    def take(self, row):
        name = (row["source"], row["external_id"])
        if name in self.evidence:
            return "duplicate", None
        attempts = self.raws.get(name, (None, 0))[1]
        if attempts >= C.ATTEMPTS:
            return "given_up", None
        self.raws[name] = (row, attempts + 1)
        for key in C.KEYS:
            found = [e for e in self.events if row[key] and e[key] == row[key]]
            if found:
                event = min(found, key=lambda e: e["event_id"]) if found[0].get("old") else found[0]
                if not fits(row, event):
                    return "conflict", event["event_id"]
                self.evidence.add(name)
                return "evidence", event["event_id"]
        self.events.append(dict(row))
        self.evidence.add(name)
        return "created", row["event_id"]

    def batch(self, rows):
        named, out, first = {(r["source"], r["external_id"]) for r in rows}, [], set()
        for name, (row, attempts) in sorted(self.raws.items()):
            if name not in self.evidence and name not in named and attempts < C.ATTEMPTS:
                out.append((None, *name, *self.take(row)))
        for r in sorted(rows, key=lambda r: r["n"]):
            name = (r["source"], r["external_id"])
            out.append((r["n"], *name, *(("duplicate", None) if name in first else self.take(r))))
            first.add(name)
        return out


def messages(rng, start, count, wide):
    out = []
    for n in range(start, start + count):
        i = rng.randrange(wide)
        out.append(dict(zip(NAMES, (n, rng.choice(["mail", "chat"]), f"x{i}", rng.choice(["", None, f"R{rng.randrange(wide // 3)}"]), rng.choice(["", f"O{rng.randrange(wide // 4)}"]), f"e{i}-{n}", rng.choice(["A", "A", "B"]), "K",
                                    rng.choice(["IN", "IN", "OUT"]), Decimal(rng.choice([1, 1, 1, 2])), rng.choice([None, "Kopi", "kopi!", "QRIS merchant"]), rng.choice(["PRIMARY_PAYMENT", "INVOICE"])), strict=True)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], MESSAGE)


def key(r):
    return tuple((x is not None, x) for x in r)


def test_batches_against_one_message_after_the_other(spark):
    rng, ledger = random.Random(2), Ledger()
    state = {t: spark.createDataFrame([], K.SCHEMAS[t]) for t in ("raws", "events", "evidence")}
    seen = set()
    for b in range(5):
        rows = messages(rng, b * 100, 60, 30)
        got = C.canonicalize(frame(spark, rows).repartition(3), state["raws"], state["events"], state["evidence"])
        want = ledger.batch(rows)
        out = [tuple(r) for r in got["outcomes"].select("n", "source", "external_id", "outcome", "event_id").collect()]
        assert sorted(out, key=key) == sorted(want, key=key)
        seen |= {w[3] for w in want}
        new = got["raws"].select("source", "external_id")
        state = {"raws": C.cut(state["raws"].join(new, ["source", "external_id"], "left_anti").unionByName(got["raws"])), "events": C.cut(state["events"].unionByName(got["events"])), "evidence": C.cut(state["evidence"].unionByName(got["evidence"]))}
    assert seen == {"duplicate", "created", "evidence", "conflict", "given_up"}


def test_a_hot_key_takes_two_rounds_and_empty_batches_none(spark, monkeypatch):
    rows = [dict(zip(NAMES, (n, "mail", f"x{n}", "R", f"O{n % 7}", f"e{n}", "A", "K", "IN", Decimal(1), None, "INVOICE"), strict=True)) for n in range(400)]
    rounds = []
    monkeypatch.setattr(C, "cut", lambda df, real=C.cut: rounds.append(1) or real(df))
    empty = frame(spark, [])
    out = C.assign(frame(spark, rows), empty)
    assert {(r.target, r.matched_by) for r in out.filter("n > 0").collect()} == {("e0", "reference")}
    assert len(rounds) == 1 + 2 * 2
    assert C.assign(empty, empty).count() == 0


def test_a_batch_is_there_whole_or_not_at_all(spark, tmp_path):
    root, src, ck = str(tmp_path / "t"), tmp_path / "in", str(tmp_path / "ck")
    src.mkdir()
    rng, ledger = random.Random(5), Ledger()
    stream = lambda: spark.readStream.schema(f"{MESSAGE}, ts long").json(str(src))

    def run(**more):
        q = K.canonical_sink(stream(), root, ck, **more)
        try:
            q.awaitTermination(120)
        except StreamingQueryException:
            pass
        return q.exception()

    def broken(spark_, root_, batch, tables):
        tables["events"].write.parquet(f"{root_}/events/torn")
        raise RuntimeError("killed between two tables")

    for part in range(2):
        rows = messages(rng, part * 100, 20, 12)
        (src / f"{part}.json").write_text("\n".join(json.dumps({**r, "amount": str(r["amount"]), "ts": r["n"]}) for r in rows))
        if part:
            before = sorted(map(str, K.read_committed(spark, root, "evidence").collect()))
            assert "killed" in str(run(write=broken))
            assert sorted(map(str, K.read_committed(spark, root, "evidence").collect())) == before
        assert run() is None
        assert run() is None  # nothing new
        ledger.batch([{**r, "n": n} for n, r in enumerate(sorted(rows, key=lambda r: (r["n"], r["source"], r["external_id"])), 1)])
    assert {(r.source, r.external_id) for r in K.read_committed(spark, root, "evidence").collect()} == ledger.evidence
    assert sorted(r.event_id for r in K.read_committed(spark, root, "events").collect()) == sorted(e["event_id"] for e in ledger.events)
    assert {(r.source, r.external_id): r.attempts for r in K.current_raws(spark, root).collect()} == {k: v[1] for k, v in ledger.raws.items()}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{root}/nothing")
