"""Reversals of debt events against requests taken one after the other."""

import random
from decimal import Decimal

from saldo.operators.reversals import reverse_debt_events

EVENT = "event_id long, debt_id long, transaction_id long, event_type string, effect int, amount decimal(18,2), reversal_of_id long, operation_key string"
TX = "id long, transaction_type string, account_from string, account_to string, description string"
REQUEST = "request_no long, event_id long, operation_key string"


def run(spark, requests, events, tx=()):
    out = reverse_debt_events(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(events, EVENT), spark.createDataFrame(list(tx), TX), "2026-01-02")
    return {k: df.collect() for k, df in out.items()}


def test_one_after_the_other(spark):
    rng = random.Random(1)
    events = [(i, i % 3, None, "Correction" if i % 7 == 0 else "Increase", 1, Decimal(5), i - 1 if i % 7 == 0 else None, f"k{i}" if i % 5 == 0 else None) for i in range(1, 40)]
    requests = [(n, rng.randrange(1, 44), rng.choice([None, f"k{rng.randrange(30)}"])) for n in range(150)]
    have, gone, used, want = {e[0]: e for e in events}, {e[6] for e in events if e[6]}, {e[7] for e in events if e[7]}, {}
    for n, e, k in requests:
        want[n] = "unknown" if e not in have else "correction" if have[e][3] == "Correction" else "reversed" if e in gone else "replay" if k in used else "applied"
        if want[n] == "applied":
            gone.add(e)
            used |= {k} - {None}
    rng.shuffle(requests)
    got = run(spark, requests, events)
    assert {r.request_no: r.outcome for r in got["outcomes"]} == want and set(want.values()) == {"unknown", "correction", "reversed", "replay", "applied"}
    assert {r.request_no for r in got["corrections"]} == {n for n, w in want.items() if w == "applied"}
    assert all(r.effect == -1 and r.event_type == "Correction" for r in got["corrections"])


def test_cash_goes_back(spark):
    tx = [(1, "Income", "", "bank", "loan"), (2, "Expense", "purse", "", "paid")]
    events = [(10, 1, 1, "Increase", 1, Decimal(7), None, None), (11, 1, 2, "Settlement", -1, Decimal(3), None, None), (12, 1, None, "Increase", 1, Decimal(1), None, None)]
    got = run(spark, [(1, 10, None), (2, 11, "k"), (3, 12, None)], events, tx)
    assert sorted((r.request_no, r.transaction_type, r.account_from, r.account_to, r.account, r.delta, r.description) for r in got["cash"]) == [
        (1, "Expense", "bank", "", "bank", -7, "[Reversal Event #10] loan"), (2, "Income", "", "purse", "purse", 3, "[Reversal Event #11] paid")]
    assert run(spark, [], events)["outcomes"] == []
