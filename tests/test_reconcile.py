"""A chain of observed balances against one request after the other."""

import random
from decimal import Decimal

import pytest

from saldo.operators import reconcile as K

SKIPPED = ("unknown_account", "invalid", "refused")


def replay(requests, books):
    state = {a: [e if ok == "ok" else None, c] for a, e, c, ok in books}
    out = []
    for n, account, actual, force in sorted(requests):
        if account not in state:
            out.append((n, "unknown_account", None, None))
            continue
        e, c = state[account]
        if actual is None:
            said = "invalid"
        elif e is None:
            said = "anchor_established" if force else "refused"
        else:
            said = "ledger_adjusted" if actual != e else "cache_repaired" if actual != c else "confirmed_in_sync"
        out.append((n, said, e, None if said in SKIPPED else actual - e if e is not None else Decimal(0)))
        if said not in SKIPPED:
            state[account] = [actual, actual]
    return out


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_one_after_the_other(spark, block):
    rng = random.Random(block)
    books = [("a", Decimal(10), Decimal(10), "ok"), ("b", Decimal(7), Decimal(9), "ok"), ("c", None, Decimal(3), "unverifiable"), ("d", None, None, "unverifiable"), ("e", Decimal(1), None, "ok")]
    hot = ["a"] * 6 + ["b", "c", "c", "d", "e", "missing"]  # one account has half of the requests
    requests = [(n, rng.choice(hot), rng.choice([None, Decimal(3), Decimal(9), Decimal(10), Decimal("10.01")]), rng.choice([None, False, False, True])) for n in range(300)]
    shuffled = rng.sample(requests, len(requests))
    df = spark.createDataFrame(shuffled, "request_no long, account string, actual decimal(18,2), force boolean").repartition(5)
    b = spark.createDataFrame(books, "account string, expected decimal(18,2), current_balance decimal(18,2), status string")
    chain = K.reconcile_chain(df, b, block)
    assert sorted((r.request_no, r.action, r.expected, r.difference) for r in chain.collect()) == replay(requests, books)


def test_row_sets_of_golden_steps(spark):
    """Up by 50 000, down by 20 000, confirmed, then an account without an anchor that is forced."""
    books = [("main", Decimal(100000), Decimal(100000), "ok"), ("wallet", None, Decimal(50000), "unverifiable")]
    steps = [(1, "main", Decimal(150000), False), (2, "main", Decimal(130000), False), (3, "main", Decimal(130000), False), (4, "wallet", Decimal(75000), False), (5, "wallet", Decimal(75000), True), (6, "wallet", Decimal(75000), False)]
    df = spark.createDataFrame(steps, "request_no long, account string, actual decimal(18,2), force boolean")
    b = spark.createDataFrame(books, "account string, expected decimal(18,2), current_balance decimal(18,2), status string")
    chain = K.reconcile_chain(df, b)
    tx = sorted((r.request_no, float(r.amount), r.account_from, r.account_to, float(r.budget_effect)) for r in K.adjustments(chain, "2026-08-23").collect())
    assert tx == [(1, 50000.0, "", "main", 0.0), (2, 20000.0, "main", "", 0.0)]
    assert sorted((r.request_no, float(r.balance), r.snapshot_kind) for r in K.anchors_set(chain, "2026-08-23").collect()) == [(1, 150000.0, "reconciliation"), (2, 130000.0, "reconciliation"), (5, 75000.0, "manual_anchor")]
    assert sorted((r.request_no, float(r.book_balance), float(r.difference)) for r in K.audit_rows(chain, "2026-08-23").collect()) == [(1, 100000.0, 50000.0), (2, 150000.0, -20000.0), (3, 130000.0, 0.0), (5, 75000.0, 0.0), (6, 75000.0, 0.0)]
    own = spark.createDataFrame([("main", Decimal(100000), None), ("wallet", Decimal(50000), None), ("idle", None, None)], "name string, current_balance decimal(18,2), balance_date date")
    after = {r.name: (r.current_balance and float(r.current_balance), str(r.balance_date), str(r.last_reconciled_at)) for r in K.accounts_after(own, chain, "2026-08-23").collect()}
    assert after == {"main": (130000.0, "None", "2026-08-23"), "wallet": (75000.0, "2026-08-23", "2026-08-23"), "idle": (None, "None", "None")}
    empty = K.reconcile_chain(df.limit(0), b)
    assert empty.collect() == [] and K.adjustments(empty, "2026-08-23").collect() == []
