"""Saved transactions against the ledger's rules, applied one request after the other."""

import datetime as dt
import random
from decimal import Decimal

from saldo.operators import books as B

FACTS = "date date, transaction_type string, amount decimal(18,2), account_from string, account_to string"
REQ = f"request_no long, op string, id long, {FACTS}"
D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def replay(requests, state, accounts):
    rows = {r[0]: r[1:] for r in state}
    book = {a[0]: [a[1], a[2], a[3]] for a in accounts}
    history, audit = [], {}

    def move(n, step, name, delta, date):
        kind, balance, since = book.get(name, (None, None, None))
        if not name or balance is None or kind in ("External", "Investment") or since is not None and date < since:
            return
        book[name][1] += delta
        history.append((name, n, step, book[name][1], date))

    def effect(n, step, facts, sign, date):
        _, kind, amount, start, to = facts
        if kind in ("Expense", "Transfer"):
            move(n, step, start, -sign * amount, date)
        if kind in ("Income", "Transfer"):
            move(n, step + 1, to, sign * amount, date)

    for n, op, i, *facts in sorted(requests):
        old = rows.get(i) if op != "create" else None
        changed = op != "update" or old is None or tuple(old[1:]) != tuple(facts[1:])
        audit[n] = "CREATE" if op == "create" else None if old is None else {"update": "UPDATE", "delete": "SOFT_DELETE"}[op]
        if old is not None and changed:
            effect(n, 0, old, -1, facts[0] if op == "update" else old[0])
        if op != "delete" and changed:
            effect(n, 2, facts, 1, facts[0])
        if op == "update" and old is not None or op == "create":
            rows[i] = tuple(facts)
    return sorted(history), audit, {k: v[1] for k, v in book.items()}


def test_requests_one_after_the_other(spark):
    rng = random.Random(1)
    names = ["a", "b", "c", "inv", "ext", "none"]
    accounts = [("a", "Owned", Decimal(100), D(50)), ("b", "Owned", Decimal(5), None), ("c", "Suspense", Decimal(0), D(10)), ("inv", "Investment", Decimal(9), None), ("ext", "External", Decimal(9), None), ("none", "Owned", None, None)]

    def facts():
        kind = rng.choice(["Expense", "Income", "Transfer", "Adjustment"])
        return (D(rng.randrange(100)), kind, Decimal(rng.randrange(1, 999)) / 4, "" if kind == "Income" else rng.choice(names), "" if kind == "Expense" else rng.choice([*names, "new"]))

    state = [(i, *facts()) for i in range(20)]
    requests = []
    for n in range(300):
        op = rng.choice(["create", "update", "update", "delete"])
        i = 1000 + n if op == "create" else rng.randrange(25)
        old = next((s for s in state if s[0] == i), None)
        requests.append((n, op, i, *(old[1:] if old and rng.random() < 0.2 else facts())))
    a = spark.createDataFrame([(*x, True) for x in accounts], "name string, kind string, current_balance decimal(18,2), balance_date date, active boolean")
    saved = B.save_transactions(spark.createDataFrame(requests, REQ).repartition(3), spark.createDataFrame(state, f"id long, {FACTS}"))
    history, audit, after = replay(requests, state, accounts)
    assert {r.request_no: r.action for r in saved.collect()} == audit
    for block in (7, 1 << 16):
        got = B.balance_history(B.mutations(saved), a, block)
        assert sorted((r.account, r.request_no, r.step, r.balance, r.snapshot_date) for r in got.collect()) == history
    assert {r.name: r.new_balance for r in B.balances_after(a, got).collect()} == after


def test_a_backdated_expense_leaves_the_balance(spark):
    a = spark.createDataFrame([("a", "Owned", Decimal(100), dt.date(1996, 1, 1), True)], "name string, kind string, current_balance decimal(18,2), balance_date date, active boolean")
    none = spark.createDataFrame([], f"id long, {FACTS}")
    for year, want in ((1990, 100), (1996, 90)):
        saved = B.save_transactions(spark.createDataFrame([(1, "create", 1, dt.date(year, 5, 1), "Expense", Decimal(10), "a", "")], REQ), none)
        assert B.balances_after(a, B.balance_history(B.mutations(saved), a)).first().new_balance == want


def test_accounts_of_requests(spark):
    a = spark.createDataFrame([("on", "Owned", None, None, True), ("off", "Owned", None, None, False)], "name string, kind string, current_balance decimal(18,2), balance_date date, active boolean")
    rows = [(1, "Expense", "Bank Jago Utama X", ""), (2, "Income", "", "Receivable: Ann"), (3, "Expense", "Receivable: Ann", ""), (4, "Transfer", "on", "off"), (5, "Transfer", "on", "nobody"), (6, "Income", "", "off"), (7, "Income", "", "nobody"), (8, "Expense", "off", "")]
    df = spark.createDataFrame([(n, "create", n, D(0), k, Decimal(1), f, t, "Personal", "derived", False, "") for n, k, f, t in rows], f"{REQ}, money_context string, budget_rule_version string, exclude_from_budget boolean, exclusion_reason string")
    told = B.account_rejects(df, a)
    got = {r.request_no: r.reject_reason for r in told.collect()}
    assert got == {1: "from_missing", 2: None, 3: None, 4: "to_inactive", 5: "to_missing", 6: "to_inactive", 7: None, 8: "from_inactive"}
    assert [tuple(r) for r in B.accounts_made(told.filter("reject_reason is null"), a).collect()] == [("Receivable: Ann", "Receivable")]
