"""Budget moves against a plain loop."""

import random
from decimal import Decimal

from saldo.operators.commands import reallocate


def test_credits_count_for_later_moves(spark):
    rng = random.Random(3)
    budgets = [(m, c, Decimal(n)) for m in ("2026-01", "2026-02") for c, n in (("a", 100), ("b", 0), ("c", 30))]
    requests = [(n, rng.choice(["2026-01", "2026-02", "2026-03"]), rng.choice(["a", "b", "c", "a", "x", ""]), rng.choice(["a", "b", "c", "b", None]), Decimal(rng.randrange(-1, 60))) for n in range(200)]
    held, want = {(m, c): n for m, c, n in budgets}, {}
    for n, m, a, b, amount in requests:
        if not a or not b or a == b or amount <= 0:
            want[n] = "invalid"
        elif (m, a) not in held or (m, b) not in held:
            want[n] = "unknown"
        elif held[m, a] < amount:
            want[n] = "short"
        else:
            held[m, a] -= amount
            held[m, b] += amount
            want[n] = "moved"
    rng.shuffle(requests)
    out = reallocate(spark.createDataFrame(requests, "request_no long, month string, source string, target string, amount decimal(18,2)").repartition(3), spark.createDataFrame(budgets, "month string, category string, current_budget decimal(18,2)")).collect()
    assert {r.request_no: r.outcome for r in out} == want
    last = max((r for r in out if r.month == "2026-01" and r.outcome == "moved"), key=lambda r: r.request_no)
    assert (last.source_after, last.target_after) != (None, None)
    assert len(out) == len(requests) and set(want.values()) == {"moved", "short", "unknown", "invalid"}
