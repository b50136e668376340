from decimal import Decimal

from saldo.operators import insights as I
from saldo.operators import obligations as O

GOALS = "id long, kind string, status string, allocated_amount decimal(18,2)"
ACCOUNTS = "name string, kind string, active boolean, protected boolean, protected_amount decimal(18,2), current_balance decimal(18,2)"


def test_breakdown_falls_back_to_protected_accounts(spark):
    accounts = spark.createDataFrame([("a", "Owned", True, True, Decimal("0"), Decimal("70")), ("b", "Owned", True, True, Decimal("5"), Decimal("90")), ("c", "Owned", True, True, Decimal("0"), Decimal("-3")), ("d", "Owned", True, True, None, None),
                                      ("e", "Owned", False, True, Decimal("0"), Decimal("11")), ("f", "External", True, True, Decimal("8"), Decimal("11")), ("g", "Owned", True, False, Decimal("0"), Decimal("40"))], ACCOUNTS)
    goals = spark.createDataFrame([(1, "Emergency", "Active", Decimal("10")), (2, "Goal", "Active", Decimal("20")), (3, "Goal", "Completed", Decimal("99")), (4, "General", "Active", None)], GOALS)
    assert tuple(O.allocation_breakdown(goals, accounts).first()) == (10, 20, 0, 30)
    assert tuple(O.allocation_breakdown(goals.filter("status = 'Completed'"), accounts).first()) == (0, 0, 0, 0)  # a goal there is, so no fallback
    assert tuple(O.allocation_breakdown(goals.limit(0), accounts).first()) == (75, 0, 0, 75)
    assert tuple(O.allocation_breakdown(goals.limit(0), accounts.limit(0)).first()) == (0, 0, 0, 0)


def test_anomalies_need_support_distance_and_size(spark):
    rows = [(i, f"2026-01-{i + 1:02d}", "rent", 100_000) for i in range(5)] + [(9, "2026-01-20", "rent", 160_000), (10, "2026-01-21", "rent", 149_000), (11, "2026-01-22", "once", 5_000_000)]
    rows += [(20 + i, f"2026-01-{i + 1:02d}", "tea", 1000 + i) for i in range(7)] + [(30, "2026-01-20", "tea", 9000)] + [(40, "2025-06-01", "rent", 900_000)]
    df = spark.createDataFrame(rows, "id long, date string, merchant string, amount long").selectExpr("id", "cast(date as date) date", "merchant", "cast(amount as decimal(18,2)) amount")
    assert [r.id for r in I.anomalies(df, ["merchant"], "2026-01-31").collect()] == [9]  # 10 is within half again, 11 has no history, 30 is too small, 40 too old
