"""Debts, coverage, commitments and what is safe to spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def outstanding(events: DataFrame) -> DataFrame:
    """(debt_id, outstanding, written_off): the signed sum of each debt's events."""
    return events.groupBy("debt_id").agg(F.sum(F.col("effect") * F.col("amount")).cast("decimal(28,2)").alias("outstanding"), F.max((F.col("event_type") == "WriteOff").cast("int")).alias("written_off"))


def debt_status(debts: DataFrame, events: DataFrame) -> DataFrame:
    """Each debt's outstanding amount and status: Invalid below zero, Settled or WrittenOff at zero, else Active."""
    o = F.coalesce(F.col("outstanding"), F.lit(0)).cast("decimal(28,2)")
    status = F.when(o < -0.005, "Invalid").when(F.abs(o) <= 0.005, F.when(F.coalesce("written_off", F.lit(0)) == 1, "WrittenOff").otherwise("Settled")).otherwise("Active")
    return debts.join(outstanding(events), debts.id == F.col("debt_id"), "left").select("id", "person_name", "kind", o.alias("outstanding"), status.alias("status"))


def latest_event(events: DataFrame) -> DataFrame:
    """The newest event of each debt; ties go by every column, as no key is unique."""
    order = F.struct("event_date", "transaction_id", "line", "amount", "event_type")
    return events.groupBy("debt_id").agg(F.max(order).alias("e")).select("debt_id", "e.*")


def coverage(upcoming: DataFrame, allocations: DataFrame, goals: DataFrame) -> DataFrame:
    """(upcoming_id, covered): active allocations, plus the whole allocated amount of an active linked goal."""
    direct = allocations.filter("status = 'Active' and covers_upcoming_id is not null").select(F.col("covers_upcoming_id").alias("upcoming_id"), "amount")
    linked = upcoming.join(goals.filter("status = 'Active'").select(F.col("id").alias("linked_goal_id"), F.col("allocated_amount").alias("goal_amount")), "linked_goal_id").select(F.col("id").alias("upcoming_id"), F.col("goal_amount").alias("amount"))
    return direct.unionByName(linked).groupBy("upcoming_id").agg(F.sum("amount").alias("covered"))


def covered_upcoming(upcoming: DataFrame, allocations: DataFrame, goals: DataFrame) -> DataFrame:
    """Upcoming rows with what covers them and what is left to pay."""
    c = F.coalesce(F.col("covered"), F.lit(0)).cast(MONEY)
    return upcoming.join(coverage(upcoming, allocations, goals), upcoming.id == F.col("upcoming_id"), "left").drop("upcoming_id").withColumn("covered", c).withColumn("effective", F.greatest(F.lit(0), F.col("amount") - F.col("covered")).cast(MONEY))


def effective_commitments(rows: DataFrame) -> DataFrame:
    """Open rows without a debt, at what is not covered: Upcoming, Confirmed, and Tentative ones that are reserved."""
    open_now = F.col("status").isin("Upcoming", "Confirmed") | ((F.col("status") == "Tentative") & (F.col("reserve_now") == 1))
    return rows.filter(F.col("debt_id").isNull() & open_now)


def effective_payables(debt_rows: DataFrame, upcoming: DataFrame, allocations: DataFrame) -> DataFrame:
    """Active payables less the active allocations on their Upcoming rows, one row per debt."""
    cover = (upcoming.filter("status = 'Upcoming' and debt_id is not null").select(F.col("id").alias("upcoming_id"), "debt_id")
             .join(allocations.filter("status = 'Active'").select(F.col("covers_upcoming_id").alias("upcoming_id"), F.col("amount").alias("part")), "upcoming_id").groupBy("debt_id").agg(F.sum("part").alias("covered")))
    df = debt_rows.filter("kind = 'Payable' and status = 'Active'").join(cover, debt_rows.id == cover.debt_id, "left")
    c = F.coalesce(F.col("covered"), F.lit(0))
    return df.select("id", "outstanding", c.cast(MONEY).alias("covered"), F.greatest(F.lit(0), F.col("outstanding") - c).cast("decimal(28,2)").alias("effective"))


def safe_to_spend(liquid: DataFrame, allocated: DataFrame, custody: DataFrame, commitments: DataFrame, pending: DataFrame, remaining_budget: DataFrame | None = None) -> DataFrame:
    """One row from one-row inputs (liquid with total and complete; the others with their one amount).

    liquid - allocated - max(0, custody) - commitments - pending; null while a balance is missing.
    """
    parts = liquid
    for df in (allocated, custody, commitments, pending, *([] if remaining_budget is None else [remaining_budget])):
        parts = parts.crossJoin(F.broadcast(df))  # one row each, by aggregation without a key
    value = F.when(F.col("complete"), (F.col("total") - F.col("allocated") - F.greatest(F.lit(0), F.col("custody")) - F.col("commitments") - F.col("pending")).cast("decimal(28,2)"))
    low = F.col("remaining_budget") if remaining_budget is not None else F.lit(0)
    status = F.when(value.isNull(), None).when(value < 0, "Defisit").when(value < low, "Perlu Perhatian").otherwise("Terkendali")
    return parts.withColumn("safe_to_spend", value).withColumn("state", status)


def protected_contribution() -> Column:
    """What an account keeps back: its protected amount, or its whole balance above zero where it is protected without one."""
    return F.when(F.col("protected_amount") > 0, F.col("protected_amount")).when(F.col("protected"), F.greatest(F.lit(0).cast(MONEY), F.coalesce("current_balance", F.lit(0).cast(MONEY)))).otherwise(F.lit(0).cast(MONEY))


def allocation_breakdown(goals: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row (emergency, goals, general, total): what active goals of each kind hold. Where there is no goal at all, active or not, the
    active own accounts' protected contributions stand for the emergency fund."""
    of = lambda kind: F.coalesce(F.sum(F.when((F.col("status") == "Active") & (F.col("kind") == kind), F.col("allocated_amount"))), F.lit(0)).cast("decimal(28,2)")
    by_goals = goals.agg(F.count("*").alias("n"), of("Emergency").alias("emergency"), of("Goal").alias("goals"), of("General").alias("general"))
    legacy = accounts.filter("active and kind = 'Owned'").agg(F.coalesce(F.sum(protected_contribution()), F.lit(0)).cast("decimal(28,2)").alias("legacy"))
    parts = by_goals.crossJoin(F.broadcast(legacy)).withColumn("emergency", F.when(F.col("n") == 0, F.col("legacy")).otherwise(F.col("emergency")))  # one row each
    return parts.select("emergency", "goals", "general", (F.col("emergency") + F.col("goals") + F.col("general")).alias("total"))


def linked_payable_excess(upcoming: DataFrame, debt_rows: DataFrame) -> DataFrame:
    """Debts whose live linked schedules exceed what is outstanding (a violated guard)."""
    linked = upcoming.filter("debt_id is not null and status in ('Upcoming', 'Confirmed')").groupBy("debt_id").agg(F.sum("amount").alias("scheduled"))
    return debt_rows.join(linked, debt_rows.id == linked.debt_id).filter(F.col("scheduled") > F.col("outstanding") + 0.005).select("id", "scheduled", "outstanding")


def running_minimum(partition: list[str], order: list[str], opening, signed):
    """Columns (running, lowest) of a cash curve that starts at `opening`."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return opening + F.sum(signed).over(w)
