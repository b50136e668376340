"""Cohorts, postings and balances of the transaction ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
POSTED = ("Confirmed", "Auto-classified")
TRUSTED = ("initial_anchor", "manual_anchor", "reconciliation")


def total(column: Column | str) -> Column:
    """Exact decimal sum, 0 for no rows, as a double for reporting."""
    return F.coalesce(F.sum(column), F.lit(0)).cast("double")


def live(tx: DataFrame) -> DataFrame:
    """Transactions that are not soft-deleted."""
    return tx.filter(~F.col("is_deleted"))


def between(first: str, last: str, column: str = "date") -> Column:
    """A date range that reaches the Parquet scan."""
    return (F.col(column) >= F.lit(first).cast("date")) & (F.col(column) <= F.lit(last).cast("date"))


def in_month(month: str, column: str = "date") -> Column:
    first = F.lit(f"{month}-01").cast("date")
    return (F.col(column) >= first) & (F.col(column) <= F.last_day(first))


def is_reconciliation() -> Column:
    return F.lower("description").startswith("[rekonsiliasi]")


def personal(kind: str) -> Column:
    """Posted personal rows of one type, without reconciliation entries."""
    return (F.col("transaction_type") == kind) & (F.col("money_context") == "Personal") & F.col("status").isin(*POSTED) & ~F.col("is_deleted") & ~is_reconciliation()


def report_cohort() -> Column:
    """Personal rows that are not provisional, for reports."""
    return ~F.col("is_deleted") & ~F.col("status").startswith("Provisional") & (F.col("money_context") == "Personal") & ~is_reconciliation()


def pending() -> Column:
    """Provisional expenses, and provisional rows without a type that have an amount."""
    return ~F.col("is_deleted") & F.col("status").startswith("Provisional") & ((F.col("transaction_type") == "Expense") | ((F.col("transaction_type") == "") & (F.col("amount") > 0)))


def budget_spend() -> Column:
    """What a row takes from its budget: the stored effect of legacy rows, else the amount of a posted personal expense that is not excluded."""
    derived = F.when((F.col("transaction_type") == "Expense") & (F.col("money_context") == "Personal") & F.col("status").isin(*POSTED) & ~F.col("is_deleted") & ~F.col("exclude_from_budget"), F.col("amount")).otherwise(F.lit(0).cast(MONEY))
    return F.when(F.col("budget_rule_version") == "legacy", F.col("budget_effect")).otherwise(derived)


def rule_gap() -> Column:
    """A legacy personal expense whose stored effect is not its amount."""
    return (F.col("budget_rule_version") == "legacy") & (F.col("transaction_type") == "Expense") & (F.col("money_context") == "Personal") & (F.abs(F.col("budget_effect") - F.col("amount")) > 0.005)


def search(tx: DataFrame, words: str, month: str | None = None, status: str | None = None, limit: int = 5000) -> DataFrame:
    """Rows that contain `words` in any text field, whatever the case; newest first."""
    text = F.lower(F.concat_ws(" ", "description", "account_from", "account_to", "category", "for_with_whom"))
    df = live(tx).filter(text.contains(words.lower()))
    df = df if month is None else df.filter(in_month(month))
    df = df if status is None else df.filter(F.col("status") == status)
    return df.orderBy(F.desc("date"), F.desc("time"), F.desc("id")).limit(limit)


def postings(tx: DataFrame) -> DataFrame:
    """Two rows a transaction: -amount on account_from, +amount on account_to. Turns every either-side join into an equi-join."""
    side = lambda account, sign, name: F.struct(F.col(account).alias("account"), (F.col("amount") * sign).cast(MONEY).alias("delta"), F.lit(name).alias("side"))
    rows = tx.select("id", "date", "created_at", "transaction_type", "amount", F.explode(F.array(side("account_from", -1, "out"), side("account_to", 1, "in"))).alias("p"))
    return rows.select("id", "date", "created_at", "transaction_type", "amount", "p.*").filter("account != ''")


def anchors(snapshots: DataFrame, as_of: str | None = None) -> DataFrame:
    """One snapshot per account: the newest trusted one, else the oldest legacy one."""
    df = snapshots if as_of is None else snapshots.filter(F.col("snapshot_date") <= F.lit(as_of).cast("date"))
    ranked = df.withColumn("trusted", F.col("snapshot_kind").isin(*TRUSTED))
    w = Window.partitionBy("account_name").orderBy(F.desc("trusted"), F.when(F.col("trusted"), -F.col("id")).otherwise(F.col("id")))
    return ranked.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "trusted")


def reconstruct(accounts: DataFrame, tx: DataFrame, snapshots: DataFrame, as_of: str | None = None, dialect: str = "ledger") -> DataFrame:
    """Book balance of every account from its anchor and the postings after it, against the cached balance.

    A posting counts if (date, created_at) is after the anchor's. status: `unverifiable` without an anchor, or (dialect
    `ledger`) where a posting of the anchor's date was created at the anchor's instant; else `ok`. With dialect `shadow`
    `as_of` bounds anchors and postings and collisions are not looked for.
    """
    anchor = anchors(snapshots, as_of).select(F.col("account_name").alias("account"), "snapshot_date", F.col("created_at").alias("anchored_at"), "balance", "snapshot_kind")
    moves = postings(live(tx))
    if as_of is not None:
        moves = moves.filter(F.col("date") <= F.lit(as_of).cast("date"))
    m = moves.select("account", "date", "created_at", "delta").join(anchor, "account")
    after = (F.col("date") > F.col("snapshot_date")) | ((F.col("date") == F.col("snapshot_date")) & (F.col("created_at") > F.col("anchored_at")))
    hit = (F.col("date") == F.col("snapshot_date")) & (F.col("created_at") == F.col("anchored_at"))
    sums = m.groupBy("account").agg(F.sum(F.when(after, F.col("delta"))).alias("moved"), F.sum(F.when(after & (F.col("delta") > 0), F.col("delta"))).alias("inflow"), F.sum(F.when(after & (F.col("delta") < 0), -F.col("delta"))).alias("outflow"), F.sum(hit.cast("int")).alias("collisions"))
    out = accounts.withColumnRenamed("name", "account").join(anchor, "account", "left").join(sums, "account", "left")
    clash = F.coalesce(F.col("collisions"), F.lit(0)) > 0 if dialect == "ledger" else F.lit(False)
    status = F.when(F.col("balance").isNull() | clash, "unverifiable").otherwise("ok")
    book = F.when(status == "ok", (F.col("balance") + F.coalesce(F.col("moved"), F.lit(0))).cast(MONEY))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast(MONEY)
    return out.select("account", "kind", "active", "current_balance", "snapshot_kind", zero("inflow").alias("inflow"), zero("outflow").alias("outflow"), F.coalesce("collisions", F.lit(0)).cast("long").alias("collisions"), book.alias("expected"),
                      (book - F.col("current_balance")).cast(MONEY).alias("difference"), status.alias("status"))


def verify(balances: DataFrame) -> DataFrame:
    """Active accounts with a cached balance that can't be verified or don't agree."""
    return (balances.filter("active and current_balance is not null")
            .withColumn("issue", F.when(F.col("status") == "unverifiable", "unverifiable").when(F.abs("difference") >= 0.005, "discrepancy")).filter("issue is not null"))


def reconcile_action(actual: Column, expected: Column, cached: Column) -> Column:
    """What a reconciliation of an observed balance does."""
    return (F.when(expected.isNull(), "anchor_established").when(F.abs(actual - expected) >= 0.005, "ledger_adjusted")
            .when(cached.isNull() | (F.abs(actual - cached) >= 0.005), "cache_repaired").otherwise("confirmed_in_sync"))
