"""Observed balances against the book, as a chain: what one request settles is what the next one of its account finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldo.operators.ledger import MONEY, reconcile_action

BLOCK = 100_000


def reconcile_chain(requests: DataFrame, balances: DataFrame, block: int = BLOCK) -> DataFrame:
    """Requests (request_no, account, actual, force) with action, expected, cached, difference.

    `balances` is the book before the first of them, as `reconstruct` gives it (account, expected, current_balance, status). An
    account that can't be verified refuses requests until one has `force`, which sets its anchor; from the first request that is
    taken, book and cached balance are the last observed one. action: unknown_account, invalid (no amount), refused,
    anchor_established, ledger_adjusted, cache_repaired, confirmed_in_sync; the first three change nothing and are not seen by
    later requests. Numbers of requests are unique.

    No fold: a request is taken from the account's first possible one on, so that the state it finds is the amount of the one
    before it, looked up within a block of requests, then among blocks. A busy account is no single task.
    """
    book = balances.select("account", "expected", "current_balance", (F.col("status") == "ok").alias("_ok"))
    df = requests.select("request_no", "account", F.col("actual").cast(MONEY).alias("actual"), F.coalesce("force", F.lit(False)).alias("force")).join(book, "account", "left")
    seen = F.col("_ok").isNotNull() & F.col("actual").isNotNull()
    first = df.filter(seen & (F.col("_ok") | F.col("force"))).groupBy("account").agg(F.min("request_no").alias("_first"))
    df = df.join(first, "account", "left").withColumn("_taken", seen & F.coalesce(F.col("request_no") >= F.col("_first"), F.lit(False)))
    df = df.withColumn("_block", F.floor(F.col("request_no") / block))
    taken = F.when(F.col("_taken"), F.col("actual"))
    per = df.filter("_taken").groupBy("account", "_block").agg(F.max_by("actual", "request_no").alias("_end"))
    blocks = df.select("account", "_block").distinct().join(per, ["account", "_block"], "left")
    before = Window.partitionBy("account").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("account", "_block", F.last("_end", True).over(before).alias("_earlier"))
    within = Window.partitionBy("account", "_block").orderBy("request_no").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_own", F.last(taken, True).over(within)).join(blocks, ["account", "_block"])
    last = F.coalesce("_own", "_earlier")
    opening = last.isNull() & ~F.col("_ok")
    expected = F.when(~opening, F.coalesce(last, F.col("expected")))
    cached = F.coalesce(last, F.col("current_balance"))
    action = (F.when(F.col("_ok").isNull(), "unknown_account").when(F.col("actual").isNull(), "invalid").when(~F.col("_taken"), "refused")
              .otherwise(reconcile_action(F.col("actual"), expected, cached)))
    return df.select("request_no", "account", "actual", action.alias("action"), expected.cast(MONEY).alias("expected"), cached.cast(MONEY).alias("cached"),
                     F.when(F.col("_taken"), F.coalesce(F.col("actual") - expected, F.lit(0))).cast(MONEY).alias("difference"))


def adjustments(chain: DataFrame, today: str) -> DataFrame:
    """The transaction of each adjustment: what is missing in the book comes to the account, what is too much leaves it."""
    gap, side = F.col("difference"), lambda on: F.when(on, F.col("account")).otherwise("")
    return chain.filter("action = 'ledger_adjusted'").select(
        "request_no", F.lit(today).cast("date").alias("date"), F.lit("Adjustment").alias("transaction_type"), F.abs(gap).cast(MONEY).alias("amount"), side(gap < 0).alias("account_from"), side(gap > 0).alias("account_to"),
        F.lit("Other / Miscellaneous").alias("category"), F.lit("Personal").alias("money_context"), F.lit("Balance Reconciliation").alias("subtype"), F.lit("Confirmed").alias("status"), F.lit(0).cast(MONEY).alias("budget_effect"))


def anchors_set(chain: DataFrame, today: str) -> DataFrame:
    """The snapshot of each request that changed a balance or set an anchor."""
    kind = F.when(F.col("action") == "anchor_established", "manual_anchor").when(F.col("action").isin("ledger_adjusted", "cache_repaired"), "reconciliation")
    return chain.withColumn("snapshot_kind", kind).filter("snapshot_kind is not null").select("request_no", F.col("account").alias("account_name"), F.col("actual").alias("balance"), F.lit(today).cast("date").alias("snapshot_date"), "snapshot_kind")


def audit_rows(chain: DataFrame, today: str) -> DataFrame:
    """A reconciliation record of each request that was taken; an anchor's book balance is the observed one."""
    taken = chain.filter("action not in ('unknown_account', 'invalid', 'refused')")
    return taken.select("request_no", F.col("account").alias("account_name"), F.coalesce("expected", "actual").alias("book_balance"), F.col("actual").alias("actual_balance"), "difference", F.lit(today).cast("date").alias("date_created"))


def accounts_after(accounts: DataFrame, chain: DataFrame, today: str) -> DataFrame:
    """Accounts with the balance that their last request left, the day of it, and the day of an anchor set among them."""
    told = (chain.filter("action not in ('unknown_account', 'invalid', 'refused')").groupBy(F.col("account").alias("name"))
            .agg(F.max_by("actual", "request_no").alias("_last"), F.max((F.col("action") == "anchor_established").cast("int")).alias("_anchored")))
    day = F.lit(today).cast("date")
    out = accounts.join(told, "name", "left")
    return (out.withColumn("current_balance", F.coalesce("_last", "current_balance")).withColumn("balance_date", F.when(F.col("_anchored") == 1, day).otherwise(F.col("balance_date")))
            .withColumn("last_reconciled_at", F.when(F.col("_last").isNotNull(), day)).drop("_last", "_anchored"))
