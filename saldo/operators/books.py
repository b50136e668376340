"""Saved transactions: what a batch of creates, updates and deletes leaves in accounts, in the history of balances, and in the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions.text import account_kind
from saldo.operators.commands import reject_reason

MONEY = "decimal(18,2)"
FACTS = ["date", "transaction_type", "amount", "account_from", "account_to"]
#: Requests of a block of an account's history: an account's running balance is summed in blocks, then within them.
BLOCK = 1 << 16


def account_rejects(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds reject_reason: the rule that a create or update breaks by itself, else a missing or inactive account of a side that moves money.

    An income may go to an account that isn't there; it creates it unless its name is an external one, so later requests find it.
    """
    df = requests.withColumn("_rule", F.when(F.col("op") != "delete", reject_reason()))
    names = F.array_distinct(F.array("account_from", "account_to"))
    made = (df.filter("op != 'delete' and transaction_type = 'Income' and _rule is null").select("request_no", F.explode(names).alias("name")).filter(F.coalesce("name", F.lit("")) != "")
            .filter(account_kind(F.col("name")) != "External").groupBy("name").agg(F.min("request_no").alias("_made")))
    known = accounts.select("name", F.col("active").alias("_active"))
    for side in ("from", "to"):
        name = F.col(f"account_{side}")
        df = df.join(known.select(F.col("name").alias(f"account_{side}"), F.col("_active").alias(f"_{side}_active")), f"account_{side}", "left")
        df = df.join(made.select(F.col("name").alias(f"account_{side}"), F.col("_made").alias(f"_{side}_made")), f"account_{side}", "left")
        named, there, later = F.coalesce(name, F.lit("")) != "", F.col(f"_{side}_active").isNotNull(), F.coalesce(F.col(f"_{side}_made") < F.col("request_no"), F.lit(False))
        df = df.withColumn(f"_{side}", F.when(~named, None).when(there & ~F.coalesce(F.col(f"_{side}_active"), F.lit(True)), "inactive").when(~there & ~later, "missing"))
    kind = F.col("transaction_type")
    account = (F.when(kind.isin("Expense", "Transfer") & F.col("_from").isNotNull(), F.concat(F.lit("from_"), "_from"))
               .when((kind == "Transfer") & F.col("_to").isNotNull(), F.concat(F.lit("to_"), "_to")).when((kind == "Income") & (F.col("_to") == "inactive"), "to_inactive"))
    return df.withColumn("reject_reason", F.coalesce("_rule", F.when(F.col("op") != "delete", account))).select(*requests.columns, "reject_reason")


def save_transactions(requests: DataFrame, state: DataFrame) -> DataFrame:
    """What each accepted request (request_no, op, id, and the facts of a transaction) replaces: adds `old` (the facts before it, null where
    there are none), `changed` (whether balances move) and the audit `action` (null for an update of nothing).

    Requests of one transaction follow each other by request_no. Deleted rows count as they stand: deletes and updates of them revert what
    they once did, as the ledger keeps no other record of it.
    """
    facts = F.struct(*FACTS)
    rows = requests.select("request_no", "op", "id", *FACTS).unionByName(state.select(F.lit(None).cast("long").alias("request_no"), F.lit("state").alias("op"), "id", *FACTS))
    # a delete leaves the facts as they were: the newest facts before a request are of its last row that isn't a delete
    before = Window.partitionBy("id").orderBy(F.asc_nulls_first("request_no")).rowsBetween(Window.unboundedPreceding, -1)
    # and an update of a row that isn't there makes none
    there = F.coalesce(F.max(F.col("op").isin("state", "create")).over(before), F.lit(False))
    known = F.when(there & (F.col("op") != "create"), F.last(F.when(F.col("op") != "delete", facts), ignorenulls=True).over(before))
    df = rows.withColumn("old", known).filter("op != 'state'")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    same = (text("old.transaction_type") == text("transaction_type")) & (F.abs(F.coalesce("old.amount", F.lit(0)) - F.coalesce("amount", F.lit(0))) < 0.005) & (text("old.account_from") == text("account_from")) & (text("old.account_to") == text("account_to"))
    there = F.col("old").isNotNull()
    action = F.when(F.col("op") == "create", "CREATE").when(there, F.when(F.col("op") == "update", "UPDATE").otherwise("SOFT_DELETE"))
    return df.withColumn("changed", F.when(F.col("op") == "update", ~there | ~same).when(F.col("op") == "delete", there).otherwise(True)).withColumn("action", action)


def mutations(saved: DataFrame) -> DataFrame:
    """Movements (request_no, step, account, delta, date) of saved requests, in order: an update first takes back the old facts, on the new
    date; a delete takes them back on their own."""
    def effect(kind: Column, amount: Column, start: Column, to: Column, date: Column, sign: int, step: int) -> list[Column]:
        move = lambda when, account, s, n: F.struct(F.when(when, account).alias("account"), (amount * (s * sign)).cast(MONEY).alias("delta"), date.alias("date"), F.lit(n).alias("step"))
        return [move(kind.isin("Expense", "Transfer"), start, -1, step), move(kind.isin("Income", "Transfer"), to, 1, step + 1)]

    c = F.col
    back = effect(F.when(c("op") != "create", c("old.transaction_type")), c("old.amount"), c("old.account_from"), c("old.account_to"), F.when(c("op") == "update", c("date")).otherwise(c("old.date")), -1, 0)
    new = effect(F.when(c("op") != "delete", c("transaction_type")), c("amount"), c("account_from"), c("account_to"), c("date"), 1, 2)
    moves = F.filter(F.array(*back, *new), lambda m: F.coalesce(m["account"], F.lit("")) != "")
    return saved.filter("changed").select("request_no", F.explode(moves).alias("m")).select("request_no", "m.step", "m.account", "m.delta", "m.date")


def balance_history(moves: DataFrame, accounts: DataFrame, block: int = BLOCK) -> DataFrame:
    """A snapshot (account, request_no, step, balance, snapshot_date) for each movement that counts, with the balance after it.

    Accounts that are External, Investment or without a balance don't move; a movement before the account's balance_date is in that
    balance already. Balances are sums over blocks of requests, then within a block, so a busy account is no single task.
    """
    takes = accounts.filter(F.col("current_balance").isNotNull() & ~F.col("kind").isin("External", "Investment")).select(F.col("name").alias("account"), "current_balance", "balance_date")
    df = moves.join(takes, "account").filter(F.col("balance_date").isNull() | (F.col("date") >= F.col("balance_date"))).withColumn("_block", F.floor(F.col("request_no") / block))
    per = df.groupBy("account", "_block").agg(F.sum("delta").alias("_sum"))
    earlier = per.select("account", "_block", F.coalesce(F.sum("_sum").over(Window.partitionBy("account").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    within = F.sum("delta").over(Window.partitionBy("account", "_block").orderBy("request_no", "step"))
    out = df.withColumn("_within", within).join(earlier, ["account", "_block"])
    return out.select("account", "request_no", "step", (F.col("current_balance") + F.col("_earlier") + F.col("_within")).cast(MONEY).alias("balance"), F.col("date").alias("snapshot_date"), F.lit("mutation").alias("snapshot_kind"))


def balances_after(accounts: DataFrame, history: DataFrame) -> DataFrame:
    """Accounts with the balance of their last snapshot, or their own."""
    last = history.groupBy(F.col("account").alias("name")).agg(F.max_by("balance", F.struct("request_no", "step")).alias("_last"))
    return accounts.join(last, "name", "left").withColumn("new_balance", F.coalesce("_last", "current_balance")).drop("_last")


def accounts_made(saved: DataFrame, accounts: DataFrame) -> DataFrame:
    """Accounts (name, kind) that saved creates and updates name and that aren't there yet; names of external parties make none."""
    names = saved.filter("op != 'delete'").select(F.explode(F.array("account_from", "account_to")).alias("name")).filter(F.coalesce("name", F.lit("")) != "").distinct()
    return names.withColumn("kind", account_kind(F.col("name"))).filter("kind != 'External'").join(accounts.select("name"), "name", "left_anti")
