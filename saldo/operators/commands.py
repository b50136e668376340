"""Mutations as set-producing operators: a batch of requests and the current state give rejects and rows to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.operators.folds import fold, fold_moves

MONEY = "decimal(18,2)"
TYPES, CONTEXTS = ("Income", "Expense", "Transfer"), ("Personal", "Pass-through", "Third-party")
# The sign of a debt event and the cash side it has, by debt kind and event type; custody can't be written off.
SIGNS = [("Custody", "Increase", 1, "Income"), ("Custody", "Settlement", -1, "Expense"), ("Receivable", "Increase", 1, "Expense"), ("Receivable", "Settlement", -1, "Income"), ("Receivable", "WriteOff", -1, None),
         ("Payable", "Increase", 1, "Income"), ("Payable", "Settlement", -1, "Expense"), ("Payable", "WriteOff", -1, None)]


def reject_reason() -> Column:
    """Why a transaction request is invalid; null if it is valid."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    kind = F.col("transaction_type")
    return (F.when(F.col("date").isNull(), "date").when(~F.coalesce(kind.isin(*TYPES), F.lit(False)), "type").when(~F.coalesce(F.abs("amount") > 0, F.lit(False)), "amount").when(~F.coalesce(F.col("money_context").isin(*CONTEXTS), F.lit(False)), "context")
            .when((kind == "Expense") & blank("account_from"), "from").when((kind == "Income") & blank("account_to"), "to").when((kind == "Transfer") & (blank("account_from") | blank("account_to")), "both")
            .when((kind == "Transfer") & (F.col("account_from") == F.col("account_to")), "same").when((F.col("budget_rule_version") == "derived") & F.col("exclude_from_budget") & blank("exclusion_reason"), "reason"))


def validate(rows: DataFrame) -> DataFrame:
    """Adds reject_reason; an unknown status becomes Confirmed."""
    known = ("Confirmed", "Auto-classified", "Provisional Neutral", "Provisional")
    return rows.withColumn("reject_reason", reject_reason()).withColumn("status", F.when(F.col("status").isin(*known), F.col("status")).otherwise("Confirmed"))


def current(versions: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The newest version of each row of an append-only table, without tombstones."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return versions.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1 and not is_deleted").drop("_rn")


def upsert(state: DataFrame, requests: DataFrame, key: str = "id") -> DataFrame:
    """Versions to append: each request one above the newest version of its key, in request order."""
    top = state.groupBy(key).agg(F.max("version").alias("_top"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("request_no"))
    return requests.withColumn("_n", n).join(top, key, "left").withColumn("version", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("int")).drop("_n", "_top")


def reversal(tx: DataFrame, targets: DataFrame) -> DataFrame:
    """Offsetting rows for posted targets: income and expense swap, transfers and adjustments go back as transfers. Targets that are deleted, reversals, or reversed already get none."""
    done = tx.filter("reversal_of_id is not null and not is_deleted").select(F.col("reversal_of_id").alias("id")).distinct()
    df = tx.filter("not is_deleted and reversal_of_id is null").join(targets.select("id").distinct(), "id", "left_semi").join(done, "id", "left_anti")
    kind = F.when(F.col("transaction_type") == "Expense", "Income").when(F.col("transaction_type") == "Income", "Expense").otherwise("Transfer")
    return df.select(F.col("id").alias("reversal_of_id"), "date", kind.alias("transaction_type"), "amount", F.col("account_to").alias("account_from"), F.col("account_from").alias("account_to"), F.concat(F.lit("[Reversal] "), "description").alias("description"), "category", "money_context", F.lit("Confirmed").alias("status"))


def debt_commands(requests: DataFrame, debts: DataFrame, outstanding: DataFrame, events: DataFrame, coverage: DataFrame) -> DataFrame:
    """Outcome of debt event requests (request_no, debt_id, event_type, amount, operation_key).

    The sign table decides effect and cash side; a pair outside it is `not_allowed`, an amount of nothing or less `amount`. The key of an
    event of the debt, or of an applied request before, is a `replay`. A negative effect beyond what is outstanding at that point is
    `exceeds`; a settlement that leaves a payable less than its active `coverage` (debt_id, covered) is `covered`. Refused requests
    change nothing for those after them.
    """
    signs = requests.sparkSession.createDataFrame(SIGNS, "kind string, event_type string, effect int, cash string")
    used = events.select("debt_id", "operation_key").filter("operation_key is not null").distinct().withColumn("_used", F.lit(True))
    df = (requests.join(debts.select(F.col("id").alias("debt_id"), "kind"), "debt_id", "left").join(F.broadcast(signs), ["kind", "event_type"], "left").join(used, ["debt_id", "operation_key"], "left")
          .join(outstanding.select("debt_id", F.col("outstanding").alias("_open")), "debt_id", "left").join(coverage.select("debt_id", F.col("covered").alias("_covered")), "debt_id", "left"))
    valid = F.col("effect").isNotNull() & (F.col("amount") > 0) & F.col("_used").isNull()
    guard = F.when((F.col("kind") == "Payable") & (F.col("event_type") == "Settlement"), F.coalesce("_covered", F.lit(0))).otherwise(F.lit(0))
    told = fold(df, ["debt_id"], "request_no", F.coalesce("_open", F.lit(0)), F.when(valid, F.col("effect") * F.col("amount")), guard, "operation_key")
    out = (F.when(F.col("kind").isNull(), "unknown_debt").when(F.col("_used").isNotNull() | F.col("replay"), "replay").when(F.col("effect").isNull(), "not_allowed").when(F.col("amount") <= 0, "amount").when(F.col("applied"), "applied")
           .when(F.col("before") - F.col("amount") < 0, "exceeds").otherwise("covered"))
    return told.withColumn("outcome", out).select("request_no", "debt_id", "event_type", "amount", "effect", "cash", "outcome")


def pay_upcoming(requests: DataFrame, upcoming: DataFrame, allocations: DataFrame) -> dict[str, DataFrame]:
    """Row sets of paying upcoming rows (request_no, upcoming_id, account, date): transactions, statuses, spent allocations, debt events, rejects.

    Only rows with status Upcoming can be paid, each once. The sum of the parts leaves what is safe to spend as it was.
    """
    first = F.row_number().over(Window.partitionBy("upcoming_id").orderBy("request_no")) == 1
    j = requests.withColumn("_first", first).join(upcoming.withColumnRenamed("id", "upcoming_id").select("upcoming_id", "title", F.col("amount").alias("due"), "status", "debt_id"), "upcoming_id", "left")
    code = F.when(F.col("status").isNull(), "unknown").when(F.col("status") != "Upcoming", "not_payable").when(~F.col("_first"), "repeated").when(F.coalesce("account", F.lit("")) == "", "account")
    j = j.withColumn("reject_code", code)
    ok = j.filter("reject_code is null")
    return {"transactions": ok.select("upcoming_id", "date", F.lit("Expense").alias("transaction_type"), F.col("due").alias("amount"), F.col("account").alias("account_from"), F.col("title").alias("description"), F.when(F.col("debt_id").isNull(), "Personal").otherwise("Third-party").alias("money_context")),
            "statuses": ok.select(F.col("upcoming_id").alias("id"), F.lit("Paid").alias("status")),
            "allocations": allocations.filter("status = 'Active'").join(ok.select(F.col("upcoming_id").alias("covers_upcoming_id")), "covers_upcoming_id", "left_semi").select("id", F.lit("Spent").alias("status")),
            "debt_events": ok.filter("debt_id is not null").select("debt_id", F.lit("Settle").alias("event_type"), F.lit(-1).alias("effect"), F.col("due").alias("amount"), F.col("date").alias("event_date")),
            "rejects": j.filter("reject_code is not null").select("request_no", "reject_code")}


def idempotent(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Outcome of requests (request_no, scope, key, payload) against stored ones (scope, key, request_hash, state).

    Same key and hash: replay, or in_progress while it runs. Same key and another hash: conflict. Within the batch the
    first request of a key is new and stands for the others.
    """
    w = Window.partitionBy("scope", "key").orderBy("request_no")
    df = requests.withColumn("request_hash", F.sha2("payload", 256)).join(done.select("scope", "key", F.col("request_hash").alias("_old"), F.col("state").alias("_state")), ["scope", "key"], "left")
    df = df.withColumn("_first", F.first("request_hash").over(w)).withColumn("_rn", F.row_number().over(w))
    base = F.coalesce("_old", F.when(F.col("_rn") > 1, F.col("_first")))
    out = F.when(base.isNull(), "new").when(base != F.col("request_hash"), "conflict").when(F.col("_state") == "IN_PROGRESS", "in_progress").otherwise("replay")
    return df.withColumn("outcome", out).drop("_old", "_state", "_first", "_rn")


def reallocate(requests: DataFrame, budgets: DataFrame) -> DataFrame:
    """Budget moves (request_no, month, source, target, amount) in order: `invalid` without two categories and an amount, `unknown` where the
    month lacks one of them, `short` where the source has less at that point, what it got before included; else `moved`."""
    return fold_moves(requests, budgets.select("month", F.col("category").alias("name"), F.col("current_budget").alias("balance")), ["month"], "request_no")


def goal_moves(requests: DataFrame, goals: DataFrame) -> DataFrame:
    """Fund, release and spend requests (request_no, goal_id, op, amount) with the goal's allocation after each and an outcome.

    Only active goals move; releasing or spending more than is allocated at that point is `exceeds`. Refused requests change nothing.
    """
    signed = F.when(F.col("op") == "fund", F.col("amount")).otherwise(-F.col("amount"))
    j = requests.join(goals.select(F.col("id").alias("goal_id"), "allocated_amount", "status"), "goal_id", "left")
    told = fold(j, ["goal_id"], "request_no", F.col("allocated_amount"), F.when((F.col("status") == "Active") & (F.col("amount") > 0), signed))
    out = F.when(F.col("status").isNull(), "unknown").when(F.col("status") != "Active", "inactive").when(F.col("amount") <= 0, "amount").when(F.col("applied"), "applied").otherwise("exceeds")
    after = (F.col("before") + F.when(F.col("applied"), signed).otherwise(F.lit(0))).cast(MONEY)
    return told.withColumn("outcome", out).withColumn("after", after).drop("status", "allocated_amount", "applied", "replay", "before")


def status_changes(requests: DataFrame, rows: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """The last request per id (id, request_no, status), applied where the current status allows it."""
    last = requests.groupBy("id").agg(F.max_by("status", "request_no").alias("wanted"))
    j = last.join(rows.select("id", F.col("status").alias("now")), "id", "left")
    ok = F.lit(False)
    for now, to in allowed.items():
        ok = ok | ((F.col("now") == now) & F.col("wanted").isin(*to))
    return j.withColumn("outcome", F.when(F.col("now").isNull(), "unknown").when(F.col("now") == F.col("wanted"), "same").when(ok, "applied").otherwise("locked"))


def insert_ignore(state: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key the state has not, the first of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").join(state.select(*keys).distinct(), keys, "left_anti")


def over_coverage(allocations: DataFrame, upcoming: DataFrame) -> DataFrame:
    """Obligations whose active coverage exceeds their amount (a violated guard)."""
    c = allocations.filter("status = 'Active'").groupBy(F.col("covers_upcoming_id").alias("id")).agg(F.sum("amount").alias("covered"))
    return upcoming.select("id", "amount").join(c, "id").filter(F.col("covered") > F.col("amount") + 0.005)


def bulk_approve(candidates: DataFrame, allow_low: bool = False, allow_probable: bool = False) -> DataFrame:
    """Candidates (id, review_status, confidence, duplicate_status, amount, account) with `approved`: pending ones that are confident and no duplicate, unless allowed."""
    ok = (F.col("review_status") == "Pending") & ((F.col("confidence") != "low") | F.lit(allow_low)) & ((F.col("duplicate_status") == "None") | (F.lit(allow_probable) & (F.col("duplicate_status") == "Probable")))
    return candidates.withColumn("approved", F.coalesce(ok, F.lit(False)))


def approval_summary(marked: DataFrame) -> DataFrame:
    a = F.col("approved")
    return marked.agg(F.sum(a.cast("long")).alias("approved_count"), F.coalesce(F.sum(F.when(a, F.col("amount"))), F.lit(0)).cast(MONEY).alias("total"), F.array_sort(F.collect_set(F.when(a, F.col("account")))).alias("accounts"), F.sum((~a).cast("long")).alias("skipped"))
