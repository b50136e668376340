"""Budgets, period reports and statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions.text import CATEGORIES, OTHER
from saldo.operators import ledger as L

MONEY = "decimal(18,2)"


def _if(kind: str, amount: str = "amount") -> Column:
    return F.when(F.col("transaction_type") == kind, F.col(amount)).otherwise(F.lit(0).cast(MONEY))


def monthly(tx: DataFrame) -> DataFrame:
    """One row a month in one pass: income, expense (stored effects), research, provisional, surplus."""
    keep = L.report_cohort()
    zero = F.lit(0).cast(MONEY)
    rows = L.live(tx).select(
        F.date_format("date", "yyyy-MM").alias("month"), F.when(keep, _if("Income")).otherwise(zero).alias("income"), F.when(keep & (F.col("transaction_type") == "Expense"), F.col("budget_effect")).otherwise(zero).alias("expense"),
        F.when(F.col("money_context") == "Historical Research", F.col("amount")).otherwise(zero).alias("research"), F.when(F.col("status").startswith("Provisional"), F.col("amount")).otherwise(zero).alias("provisional"))
    sums = rows.groupBy("month").agg(*[F.sum(c).alias(c) for c in ("income", "expense", "research", "provisional")])
    return sums.withColumn("surplus", F.col("income") - F.col("expense"))


def rollup_terms(months: DataFrame) -> DataFrame:
    """Month rows rolled up to four-month terms, years and all, with a `level`."""
    m = months.withColumn("year", F.substring("month", 1, 4)).withColumn("term", F.concat("year", F.lit("-T"), (F.floor((F.substring("month", 6, 2).cast("int") - 1) / 4) + 1).cast("string")))
    out = m.rollup("year", "term", "month").agg(*[F.sum(c).alias(c) for c in ("income", "expense", "research", "provisional", "surplus")], F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, "month").when(F.col("g") == 1, "term").when(F.col("g") == 3, "year").otherwise("all")
    return out.select(level.alias("level"), F.coalesce("month", "term", "year", F.lit("all")).alias("period"), "income", "expense", "research", "provisional", "surplus")


def daily_trend(tx: DataFrame, month: str) -> DataFrame:
    """Every day of the month, with zero where nothing was spent."""
    first = F.lit(f"{month}-01").cast("date")
    days = tx.sparkSession.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("date"))
    spent = tx.filter(L.report_cohort() & L.in_month(month) & (F.col("transaction_type") == "Expense")).groupBy("date").agg(F.sum("budget_effect").alias("spent"))
    return days.join(spent, "date", "left").select("date", F.coalesce("spent", F.lit(0)).cast("double").alias("spent"))


def statement_flows(tx: DataFrame, accounts: DataFrame, month: str) -> DataFrame:
    """In, out and count of each owned account in a month; a transfer to itself counts once, as an outflow."""
    p = L.postings(L.live(tx).filter(L.in_month(month) & ((F.col("account_from") != F.col("account_to")) | (F.col("account_from") != ""))).withColumn("account_to", F.when(F.col("account_from") == F.col("account_to"), "").otherwise(F.col("account_to"))))
    own = accounts.filter("kind = 'Owned'").select(F.col("name").alias("account"))
    return p.join(own, "account", "left_semi").groupBy("account").agg(F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("delta"))), F.lit(0)).cast("double").alias("inflow"), F.coalesce(F.sum(F.when(F.col("side") == "out", -F.col("delta"))), F.lit(0)).cast("double").alias("outflow"), F.count("*").alias("n"))


def budget_view(budgets: DataFrame, actuals: DataFrame, days_left: int) -> DataFrame:
    """Budget rows with actual spending, what remains, a status, and what is safe a day."""
    df = budgets.join(actuals, ["month", "category"], "full_outer")
    plan, spent = F.coalesce("current_budget", F.lit(0)).cast(MONEY), F.coalesce("actual", F.lit(0)).cast(MONEY)
    left = (plan - spent).cast(MONEY)
    status = F.when((plan <= 0) & (spent > 0), "Unplanned Spending").when(spent > plan, "Over").when((plan > 0) & (spent >= plan * F.lit("0.8").cast("decimal(3,1)")), "Watch").otherwise("Safe")
    return df.select("month", "category", plan.alias("budget"), spent.alias("actual"), left.alias("remaining"), status.alias("status"), F.floor(F.greatest(F.lit(0), left) / F.lit(days_left)).cast("long").alias("safe_daily"))


# Categories that are suggested from spending, and those with a fixed suggestion.
ROUTINE = ["Main Meals", "Snacks", "Cafe & Drinks", "Groceries & Daily Needs", "Fuel", "Parking/Toll", "Transport / Other Transport", "Personal Care", "Health", "Campus & Organization", "Phone & Internet", "Subscriptions", "Gifts & Giving"]
FIXED_BUDGETS = {"Vehicle Service": 50_000, "Education": 0}
NEVER_PLANNED = ["Fashion", "Electronics", "Travel"]


def suggest_budgets(actuals: DataFrame, month: str, as_of: str) -> DataFrame:
    """Budgets of all categories for `month` from the three months before (v1 the newest); the month of `as_of` counts as if
    it went on at its rate so far.

    Routine categories: the larger of the median and 85 % of the weighted mean (.5, .3, .2), Health between 50 000 and
    150 000; others the median of the months with spending; rounded up to 10 000. The catch-all gets a tenth of the rest.
    """
    start, day = F.lit(f"{month}-01").cast("date"), F.lit(as_of).cast("date")
    scale = F.when((F.col("month") == F.date_format(day, "yyyy-MM")) & (F.day(day) < F.day(F.last_day(day))), F.day(F.last_day(day)) / F.day(day)).otherwise(F.lit(1.0))
    back = F.round(F.months_between(start, F.to_date(F.concat("month", F.lit("-01"))))).cast("int")
    seen = actuals.select("category", F.greatest(F.lit(0), F.col("actual")).cast("double").alias("a"), scale.alias("scale"), back.alias("back")).filter(F.col("back").between(1, 3))
    all_categories = actuals.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, CATEGORIES[:-1]))).alias("category"))
    v = [F.coalesce(F.sum(F.when(F.col("back") == i, F.col("a") * F.col("scale"))), F.lit(0.0)).alias(f"v{i}") for i in (1, 2, 3)]
    p = all_categories.join(seen, "category", "left").groupBy("category").agg(*v)
    up = lambda c: (F.ceil(F.round(c, 4) / 10_000) * 10_000).cast("long")
    values = F.array_sort(F.array("v1", "v2", "v3"))
    base = F.greatest(F.element_at(values, 2), 0.85 * (0.5 * F.col("v1") + 0.3 * F.col("v2") + 0.2 * F.col("v3")))
    base = F.when(F.col("category") == "Health", F.greatest(F.lit(50_000.0), F.least(base, F.lit(150_000.0)))).otherwise(base)
    some = F.filter(values, lambda x: x > 0)
    mid = (F.element_at(some, F.floor((F.size(some) + 1) / 2).cast("int")) + F.element_at(some, F.ceil((F.size(some) + 1) / 2).cast("int"))) / 2
    fixed = F.lit(None).cast("long")
    for name, amount in [*FIXED_BUDGETS.items(), *((c, 0) for c in NEVER_PLANNED)]:
        fixed = F.when(F.col("category") == name, F.lit(amount).cast("long")).otherwise(fixed)
    own = F.coalesce(fixed, F.when(F.size(some) == 0, F.lit(0).cast("long")).when(F.col("category").isin(*ROUTINE), up(base)).otherwise(up(mid)))
    out = p.withColumn("suggested", own)
    rest = out.filter(F.col("category") != OTHER).agg((F.ceil(F.sum("suggested") * 0.1 / 10_000) * 10_000).cast("long").alias("rest"))
    return out.crossJoin(F.broadcast(rest)).withColumn("suggested", F.when(F.col("category") == OTHER, F.col("rest")).otherwise(F.col("suggested"))).drop("rest")  # rest is one row


def with_other(df: DataFrame, name: str, value: str, k: int) -> DataFrame:
    """The k largest groups by value (ties by name), and one row `Other` for the rest."""
    rank = F.row_number().over(Window.orderBy(F.desc(value), name))
    label = F.when(F.col("_rn") <= k, F.col(name)).otherwise("Other")
    return df.withColumn("_rn", rank).groupBy(label.alias(name)).agg(F.sum(value).alias(value), F.count("*").alias("groups"))


def calendar_metrics(spent: Column, remaining: Column, month: Column, today: Column) -> dict[str, Column]:
    """Days left, safe daily amount and daily average of a month that is past, current or to come. Deficits stay negative."""
    first = F.to_date(F.concat(month, F.lit("-01")))
    size, now = F.day(F.last_day(first)), F.date_format(today, "yyyy-MM")
    past, current = month < now, month == now
    left = F.when(past, 0).when(current, size - F.day(today) + 1).otherwise(size)
    elapsed = F.when(past, size).when(current, F.day(today)).otherwise(0)
    return {"days_left": left.cast("int"), "safe_daily": F.when(left > 0, remaining / left).otherwise(F.lit(0)).cast("double"),
            "daily_average": F.when(elapsed > 0, spent / elapsed).otherwise(spent / size).cast("double"), "elapsed": elapsed.cast("int")}


def savings_band(income: Column, surplus: Column) -> Column:
    """strong from 20 %, fair from 10 %, else weak; none without income."""
    share = F.try_divide(surplus.cast("double") * 100, income.cast("double"))
    return F.when(share.isNull(), "none").when(share >= 20, "strong").when(share >= 10, "fair").otherwise("weak")
