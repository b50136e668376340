"""Queries on months, budgets, statements and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from saldo.functions import text as T
from saldo.operators import ledger as L
from saldo.operators import reports as R
from saldo.plans.core import REPORT, SPEND, D, _personal, _with
from saldo.plans.registry import query
from saldo.sources.ledger import AS_OF, MONTH, accounts, budgets, goals, transactions, upcoming, with_tables

MONTHS = f"""months AS (SELECT strftime(date, '%Y-%m') AS month, sum(CASE WHEN {REPORT} AND transaction_type = 'Income' THEN amount ELSE 0 END) AS income, sum(CASE WHEN {REPORT} AND transaction_type = 'Expense' THEN budget_effect ELSE 0 END) AS expense,
  sum(CASE WHEN money_context = 'Historical Research' THEN amount ELSE 0 END) AS research, sum(CASE WHEN starts_with(status, 'Provisional') THEN amount ELSE 0 END) AS provisional FROM tx WHERE NOT is_deleted GROUP BY 1)"""
VALUES = ("income", "expense", "research", "provisional", "surplus")


def _doubles(df, *keys):
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in VALUES])


@query(_with(["tx"], [MONTHS], f"SELECT month, {D('income')} AS income, {D('expense')} AS expense, {D('research')} AS research, {D('provisional')} AS provisional, {D('income - expense')} AS surplus FROM months"))
def monthly_report(spark, d):
    return _doubles(R.monthly(transactions(spark, d)), "month")


@query(_with(["tx"], [MONTHS], f"""SELECT CASE WHEN GROUPING(month) = 0 THEN 'month' WHEN GROUPING(term) = 0 THEN 'term' WHEN GROUPING(year) = 0 THEN 'year' ELSE 'all' END AS level, coalesce(month, term, year, 'all') AS period,
{D('sum(income)')} AS income, {D('sum(expense)')} AS expense, {D('sum(research)')} AS research, {D('sum(provisional)')} AS provisional, {D('sum(income - expense)')} AS surplus
FROM (SELECT *, substr(month, 1, 4) AS year, substr(month, 1, 4) || '-T' || ((CAST(substr(month, 6, 2) AS INTEGER) - 1) // 4 + 1) AS term FROM months) GROUP BY ROLLUP (year, term, month)"""))
def term_year_rollup(spark, d):
    return _doubles(R.rollup_terms(R.monthly(transactions(spark, d))), "level", "period")


@query(_with(["tx"], [MONTHS], f"""SELECT month, CASE WHEN income = 0 THEN 'none' WHEN {D('income - expense')} * 100 / {D('income')} >= 20 THEN 'strong' WHEN {D('income - expense')} * 100 / {D('income')} >= 10 THEN 'fair' ELSE 'weak' END AS band FROM months"""))
def savings_rate_band(spark, d):
    return R.monthly(transactions(spark, d)).select("month", R.savings_band(F.col("income"), F.col("surplus")).alias("band"))


def keyword_sql(text: str, groups, other: str) -> str:
    return "CASE" + "".join(" WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in groups) + f" ELSE {other} END"


CAT = f"CASE WHEN category NOT IN ('', '{T.OTHER}', 'Lain-lain') THEN category ELSE {keyword_sql('upper(description)', T.LEDGER_KEYWORDS, repr(T.OTHER))} END"


@query(with_tables("tx", body=f"SELECT {CAT} AS category, CAST(count(*) AS BIGINT) AS n, {D('sum(budget_effect)')} AS spent FROM tx WHERE {REPORT} AND transaction_type = 'Expense' GROUP BY 1"))
def category_normalized_spend(spark, d):
    t = transactions(spark, d).filter(L.report_cohort() & (F.col("transaction_type") == "Expense"))
    return t.groupBy(T.infer_category(F.col("description"), F.col("category")).alias("category")).agg(F.count("*").alias("n"), L.total("budget_effect").alias("spent"))


@query(with_tables("tx", body=f"""SELECT d.date, {D('coalesce(s.spent, 0)')} AS spent FROM (SELECT CAST(unnest(generate_series(DATE '{MONTH}-01', DATE '1999-06-30', INTERVAL 1 DAY)) AS DATE) AS date) d
LEFT JOIN (SELECT date, sum(budget_effect) AS spent FROM tx WHERE {REPORT} AND transaction_type = 'Expense' GROUP BY date) s USING (date)"""))
def daily_trend_dense(spark, d):
    return R.daily_trend(transactions(spark, d), MONTH)


@query(with_tables("tx", body=f"""SELECT {D(f"sum(CASE WHEN {REPORT} AND transaction_type = 'Income' THEN amount ELSE 0 END)")} AS income, {D(f"sum(CASE WHEN {REPORT} AND transaction_type = 'Expense' THEN budget_effect ELSE 0 END)")} AS expense,
{D("sum(CASE WHEN transaction_type = 'Transfer' THEN amount ELSE 0 END)")} AS transfers, {D("sum(CASE WHEN starts_with(status, 'Provisional') THEN amount ELSE 0 END)")} AS provisional, max(date) AS coverage_end FROM tx WHERE NOT is_deleted AND date BETWEEN DATE '{MONTH}-01' AND DATE '1999-06-30'"""))
def statement_totals(spark, d):
    t = L.live(transactions(spark, d)).filter(L.in_month(MONTH))
    cond = lambda c, v: L.total(F.when(c, F.col(v)).otherwise(F.lit(0)))
    kind = F.col("transaction_type")
    return t.agg(cond(L.report_cohort() & (kind == "Income"), "amount").alias("income"), cond(L.report_cohort() & (kind == "Expense"), "budget_effect").alias("expense"), cond(kind == "Transfer", "amount").alias("transfers"),
                 cond(F.col("status").startswith("Provisional"), "amount").alias("provisional"), F.max("date").alias("coverage_end"))


@query(with_tables("tx", "accounts", body=f"""SELECT account, {D('coalesce(sum(i), 0)')} AS inflow, {D('coalesce(sum(o), 0)')} AS outflow, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT account_from AS account, NULL AS i, amount AS o FROM tx WHERE NOT is_deleted AND date BETWEEN DATE '{MONTH}-01' AND DATE '1999-06-30' AND account_from <> ''
  UNION ALL SELECT account_to, amount, NULL FROM tx WHERE NOT is_deleted AND date BETWEEN DATE '{MONTH}-01' AND DATE '1999-06-30' AND account_to <> '' AND account_to <> account_from)
WHERE account IN (SELECT name FROM accounts WHERE kind = 'Owned') GROUP BY account"""))
def statement_account_flows(spark, d):
    return R.statement_flows(transactions(spark, d), accounts(spark, d), MONTH)


ACTUALS = f"actuals AS (SELECT strftime(date, '%Y-%m') AS month, category, sum({SPEND}) AS actual FROM tx WHERE {_personal('Expense')} GROUP BY 1, 2)"


def _actuals(spark, d):
    return transactions(spark, d).filter(L.personal("Expense")).groupBy(F.date_format("date", "yyyy-MM").alias("month"), "category").agg(F.sum(L.budget_spend()).alias("actual"))


@query(_with(["tx", "budgets"], [ACTUALS], f"""SELECT month, category, {D('plan')} AS budget, {D('spent')} AS actual, {D('plan - spent')} AS remaining, CASE WHEN plan <= 0 AND spent > 0 THEN 'Unplanned Spending' WHEN spent > plan THEN 'Over' WHEN plan > 0 AND spent >= plan * CAST(0.8 AS DECIMAL(3,1)) THEN 'Watch' ELSE 'Safe' END AS status,
CAST(floor({D('greatest(0, plan - spent)')} / 16) AS BIGINT) AS safe_daily
FROM (SELECT coalesce(b.month, a.month) AS month, coalesce(b.category, a.category) AS category, coalesce(b.current_budget, 0) AS plan, coalesce(a.actual, 0) AS spent FROM (SELECT * FROM budgets WHERE active) b FULL JOIN actuals a ON a.month = b.month AND a.category = b.category)"""))
def budget_view(spark, d):
    v = R.budget_view(budgets(spark, d).filter("active").select("month", "category", "current_budget"), _actuals(spark, d), 16)
    return v.select("month", "category", *[F.col(c).cast("double").alias(c) for c in ("budget", "actual", "remaining")], "status", "safe_daily")


FIXED = R.FIXED_BUDGETS | {c: 0 for c in R.NEVER_PLANNED}
_M = ["1999-06", "1999-05", "1999-04"]


@query(_with(["tx"], [ACTUALS, "cats AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in T.CATEGORIES[:-1]) + "]) AS category)",
    "v AS (SELECT c.category, " + ", ".join(f"greatest(0, {D(f'coalesce(sum(CASE WHEN month = {m!r} THEN actual END), 0)')}){' * 2' if m == _M[0] else ''} AS v{i}" for i, m in enumerate(_M, 1)) + " FROM cats c LEFT JOIN actuals a ON a.category = c.category GROUP BY c.category)",
    "b AS (SELECT *, greatest(list_sort([v1, v2, v3])[2], 0.85::DOUBLE * (0.5::DOUBLE * v1 + 0.3::DOUBLE * v2 + 0.2::DOUBLE * v3)) AS base, list_median(list_filter([v1, v2, v3], lambda x: x > 0)) AS mid FROM v)",
    "o AS (SELECT category, v1, v2, v3, CAST(CASE " + " ".join(f"WHEN category = '{c}' THEN {n}" for c, n in FIXED.items()) + " WHEN v1 = 0 AND v2 = 0 AND v3 = 0 THEN 0 WHEN category IN (" + ", ".join(f"'{c}'" for c in R.ROUTINE) + ") THEN ceil(round(CASE WHEN category = 'Health' THEN greatest(50000.0::DOUBLE, least(base, 150000.0::DOUBLE)) ELSE base END, 4) / 10000) * 10000 ELSE ceil(round(mid, 4) / 10000) * 10000 END AS BIGINT) AS suggested FROM b)"],
    f"SELECT category, v1, v2, v3, CASE WHEN category = '{T.OTHER}' THEN CAST(ceil((SELECT sum(suggested) FROM o WHERE category <> '{T.OTHER}') * 0.1::DOUBLE / 10000) * 10000 AS BIGINT) ELSE suggested END AS suggested FROM o"))
def budget_suggestion(spark, d):
    return R.suggest_budgets(_actuals(spark, d), "1999-07", AS_OF)


@query(with_tables("tx", body=f"""SELECT strftime(date, '%Y') AS year, {D(f"sum(CASE WHEN transaction_type = 'Expense' THEN {SPEND} ELSE 0 END)")} AS spent, {D("sum(CASE WHEN transaction_type = 'Income' THEN amount ELSE 0 END)")} AS income FROM tx WHERE (({_personal('Expense')}) OR ({_personal('Income')})) AND date <= DATE '{AS_OF}' GROUP BY 1"""))
def ytd_totals(spark, d):
    t = transactions(spark, d).filter((L.personal("Expense") | L.personal("Income")) & (F.col("date") <= F.lit(AS_OF).cast("date")))
    cond = lambda k, v: L.total(F.when(F.col("transaction_type") == k, v).otherwise(F.lit(0)))
    return t.groupBy(F.date_format("date", "yyyy").alias("year")).agg(cond("Expense", L.budget_spend()).alias("spent"), cond("Income", F.col("amount")).alias("income"))


SPENT = f"spent AS (SELECT account_from AS account, sum(amount) AS spent FROM tx WHERE {_personal('Expense')} GROUP BY 1)"


def _spent(spark, d):
    return transactions(spark, d).filter(L.personal("Expense")).groupBy(F.col("account_from").alias("account")).agg(F.sum("amount").alias("spent"))


@query(_with(["tx"], [SPENT], f"SELECT CASE WHEN rn <= 6 THEN account ELSE 'Other' END AS account, {D('sum(spent)')} AS spent, CAST(count(*) AS BIGINT) AS groups FROM (SELECT *, row_number() OVER (ORDER BY spent DESC, account) AS rn FROM spent) GROUP BY 1"))
def topk_other_bucket(spark, d):
    return R.with_other(_spent(spark, d), "account", "spent", 6).withColumn("spent", F.col("spent").cast("double"))


@query(_with(["tx"], [ACTUALS], f"SELECT month, category, round({D('actual')} / nullif({D('sum(actual) OVER (PARTITION BY month)')}, 0), 6) AS share FROM actuals"))
def share_of_total(spark, d):
    total = F.sum("actual").over(Window.partitionBy("month")).cast("double")
    return _actuals(spark, d).select("month", "category", F.round(F.try_divide(F.col("actual").cast("double"), total), 6).alias("share"))


@query(_with(["tx"], [ACTUALS], f"SELECT month, arg_max(category, struct_pack(a := actual, c := category)) AS top_category, {D('max(actual)')} AS spent FROM actuals GROUP BY month"))
def top_category(spark, d):
    return _actuals(spark, d).groupBy("month").agg(F.max_by("category", F.struct("actual", "category")).alias("top_category"), F.max("actual").cast("double").alias("spent"))


@query(_with(["tx"], [MONTHS], f"""SELECT month, CAST(CASE WHEN month < '1999-06' THEN 0 WHEN month = '1999-06' THEN size - 15 + 1 ELSE size END AS INTEGER) AS days_left, CAST(CASE WHEN month < '1999-06' THEN size WHEN month = '1999-06' THEN 15 ELSE 0 END AS INTEGER) AS elapsed,
round({D('expense')} / CASE WHEN month = '1999-06' THEN 15 ELSE size END, 4) AS daily_average, round(CASE WHEN month < '1999-06' THEN 0 WHEN month = '1999-06' THEN {D('income - expense')} / (size - 15 + 1) ELSE {D('income - expense')} / size END, 4) AS safe_daily
FROM (SELECT *, day(last_day(CAST(month || '-01' AS DATE))) AS size FROM months)"""))
def calendar_metrics(spark, d):
    m = R.monthly(transactions(spark, d))
    c = R.calendar_metrics(F.col("expense").cast("double"), F.col("surplus").cast("double"), F.col("month"), F.lit(AS_OF).cast("date"))
    return m.select("month", c["days_left"].alias("days_left"), c["elapsed"].alias("elapsed"), F.round(c["daily_average"], 4).alias("daily_average"), F.round(c["safe_daily"], 4).alias("safe_daily"))


@query(with_tables("goals", body=f"""SELECT id, name, kind, round({D('allocated_amount')} * 100 / nullif({D('target_amount')}, 0), 4) AS progress, {D('greatest(0, target_amount - allocated_amount)')} AS shortfall,
CAST(ceil({D('greatest(0, target_amount - allocated_amount)')} / greatest(1, (year(target_date) - 1999) * 12 + month(target_date) - 6)) AS BIGINT) AS monthly_deposit FROM goals"""))
def goal_progress(spark, d):
    short = F.greatest(F.lit(0), F.col("target_amount") - F.col("allocated_amount")).cast("double")
    months = F.greatest(F.lit(1), (F.year("target_date") - 1999) * 12 + F.month("target_date") - 6)
    return goals(spark, d).select("id", "name", "kind", F.round(F.try_divide(F.col("allocated_amount").cast("double") * 100, F.col("target_amount").cast("double")), 4).alias("progress"), short.alias("shortfall"), F.ceil(short / months).cast("long").alias("monthly_deposit"))


@query(with_tables("upcoming", body=f"""SELECT id, CASE WHEN due_date < DATE '{AS_OF}' THEN 'overdue' WHEN due_date = DATE '{AS_OF}' THEN 'today' WHEN due_date = DATE '{AS_OF}' + 1 THEN 'tomorrow' ELSE (due_date - DATE '{AS_OF}') || ' days' END AS due,
CASE status WHEN 'Confirmed' THEN 1 WHEN 'Upcoming' THEN 2 WHEN 'Tentative' THEN 3 ELSE 9 END AS rank FROM upcoming"""))
def due_labels(spark, d):
    gap = F.datediff("due_date", F.lit(AS_OF).cast("date"))
    label = F.when(gap < 0, "overdue").when(gap == 0, "today").when(gap == 1, "tomorrow").otherwise(F.concat(gap.cast("string"), F.lit(" days")))
    return upcoming(spark, d).select("id", label.alias("due"), F.when(F.col("status") == "Confirmed", 1).when(F.col("status") == "Upcoming", 2).when(F.col("status") == "Tentative", 3).otherwise(9).alias("rank"))


@query(with_tables("tx", body="""SELECT id, date, time, description, status FROM tx WHERE NOT is_deleted ORDER BY date DESC, time DESC, id DESC LIMIT 250 OFFSET 500"""))
def latest_page(spark, d):
    return L.live(transactions(spark, d)).orderBy(F.desc("date"), F.desc("time"), F.desc("id")).offset(500).limit(250).select("id", "date", "time", "description", "status")


@query(with_tables("accounts", body=f"""SELECT name, kind, CASE WHEN kind = 'Owned' THEN 'primary' ELSE 'other' END AS bucket, {D('current_balance')} AS balance FROM accounts WHERE active AND current_balance IS NOT NULL AND current_balance > 0 ORDER BY kind, name"""))
def account_list(spark, d):
    return (accounts(spark, d).filter("active and current_balance is not null and current_balance > 0").orderBy("kind", "name")
            .select("name", "kind", F.when(F.col("kind") == "Owned", "primary").otherwise("other").alias("bucket"), F.col("current_balance").cast("double").alias("balance")))


@query(with_tables("tx", body=f"SELECT strftime(date, '%Y-%m') AS month, {D(f'''sum(CASE WHEN transaction_type = 'Income' THEN amount ELSE 0 END)''')} AS income, {D(f'''sum(CASE WHEN transaction_type = 'Expense' THEN amount ELSE 0 END)''')} AS expense FROM tx WHERE NOT is_deleted GROUP BY 1"))
def monthly_shadow(spark, d):
    cond = lambda k: L.total(F.when(F.col("transaction_type") == k, F.col("amount")).otherwise(F.lit(0)))
    return L.live(transactions(spark, d)).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(cond("Income").alias("income"), cond("Expense").alias("expense"))


@query(with_tables("tx", body="SELECT id, date, time, transaction_type, CAST(amount AS DOUBLE) AS amount, account_from, account_to, description, category, for_with_whom, money_context, status, CAST(budget_effect AS DOUBLE) AS budget_effect, budget_rule_version, source_refs FROM tx WHERE NOT is_deleted"))
def export_csv_rows(spark, d):
    from saldo.sources.files import EXPORT_COLUMNS

    return L.live(transactions(spark, d)).select(*[F.col(c).cast("double").alias(c) if c in ("amount", "budget_effect") else F.col(c) for c in EXPORT_COLUMNS])
