"""Queries on patterns, anomalies, forecasts, suggestions and freshness."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from saldo.functions import text as T
from saldo.operators import insights as I
from saldo.operators import ledger as L
from saldo.plans.core import CU, COVER, POSTED, POSTINGS, D, _with
from saldo.plans.registry import query
from saldo.sources.ledger import AS_OF, accounts, raw_events, read, snapshots, transactions, upcoming, with_tables

EV = "2024-01-25"
NORM = "trim(lower(coalesce({}, '')))"


def normalize_sql(column: str) -> str:
    """The same normalization in DuckDB."""
    x = f"regexp_replace({NORM.format(column)}, '^({'|'.join(T.VERBS)})\\s+', '')"
    for p in T.NOISE:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return f"array_to_string(list_filter(regexp_split_to_array(regexp_replace({x}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '\\d+')), ' ')"


def _patterns_sql(rows: str, keys: str, as_of: str) -> list[str]:
    return [rows, f"gaps AS (SELECT *, date - lag(date) OVER (PARTITION BY {keys} ORDER BY date, id) AS gap FROM rows_ WHERE date <= DATE '{as_of}')",
            f"""g AS (SELECT {keys}, count(*) AS support, median(CAST(amount AS DOUBLE)) AS median_amount, avg(CAST(amount AS DOUBLE)) AS mean_amount, coalesce(stddev_samp(CAST(amount AS DOUBLE)), 0) AS sd_amount, median(gap) AS median_gap, avg(gap) AS mean_gap, coalesce(stddev_samp(gap), 0) AS sd_gap, max(date) AS last_date
  FROM gaps GROUP BY {keys} HAVING count(*) >= 2)""",
            """p0 AS (SELECT *, CASE WHEN mean_amount > 0 THEN sd_amount / mean_amount ELSE 0 END AS amount_cv, CASE WHEN mean_gap > 0 THEN sd_gap / mean_gap ELSE 0 END AS interval_cv, greatest(1, CAST(round_even(median_gap, 0) AS INTEGER)) AS step FROM g)""",
            f"""p AS (SELECT *, last_date + CAST(step * greatest(1, ceil((DATE '{as_of}' - last_date) / step)) AS INTEGER) AS next_date, CASE WHEN support < 3 THEN 'low' WHEN amount_cv <= 0.10 AND interval_cv <= 0.40 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN support < 3 THEN 'Abstain' ELSE 'Recurring' END AS pattern FROM p0)"""]


EVENT_ROWS = "rows_ AS (SELECT id, date, amount, merchant, source FROM raws)"
PATTERN_OUT = "CAST(support AS BIGINT) AS support, round(median_amount, 4) AS median_amount, round(amount_cv, 6) AS amount_cv, round(interval_cv, 6) AS interval_cv, step, next_date, confidence, pattern"


def _pattern_out(df, *keys):
    return df.select(*keys, "support", F.round("median_amount", 4).alias("median_amount"), F.round("amount_cv", 6).alias("amount_cv"), F.round("interval_cv", 6).alias("interval_cv"), "step", "next_date", "confidence", "pattern")


@query(_with(["raws"], _patterns_sql(EVENT_ROWS, "merchant, source", EV), f"SELECT merchant, source, {PATTERN_OUT} FROM p"))
def recurring_patterns(spark, d):
    return _pattern_out(I.recurring(raw_events(spark, d), ["merchant", "source"], EV), "merchant", "source")


LEDGER_ROWS = f"""rows_ AS (SELECT id, date, amount, {normalize_sql('description')} AS merchant, transaction_type, category, CASE WHEN transaction_type = 'Income' THEN account_to ELSE account_from END AS account FROM tx
  WHERE NOT is_deleted AND money_context = 'Personal' AND {POSTED} AND transaction_type IN ('Income', 'Expense') AND reversal_of_id IS NULL AND NOT contains(description, '['))"""


def _ledger_rows(spark, d, *more):
    cohort = ~F.col("is_deleted") & (F.col("money_context") == "Personal") & F.col("status").isin(*L.POSTED) & F.col("transaction_type").isin("Income", "Expense") & F.col("reversal_of_id").isNull() & ~F.col("description").contains("[")
    return transactions(spark, d).filter(cohort).select("id", "date", "amount", T.normalize_merchant("description").alias("merchant"), "transaction_type", "category", F.when(F.col("transaction_type") == "Income", F.col("account_to")).otherwise(F.col("account_from")).alias("account"), *more)


@query(_with(["tx"], _patterns_sql(LEDGER_ROWS, "merchant, transaction_type, category, account", AS_OF), f"SELECT merchant, transaction_type, category, account, {PATTERN_OUT} FROM p"))
def ledger_recurring(spark, d):
    keys = ["merchant", "transaction_type", "category", "account"]
    return _pattern_out(I.recurring(_ledger_rows(spark, d), keys, AS_OF), *keys)


@query(_with(["raws", "upcoming"], _patterns_sql("rows_ AS (SELECT id, date, amount, CASE WHEN user_id % 2 = 0 THEN 'red bolt' ELSE merchant END AS merchant, source FROM raws)", "merchant, source", EV) + ["titles AS (SELECT lower(title) AS title, min(id) AS id FROM upcoming WHERE status IN ('Upcoming', 'Confirmed', 'Tentative') GROUP BY 1)"],
    "SELECT merchant, source, CAST(support AS BIGINT) AS support, min(t.id) AS upcoming_id FROM p LEFT JOIN titles t ON contains(p.merchant, t.title) OR contains(t.title, p.merchant) GROUP BY merchant, source, support"))
def recurring_vs_upcoming(spark, d):
    rows = raw_events(spark, d).withColumn("merchant", F.when(F.col("user_id") % 2 == 0, "red bolt").otherwise(F.col("merchant")))
    return I.match_upcoming(I.recurring(rows, ["merchant", "source"], EV), upcoming(spark, d)).select("merchant", "source", "support", "upcoming_id")


@query(_with(["raws"], [f"past AS (SELECT *, CAST(amount AS DOUBLE) AS x FROM raws WHERE date <= DATE '{EV}')", "mid AS (SELECT merchant, median(x) AS median, count(*) AS support FROM past GROUP BY merchant HAVING count(*) >= 3)",
    "off AS (SELECT p.*, m.median, m.support, abs(p.x - m.median) AS diff FROM past p JOIN mid m USING (merchant))", "mad AS (SELECT merchant, median(diff) AS mad FROM off GROUP BY merchant)"],
    f"""SELECT id, merchant, round(median, 4) AS median, round(mad, 4) AS mad, round(diff, 4) AS diff FROM off JOIN mad USING (merchant) WHERE date >= DATE '{EV}' - 10 AND diff >= 10 AND CASE WHEN mad = 0 THEN x > 1.5 * median OR x < 0.5 * median ELSE diff / mad >= 3 END"""))
def mad_anomalies(spark, d):
    a = I.anomalies(raw_events(spark, d), ["merchant"], EV, lookback=10, least=10.0)
    return a.select("id", "merchant", *[F.round(c, 4).alias(c) for c in ("median", "mad", "diff")])


# Every 37th row has a digit too many.
LAST = "1998-08-01"
SPENT = f"""spent AS (SELECT id, date, description, category, CAST(amount * CASE WHEN id % 37 = 0 THEN 10 ELSE 1 END AS DOUBLE) AS x, coalesce(nullif({normalize_sql('description')}, ''), lower(trim(description))) AS merchant FROM tx
  WHERE NOT is_deleted AND money_context = 'Personal' AND {POSTED} AND transaction_type = 'Expense' AND reversal_of_id IS NULL AND NOT contains(lower(description), '[rekonsiliasi]') AND date <= DATE '{LAST}')"""


@query(_with(["tx"], [SPENT, "mid AS (SELECT merchant, median(x) AS median, count(*) AS support FROM spent GROUP BY merchant HAVING count(*) >= 3)", "off AS (SELECT s.*, m.median, m.support, abs(s.x - m.median) AS diff FROM spent s JOIN mid m USING (merchant))",
    "mad AS (SELECT merchant, median(diff) AS mad FROM off GROUP BY merchant)"],
    f"""SELECT id, date, merchant, category, x AS amount, CAST(support AS BIGINT) AS support, round(median, 4) AS median, round(mad, 4) AS mad, round(diff, 4) AS diff FROM off JOIN mad USING (merchant)
WHERE date >= DATE '{LAST}' - 90 AND diff >= 10000 AND CASE WHEN mad = 0 THEN x > 1.5 * median OR x < 0.5 * median ELSE diff / mad >= 3 END"""))
def expense_anomalies(spark, d):
    cohort = ~F.col("is_deleted") & (F.col("money_context") == "Personal") & F.col("status").isin(*L.POSTED) & (F.col("transaction_type") == "Expense") & F.col("reversal_of_id").isNull() & ~F.lower("description").contains("[rekonsiliasi]")
    merchant = F.coalesce(F.nullif(T.normalize_merchant("description"), F.lit("")), F.lower(F.trim("description")))
    rows = transactions(spark, d).filter(cohort).select("id", "date", "category", (F.col("amount") * F.when(F.col("id") % 37 == 0, 10).otherwise(1)).alias("amount"), merchant.alias("merchant"))
    return I.anomalies(rows, ["merchant"], LAST, lookback=90).select("id", "date", "merchant", "category", F.col("x").alias("amount"), "support", *[F.round(c, 4).alias(c) for c in ("median", "mad", "diff")])


@query(_with(["accounts", "upcoming", "allocs", "goals"], [COVER, CU, "opening AS (SELECT coalesce(sum(current_balance), 0) AS opening FROM accounts WHERE active AND kind = 'Owned')",
    f"ev AS (SELECT due_date AS date, CASE WHEN status = 'Confirmed' THEN '1 confirmed' ELSE '2 expected' END AS kind, sum(-amount) AS signed, count(*) AS n FROM upcoming WHERE status IN ('Upcoming', 'Confirmed') AND due_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30 GROUP BY 1, 2)",
    "c AS (SELECT ev.*, opening, opening + sum(signed) OVER (ORDER BY date, kind) AS balance FROM ev, opening)"],
    f"SELECT date, kind, CAST(n AS BIGINT) AS n, {D('balance')} AS balance, {D('least(opening, min(balance) OVER (ORDER BY date, kind))')} AS lowest FROM c"))
def forecast_curve(spark, d):
    return _curve(spark, d).select("date", "kind", "n", F.col("balance").cast("double").alias("balance"), F.col("lowest").cast("double").alias("lowest"))


def _curve(spark, d):
    return I.forecast(*_sure(spark, d), AS_OF, 30)


def _sure(spark, d):
    opening = accounts(spark, d).filter("active and kind = 'Owned'").agg(F.coalesce(F.sum("current_balance"), F.lit(0)).cast("decimal(28,2)").alias("opening"))
    ev = upcoming(spark, d).filter("status in ('Upcoming', 'Confirmed')").select(F.col("due_date").alias("date"), F.col("id").alias("seq"), (-F.col("amount")).alias("signed"), F.when(F.col("status") == "Confirmed", "1 confirmed").otherwise("2 expected").alias("kind"))
    return opening, ev


@query(_with(["accounts", "upcoming"], ["opening AS (SELECT coalesce(sum(current_balance), 0) AS opening FROM accounts WHERE active AND kind = 'Owned')",
    f"ev AS (SELECT due_date AS date, CASE WHEN status = 'Confirmed' THEN '1 confirmed' ELSE '2 expected' END AS kind, sum(-amount) AS signed, count(*) AS n FROM upcoming WHERE status IN ('Upcoming', 'Confirmed') AND due_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30 GROUP BY 1, 2)",
    "c AS (SELECT ev.*, opening, opening + sum(signed) OVER (ORDER BY date, kind) AS balance FROM ev, opening)"],
    f"SELECT CAST(sum(n) AS BIGINT) AS events, {D('-sum(signed)')} AS outflow, {D('least(max(opening), min(balance))')} AS lowest, least(max(opening), min(balance)) < 0 AS short FROM c"))
def forecast_summary(spark, d):
    c = _curve(spark, d)
    low = F.least(F.max("opening"), F.min("balance"))
    return c.agg(F.sum("n").alias("events"), (-F.sum("signed")).cast("double").alias("outflow"), low.cast("double").alias("lowest"), (low < 0).alias("short"))


#: A payment every thirty days of each account, some with changing amounts, some planned already.
SUBSCRIBED = ["Langganan musik", "Langganan red bolt", "Bayar listrik", "Gaji"]
MONTHLY = f"""rows_ AS (SELECT c_custkey * 10 + k AS id, DATE '{AS_OF}' - 20 - CAST(c_custkey % 9 AS INTEGER) - CAST(30 * k AS INTEGER) AS date, CAST((100 + c_custkey % 50) * CASE WHEN c_custkey % 3 = 0 THEN 1 + k ELSE 1 END AS DECIMAL(18,2)) AS amount, d AS description, {normalize_sql('d')} AS merchant,
  CASE WHEN c_custkey % 4 = 3 THEN 'Income' ELSE 'Expense' END AS transaction_type, c_name AS account FROM (SELECT *, ['{"', '".join(SUBSCRIBED)}'][c_custkey % 4 + 1] AS d, unnest(range(0, 6)) AS k FROM (SELECT c_custkey, c_name FROM customer)))"""
PLANNED = f"""est AS (SELECT next_date AS date, '3 estimated' AS kind, sum(CASE WHEN transaction_type = 'Income' THEN 1 ELSE -1 END * CAST(round(median_amount, 2) AS DECIMAL(18,2))) AS signed, count(*) AS n FROM (SELECT p.*, t.title FROM p JOIN (SELECT merchant, transaction_type, account, arg_max(description, date) AS title FROM rows_ GROUP BY ALL) t USING (merchant, transaction_type, account)) p
  WHERE confidence = 'high' AND next_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30 AND NOT EXISTS (SELECT 1 FROM (SELECT lower(title) AS low, {normalize_sql('title')} AS norm FROM upcoming WHERE status IN ('Upcoming', 'Confirmed', 'Tentative')) u
    WHERE norm <> '' AND contains(p.merchant, norm) OR p.merchant <> '' AND contains(norm, p.merchant) OR contains(lower(p.title), low)) GROUP BY 1)"""


def _monthly(spark, d):
    c = F.col("c_custkey")
    t = read(spark, d, "customer").select("c_custkey", "c_name", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"), F.element_at(F.array(*map(F.lit, SUBSCRIBED)), (c % 4 + 1).cast("int")).alias("description"))
    return t.select((c * 10 + F.col("k")).alias("id"), F.date_sub(F.date_sub(F.lit(AS_OF).cast("date"), (20 + c % 9).cast("int")), (30 * F.col("k")).cast("int")).alias("date"), ((100 + c % 50) * F.when(c % 3 == 0, 1 + F.col("k")).otherwise(1)).cast("decimal(18,2)").alias("amount"),
                    "description", T.normalize_merchant("description").alias("merchant"), F.when(c % 4 == 3, "Income").otherwise("Expense").alias("transaction_type"), F.col("c_name").alias("account"))


@query(_with(["accounts", "upcoming"], _patterns_sql(MONTHLY, "merchant, transaction_type, account", AS_OF) + [PLANNED, "opening AS (SELECT coalesce(sum(current_balance), 0) AS opening FROM accounts WHERE active AND kind = 'Owned')",
    f"ev AS (SELECT due_date AS date, CASE WHEN status = 'Confirmed' THEN '1 confirmed' ELSE '2 expected' END AS kind, sum(-amount) AS signed, count(*) AS n FROM upcoming WHERE status IN ('Upcoming', 'Confirmed') AND due_date BETWEEN DATE '{AS_OF}' AND DATE '{AS_OF}' + 30 GROUP BY 1, 2 UNION ALL SELECT date, kind, signed, n FROM est)",
    "c AS (SELECT ev.*, opening, opening + sum(signed) OVER (ORDER BY date, kind) AS balance, opening + sum(CASE WHEN kind <> '3 estimated' THEN signed ELSE 0 END) OVER (ORDER BY date, kind) AS sure FROM ev, opening)"],
    f"SELECT date, kind, CAST(n AS BIGINT) AS n, {D('sure')} AS confirmed_balance, {D('least(opening, min(sure) OVER (ORDER BY date, kind))')} AS confirmed_lowest, {D('balance')} AS estimated_balance, {D('least(opening, min(balance) OVER (ORDER BY date, kind))')} AS estimated_lowest FROM c"))
def forecast_estimated(spark, d):
    patterns = I.planned(I.recurring(_monthly(spark, d), ["merchant", "transaction_type", "account"], AS_OF), upcoming(spark, d))
    opening, sure = _sure(spark, d)
    more = I.estimated_events(patterns, AS_OF, 30).withColumn("kind", F.lit("3 estimated"))
    c = I.forecast(opening, sure.unionByName(more), AS_OF, 30)
    w = Window.orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a day and kind
    c = c.withColumn("sure", F.col("opening") + F.sum(F.when(F.col("kind") != "3 estimated", F.col("signed")).otherwise(F.lit(0))).over(w)).withColumn("sure_lowest", F.least("opening", F.min("sure").over(w)))
    return c.select("date", "kind", "n", *[F.col(a).cast("double").alias(b) for a, b in (("sure", "confirmed_balance"), ("sure_lowest", "confirmed_lowest"), ("balance", "estimated_balance"), ("lowest", "estimated_lowest"))])


@query(_with(["tx"], _patterns_sql(LEDGER_ROWS.replace("SELECT id, date", "SELECT id, description, date", 1), "merchant, transaction_type, category, account", AS_OF) + [f"t AS (SELECT merchant, transaction_type, category, account, arg_max(description, (date, id)) AS title FROM rows_ WHERE date <= DATE '{AS_OF}' GROUP BY ALL)"],
    "SELECT merchant, transaction_type, category, account, CAST(support AS BIGINT) AS support, title FROM p JOIN t USING (merchant, transaction_type, category, account)"))
def recurring_titles(spark, d):
    keys = ["merchant", "transaction_type", "category", "account"]
    return I.recurring(_ledger_rows(spark, d, "description"), keys, AS_OF).select(*keys, "support", "title")


SUGGEST = """n AS (SELECT merchant, {f} AS v, count(*) AS n FROM rows_ WHERE date <= DATE '{day}' AND {f} <> '' GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY merchant) AS support, row_number() OVER (PARTITION BY merchant ORDER BY n DESC, v) AS rn, lead(n) OVER (PARTITION BY merchant ORDER BY n DESC, v) AS second FROM n)"""


@query(_with(["tx"], [LEDGER_ROWS, SUGGEST.format(f="category", day=AS_OF)], "SELECT merchant, v AS suggested, CAST(support AS BIGINT) AS support, round(n / CAST(support AS DOUBLE), 6) AS confidence FROM r WHERE rn = 1 AND support >= 3 AND coalesce(second, 0) < n AND n / CAST(support AS DOUBLE) >= 0.2"))
def suggest_mode(spark, d):
    s = I.suggest(_ledger_rows(spark, d).filter(F.col("date") <= F.lit(AS_OF).cast("date")), ["merchant"], "category", 3, 0.2)
    return s.withColumn("confidence", F.round("confidence", 6))


@query(_with(["tx"], [LEDGER_ROWS, "k AS (SELECT *, row_number() OVER (ORDER BY date, id) <= floor((SELECT count(*) FROM rows_) * 0.7::DOUBLE) AS is_train FROM rows_)",
    "n AS (SELECT merchant, category AS v, count(*) AS n FROM k WHERE is_train GROUP BY 1, 2)", "r AS (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY n DESC, v) AS rn, lead(n) OVER (PARTITION BY merchant ORDER BY n DESC, v) AS second FROM n)"],
    "SELECT merchant, CAST(count(*) AS BIGINT) AS tested, CAST(sum(CASE WHEN r.v = k.category THEN 1 ELSE 0 END) AS BIGINT) AS right_ FROM k JOIN r USING (merchant) WHERE NOT is_train AND rn = 1 AND coalesce(second, 0) < n GROUP BY merchant"))
def holdout_precision(spark, d):
    rows = I.holdout_split(_ledger_rows(spark, d))
    learnt = I.suggest(rows.filter("is_train"), ["merchant"], "category", 1, 0.0)
    return rows.filter("not is_train").join(learnt, "merchant").groupBy("merchant").agg(F.count("*").alias("tested"), F.sum((F.col("suggested") == F.col("category")).cast("int")).alias("right_"))


@query(_with(["accounts", "tx", "snaps"], [POSTINGS], f"""SELECT account, kind, last_tx, last_snapshot, CAST(coalesce(snapshots, 0) AS BIGINT) AS snapshots, CAST(coalesce(DATE '{AS_OF}' - greatest(last_tx, last_snapshot), 999) AS INTEGER) AS age,
CASE WHEN last_tx IS NULL AND last_snapshot IS NULL THEN 'never' WHEN DATE '{AS_OF}' - greatest(last_tx, last_snapshot) <= 3 THEN 'fresh' ELSE 'stale' END AS state
FROM (SELECT name AS account, kind FROM accounts) LEFT JOIN (SELECT account, max(date) AS last_tx FROM postings WHERE date <= DATE '{AS_OF}' GROUP BY account) USING (account)
LEFT JOIN (SELECT account_name AS account, max(snapshot_date) AS last_snapshot, count(*) AS snapshots FROM snaps WHERE snapshot_date <= DATE '{AS_OF}' GROUP BY 1) USING (account)"""))
def account_freshness(spark, d):
    return I.account_freshness(accounts(spark, d), L.postings(L.live(transactions(spark, d))), snapshots(spark, d), AS_OF)


@query(with_tables("raws", body="SELECT source, max(ts) AS last_event, CAST(count(*) AS BIGINT) AS n, CAST(floor(date_diff('second', max(ts), TIMESTAMP '2024-02-01 00:00:00') / 3600) AS BIGINT) AS hours FROM raws GROUP BY source"))
def source_freshness(spark, d):
    hours = F.floor(F.timestamp_diff("SECOND", F.max("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")) / 3600).cast("long")
    return raw_events(spark, d).groupBy("source").agg(F.max("ts").alias("last_event"), F.count("*").alias("n"), hours.alias("hours"))


@query("""SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN regexp_matches(text, '[#$%&*]{3}') AND quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 1 ELSE 0 END) AS BIGINT) AS predicted, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive
FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def junk_precision(spark, d):
    j = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("lang", F.col("text").rlike("[#$%&*]{3}").alias("p"), (F.col("quality") == 0).alias("t"))
    return j.groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(c.cast("int")).alias(k) for c, k in ((F.col("p") & F.col("t"), "hits"), (F.col("p"), "predicted"), (F.col("t"), "positive"))])
