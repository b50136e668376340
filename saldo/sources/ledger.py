"""Ledger tables read from the star schema: transactions, accounts, budgets, obligations, debts, and message streams.

Each function returns a DataFrame of the ledger model (money as DECIMAL(18,2), dates as DATE); SQL holds the same mapping
as a common table expression for the oracle. All dates are compared with an explicit `as_of`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Account kinds by market segment.
KIND = {"HOUSEHOLD": "Owned", "BUILDING": "Receivable", "AUTOMOBILE": "Suspense", "MACHINERY": "External", "FURNITURE": "Investment"}
#: Spending categories by order priority.
CATEGORY = {"1-URGENT": "Health", "2-HIGH": "Main Meals", "3-MEDIUM": "Fuel", "4-NOT SPECIFIED": "Other / Miscellaneous", "5-LOW": "Electronics"}
#: Upcoming status by part type.
UPCOMING = {"STANDARD": "Upcoming", "ECONOMY": "Confirmed", "MEDIUM": "Tentative", "PROMO": "Paid", "LARGE": "Skipped", "SMALL": "Cancelled"}
AS_OF = "1999-06-15"
MONTH = "1999-06"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(column: str | Column, options: dict[str, str], other: str | None = None) -> Column:
    """Value by equality, as a chain of conditions."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(other)
    for k, v in options.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def account_name(key: Column) -> Column:
    return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), pick("c_mktsegment", KIND, "Owned").alias("kind"),
        F.when(k % 23 != 0, F.col("c_acctbal").cast(MONEY)).alias("current_balance"),
        F.lit("1996-01-01").cast("date").alias("balance_date"), (k % 13 == 0).alias("protected"),
        F.when(k % 17 == 0, (k % 50 * 10).cast(MONEY)).otherwise(F.lit(0).cast(MONEY)).alias("protected_amount"), (k % 20 != 0).alias("active"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    digit = k % 10
    kind = F.when(digit <= 5, "Expense").when(digit <= 7, "Income").when((digit == 9) & (k % 20 >= 10), "Adjustment").otherwise("Transfer")
    own, peer = account_name(c), account_name((c * 7 + 3) % 100)
    date = F.col("o_orderdate").cast("date")
    minute = (k % 1440).cast("int")
    category = pick("o_orderpriority", CATEGORY, "Other / Miscellaneous")
    amount = F.col("o_totalprice").cast(MONEY)
    context = F.when(k % 16 == 3, "Pass-through").when(k % 16 == 7, "Historical Research").when(k % 16 == 11, "Third-party").otherwise("Personal")
    words = F.when(k % 30 == 0, "[Rekonsiliasi] balance check").when(k % 7 == 0, "Transfer ke toko kopi TRX#99812").when(k % 7 == 1, "Bayar bensin pertamax 22-08-2026") \
        .when(k % 7 == 2, "Bayar obat apotek").when(k % 7 == 3, "GRAB ride ref #89281 Rp 50.000").otherwise("Makan siang nasi padang")
    return read(spark, sf_dir, "orders").select(
        k.alias("id"), date.alias("date"), F.format_string("%02d:%02d", (minute / 60).cast("int"), minute % 60).alias("time"), kind.alias("transaction_type"), amount.alias("amount"),
        F.when(kind == "Income", "").otherwise(own).alias("account_from"), F.when(kind == "Expense", "").when(kind == "Income", own).otherwise(peer).alias("account_to"),
        words.alias("description"), category.alias("category"), F.when(k % 9 == 0, "Family").otherwise("Self").alias("for_with_whom"), context.alias("money_context"),
        pick("o_orderstatus", {"F": "Confirmed", "O": "Auto-classified"}, "Provisional Neutral").alias("status"),
        F.when((k % 3 == 0) & (kind == "Expense"), (amount / 2).cast(MONEY)).when(kind == "Expense", amount).otherwise(F.lit(0).cast(MONEY)).alias("budget_effect"),
        (k % 41 == 0).alias("exclude_from_budget"), F.when(k % 3 == 0, "legacy").otherwise("derived").alias("budget_rule_version"),
        F.concat(F.lit("import:"), k.cast("string"), F.lit(":bca:"), (k % 5000).cast("string")).alias("source_refs"), (k % 50 == 0).alias("is_deleted"),
        F.when(k % 97 == 0, k + 1).alias("reversal_of_id"), (date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute)).alias("created_at"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    row = lambda kind, n, date, part: F.struct((k * 3 + n).alias("id"), F.lit(date).cast("date").alias("snapshot_date"), F.lit(f"{date} 00:00:00").cast("timestamp_ntz").alias("created_at"), (F.col("c_acctbal") * part).cast(MONEY).alias("balance"), F.lit(kind).alias("snapshot_kind"))
    rows = F.filter(F.array(F.when(k % 11 != 0, row("initial_anchor", 0, "1996-01-01", 1.0)), F.when((k % 3 == 0) & (k % 11 != 0), row("manual_anchor", 1, "1998-03-01", 2.0)), F.when((k % 7 == 0), row("legacy", 2, "1997-02-01", 3.0))), lambda r: r.isNotNull())
    return read(spark, sf_dir, "customer").select(F.col("c_name").alias("account_name"), F.explode(rows).alias("r")).select("account_name", "r.*")


def upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").cast(MONEY).alias("amount"), pick("p_type", UPCOMING, "Upcoming").alias("status"),
        (F.col("p_size") % 2).cast("int").alias("reserve_now"), F.date_add(F.lit(AS_OF).cast("date"), (k % 365 - 30).cast("int")).alias("due_date"),
        F.when(k % 5 == 0, k % 10).alias("debt_id"), F.when(k % 4 == 0, (F.col("p_size") % 25).cast("long")).alias("linked_goal_id"))


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(
        k.cast("long").alias("id"), F.col("n_name").alias("name"), pick((F.col("n_regionkey") % 3).cast("string"), {"0": "Emergency", "1": "Goal"}, "General").alias("kind"),
        ((k + 1) * 1000).cast(MONEY).alias("target_amount"), (k * 130 + 5).cast(MONEY).alias("allocated_amount"), F.when(k % 2 == 0, "Active").otherwise("Completed").alias("status"),
        (k % 4 + 1).cast("int").alias("priority"), F.add_months(F.lit("1999-12-01").cast("date"), k.cast("int")).alias("target_date"))


def allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").filter(k % 6 == 1).select(
        k.alias("id"), F.col("p_name").alias("title"), (F.col("p_retailprice").cast(MONEY) * (k % 4)).cast(MONEY).alias("amount"),
        pick((k % 3).cast("string"), {"0": "Active", "1": "Active"}, "Spent").alias("status"), k.alias("covers_upcoming_id"))


def debts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("person_name"), pick((k % 3).cast("string"), {"0": "Custody", "1": "Receivable"}, "Payable").alias("kind"))


def debt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("debt_id"), F.col("l_orderkey").alias("transaction_id"), F.col("l_linenumber").cast("int").alias("line"),
        F.when(flag == "R", F.when(F.col("l_linenumber") == 7, "WriteOff").otherwise("Settle")).otherwise("Opening").alias("event_type"),
        F.when(flag == "R", -1).otherwise(1).alias("effect"), F.col("l_extendedprice").cast(MONEY).alias("amount"), F.col("l_shipdate").cast("date").alias("event_date"))


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each month and category with orders; the fixed amount grows with the category's length."""
    rows = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), pick("o_orderpriority", CATEGORY, "Other / Miscellaneous").alias("category")).distinct()
    return rows.withColumn("current_budget", (F.length("category") * 1_000_000).cast(MONEY)).withColumn("active", F.substring("month", 6, 2).cast("int") % 5 != 0)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        k.alias("id"), F.col("event_type").alias("source"), (k % 4000).cast("string").alias("external_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("ts").cast("date").alias("date"),
        F.col("user_id"), F.col("value").cast(MONEY).alias("amount"), F.concat(F.col("event_type"), F.lit(" shop "), (F.col("user_id") % 40).cast("string")).alias("merchant"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def _case(column: str, options: dict[str, str], other: str) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in options.items()) + f" ELSE '{other}' END"


_NAME = "'Customer#' || lpad(CAST({} AS VARCHAR), 9, '0')"
_M = "DECIMAL(18,2)"
CTE = {
    "accounts": f"""accounts AS (SELECT c_name AS name, {_case('c_mktsegment', KIND, 'Owned')} AS kind, CASE WHEN c_custkey % 23 <> 0 THEN CAST(c_acctbal AS {_M}) END AS current_balance,
  DATE '1996-01-01' AS balance_date, c_custkey % 13 = 0 AS protected, CASE WHEN c_custkey % 17 = 0 THEN CAST(c_custkey % 50 * 10 AS {_M}) ELSE CAST(0 AS {_M}) END AS protected_amount, c_custkey % 20 <> 0 AS active FROM customer)""",
    "tx": f"""tx AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, strftime(CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)), '%H:%M') AS time,
  kind AS transaction_type, amount, CASE WHEN kind = 'Income' THEN '' ELSE own END AS account_from, CASE WHEN kind = 'Expense' THEN '' WHEN kind = 'Income' THEN own ELSE peer END AS account_to,
  CASE WHEN o_orderkey % 30 = 0 THEN '[Rekonsiliasi] balance check' WHEN o_orderkey % 7 = 0 THEN 'Transfer ke toko kopi TRX#99812' WHEN o_orderkey % 7 = 1 THEN 'Bayar bensin pertamax 22-08-2026'
    WHEN o_orderkey % 7 = 2 THEN 'Bayar obat apotek' WHEN o_orderkey % 7 = 3 THEN 'GRAB ride ref #89281 Rp 50.000' ELSE 'Makan siang nasi padang' END AS description,
  {_case('o_orderpriority', CATEGORY, 'Other / Miscellaneous')} AS category, CASE WHEN o_orderkey % 9 = 0 THEN 'Family' ELSE 'Self' END AS for_with_whom,
  CASE o_orderkey % 16 WHEN 3 THEN 'Pass-through' WHEN 7 THEN 'Historical Research' WHEN 11 THEN 'Third-party' ELSE 'Personal' END AS money_context,
  {_case('o_orderstatus', {'F': 'Confirmed', 'O': 'Auto-classified'}, 'Provisional Neutral')} AS status,
  o_orderkey % 41 = 0 AS exclude_from_budget,
  CASE WHEN o_orderkey % 3 = 0 THEN 'legacy' ELSE 'derived' END AS budget_rule_version, 'import:' || o_orderkey || ':bca:' || (o_orderkey % 5000) AS source_refs, o_orderkey % 50 = 0 AS is_deleted,
  CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey + 1 END AS reversal_of_id, CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS created_at,
  CAST(CASE WHEN kind <> 'Expense' THEN 0 WHEN o_orderkey % 3 = 0 THEN ((CAST(amount * 100 AS BIGINT) + 1) // 2) / 100 ELSE amount END AS {_M}) AS budget_effect
  FROM (SELECT *, CAST(o_totalprice AS {_M}) AS amount, {_NAME.format('o_custkey')} AS own, {_NAME.format('(o_custkey * 7 + 3) % 100')} AS peer,
    CASE WHEN o_orderkey % 10 <= 5 THEN 'Expense' WHEN o_orderkey % 10 <= 7 THEN 'Income' WHEN o_orderkey % 10 = 9 AND o_orderkey % 20 >= 10 THEN 'Adjustment' ELSE 'Transfer' END AS kind FROM orders))""",
    "snaps": f"""snaps AS (SELECT c_name AS account_name, c_custkey * 3 AS id, DATE '1996-01-01' AS snapshot_date, TIMESTAMP '1996-01-01 00:00:00' AS created_at, CAST(c_acctbal AS {_M}) AS balance, 'initial_anchor' AS snapshot_kind FROM customer WHERE c_custkey % 11 <> 0
  UNION ALL SELECT c_name, c_custkey * 3 + 1, DATE '1998-03-01', TIMESTAMP '1998-03-01 00:00:00', CAST(c_acctbal * 2.0 AS {_M}), 'manual_anchor' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 11 <> 0
  UNION ALL SELECT c_name, c_custkey * 3 + 2, DATE '1997-02-01', TIMESTAMP '1997-02-01 00:00:00', CAST(c_acctbal * 3.0 AS {_M}), 'legacy' FROM customer WHERE c_custkey % 7 = 0)""",
    "upcoming": f"""upcoming AS (SELECT p_partkey AS id, p_name AS title, CAST(p_retailprice AS {_M}) AS amount, {_case('p_type', UPCOMING, 'Upcoming')} AS status, p_size % 2 AS reserve_now,
  DATE '{AS_OF}' + CAST(p_partkey % 365 - 30 AS INTEGER) AS due_date, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 10 END AS debt_id, CASE WHEN p_partkey % 4 = 0 THEN p_size % 25 END AS linked_goal_id FROM part)""",
    "goals": f"""goals AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, {_case('CAST(n_regionkey % 3 AS VARCHAR)', {'0': 'Emergency', '1': 'Goal'}, 'General')} AS kind, CAST((n_nationkey + 1) * 1000 AS {_M}) AS target_amount,
  CAST(n_nationkey * 130 + 5 AS {_M}) AS allocated_amount, CASE WHEN n_nationkey % 2 = 0 THEN 'Active' ELSE 'Completed' END AS status, n_nationkey % 4 + 1 AS priority, CAST(DATE '1999-12-01' + to_months(CAST(n_nationkey AS INTEGER)) AS DATE) AS target_date FROM nation)""",
    "allocs": f"""allocs AS (SELECT p_partkey AS id, p_name AS title, CAST(CAST(p_retailprice AS {_M}) * (p_partkey % 4) AS {_M}) AS amount,
  CASE WHEN p_partkey % 3 < 2 THEN 'Active' ELSE 'Spent' END AS status, p_partkey AS covers_upcoming_id FROM part WHERE p_partkey % 6 = 1)""",
    "debts": f"""debts AS (SELECT s_suppkey AS id, s_name AS person_name, {_case('CAST(s_suppkey % 3 AS VARCHAR)', {'0': 'Custody', '1': 'Receivable'}, 'Payable')} AS kind FROM supplier)""",
    "devents": f"""devents AS (SELECT l_suppkey AS debt_id, l_orderkey AS transaction_id, CAST(l_linenumber AS INTEGER) AS line, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber = 7 THEN 'WriteOff' ELSE 'Settle' END ELSE 'Opening' END AS event_type,
  CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS effect, CAST(l_extendedprice AS {_M}) AS amount, CAST(l_shipdate AS DATE) AS event_date FROM lineitem)""",
    "budgets": f"""budgets AS (SELECT *, CAST(length(category) * 1000000 AS {_M}) AS current_budget, CAST(substr(month, 6, 2) AS INTEGER) % 5 <> 0 AS active FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, {_case('o_orderpriority', CATEGORY, 'Other / Miscellaneous')} AS category FROM orders))""",
    "raws": f"""raws AS (SELECT event_id AS id, event_type AS source, CAST(event_id % 4000 AS VARCHAR) AS external_id, CAST(ts AS TIMESTAMP) AS ts, CAST(ts AS DATE) AS date, user_id, CAST(value AS {_M}) AS amount,
  event_type || ' shop ' || (user_id % 40) AS merchant, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
}


def with_tables(*names: str, body: str) -> str:
    """Oracle SQL: the named tables as common table expressions, then the query."""
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n" + body
