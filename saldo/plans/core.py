"""Queries on cohorts, balances, debts and commitments."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.operators import ledger as L
from saldo.operators import obligations as O
from saldo.operators import reconcile as K
from saldo.plans.registry import query
from saldo.sources.ledger import AS_OF, MONTH, account_name, accounts, allocations, budgets, debt_events, debts, goals, raw_events, snapshots, transactions, upcoming, with_tables

POSTED = "status IN ('Confirmed', 'Auto-classified')"
NOT_REC = "NOT starts_with(lower(description), '[rekonsiliasi]')"
D = lambda x: f"CAST({x} AS DOUBLE)"


def _personal(kind):
    return f"transaction_type = '{kind}' AND money_context = 'Personal' AND {POSTED} AND NOT is_deleted AND {NOT_REC}"


SPEND = f"CASE WHEN budget_rule_version = 'legacy' THEN budget_effect WHEN transaction_type = 'Expense' AND money_context = 'Personal' AND {POSTED} AND NOT is_deleted AND NOT exclude_from_budget THEN amount ELSE 0 END"
REPORT = f"NOT is_deleted AND NOT starts_with(status, 'Provisional') AND money_context = 'Personal' AND {NOT_REC}"
PENDING = "NOT is_deleted AND starts_with(status, 'Provisional') AND (transaction_type = 'Expense' OR (transaction_type = '' AND amount > 0))"
POSTINGS = """postings AS (SELECT id, date, created_at, transaction_type, amount, account_from AS account, -amount AS delta, 'out' AS side FROM tx WHERE NOT is_deleted AND account_from <> ''
  UNION ALL SELECT id, date, created_at, transaction_type, amount, account_to, amount, 'in' FROM tx WHERE NOT is_deleted AND account_to <> '')"""
ANCHOR = """anchor AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_name ORDER BY CASE WHEN snapshot_kind IN ('initial_anchor', 'manual_anchor', 'reconciliation') THEN 0 ELSE 1 END,
  CASE WHEN snapshot_kind IN ('initial_anchor', 'manual_anchor', 'reconciliation') THEN -id ELSE id END) AS rn FROM snaps {where}) WHERE rn = 1)"""


def _with(names, extra, body):
    return with_tables(*names, body="").rstrip() + ",\n" + ",\n".join(extra) + "\n" + body


@query(with_tables("tx", body=f"""SELECT id, date, time, transaction_type, CAST(amount AS DOUBLE) AS amount, description, status FROM tx
WHERE NOT is_deleted AND contains(lower(description || ' ' || account_from || ' ' || account_to || ' ' || category || ' ' || for_with_whom), 'padang') AND date BETWEEN DATE '{MONTH}-01' AND DATE '1999-06-30' ORDER BY date DESC, time DESC, id DESC LIMIT 5000"""))
def tx_search(spark, d):
    return L.search(transactions(spark, d), "PADANG", MONTH).select("id", "date", "time", "transaction_type", F.col("amount").cast("double").alias("amount"), "description", "status")


@query(with_tables("tx", body=f"SELECT account_from AS account, CAST(count(*) AS BIGINT) AS n, {D('sum(amount)')} AS spent FROM tx WHERE {_personal('Expense')} GROUP BY account_from"))
def personal_expense_cohort(spark, d):
    return transactions(spark, d).filter(L.personal("Expense")).groupBy(F.col("account_from").alias("account")).agg(F.count("*").alias("n"), L.total("amount").alias("spent"))


@query(with_tables("tx", body=f"SELECT account_to AS account, CAST(count(*) AS BIGINT) AS n, {D('sum(amount)')} AS earned FROM tx WHERE {_personal('Income')} GROUP BY account_to"))
def personal_income_cohort(spark, d):
    return transactions(spark, d).filter(L.personal("Income")).groupBy(F.col("account_to").alias("account")).agg(F.count("*").alias("n"), L.total("amount").alias("earned"))


@query(with_tables("tx", body=f"SELECT strftime(date, '%Y-%m') AS month, {D(f'sum({SPEND})')} AS spent, {D('sum(budget_effect)')} AS stored FROM tx WHERE {_personal('Expense')} GROUP BY 1"))
def budget_effect_by_month(spark, d):
    return transactions(spark, d).filter(L.personal("Expense")).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(L.total(L.budget_spend()).alias("spent"), L.total("budget_effect").alias("stored"))


@query(with_tables("tx", body="""SELECT category, CAST(count(*) AS BIGINT) AS n, CAST(sum(amount - budget_effect) AS DOUBLE) AS gap FROM tx
WHERE budget_rule_version = 'legacy' AND transaction_type = 'Expense' AND money_context = 'Personal' AND abs(budget_effect - amount) > 0.005 AND NOT is_deleted GROUP BY category"""))
def rule_discrepancies(spark, d):
    return L.live(transactions(spark, d)).filter(L.rule_gap()).groupBy("category").agg(F.count("*").alias("n"), L.total(F.col("amount") - F.col("budget_effect")).alias("gap"))


@query(_with(["tx"], [POSTINGS], f"SELECT account, side, CAST(count(*) AS BIGINT) AS n, {D('sum(delta)')} AS moved FROM postings GROUP BY account, side"))
def account_postings(spark, d):
    return L.postings(L.live(transactions(spark, d))).groupBy("account", "side").agg(F.count("*").alias("n"), L.total("delta").alias("moved"))


@query(_with(["snaps"], [ANCHOR.format(where="")], "SELECT account_name, id, snapshot_kind, CAST(balance AS DOUBLE) AS balance FROM anchor"))
def anchor_pick(spark, d):
    return L.anchors(snapshots(spark, d)).select("account_name", "id", "snapshot_kind", F.col("balance").cast("double").alias("balance"))


def _book(as_of: str | None, ledger: bool) -> list[str]:
    bound = f"WHERE snapshot_date <= DATE '{as_of}'" if as_of else ""
    late = f"AND p.date <= DATE '{as_of}'" if as_of else ""
    after = "(p.date > a.snapshot_date OR (p.date = a.snapshot_date AND p.created_at > a.created_at))"
    return [POSTINGS, ANCHOR.format(where=bound), f"""sums AS (SELECT p.account, sum(CASE WHEN {after} THEN delta END) AS moved, sum(CASE WHEN {after} AND delta > 0 THEN delta END) AS inflow, sum(CASE WHEN {after} AND delta < 0 THEN -delta END) AS outflow,
  sum(CASE WHEN p.date = a.snapshot_date AND p.created_at = a.created_at THEN 1 ELSE 0 END) AS collisions FROM postings p JOIN anchor a ON p.account = a.account_name {late} GROUP BY p.account)""",
            f"""book AS (SELECT c.name AS account, c.kind, c.active, c.current_balance, a.snapshot_kind, coalesce(s.inflow, 0) AS inflow, coalesce(s.outflow, 0) AS outflow, coalesce(s.collisions, 0) AS collisions,
  CASE WHEN a.balance IS NOT NULL {'AND coalesce(s.collisions, 0) = 0' if ledger else ''} THEN a.balance + coalesce(s.moved, 0) END AS expected FROM accounts c LEFT JOIN anchor a ON c.name = a.account_name LEFT JOIN sums s ON s.account = c.name)"""]


ACCOUNT_BOOK = _book(None, True)
BOOK_OUT = f"SELECT account, kind, snapshot_kind, {D('inflow')} AS inflow, {D('outflow')} AS outflow, CAST(collisions AS BIGINT) AS collisions, {D('expected')} AS expected, {D('expected - current_balance')} AS difference, CASE WHEN expected IS NULL THEN 'unverifiable' ELSE 'ok' END AS status FROM book"


def _book_out(df):
    d = lambda c: F.col(c).cast("double").alias(c)
    return df.select("account", "kind", "snapshot_kind", d("inflow"), d("outflow"), "collisions", d("expected"), d("difference"), "status")


@query(_with(["accounts", "tx", "snaps"], _book(None, True), BOOK_OUT))
def balance_reconstruct(spark, d):
    return _book_out(L.reconstruct(accounts(spark, d), transactions(spark, d), snapshots(spark, d)))


@query(_with(["accounts", "tx", "snaps"], _book("1998-12-31", False), BOOK_OUT))
def balance_reconstruct_shadow(spark, d):
    return _book_out(L.reconstruct(accounts(spark, d), transactions(spark, d), snapshots(spark, d), "1998-12-31", "shadow"))


@query(_with(["accounts", "tx", "snaps"], _book(None, True), f"""SELECT account, CASE WHEN expected IS NULL THEN 'unverifiable' ELSE 'discrepancy' END AS issue, {D('expected - current_balance')} AS difference FROM book
WHERE active AND current_balance IS NOT NULL AND (expected IS NULL OR abs(expected - current_balance) >= 0.005)"""))
def balance_verify(spark, d):
    return L.verify(L.reconstruct(accounts(spark, d), transactions(spark, d), snapshots(spark, d))).select("account", "issue", F.col("difference").cast("double").alias("difference"))


@query(_with(["accounts", "tx", "snaps"], _book(None, True), f"""SELECT account, CASE WHEN expected IS NULL THEN 'anchor_established' WHEN abs(actual - expected) >= 0.005 THEN 'ledger_adjusted' WHEN current_balance IS NULL OR abs(actual - current_balance) >= 0.005 THEN 'cache_repaired' ELSE 'confirmed_in_sync' END AS action,
{D('CASE WHEN abs(actual - expected) >= 0.005 THEN actual - expected ELSE 0 END')} AS adjustment
FROM (SELECT *, CASE WHEN CAST(right(account, 2) AS INTEGER) % 3 = 0 THEN expected WHEN CAST(right(account, 2) AS INTEGER) % 3 = 1 THEN current_balance ELSE 1000 END AS actual FROM book) WHERE actual IS NOT NULL"""))
def reconcile_actions(spark, d):
    third = F.substring("account", -2, 2).cast("int") % 3
    df = L.reconstruct(accounts(spark, d), transactions(spark, d), snapshots(spark, d))
    df = df.withColumn("actual", F.when(third == 0, F.col("expected")).when(third == 1, F.col("current_balance")).otherwise(F.lit(1000).cast("decimal(18,2)"))).filter("actual is not null")
    gap = F.col("actual") - F.col("expected")
    return df.select("account", L.reconcile_action(F.col("actual"), F.col("expected"), F.col("current_balance")).alias("action"), F.when(F.abs(gap) >= 0.005, gap).otherwise(F.lit(0)).cast("double").alias("adjustment"))


#: An observed balance for each event: of its user's account what the book or the cache says, an amount of its own, or none.
CHAIN = [*_book(None, True), """req AS (SELECT id AS request_no, account, force, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN e WHEN k % 3 = 1 THEN c ELSE amount END AS actual FROM (
  SELECT r.id, r.k, r.amount, 'Customer#' || lpad(CAST(r.user_id * 11 % 190 AS VARCHAR), 9, '0') AS account, r.id % 5 = 0 AS force FROM raws r) q LEFT JOIN (SELECT account AS a, expected AS e, current_balance AS c FROM book) b ON b.a = q.account)""",
    "numbered AS (SELECT req.*, b.account IS NOT NULL AS known, b.expected, b.current_balance, row_number() OVER (PARTITION BY req.account ORDER BY request_no) AS n FROM req LEFT JOIN book b ON b.account = req.account)",
    """f AS (SELECT account, CAST(0 AS BIGINT) AS n, min(expected) AS e, min(current_balance) AS c, CAST(NULL AS BIGINT) AS request_no, CAST(NULL AS DECIMAL(18,2)) AS actual, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS DECIMAL(38,2)) AS expected, CAST(NULL AS DECIMAL(18,2)) AS cached FROM numbered GROUP BY account
  UNION ALL SELECT account, n, CASE WHEN action IN ('unknown_account', 'invalid', 'refused') THEN e ELSE actual END, CASE WHEN action IN ('unknown_account', 'invalid', 'refused') THEN c ELSE actual END, request_no, actual, action, e, c FROM (
    SELECT x.account, x.n, x.request_no, x.actual, f.e, f.c, CASE WHEN NOT x.known THEN 'unknown_account' WHEN x.actual IS NULL THEN 'invalid' WHEN f.e IS NULL AND NOT x.force THEN 'refused' WHEN f.e IS NULL THEN 'anchor_established'
      WHEN abs(x.actual - f.e) >= 0.005 THEN 'ledger_adjusted' WHEN f.c IS NULL OR abs(x.actual - f.c) >= 0.005 THEN 'cache_repaired' ELSE 'confirmed_in_sync' END AS action FROM f JOIN numbered x ON x.account = f.account AND x.n = f.n + 1))""",
    "chain AS (SELECT *, action NOT IN ('unknown_account', 'invalid', 'refused') AS taken FROM f WHERE n > 0)"]


def _chain_sql(body):
    return _with(["accounts", "tx", "snaps", "raws"], CHAIN, body).replace("WITH ", "WITH RECURSIVE ", 1)


def _chain(spark, d):
    book = L.reconstruct(accounts(spark, d), transactions(spark, d), snapshots(spark, d)).select("account", "expected", "current_balance", "status")
    own = raw_events(spark, d).select(F.col("id").alias("request_no"), account_name(F.col("user_id") * 11 % 190).alias("account"), (F.col("id") % 5 == 0).alias("force"), "k", "amount")
    told = F.when(F.col("k") % 7 == 0, None).when(F.col("k") % 3 == 0, F.col("expected")).when(F.col("k") % 3 == 1, F.col("current_balance")).otherwise(F.col("amount"))
    return K.reconcile_chain(own.join(book.drop("status"), "account", "left").select("request_no", "account", told.alias("actual"), "force"), book)


@query(_chain_sql(f"SELECT request_no, account, action, {D('expected')} AS expected, {D('CASE WHEN taken THEN coalesce(actual - expected, 0) END')} AS difference FROM chain"))
def reconcile_chain(spark, d):
    return _chain(spark, d).select("request_no", "account", "action", F.col("expected").cast("double").alias("expected"), F.col("difference").cast("double").alias("difference"))


@query(_chain_sql(f"""SELECT 'transaction' AS row_kind, request_no, CASE WHEN actual > expected THEN '' ELSE account END AS source, CASE WHEN actual > expected THEN account ELSE '' END AS target, {D('abs(actual - expected)')} AS amount, 'Adjustment' AS label FROM chain WHERE action = 'ledger_adjusted'
UNION ALL SELECT 'snapshot', request_no, account, '', {D('actual')}, CASE action WHEN 'anchor_established' THEN 'manual_anchor' ELSE 'reconciliation' END FROM chain WHERE action IN ('anchor_established', 'ledger_adjusted', 'cache_repaired')
UNION ALL SELECT 'audit', request_no, account, '', {D('coalesce(expected, actual)')}, CAST(DATE '{AS_OF}' AS VARCHAR) FROM chain WHERE taken"""))
def reconcile_rows(spark, d):
    c, text = _chain(spark, d), lambda x: F.lit(x)
    tx = K.adjustments(c, AS_OF).select(text("transaction").alias("row_kind"), "request_no", F.col("account_from").alias("source"), F.col("account_to").alias("target"), F.col("amount").cast("double").alias("amount"), F.col("transaction_type").alias("label"))
    snap = K.anchors_set(c, AS_OF).select(text("snapshot").alias("row_kind"), "request_no", F.col("account_name").alias("source"), text("").alias("target"), F.col("balance").cast("double").alias("amount"), F.col("snapshot_kind").alias("label"))
    audit = K.audit_rows(c, AS_OF).select(text("audit").alias("row_kind"), "request_no", F.col("account_name").alias("source"), text("").alias("target"), F.col("book_balance").cast("double").alias("amount"), F.col("date_created").cast("string").alias("label"))
    return tx.unionByName(snap).unionByName(audit)


@query(_chain_sql(f"""SELECT a.name, {D('coalesce(l.actual, a.current_balance)')} AS balance, CASE WHEN l.anchored THEN DATE '{AS_OF}' ELSE a.balance_date END AS balance_date, CASE WHEN l.account IS NOT NULL THEN DATE '{AS_OF}' END AS last_reconciled_at
FROM accounts a LEFT JOIN (SELECT account, arg_max(actual, request_no) AS actual, bool_or(action = 'anchor_established') AS anchored FROM chain WHERE taken GROUP BY account) l ON l.account = a.name"""))
def reconciled_accounts(spark, d):
    return K.accounts_after(accounts(spark, d), _chain(spark, d), AS_OF).select("name", F.col("current_balance").cast("double").alias("balance"), "balance_date", "last_reconciled_at")


OUT = "outs AS (SELECT debt_id, sum(effect * amount) AS outstanding, max(CASE WHEN event_type = 'WriteOff' THEN 1 ELSE 0 END) AS written_off FROM devents GROUP BY debt_id)"
DS = """ds AS (SELECT d.id, d.person_name, d.kind, coalesce(o.outstanding, 0) AS outstanding, CASE WHEN coalesce(o.outstanding, 0) < -0.005 THEN 'Invalid' WHEN abs(coalesce(o.outstanding, 0)) <= 0.005 THEN CASE WHEN coalesce(written_off, 0) = 1 THEN 'WrittenOff' ELSE 'Settled' END ELSE 'Active' END AS status FROM debts d LEFT JOIN outs o ON o.debt_id = d.id)"""


def _debts(spark, d):
    return O.debt_status(debts(spark, d), debt_events(spark, d))


@query(_with(["devents"], [OUT], f"SELECT debt_id, {D('outstanding')} AS outstanding FROM outs"))
def debt_outstanding(spark, d):
    return O.outstanding(debt_events(spark, d)).select("debt_id", F.col("outstanding").cast("double").alias("outstanding"))


@query(_with(["debts", "devents"], [OUT, DS], f"SELECT id, person_name, kind, {D('outstanding')} AS outstanding, status FROM ds"))
def debt_status(spark, d):
    return _debts(spark, d).select("id", "person_name", "kind", F.col("outstanding").cast("double").alias("outstanding"), "status")


@query(_with(["debts", "devents"], [OUT, DS], f"SELECT kind, CAST(count(*) AS BIGINT) AS n, {D('greatest(0, sum(outstanding))')} AS total_then_clamp, {D('sum(greatest(0, outstanding))')} AS clamp_then_total FROM ds WHERE status IN ('Active', 'Invalid') GROUP BY kind"))
def debt_totals_by_kind(spark, d):
    o = F.col("outstanding")
    return _debts(spark, d).filter("status in ('Active', 'Invalid')").groupBy("kind").agg(F.count("*").alias("n"), F.greatest(F.lit(0), F.sum(o)).cast("double").alias("total_then_clamp"), F.sum(F.greatest(F.lit(0), o)).cast("double").alias("clamp_then_total"))


@query(with_tables("devents", body="""SELECT debt_id, event_date, transaction_id, line, CAST(amount AS DOUBLE) AS amount, event_type FROM (SELECT *, row_number() OVER (PARTITION BY debt_id ORDER BY event_date DESC, transaction_id DESC, line DESC, amount DESC, event_type DESC) AS rn FROM devents) WHERE rn = 1"""))
def debt_latest_event(spark, d):
    return O.latest_event(debt_events(spark, d)).withColumn("amount", F.col("amount").cast("double"))


COVER = """cover AS (SELECT upcoming_id, sum(amount) AS covered FROM (SELECT covers_upcoming_id AS upcoming_id, amount FROM allocs WHERE status = 'Active'
  UNION ALL SELECT u.id, g.allocated_amount FROM upcoming u JOIN goals g ON g.id = u.linked_goal_id AND g.status = 'Active') GROUP BY upcoming_id)"""
CU = "cu AS (SELECT u.*, coalesce(c.covered, 0) AS covered, greatest(0, u.amount - coalesce(c.covered, 0)) AS effective FROM upcoming u LEFT JOIN cover c ON c.upcoming_id = u.id)"
OPEN = "debt_id IS NULL AND (status IN ('Upcoming', 'Confirmed') OR (status = 'Tentative' AND reserve_now = 1))"


@query(_with(["upcoming", "allocs", "goals"], [COVER, CU], f"SELECT id, status, {D('amount')} AS amount, {D('covered')} AS covered, {D('effective')} AS effective FROM cu"))
def coverage_by_upcoming(spark, d):
    c = O.covered_upcoming(upcoming(spark, d), allocations(spark, d), goals(spark, d))
    return c.select("id", "status", *[F.col(x).cast("double").alias(x) for x in ("amount", "covered", "effective")])


@query(_with(["upcoming", "allocs", "goals"], [COVER, CU], f"SELECT status, CAST(count(*) AS BIGINT) AS n, {D('sum(effective)')} AS effective FROM cu WHERE {OPEN} GROUP BY status"))
def commitment_effective(spark, d):
    return O.effective_commitments(O.covered_upcoming(upcoming(spark, d), allocations(spark, d), goals(spark, d))).groupBy("status").agg(F.count("*").alias("n"), L.total("effective").alias("effective"))


PAY = """pay AS (SELECT ds.id, ds.outstanding, coalesce(c.covered, 0) AS covered, greatest(0, ds.outstanding - coalesce(c.covered, 0)) AS effective FROM ds LEFT JOIN (SELECT u.debt_id, sum(a.amount) AS covered FROM upcoming u JOIN allocs a ON a.covers_upcoming_id = u.id AND a.status = 'Active'
  WHERE u.status = 'Upcoming' AND u.debt_id IS NOT NULL GROUP BY u.debt_id) c ON c.debt_id = ds.id WHERE ds.kind = 'Payable' AND ds.status = 'Active')"""


@query(_with(["debts", "devents", "upcoming", "allocs"], [OUT, DS, PAY], f"SELECT id, {D('outstanding')} AS outstanding, {D('covered')} AS covered, {D('effective')} AS effective FROM pay"))
def payable_effective(spark, d):
    p = O.effective_payables(_debts(spark, d), upcoming(spark, d), allocations(spark, d))
    return p.select("id", *[F.col(x).cast("double").alias(x) for x in ("outstanding", "covered", "effective")])


@query(_with(["debts", "devents", "upcoming"], [OUT, DS], f"SELECT ds.id, {D('s')} AS scheduled, {D('outstanding')} AS outstanding FROM ds JOIN (SELECT debt_id, sum(amount) AS s FROM upcoming WHERE debt_id IS NOT NULL AND status IN ('Upcoming', 'Confirmed') GROUP BY debt_id) u ON u.debt_id = ds.id WHERE s > outstanding + 0.005"))
def overlinked_debts(spark, d):
    return O.linked_payable_excess(upcoming(spark, d), _debts(spark, d)).select("id", F.col("scheduled").cast("double").alias("scheduled"), F.col("outstanding").cast("double").alias("outstanding"))


@query(_with(["debts", "devents", "upcoming"], [OUT, DS], """SELECT ds.id, ds.status, CAST(count(u.id) AS BIGINT) AS n_schedules, coalesce(string_agg(CAST(u.id AS VARCHAR), ',' ORDER BY u.id), '') AS schedules FROM ds LEFT JOIN upcoming u ON u.debt_id = ds.id AND ds.kind = 'Payable' GROUP BY ds.id, ds.status"""))
def debt_list_schedules(spark, d):
    u = upcoming(spark, d).filter("debt_id is not null").groupBy("debt_id").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("s"), F.count("*").alias("n"))
    j = _debts(spark, d).join(u, (F.col("id") == F.col("debt_id")) & (F.col("kind") == "Payable"), "left")
    return j.select("id", "status", F.coalesce("n", F.lit(0)).alias("n_schedules"), F.coalesce("s", F.lit("")).alias("schedules"))


@query(with_tables("goals", body=f"""SELECT kind, CAST(count(*) AS BIGINT) AS n, {D("sum(allocated_amount)")} AS allocated, {D("sum(target_amount)")} AS target FROM goals WHERE status = 'Active' GROUP BY kind"""))
def allocation_summary(spark, d):
    return goals(spark, d).filter("status = 'Active'").groupBy("kind").agg(F.count("*").alias("n"), L.total("allocated_amount").alias("allocated"), L.total("target_amount").alias("target"))


# With the ledger's goals, and as it is where no goal was ever made.
@query(with_tables("goals", "accounts", body=f"""SELECT 'goals' AS basis, *, emergency + goals + general AS total FROM (SELECT {", ".join(f"{D(f"coalesce(sum(allocated_amount) FILTER (status = 'Active' AND kind = '{k}'), 0)")} AS {n}" for k, n in (("Emergency", "emergency"), ("Goal", "goals"), ("General", "general")))} FROM goals)
UNION ALL SELECT 'accounts', p, 0, 0, p FROM (SELECT {D('coalesce(sum(CASE WHEN protected_amount > 0 THEN protected_amount WHEN protected THEN greatest(0, coalesce(current_balance, 0)) ELSE 0 END), 0)')} AS p FROM accounts WHERE active AND kind = 'Owned')"""))
def allocation_breakdown(spark, d):
    g, a = goals(spark, d), accounts(spark, d)
    both = O.allocation_breakdown(g, a).withColumn("basis", F.lit("goals")).unionByName(O.allocation_breakdown(g.filter(F.lit(False)), a).withColumn("basis", F.lit("accounts")))
    return both.select("basis", *[F.col(c).cast("double").alias(c) for c in ("emergency", "goals", "general", "total")])


@query(with_tables("accounts", body=f"""SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(current_balance) AS BIGINT) AS known, {D('CASE WHEN count(*) = count(current_balance) THEN sum(current_balance) END')} AS total,
{D('sum(CASE WHEN protected_amount > 0 THEN protected_amount WHEN protected THEN greatest(0, coalesce(current_balance, 0)) ELSE 0 END)')} AS protected FROM accounts WHERE active AND kind = 'Owned'"""))
def balance_snapshot(spark, d):
    guard = F.when(F.col("protected_amount") > 0, F.col("protected_amount")).when(F.col("protected"), F.greatest(F.lit(0), F.coalesce("current_balance", F.lit(0)))).otherwise(F.lit(0))
    return accounts(spark, d).filter("active and kind = 'Owned'").agg(F.count("*").alias("n"), F.count("current_balance").alias("known"), F.when(F.count("*") == F.count("current_balance"), F.sum("current_balance")).cast("double").alias("total"), L.total(guard).alias("protected"))


def _sts(complete_gate: bool):
    ok = "count(*) = count(current_balance)" if complete_gate else "TRUE"
    clamp = "greatest(0, sum(outstanding))" if complete_gate else "sum(greatest(0, outstanding))"
    return _with(["accounts", "tx", "debts", "devents", "upcoming", "allocs", "goals"], [OUT, DS, COVER, CU, PAY,
        f"liq AS (SELECT sum(current_balance) AS total, {ok} AS complete FROM accounts WHERE active AND kind = 'Owned' {'AND current_balance IS NOT NULL' if complete_gate else ''})",
        "al AS (SELECT coalesce(sum(allocated_amount), 0) AS allocated FROM goals WHERE status = 'Active')", f"cu2 AS (SELECT coalesce({clamp}, 0) AS custody FROM ds WHERE kind = 'Custody' AND status = 'Active')",
        f"com AS (SELECT coalesce((SELECT sum(effective) FROM pay), 0) + coalesce((SELECT sum(effective) FROM cu WHERE {OPEN}), 0) AS commitments)", f"pen AS (SELECT coalesce(sum(amount), 0) AS pending FROM tx WHERE {PENDING})"],
        f"""SELECT {D('total')} AS total, {D('allocated')} AS allocated, {D('custody')} AS custody, {D('commitments')} AS commitments, {D('pending')} AS pending, {D('CASE WHEN complete THEN total - allocated - greatest(0, custody) - commitments - pending END')} AS safe_to_spend,
CASE WHEN NOT complete THEN NULL WHEN total - allocated - greatest(0, custody) - commitments - pending < 0 THEN 'Defisit' ELSE 'Terkendali' END AS state FROM liq, al, cu2, com, pen""")


def _safe(spark, d, ledger: bool):
    o = F.col("outstanding")
    own = accounts(spark, d).filter("active and kind = 'Owned'" + (" and current_balance is not null" if ledger else ""))
    liquid = own.agg(F.sum("current_balance").alias("total"), (F.count("*") == F.count("current_balance") if ledger else F.lit(True)).alias("complete"))
    allocated = goals(spark, d).filter("status = 'Active'").agg(F.coalesce(F.sum("allocated_amount"), F.lit(0)).alias("allocated"))
    ds = _debts(spark, d)
    clamp = F.greatest(F.lit(0), F.sum(o)) if ledger else F.sum(F.greatest(F.lit(0), o))
    custody = ds.filter("kind = 'Custody' and status = 'Active'").agg(F.coalesce(clamp, F.lit(0)).alias("custody"))
    u, a, g = upcoming(spark, d), allocations(spark, d), goals(spark, d)
    parts = O.effective_payables(ds, u, a).select("effective").unionByName(O.effective_commitments(O.covered_upcoming(u, a, g)).select("effective"))
    commitments = parts.agg(F.coalesce(F.sum("effective"), F.lit(0)).alias("commitments"))
    pend = transactions(spark, d).filter(L.pending()).agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("pending"))
    out = O.safe_to_spend(liquid, allocated, custody, commitments, pend)
    return out.select(*[F.col(c).cast("double").alias(c) for c in ("total", "allocated", "custody", "commitments", "pending", "safe_to_spend")], "state")


@query(_sts(True))
def safe_to_spend_ledger(spark, d):
    return _safe(spark, d, True)


@query(_sts(False))
def safe_to_spend_shadow(spark, d):
    return _safe(spark, d, False)


@query(with_tables("tx", "accounts", body=f"""SELECT {D('coalesce(sum(CASE WHEN o2 IS NOT NULL AND o1 IS NULL THEN amount WHEN o1 IS NOT NULL AND o2 IS NULL THEN -amount ELSE 0 END), 0)')} AS net, CAST(count(*) AS BIGINT) AS n
FROM (SELECT t.amount, a.name AS o1, b.name AS o2 FROM tx t LEFT JOIN accounts a ON a.name = t.account_from AND a.kind = 'Owned' LEFT JOIN accounts b ON b.name = t.account_to AND b.kind = 'Owned' WHERE t.money_context = 'Pass-through')"""))
def pass_through_net(spark, d):
    own = accounts(spark, d).filter("kind = 'Owned'").select("name")
    t = transactions(spark, d).filter("money_context = 'Pass-through'").join(own.select(F.col("name").alias("src")), F.col("account_from") == F.col("src"), "left").join(own.select(F.col("name").alias("dst")), F.col("account_to") == F.col("dst"), "left")
    net = F.when(F.col("dst").isNotNull() & F.col("src").isNull(), F.col("amount")).when(F.col("src").isNotNull() & F.col("dst").isNull(), -F.col("amount")).otherwise(F.lit(0))
    return t.agg(L.total(net).alias("net"), F.count("*").alias("n"))


@query(with_tables("tx", body=f"SELECT CAST(count(*) AS BIGINT) AS n, {D('coalesce(sum(amount), 0)')} AS pending FROM tx WHERE {PENDING}"))
def pending_expense(spark, d):
    return transactions(spark, d).filter(L.pending()).agg(F.count("*").alias("n"), L.total("amount").alias("pending"))


@query(with_tables("upcoming", body=f"SELECT CAST(count(*) AS BIGINT) AS n, {D('coalesce(sum(amount), 0)')} AS due, CAST(coalesce(sum(CASE WHEN due_date < DATE '{AS_OF}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS overdue FROM upcoming WHERE status IN ('Upcoming', 'Confirmed') AND due_date <= DATE '{AS_OF}' + 7"))
def upcoming_7d(spark, d):
    day = F.lit(AS_OF).cast("date")
    return upcoming(spark, d).filter(F.col("status").isin("Upcoming", "Confirmed") & (F.col("due_date") <= F.date_add(day, 7))).agg(F.count("*").alias("n"), L.total("amount").alias("due"), F.coalesce(F.sum((F.col("due_date") < day).cast("int")), F.lit(0)).alias("overdue"))


@query(with_tables("tx", "budgets", body="SELECT DISTINCT month FROM (SELECT strftime(date, '%Y-%m') AS month FROM tx WHERE NOT is_deleted UNION SELECT month FROM budgets UNION SELECT '1999-06' UNION SELECT '1999-07')"))
def available_months(spark, d):
    own = L.live(transactions(spark, d)).select(F.date_format("date", "yyyy-MM").alias("month")).union(budgets(spark, d).select("month"))
    day = F.lit(AS_OF).cast("date")
    now = spark.range(1).select(F.explode(F.array(F.date_format(day, "yyyy-MM"), F.date_format(F.add_months(day, 1), "yyyy-MM"))).alias("month"))
    return own.union(now).distinct()
