"""Queries on mutations and validation: requests are made from the tables, outcomes are rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.operators import books as B
from saldo.operators import commands as C
from saldo.operators import ledger as L
from saldo.operators import obligations as O
from saldo.operators import reversals as V
from saldo.plans.core import OUT, D, _with
from saldo.plans.registry import query
from saldo.sources.ledger import accounts, allocations, budgets, debt_events, debts, goals, raw_events, transactions, upcoming, with_tables


@query(with_tables("tx", body="""SELECT id, CASE WHEN t NOT IN ('Income', 'Expense', 'Transfer') THEN 'type' WHEN a = 0 THEN 'amount' WHEN money_context NOT IN ('Personal', 'Pass-through', 'Third-party') THEN 'context'
WHEN t = 'Expense' AND account_from = '' THEN 'from' WHEN t = 'Income' AND account_to = '' THEN 'to' WHEN t = 'Transfer' AND (account_from = '' OR account_to = '') THEN 'both' WHEN t = 'Transfer' AND account_from = account_to THEN 'same'
WHEN budget_rule_version = 'derived' AND exclude_from_budget THEN 'reason' END AS reject_reason FROM (SELECT *, transaction_type AS t, CASE WHEN id % 113 = 0 THEN 0 ELSE amount END AS a FROM tx)"""))
def validation_rejects(spark, d):
    t = transactions(spark, d).withColumn("amount", F.when(F.col("id") % 113 == 0, F.lit(0)).otherwise(F.col("amount"))).withColumn("exclusion_reason", F.lit(""))
    return C.validate(t).select("id", "reject_reason")


#: Two requests for each transaction: an update (10 more; every third 1500 days later, every seventh with its sides swapped), then a delete
#: of the odd ones and a new expense of 25 beside the even ones.
BOOK = ["""req AS (SELECT id * 2 AS request_no, 'update' AS op, id, CASE WHEN id % 3 = 0 THEN date + 1500 ELSE date END AS date, transaction_type, CAST(amount + 10 AS DECIMAL(18,2)) AS amount,
    CASE WHEN id % 7 = 0 THEN account_to ELSE account_from END AS account_from, CASE WHEN id % 7 = 0 THEN account_from ELSE account_to END AS account_to, money_context FROM tx
  UNION ALL SELECT id * 2 + 1, CASE WHEN id % 2 = 1 THEN 'delete' ELSE 'create' END, CASE WHEN id % 2 = 1 THEN id ELSE id + 1000000000 END, date, 'Expense', CAST(25 AS DECIMAL(18,2)), CASE WHEN account_from <> '' THEN account_from ELSE account_to END, '', 'Personal' FROM tx)""",
    """told AS (SELECT r.*, CASE WHEN op = 'delete' THEN NULL WHEN transaction_type NOT IN ('Income', 'Expense', 'Transfer') THEN 'type' WHEN r.amount = 0 THEN 'amount' WHEN money_context NOT IN ('Personal', 'Pass-through', 'Third-party') THEN 'context'
    WHEN transaction_type = 'Expense' AND account_from = '' THEN 'from' WHEN transaction_type = 'Income' AND account_to = '' THEN 'to' WHEN transaction_type = 'Transfer' AND (account_from = '' OR account_to = '') THEN 'both' WHEN transaction_type = 'Transfer' AND account_from = account_to THEN 'same'
    WHEN transaction_type IN ('Expense', 'Transfer') AND f.name IS NULL THEN 'from_missing' WHEN transaction_type IN ('Expense', 'Transfer') AND NOT f.active THEN 'from_inactive'
    WHEN transaction_type = 'Transfer' AND t.name IS NULL THEN 'to_missing' WHEN transaction_type IN ('Income', 'Transfer') AND NOT t.active THEN 'to_inactive' END AS reject_reason
    FROM req r LEFT JOIN accounts f ON f.name = r.account_from LEFT JOIN accounts t ON t.name = r.account_to)""",
    "kept AS (SELECT request_no, op, id, date, transaction_type, amount, account_from, account_to FROM told WHERE reject_reason IS NULL)",
    """chain AS (SELECT k.*, o.date AS o_date, o.transaction_type AS o_type, o.amount AS o_amount, o.account_from AS o_from, o.account_to AS o_to, o.id IS NOT NULL AS there FROM kept k LEFT JOIN (
      SELECT -1 AS request_no, id, date, transaction_type, amount, account_from, account_to FROM tx UNION ALL SELECT request_no, id, date, transaction_type, amount, account_from, account_to FROM kept WHERE op = 'update') o
    ON k.op <> 'create' AND o.id = k.id AND o.request_no < k.request_no QUALIFY row_number() OVER (PARTITION BY k.request_no ORDER BY o.request_no DESC) = 1)""",
    "saved AS (SELECT *, CASE op WHEN 'create' THEN TRUE WHEN 'delete' THEN there ELSE NOT there OR o_type <> transaction_type OR abs(o_amount - amount) >= 0.005 OR o_from <> account_from OR o_to <> account_to END AS changed FROM chain)",
    """moves AS (SELECT request_no, 0 AS step, o_from AS account, o_amount AS delta, CASE WHEN op = 'update' THEN date ELSE o_date END AS date FROM saved WHERE changed AND there AND o_type IN ('Expense', 'Transfer')
  UNION ALL SELECT request_no, 1, o_to, -o_amount, CASE WHEN op = 'update' THEN date ELSE o_date END FROM saved WHERE changed AND there AND o_type IN ('Income', 'Transfer')
  UNION ALL SELECT request_no, 2, account_from, -amount, date FROM saved WHERE changed AND op <> 'delete' AND transaction_type IN ('Expense', 'Transfer')
  UNION ALL SELECT request_no, 3, account_to, amount, date FROM saved WHERE changed AND op <> 'delete' AND transaction_type IN ('Income', 'Transfer'))""",
    """history AS (SELECT m.account, m.request_no, m.step, a.current_balance + sum(m.delta) OVER (PARTITION BY m.account ORDER BY m.request_no, m.step) AS balance, m.date AS snapshot_date
    FROM moves m JOIN accounts a ON a.name = m.account WHERE a.current_balance IS NOT NULL AND a.kind NOT IN ('External', 'Investment') AND m.date >= a.balance_date)"""]


def _book(spark, d):
    t = transactions(spark, d)
    own, k = F.col("account_from"), F.col("id")
    facts = lambda *c: t.select(*c, F.lit("derived").alias("budget_rule_version"), F.lit(False).alias("exclude_from_budget"), F.lit("").alias("exclusion_reason"))
    edits = facts((k * 2).alias("request_no"), F.lit("update").alias("op"), "id", F.when(k % 3 == 0, F.date_add("date", 1500)).otherwise(F.col("date")).alias("date"), "transaction_type", (F.col("amount") + 10).cast("decimal(18,2)").alias("amount"),
                  F.when(k % 7 == 0, F.col("account_to")).otherwise(own).alias("account_from"), F.when(k % 7 == 0, own).otherwise(F.col("account_to")).alias("account_to"), "money_context")
    odd = k % 2 == 1
    more = facts((k * 2 + 1).alias("request_no"), F.when(odd, "delete").otherwise("create").alias("op"), F.when(odd, k).otherwise(k + 1_000_000_000).alias("id"), "date", F.lit("Expense").alias("transaction_type"), F.lit(25).cast("decimal(18,2)").alias("amount"),
                 F.when(own != "", own).otherwise(F.col("account_to")).alias("account_from"), F.lit("").alias("account_to"), F.lit("Personal").alias("money_context"))
    return B.account_rejects(edits.unionByName(more), accounts(spark, d)), t


def _saved(spark, d):
    req, t = _book(spark, d)
    return B.save_transactions(req.filter("reject_reason is null"), t)


@query(_with(["accounts", "tx"], BOOK, f"""SELECT a.name, {D('a.current_balance')} AS before, {D('coalesce(h.balance, a.current_balance)')} AS after FROM accounts a LEFT JOIN (SELECT account, arg_max(balance, request_no * 4 + step) AS balance FROM history GROUP BY account) h ON h.account = a.name"""))
def balance_mutation(spark, d):
    a = accounts(spark, d)
    out = B.balances_after(a, B.balance_history(B.mutations(_saved(spark, d)), a))
    return out.select("name", F.col("current_balance").cast("double").alias("before"), F.col("new_balance").cast("double").alias("after"))


@query(_with(["accounts", "tx"], BOOK, f"SELECT account, request_no, CAST(step AS INTEGER) AS step, {D('balance')} AS balance, snapshot_date FROM history"))
def balance_history(spark, d):
    h = B.balance_history(B.mutations(_saved(spark, d)), accounts(spark, d))
    return h.select("account", "request_no", "step", F.col("balance").cast("double").alias("balance"), "snapshot_date")


@query(_with(["accounts", "tx"], BOOK, f"""SELECT t.request_no, CASE WHEN t.reject_reason IS NOT NULL THEN 'REJECTED' WHEN s.op = 'create' THEN 'CREATE' WHEN NOT s.there THEN NULL WHEN s.op = 'update' THEN 'UPDATE' ELSE 'SOFT_DELETE' END AS action, t.reject_reason,
  coalesce(s.changed, FALSE) AS changed, {D('s.o_amount')} AS old_amount FROM told t LEFT JOIN saved s USING (request_no)"""))
def transaction_audit(spark, d):
    req, _ = _book(spark, d)
    saved = _saved(spark, d).select("request_no", "action", "changed", F.col("old.amount").cast("double").alias("old_amount"))
    told = req.select("request_no", "reject_reason").join(saved, "request_no", "left")
    return told.select("request_no", F.when(F.col("reject_reason").isNotNull(), "REJECTED").otherwise(F.col("action")).alias("action"), "reject_reason", F.coalesce("changed", F.lit(False)).alias("changed"), "old_amount")


@query(with_tables("tx", body=f"""SELECT t.id AS reversal_of_id, CASE transaction_type WHEN 'Expense' THEN 'Income' WHEN 'Income' THEN 'Expense' ELSE 'Transfer' END AS transaction_type, account_to AS account_from, account_from AS account_to, {D('amount')} AS amount
FROM tx t WHERE NOT is_deleted AND reversal_of_id IS NULL AND NOT EXISTS (SELECT 1 FROM tx r WHERE NOT r.is_deleted AND r.reversal_of_id = t.id)"""))
def reversals(spark, d):
    t = transactions(spark, d)
    return C.reversal(t, t).select("reversal_of_id", "transaction_type", "account_from", "account_to", F.col("amount").cast("double").alias("amount"))


@query(with_tables("raws", body="""SELECT id, version, amount FROM (SELECT id, version, amount, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn, deleted FROM (
SELECT id % 3000 AS id, CAST(row_number() OVER (PARTITION BY id % 3000 ORDER BY id) AS INTEGER) AS version, CAST(amount AS DOUBLE) AS amount, k % 5 = 0 AS deleted FROM raws)) WHERE rn = 1 AND NOT deleted"""))
def current_versions(spark, d):
    e = raw_events(spark, d).select((F.col("id") % 3000).alias("id"), F.col("id").alias("request_no"), F.col("amount").cast("double").alias("amount"), (F.col("k") % 5 == 0).alias("is_deleted"))
    first, later = e.filter("request_no < 3000"), e.filter("request_no >= 3000")
    state = C.upsert(first.limit(0).withColumn("version", F.lit(0)), first)
    return C.current(state.unionByName(C.upsert(state, later))).select("id", "version", "amount")


SIGN = "signs(kind, event_type, effect) AS (VALUES " + ", ".join(f"('{k}', '{e}', {s})" for k, e, s, _ in C.SIGNS) + ")"
EVENT_TYPES = ["Increase", "Settlement", "WriteOff"]


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(_with(["debts", "devents", "raws", "upcoming", "allocs"], [OUT, SIGN, """covered AS (SELECT u.debt_id, sum(a.amount) AS covered FROM allocs a JOIN upcoming u ON u.id = a.covers_upcoming_id WHERE a.status = 'Active' AND u.status = 'Upcoming' AND u.debt_id IS NOT NULL GROUP BY u.debt_id)""",
    """req AS (SELECT r.id AS request_no, r.user_id AS debt_id, ['Increase', 'Settlement', 'WriteOff'][r.k % 3 + 1] AS event_type, CAST(r.amount * 100000 AS DECIMAL(18,2)) AS amount, 'op' || (r.id % 700) AS operation_key, row_number() OVER (PARTITION BY r.user_id ORDER BY r.id) AS n FROM raws r)""",
    "j AS (SELECT req.*, d.kind, s.effect, CASE WHEN d.kind = 'Payable' AND req.event_type = 'Settlement' THEN coalesce(c.covered, 0) ELSE 0 END AS guard FROM req LEFT JOIN debts d ON d.id = req.debt_id LEFT JOIN signs s ON s.kind = d.kind AND s.event_type = req.event_type LEFT JOIN covered c ON c.debt_id = req.debt_id)",
    """f AS (SELECT r.debt_id, CAST(0 AS BIGINT) AS n, CAST(coalesce(o.outstanding, 0) AS DECIMAL(28,2)) AS open_, CAST([] AS VARCHAR[]) AS done, CAST(NULL AS BIGINT) AS request_no, CAST(NULL AS VARCHAR) AS outcome FROM (SELECT DISTINCT debt_id FROM req) r LEFT JOIN outs o ON o.debt_id = r.debt_id
  UNION ALL SELECT debt_id, n, CASE WHEN outcome = 'applied' THEN open_ + effect * amount ELSE open_ END, CASE WHEN outcome = 'applied' THEN list_append(done, operation_key) ELSE done END, request_no, outcome FROM (
    SELECT j.*, f.open_, f.done, CASE WHEN kind IS NULL THEN 'unknown_debt' WHEN list_contains(f.done, operation_key) THEN 'replay' WHEN effect IS NULL THEN 'not_allowed' WHEN amount <= 0 THEN 'amount' WHEN effect < 0 AND amount > f.open_ THEN 'exceeds'
      WHEN effect < 0 AND f.open_ - amount < guard THEN 'covered' ELSE 'applied' END AS outcome FROM f JOIN j ON j.debt_id = f.debt_id AND j.n = f.n + 1))"""],
    "SELECT request_no, outcome FROM f WHERE n > 0")))
def debt_commands(spark, d):
    req = raw_events(spark, d).select(F.col("id").alias("request_no"), F.col("user_id").alias("debt_id"), F.element_at(F.array(*map(F.lit, EVENT_TYPES)), (F.col("k") % 3 + 1).cast("int")).alias("event_type"), (F.col("amount") * 100000).cast("decimal(18,2)").alias("amount"), F.concat(F.lit("op"), (F.col("id") % 700).cast("string")).alias("operation_key"))
    ev = debt_events(spark, d)
    due = upcoming(spark, d).filter("status = 'Upcoming' and debt_id is not null").select(F.col("id").alias("covers_upcoming_id"), "debt_id")
    covered = allocations(spark, d).filter("status = 'Active'").join(due, "covers_upcoming_id").groupBy("debt_id").agg(F.sum("amount").alias("covered"))
    return C.debt_commands(req, debts(spark, d), O.outstanding(ev), ev.withColumn("operation_key", F.lit(None).cast("string")), covered).select("request_no", "outcome")


#: Two requests for every debt event, a third of them with a key that events of a debt share; every tenth event is a correction of the one before.
TODAY = "1999-06-15"
DEBT_LOG = ["""log AS (SELECT transaction_id, line, min(debt_id) AS debt_id, max(amount) AS amount, transaction_id * 8 + line AS event_id, CASE WHEN line = 3 THEN transaction_id * 8 + 2 END AS reversal_of_id FROM devents GROUP BY transaction_id, line)""",
    """rq AS (SELECT event_id * 2 + c AS request_no, event_id, CASE WHEN (event_id + c) % 3 = 0 THEN 'k' || debt_id || '-' || (event_id + c) % 40 WHEN (event_id + c) % 3 = 1 THEN 'u' || event_id * 2 + c END AS operation_key, debt_id FROM log, (VALUES (0), (1)) v(c))""",
    """jq AS (SELECT q.*, CASE WHEN l.reversal_of_id IS NOT NULL THEN 'correction' WHEN EXISTS (SELECT 1 FROM log r WHERE r.reversal_of_id = q.event_id) THEN 'reversed' END AS early, row_number() OVER (PARTITION BY q.debt_id ORDER BY request_no) AS n FROM rq q JOIN log l ON l.event_id = q.event_id)""",
    """f AS (SELECT debt_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS gone, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS request_no, CAST(NULL AS VARCHAR) AS outcome FROM (SELECT DISTINCT debt_id FROM jq)
  UNION ALL SELECT debt_id, n, CASE WHEN outcome = 'applied' THEN list_append(gone, event_id) ELSE gone END, CASE WHEN outcome = 'applied' AND operation_key IS NOT NULL THEN list_append(used, operation_key) ELSE used END, request_no, outcome FROM (
    SELECT j.*, f.gone, f.used, CASE WHEN early IS NOT NULL THEN early WHEN list_contains(f.gone, j.event_id) THEN 'reversed' WHEN list_contains(f.used, j.operation_key) THEN 'replay' ELSE 'applied' END AS outcome FROM f JOIN jq j ON j.debt_id = f.debt_id AND j.n = f.n + 1))"""]


def _debt_log(spark, d):
    one = debt_events(spark, d).groupBy("transaction_id", "line").agg(F.min("debt_id").alias("debt_id"), F.max("amount").alias("amount"), F.min("effect").alias("effect"), F.min("event_type").alias("event_type"))
    e = one.withColumn("event_id", F.col("transaction_id") * 8 + F.col("line")).withColumn("operation_key", F.lit(None).cast("string"))
    third = F.col("line") == 3
    e = V.stored(e.withColumn("reversal_of_id", F.when(third, F.col("transaction_id") * 8 + 2)).withColumn("event_type", F.when(third, "Correction").otherwise(F.col("event_type"))))
    n, c = F.col("event_id") + F.col("c"), F.col("event_id") * 2 + F.col("c")
    key = F.when(n % 3 == 0, F.concat(F.lit("k"), F.col("debt_id").cast("string"), F.lit("-"), (n % 40).cast("string"))).when(n % 3 == 1, F.concat(F.lit("u"), c.cast("string")))
    return e, e.select("event_id", "debt_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("c")).select(c.alias("request_no"), "event_id", key.alias("operation_key"))


@query(_recursive(_with(["devents"], DEBT_LOG, "SELECT request_no, outcome FROM f WHERE n > 0")))
def debt_reversals(spark, d):
    e, requests = _debt_log(spark, d)
    return V.reverse_debt_events(requests, e, transactions(spark, d), TODAY)["outcomes"]


@query(_recursive(_with(["devents", "tx"], DEBT_LOG, f"""SELECT f.request_no, l.event_id AS reversal_of_event, CASE WHEN t.transaction_type = 'Income' THEN 'Expense' ELSE 'Income' END AS transaction_type, t.account_to AS account_from, t.account_from AS account_to,
  CASE WHEN t.account_to <> '' THEN t.account_to ELSE t.account_from END AS account, {D("CASE WHEN t.transaction_type = 'Income' THEN -l.amount ELSE l.amount END")} AS delta FROM f JOIN jq j ON j.request_no = f.request_no JOIN log l ON l.event_id = j.event_id JOIN tx t ON t.id = l.transaction_id WHERE f.n > 0 AND f.outcome = 'applied'""")))
def debt_reversal_cash(spark, d):
    e, requests = _debt_log(spark, d)
    cash = V.reverse_debt_events(requests, e, transactions(spark, d), TODAY)["cash"]
    return cash.select("request_no", "reversal_of_event", "transaction_type", "account_from", "account_to", "account", F.col("delta").cast("double").alias("delta"))


@query(with_tables("upcoming", "allocs", "raws", body=f"""SELECT 'transaction' AS part, CAST(count(*) AS BIGINT) AS n, {D('coalesce(sum(amount), 0)')} AS amount FROM ok UNION ALL SELECT 'debt_event', count(*), {D('coalesce(sum(amount), 0)')} FROM ok WHERE debt_id IS NOT NULL
UNION ALL SELECT 'allocation', (SELECT count(*) FROM allocs WHERE status = 'Active' AND covers_upcoming_id IN (SELECT id FROM ok)), 0 UNION ALL SELECT 'reject', (SELECT count(*) FROM req) - (SELECT count(*) FROM ok), 0""").replace("\nSELECT 'transaction'", """,
req AS (SELECT id AS request_no, id % 1500 AS upcoming_id FROM raws),
ok AS (SELECT u.* FROM upcoming u WHERE u.status = 'Upcoming' AND u.id IN (SELECT upcoming_id FROM req))
SELECT 'transaction'""", 1))
def pay_upcoming(spark, d):
    req = raw_events(spark, d).select(F.col("id").alias("request_no"), (F.col("id") % 1500).alias("upcoming_id"), F.lit("BCA Main").alias("account"), "date")
    parts = C.pay_upcoming(req, upcoming(spark, d), allocations(spark, d))
    row = lambda name, df, amount=None: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), L.total(amount if amount is not None else F.lit(0)).alias("amount"))
    return row("transaction", parts["transactions"], F.col("amount")).unionByName(row("debt_event", parts["debt_events"], F.col("amount"))).unionByName(row("allocation", parts["allocations"])).unionByName(row("reject", parts["rejects"]))


#: Requests before this moment are stored ones, a key's first of a scope; the others come in.
STORED = "2024-01-11"


@query(with_tables("raws", body=f"""SELECT id AS request_no, CASE WHEN base IS NULL THEN 'new' WHEN base <> h THEN 'conflict' WHEN old IS NOT NULL AND running THEN 'in_progress' ELSE 'replay' END AS outcome FROM (SELECT id, h, running, old, coalesce(old, CASE WHEN rn > 1 THEN fst END) AS base FROM (
SELECT r.id, r.h, s.h AS old, s.running, row_number() OVER w AS rn, first_value(r.h) OVER w AS fst FROM (SELECT * FROM keyed WHERE NOT stored) r
LEFT JOIN (SELECT source, key, arg_min(h, id) AS h, arg_min(k % 7 = 0, id) AS running FROM keyed WHERE stored GROUP BY source, key) s ON s.source = r.source AND s.key = r.key WINDOW w AS (PARTITION BY r.source, r.key ORDER BY r.id)))""").replace("\nSELECT id AS request_no", f""",
keyed AS (SELECT *, id % 2000 AS key, sha256(CAST(k % 3 AS VARCHAR)) AS h, ts < TIMESTAMP '{STORED} 00:00:00' AS stored FROM raws)
SELECT id AS request_no""", 1))
def idempotency_replay(spark, d):
    body, stored = (F.col("k") % 3).cast("string"), F.col("ts") < F.lit(f"{STORED} 00:00:00").cast("timestamp_ntz")
    e = raw_events(spark, d).withColumn("key", F.col("id") % 2000).withColumnRenamed("source", "scope")
    req = e.filter(~stored).select(F.col("id").alias("request_no"), "scope", "key", body.alias("payload"))
    done = e.filter(stored).groupBy("scope", "key").agg(F.min_by(F.sha2(body, 256), "id").alias("request_hash"), F.min_by(F.when(F.col("k") % 7 == 0, "IN_PROGRESS").otherwise("COMPLETED"), "id").alias("state"))
    return C.idempotent(req, done).select("request_no", "outcome")


#: A move of every event, between categories of a month, one of which no month has; amounts up to some budgets.
SPENT_ON = ["Health", "Main Meals", "None", "Fuel", "Electronics", "Other / Miscellaneous"]


@query(_recursive(_with(["budgets", "raws"], [f"""r AS (SELECT id AS request_no, '1997-' || lpad(CAST(id % 12 + 1 AS VARCHAR), 2, '0') AS month, {SPENT_ON}[id * 7 % 6 + 1] AS source, {SPENT_ON}[id // 5 % 6 + 1] AS target, CAST(CASE WHEN id % 31 = 0 THEN 0 ELSE amount * 30000 END AS DECIMAL(18,2)) AS amount FROM raws)""",
    "req AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY request_no) AS n FROM r)",
    "have AS (SELECT month, map(list(category), list(CAST(current_budget AS DECIMAL(18,2)))) AS held FROM budgets GROUP BY month)",
    """f AS (SELECT q.month, CAST(0 AS BIGINT) AS n, h.held, CAST(NULL AS BIGINT) AS request_no, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS DECIMAL(18,2)) AS source_after, CAST(NULL AS DECIMAL(18,2)) AS target_after FROM (SELECT DISTINCT month FROM req) q LEFT JOIN have h ON h.month = q.month
  UNION ALL SELECT month, n, CASE WHEN outcome = 'moved' THEN map_concat(held, MAP([source, target], [CAST(s - amount AS DECIMAL(18,2)), CAST(t + amount AS DECIMAL(18,2))])) ELSE held END, request_no, outcome, CAST(CASE WHEN outcome = 'moved' THEN s - amount ELSE s END AS DECIMAL(18,2)), CAST(CASE WHEN outcome = 'moved' THEN t + amount ELSE t END AS DECIMAL(18,2)) FROM (
    SELECT *, CASE WHEN source = target OR amount <= 0 THEN 'invalid' WHEN s IS NULL OR t IS NULL THEN 'unknown' WHEN s < amount THEN 'short' ELSE 'moved' END AS outcome FROM (
      SELECT q.*, f.held, f.held[q.source] AS s, f.held[q.target] AS t FROM f JOIN req q ON q.month = f.month AND q.n = f.n + 1)))"""],
    f"SELECT request_no, outcome, {D('source_after')} AS source_after, {D('target_after')} AS target_after FROM f WHERE n > 0")))
def budget_reallocations(spark, d):
    k, names = F.col("id"), F.array(*map(F.lit, SPENT_ON))
    at = lambda n: F.element_at(names, (n % 6 + 1).cast("int"))
    req = raw_events(spark, d).select(k.alias("request_no"), F.concat(F.lit("1997-"), F.lpad((k % 12 + 1).cast("string"), 2, "0")).alias("month"), at(k * 7).alias("source"), at(F.floor(k / 5)).alias("target"),
                                      F.when(k % 31 == 0, F.lit(0)).otherwise(F.col("amount") * 30000).cast("decimal(18,2)").alias("amount"))
    return C.reallocate(req, budgets(spark, d)).select("request_no", "outcome", F.col("source_after").cast("double").alias("source_after"), F.col("target_after").cast("double").alias("target_after"))


@query(_recursive(_with(["goals", "raws"], ["req AS (SELECT id AS request_no, id % 30 AS goal_id, ['fund', 'release', 'spend'][k % 3 + 1] AS op, amount, row_number() OVER (PARTITION BY id % 30 ORDER BY id) AS n FROM raws)",
    """f AS (SELECT q.goal_id, CAST(0 AS BIGINT) AS n, g.status, CAST(g.allocated_amount AS DECIMAL(28,2)) AS bal, CAST(NULL AS BIGINT) AS request_no, CAST(NULL AS VARCHAR) AS outcome FROM (SELECT DISTINCT goal_id FROM req) q LEFT JOIN goals g ON g.id = q.goal_id
  UNION ALL SELECT goal_id, n, status, CAST(CASE WHEN outcome <> 'applied' THEN bal WHEN op = 'fund' THEN bal + amount ELSE bal - amount END AS DECIMAL(28,2)), request_no, outcome FROM (
    SELECT q.*, f.status, f.bal, CASE WHEN f.status IS NULL THEN 'unknown' WHEN f.status <> 'Active' THEN 'inactive' WHEN q.amount <= 0 THEN 'amount' WHEN q.op <> 'fund' AND q.amount > f.bal THEN 'exceeds' ELSE 'applied' END AS outcome FROM f JOIN req q ON q.goal_id = f.goal_id AND q.n = f.n + 1))"""],
    "SELECT request_no, outcome FROM f WHERE n > 0")))
def goal_moves(spark, d):
    k = F.col("k") % 3
    req = raw_events(spark, d).select(F.col("id").alias("request_no"), (F.col("id") % 30).alias("goal_id"), F.when(k == 0, "fund").when(k == 1, "release").otherwise("spend").alias("op"), "amount")
    return C.goal_moves(req, goals(spark, d)).select("request_no", "outcome")


@query(with_tables("upcoming", "raws", body="""SELECT w.id, CASE WHEN u.status IS NULL THEN 'unknown' WHEN u.status = w.wanted THEN 'same' WHEN u.status = 'Upcoming' AND w.wanted IN ('Confirmed', 'Skipped', 'Cancelled') OR u.status = 'Confirmed' AND w.wanted IN ('Upcoming', 'Skipped') OR u.status = 'Tentative' AND w.wanted IN ('Upcoming', 'Confirmed', 'Cancelled') THEN 'applied' ELSE 'locked' END AS outcome
FROM (SELECT id % 2500 AS id, arg_max(['Confirmed', 'Skipped', 'Cancelled', 'Upcoming'][k % 4 + 1], id) AS wanted FROM raws GROUP BY 1) w LEFT JOIN upcoming u ON u.id = w.id"""))
def status_changes(spark, d):
    k = F.col("k") % 4
    req = raw_events(spark, d).select((F.col("id") % 2500).alias("id"), F.col("id").alias("request_no"), F.when(k == 0, "Confirmed").when(k == 1, "Skipped").when(k == 2, "Cancelled").otherwise("Upcoming").alias("status"))
    allowed = {"Upcoming": ("Confirmed", "Skipped", "Cancelled"), "Confirmed": ("Upcoming", "Skipped"), "Tentative": ("Upcoming", "Confirmed", "Cancelled")}
    return C.status_changes(req, upcoming(spark, d), allowed).select("id", "outcome")


@query(with_tables("upcoming", "allocs", body=f"SELECT u.id, {D('u.amount')} AS amount, {D('sum(a.amount)')} AS covered FROM allocs a JOIN upcoming u ON u.id = a.covers_upcoming_id WHERE a.status = 'Active' GROUP BY u.id, u.amount HAVING sum(a.amount) > u.amount + 0.005"))
def over_coverage(spark, d):
    return C.over_coverage(allocations(spark, d), upcoming(spark, d)).select("id", F.col("amount").cast("double").alias("amount"), F.col("covered").cast("double").alias("covered"))


@query(with_tables("tx", "accounts", body="SELECT name, 'External' AS kind FROM (SELECT DISTINCT account_to AS name FROM tx UNION SELECT account_from FROM tx) WHERE name <> '' AND name NOT IN (SELECT name FROM accounts WHERE active)"))
def account_bootstrap(spark, d):
    from saldo.functions.text import account_kind

    t = transactions(spark, d)
    names = t.select(F.col("account_from").alias("name")).union(t.select(F.col("account_to").alias("name"))).filter("name != ''")
    return C.insert_ignore(accounts(spark, d).filter("active"), names.withColumn("kind", account_kind(F.col("name"))), ["name"], ["kind"])


@query(with_tables("tx", body=f"""SELECT CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS approved_count, {D('sum(CASE WHEN ok THEN amount ELSE 0 END)')} AS total, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS skipped, CAST(count(DISTINCT CASE WHEN ok THEN account_from END) AS BIGINT) AS accounts
FROM (SELECT *, id % 3 <> 0 AND id % 4 <> 1 AND id % 5 <> 2 AS ok FROM tx)"""))
def bulk_approval(spark, d):
    k = F.col("id")
    c = transactions(spark, d).select("id", F.when(k % 3 == 0, "Approved").otherwise("Pending").alias("review_status"), F.when(k % 4 == 1, "low").otherwise("high").alias("confidence"), F.when(k % 5 == 2, "Probable").otherwise("None").alias("duplicate_status"), "amount", F.col("account_from").alias("account"))
    return C.approval_summary(C.bulk_approve(c)).select("approved_count", F.col("total").cast("double").alias("total"), "skipped", F.size("accounts").cast("long").alias("accounts"))
