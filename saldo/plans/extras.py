"""Further queries: listings, joins of evidence and debts, dialects, commands, dashboards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from saldo.functions import money as M
from saldo.functions import text as T
from saldo.operators import commands as C
from saldo.operators import ingest as G
from saldo.operators import ledger as L
from saldo.operators import obligations as O
from saldo.operators import reports as R
from saldo.plans.core import ACCOUNT_BOOK, DS, OUT, PENDING, D, _with
from saldo.plans.ingestion import CLASSED, EVENTS, MSG, RULE, _list, messages
from saldo.plans.registry import query
from saldo.plans.reports import MONTHS, keyword_sql
from saldo.sources.ledger import AS_OF, MONTH, accounts, allocations, budgets, debt_events, debts, goals, raw_events, read, snapshots, transactions, upcoming, with_tables


def _from(options, key):
    return F.element_at(F.array(*map(F.lit, options)), (F.col(key) % len(options) + 1).cast("int"))


@query(with_tables("upcoming", "allocs", body=f"SELECT a.id, a.title, {D('a.amount')} AS amount, a.status, u.title AS covers, {D('u.amount')} AS due FROM allocs a LEFT JOIN upcoming u ON u.id = a.covers_upcoming_id"))
def allocation_list(spark, d):
    u = upcoming(spark, d).select(F.col("id").alias("covers_upcoming_id"), F.col("title").alias("covers"), F.col("amount").cast("double").alias("due"))
    return allocations(spark, d).join(u, "covers_upcoming_id", "left").select("id", "title", F.col("amount").cast("double").alias("amount"), "status", "covers", "due")


@query(with_tables("tx", "devents", body=f"SELECT debt_id, event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(t.id) AS BIGINT) AS linked, {D('coalesce(sum(t.amount), 0)')} AS ledger_amount FROM devents e LEFT JOIN tx t ON t.id = e.transaction_id AND NOT t.is_deleted GROUP BY debt_id, event_type"))
def debt_event_detail(spark, d):
    t = L.live(transactions(spark, d)).select(F.col("id").alias("transaction_id"), F.col("amount").alias("tx_amount"), F.lit(1).alias("one"))
    return debt_events(spark, d).join(t, "transaction_id", "left").groupBy("debt_id", "event_type").agg(F.count("*").alias("n"), F.count("one").alias("linked"), L.total("tx_amount").alias("ledger_amount"))


@query(with_tables("raws", body=f"SELECT id, source, external_id, {D('amount')} AS amount, status FROM (SELECT id, source, external_id, amount, ['Pending', 'Approved', 'Rejected'][k % 3 + 1] AS status FROM raws) WHERE status = 'Pending' ORDER BY id DESC LIMIT 100 OFFSET 50"))
def candidate_page(spark, d):
    e = raw_events(spark, d)
    c = e.select("id", F.col("id").alias("raw_id"), _from(["Pending", "Approved", "Rejected"], "k").alias("review_status"), F.lit(1).alias("batch"))
    out = G.candidate_page(c, e.select(F.col("id").alias("raw_id"), "source", "external_id", "amount"), "Pending", limit=100, offset=50)
    return out.select("id", "source", "external_id", F.col("amount").cast("double").alias("amount"), F.col("review_status").alias("status"))


@query(_with(["raws"], [MSG, CLASSED, RULE, EVENTS], f"""SELECT ev.source, ev.event_kind, CAST(count(*) AS BIGINT) AS evidence, CAST(count(c.id) AS BIGINT) AS candidates, {D('coalesce(sum(c.amount), 0)')} AS amount
FROM events_ ev JOIN raws r ON r.id = ev.id LEFT JOIN (SELECT id, amount FROM events_ WHERE financial_class <> 'Ignore' AND amount > 0 AND evidence_role NOT IN ('SECONDARY_RECEIPT', 'INVOICE')) c ON c.id = ev.id GROUP BY ev.source, ev.event_kind"""))
def evidence_with_candidates(spark, d):
    e = G.classify(messages(spark, d))
    c = G.to_candidate(e).select("id", F.col("amount").alias("c_amount"), F.lit(1).alias("one"))
    j = e.select("id", "source", "event_kind").join(raw_events(spark, d).select("id"), "id").join(c, "id", "left")
    return j.groupBy("source", "event_kind").agg(F.count("*").alias("evidence"), F.count("one").alias("candidates"), L.total("c_amount").alias("amount"))


@query(_with(["raws"], [MSG, "ev AS (SELECT id AS raw_id, id % 50 AS event_id, id % 700 AS twin, body FROM messages)"], """SELECT event_id, CAST(count(*) AS BIGINT) AS queued, CAST(sum(CASE WHEN raw_id % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM ev WHERE event_id % 5 = 0 GROUP BY event_id"""))
def repair_queue(spark, d):
    m = messages(spark, d)
    ev = m.select(F.col("id").alias("raw_id"), (F.col("id") % 50).alias("event_id"))
    bad = ev.filter("event_id % 5 = 0").select("event_id")
    pay = m.filter("id % 13 != 0").select(F.col("id").alias("raw_id"), F.col("body").alias("payload"), F.sha2("body", 256).alias("payload_hash"))
    q = G.repair_queue(ev, bad, pay)
    return q.groupBy("event_id").agg(F.count("*").alias("queued"), F.sum((F.col("reject_code") == "MISSING_PAYLOAD").cast("long")).alias("missing")).select("event_id", "queued", F.coalesce("missing", F.lit(0)).alias("missing"))


TEXTS = ["makan padang di kantin", "kopi studio24", "isi bensin pertamax", "pulsa telkomsel", "cetak buku skripsi", "parkir mall", "langganan spotify", "servis motor", "obat batuk", "hadiah", "NASI GORENG", "roti bakar"]


@query(f"SELECT event_id AS id, {keyword_sql('t', T.MESSAGE_KEYWORDS, repr(T.OTHER))} AS message_category, {keyword_sql('t', T.DRAFT_KEYWORDS, 'NULL')} AS draft_category, {keyword_sql('upper(t)', T.LEDGER_KEYWORDS, repr(T.OTHER))} AS ledger_category FROM (SELECT event_id, lower({_list(TEXTS)}[event_id % {len(TEXTS)} + 1]) AS t FROM events)")
def category_dialects(spark, d):
    t = F.lower(_from(TEXTS, "event_id"))
    return read(spark, d, "events").select(F.col("event_id").alias("id"), T.keyword_category(t, T.MESSAGE_KEYWORDS).alias("message_category"), T.keyword_category(t, T.DRAFT_KEYWORDS, None).alias("draft_category"), T.infer_category(t, F.lit("")).alias("ledger_category"))


HEADERS = ["BCA <bca@bca.co.id>", "noreply@jago.com", "Shopee <info@shopee.co.id>", "spoof bca@bca.co.id <x@evil.example>", "", "NOREPLY@BYU.ID"]


@query(f"SELECT event_id AS id, CASE WHEN a IN ({', '.join(repr(x) for x in G.PRIMARY_SENDERS)}) THEN 'primary' WHEN a IN ({', '.join(repr(x) for x in G.SECONDARY_SENDERS)}) THEN 'secondary' ELSE 'none' END AS trust FROM (SELECT event_id, lower(trim(CASE WHEN regexp_extract(h, '<([^>]+)>', 1) = '' THEN h ELSE regexp_extract(h, '<([^>]+)>', 1) END)) AS a FROM (SELECT event_id, {_list(HEADERS)}[event_id % {len(HEADERS)} + 1] AS h FROM events))")
def sender_trust(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("id"), G.sender_trust(_from(HEADERS, "event_id")).alias("trust"))


CHATS = [("transfer 100000 BCA Main ke Jago", "Transfer", 100000, "BCA Main", "Jago Main", T.OTHER, 0.95), ("tf 50k bca ke gopay", "Transfer", 50000, "BCA Main", "GoPay", T.OTHER, 0.95), ("keluar 12000 dari ShopeePay untuk makan", "Expense", 12000, "ShopeePay", None, "Main Meals", 0.95),
         ("bayar 25.000 pakai BCA untuk bensin", "Expense", 25000, "BCA Main", None, "Fuel", 0.95), ("masuk 500000 ke BCA dari Allan untuk gaji", "Income", 500000, "BCA Main", None, T.OTHER, 0.90), ("terima 75k di tunai", "Income", 75000, "Cash", None, T.OTHER, 0.90), ("habis 15.000 tadi", "Expense", 15000, "BCA Main", None, T.OTHER, 0.3), ("halo", "Expense", 0, "BCA Main", None, T.OTHER, 0.3)]
_q = lambda v: "NULL" if v is None else repr(v) if not isinstance(v, float) else f"CAST({v} AS DOUBLE)"


@query("WITH c(i, kind, amount, account, to_account, category, confidence) AS (VALUES " + ", ".join(f"({i}, {', '.join(map(_q, c[1:]))})" for i, c in enumerate(CHATS)) + f") SELECT e.event_id AS id, c.kind, CAST(c.amount AS DOUBLE) AS amount, c.account, CAST(c.to_account AS VARCHAR) AS to_account, c.category, c.confidence, CASE WHEN c.confidence > 0.5 THEN 'AutoApproved' ELSE 'Pending' END AS status FROM events e JOIN c ON c.i = e.event_id % {len(CHATS)}")
def chat_commands(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("id"), G.parse_command(_from([c[0] for c in CHATS], "event_id")).alias("p")).select("id", "p.kind", F.col("p.amount").cast("double").alias("amount"), "p.account", "p.to_account", "p.category", "p.confidence", "p.status")


_LABEL = lambda c, m: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + f" ELSE coalesce(nullif({c}, ''), '-') END"


@query(with_tables("tx", body=f"SELECT {_LABEL('money_context', T.CONTEXT_LABELS)} AS context, {_LABEL('status', T.STATUS_LABELS)} AS status, CAST(count(*) AS BIGINT) AS n FROM tx GROUP BY 1, 2"))
def labelled_counts(spark, d):
    return transactions(spark, d).groupBy(T.label(F.col("money_context"), T.CONTEXT_LABELS).alias("context"), T.label(F.col("status"), T.STATUS_LABELS).alias("status")).agg(F.count("*").alias("n"))


@query(with_tables("accounts", body="SELECT name, CASE WHEN current_balance IS NULL THEN '—' ELSE CASE WHEN current_balance < 0 THEN '-' ELSE '' END || 'Rp' || translate(CASE WHEN abs(round(current_balance) - current_balance) < 0.005 THEN format('{:,}', CAST(abs(current_balance) AS BIGINT)) ELSE format('{:,.2f}', CAST(abs(current_balance) AS DOUBLE)) END, ',.', '.,') END AS shown FROM accounts"))
def formatted_balances(spark, d):
    return accounts(spark, d).select("name", M.idr(F.col("current_balance")).alias("shown"))


@query(with_tables("tx", body=f"SELECT max(CASE WHEN date <= DATE '{AS_OF}' THEN date END) AS last_date, DATE '{AS_OF}' AS today, '1999-06' AS current_month, '1999-07' AS planning_month, CAST(15 AS INTEGER) AS day_of_month, CAST(30 AS INTEGER) AS days_in_month FROM tx WHERE NOT is_deleted"))
def time_context(spark, d):
    day = F.lit(AS_OF).cast("date")
    return L.live(transactions(spark, d)).agg(F.max(F.when(F.col("date") <= day, F.col("date"))).alias("last_date"), day.alias("today"), F.date_format(day, "yyyy-MM").alias("current_month"), F.date_format(F.add_months(day, 1), "yyyy-MM").alias("planning_month"), F.day(day).alias("day_of_month"), F.day(F.last_day(day)).alias("days_in_month"))


@query(with_tables("tx", body=f"SELECT CAST(sum(CASE WHEN starts_with(status, 'Provisional') THEN 1 ELSE 0 END) AS BIGINT) AS provisional, {D('''sum(CASE WHEN starts_with(status, 'Provisional') THEN amount ELSE 0 END)''')} AS gross, {D('''sum(CASE WHEN money_context = 'Historical Research' THEN amount ELSE 0 END)''')} AS research FROM tx WHERE NOT is_deleted"))
def provisional_totals(spark, d):
    p = F.col("status").startswith("Provisional")
    return L.live(transactions(spark, d)).agg(F.sum(p.cast("long")).alias("provisional"), L.total(F.when(p, F.col("amount"))).alias("gross"), L.total(F.when(F.col("money_context") == "Historical Research", F.col("amount"))).alias("research"))


@query(with_tables("accounts", "allocs", body=f"SELECT {D('p')} AS protected, {D('a')} AS allocated, {D('greatest(0, p - a)')} AS unallocated FROM (SELECT coalesce(sum(CASE WHEN protected_amount > 0 THEN protected_amount WHEN protected THEN greatest(0, coalesce(current_balance, 0)) ELSE 0 END), 0) AS p FROM accounts WHERE active), (SELECT coalesce(sum(amount), 0) AS a FROM allocs WHERE status = 'Active')"))
def unallocated_protection(spark, d):
    guard = F.when(F.col("protected_amount") > 0, F.col("protected_amount")).when(F.col("protected"), F.greatest(F.lit(0), F.coalesce("current_balance", F.lit(0)))).otherwise(F.lit(0))
    p = accounts(spark, d).filter("active").agg(F.coalesce(F.sum(guard), F.lit(0)).alias("p"))
    a = allocations(spark, d).filter("status = 'Active'").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("a"))
    return p.crossJoin(F.broadcast(a)).select(F.col("p").cast("double").alias("protected"), F.col("a").cast("double").alias("allocated"), F.greatest(F.lit(0), F.col("p") - F.col("a")).cast("double").alias("unallocated"))  # one row each


@query(with_tables("budgets", body="SELECT c.category, CAST(50000 AS BIGINT) AS suggested FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in T.CATEGORIES) + f"]) AS category) c WHERE c.category NOT IN (SELECT category FROM budgets WHERE month = '{MONTH}')"))
def budget_bootstrap(spark, d):
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, T.CATEGORIES))).alias("category"), F.lit(50_000).cast("long").alias("suggested"))
    return C.insert_ignore(budgets(spark, d).filter(F.col("month") == MONTH), every, ["category"], ["suggested"])


@query(with_tables("raws", body="SELECT source, max(ts) AS last_event_at, arg_max(external_id, id) AS cursor, max(id) AS id FROM raws GROUP BY source"))
def sync_state(spark, d):
    from saldo.sources.files import merge_state

    e = raw_events(spark, d).select("source", F.col("ts").alias("last_event_at"), F.col("external_id").alias("cursor"), "id")
    return merge_state(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), "source", "id")


@query(with_tables("raws", body="""SELECT id, sha256('{"amount":' || CAST(amount AS VARCHAR) || ',"external_id":"' || external_id || '","source":"' || source || '"}') AS request_hash FROM raws"""))
def request_hashes(spark, d):
    return raw_events(spark, d).select("id", F.sha2(F.to_json(F.struct("amount", "external_id", "source")), 256).alias("request_hash"))  # fields in the order of their names


@query(_with(["accounts", "tx", "snaps"], ACCOUNT_BOOK, """SELECT level, title, CAST(priority AS INTEGER) AS priority FROM (SELECT 'warn' AS level, 'unverified' AS title, 1 AS priority WHERE EXISTS (SELECT 1 FROM book WHERE active AND current_balance IS NOT NULL AND expected IS NULL)
UNION ALL SELECT 'warn', 'difference', 2 WHERE EXISTS (SELECT 1 FROM book WHERE active AND current_balance IS NOT NULL AND abs(expected - current_balance) >= 0.005)
UNION ALL SELECT 'info', 'incomplete', 3 WHERE EXISTS (SELECT 1 FROM accounts WHERE active AND kind = 'Owned' AND current_balance IS NULL) UNION ALL SELECT 'info', 'pending', 4 WHERE EXISTS (SELECT 1 FROM tx WHERE """ + PENDING + ")) ORDER BY priority LIMIT 3"))
def top_insights(spark, d):
    a, t = accounts(spark, d), transactions(spark, d)
    issues = L.verify(L.reconstruct(a, t, snapshots(spark, d))).groupBy("issue").count().select("issue")
    row = lambda df, level, title, p: df.limit(1).select(F.lit(level).alias("level"), F.lit(title).alias("title"), F.lit(p).alias("priority"))
    out = row(issues.filter("issue = 'unverifiable'"), "warn", "unverified", 1).unionByName(row(issues.filter("issue = 'discrepancy'"), "warn", "difference", 2))
    out = out.unionByName(row(a.filter("active and kind = 'Owned' and current_balance is null"), "info", "incomplete", 3)).unionByName(row(t.filter(L.pending()), "info", "pending", 4))
    return out.orderBy("priority").limit(3)


@query(_with(["tx", "budgets", "goals", "debts", "devents"], [MONTHS, OUT, DS], f"""SELECT {D('m.income')} AS income, {D('m.expense')} AS expense, {D('m.income - m.expense')} AS surplus, {D('(SELECT sum(current_budget) FROM budgets b WHERE b.month = m.month AND active)')} AS planned, {D('''(SELECT sum(allocated_amount) FROM goals WHERE status = 'Active')''')} AS allocated,
CAST((SELECT count(*) FROM ds WHERE status = 'Active') AS BIGINT) AS active_debts FROM months m WHERE m.month = '{MONTH}'"""))
def dashboard(spark, d):
    m = R.monthly(transactions(spark, d)).filter(F.col("month") == MONTH)
    parts = [budgets(spark, d).filter((F.col("month") == MONTH) & F.col("active")).agg(F.sum("current_budget").cast("double").alias("planned")), goals(spark, d).filter("status = 'Active'").agg(F.sum("allocated_amount").cast("double").alias("allocated")),
             O.debt_status(debts(spark, d), debt_events(spark, d)).filter("status = 'Active'").agg(F.count("*").alias("active_debts"))]
    out = m.select(*[F.col(c).cast("double").alias(c) for c in ("income", "expense", "surplus")])
    for p in parts:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


@query(with_tables("upcoming", body=f"SELECT id, title, {D('amount')} AS amount, due_date FROM upcoming WHERE status IN ('Upcoming', 'Confirmed') AND due_date >= DATE '{AS_OF}' ORDER BY due_date, id LIMIT 3"))
def next_upcoming(spark, d):
    return upcoming(spark, d).filter(F.col("status").isin("Upcoming", "Confirmed") & (F.col("due_date") >= F.lit(AS_OF).cast("date"))).orderBy("due_date", "id").limit(3).select("id", "title", F.col("amount").cast("double").alias("amount"), "due_date")


@query(with_tables("tx", body="SELECT date, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY time DESC, id DESC) AS ids FROM tx WHERE NOT is_deleted GROUP BY date"))
def grouped_by_date(spark, d):
    rows = F.reverse(F.array_sort(F.collect_list(F.struct("time", "id"))))
    return L.live(transactions(spark, d)).groupBy("date").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r["id"].cast("string")), ",").alias("ids"))


@query(with_tables("raws", body=f"SELECT id, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') || ' WIB' AS wib, strftime(ts, '%Y-%m') AS month, CASE WHEN TRY_CAST(['2024-02-30', '2024-02-29', '', 'x'][k % 4 + 1] AS DATE) IS NULL THEN FALSE ELSE TRUE END AS valid FROM raws"))
def instants(spark, d):
    given = _from(["2024-02-30", "2024-02-29", "", "x"], "k")
    return raw_events(spark, d).select("id", F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 7 HOURS"), "yyyy-MM-dd HH:mm:ss"), F.lit(" WIB")).alias("wib"), F.date_format("ts", "yyyy-MM").alias("month"), given.try_cast("date").isNotNull().alias("valid"))


@query(_with(["tx"], [MONTHS], f"SELECT month, {D('income - expense')} AS headline, abs((income - expense) - (income + (-expense))) < 0.005 AS matches, round({D('sum(income - expense) OVER (ORDER BY month)')}, 2) AS running FROM months"))
def components_match(spark, d):
    m = R.monthly(transactions(spark, d))  # one row a month: the ordered window is small by construction
    run = F.sum("surplus").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return m.select("month", F.col("surplus").cast("double").alias("headline"), (F.abs(F.col("surplus") - (F.col("income") + (-F.col("expense")))) < 0.005).alias("matches"), F.round(run.cast("double"), 2).alias("running"))
