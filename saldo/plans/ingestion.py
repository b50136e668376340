"""Queries on messages, candidates, evidence and review."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from saldo.functions import money as M
from saldo.functions import text as T
from saldo.operators import backfill as B
from saldo.operators import ingest as G
from saldo.operators import ledger as L
from saldo.operators.canonical import SCHEMAS, canonicalize, cut
from saldo.operators.guard import hmac_sha256, verify
from saldo.plans.core import D, _with
from saldo.plans.insights import normalize_sql
from saldo.plans.registry import query
from saldo.sources.ledger import raw_events, read, transactions, with_tables

# Sample notifications: senders and bodies in turn; {a} stands for the amount, {i} for a reference.
SENDERS = ["notif@bca.co.id", "noreply@jago.com", "no-reply@flip.id", "googleplay-noreply@google.com", "info@byu.id", "receipt@mailer-esb.com", "order@shopee.co.id", "friend@example.org"]
BODIES = ["Pembayaran QRIS sebesar Rp {a} no. ref {i}", "Status transaksi: Gagal Rp {a}", "Tarik tunai tanpa kartu Rp {a}", "Top up ShopeePay nominal Rp {a}", "Transfer dari Budi jumlah IDR {a}", "Subscription cancelled order id {i}", "Pesanan diterima", "Pembayaran merchant kopi total: Rp {a} order id {i}",
          "Transfer ke RDN Stockbit Rp {a}", "Kuota aktif sampai besok", "Transfer QRIS ke teman Rp {a}"]


def messages(spark, d):
    e = raw_events(spark, d)
    body = F.element_at(F.array(*map(F.lit, BODIES)), (F.col("id") % len(BODIES) + 1).cast("int"))
    body = F.replace(F.replace(body, F.lit("{a}"), F.col("amount").cast("string")), F.lit("{i}"), F.concat(F.lit("R"), (F.col("id") % 3000).cast("string")))
    return e.select("id", "source", "external_id", "date", "ts", "user_id", "merchant", F.element_at(F.array(*map(F.lit, SENDERS)), (F.col("user_id") % len(SENDERS) + 1).cast("int")).alias("sender"), F.lit("notification").alias("subject"), body.alias("body"))


def epoch(ts):
    """Seconds since 1970 of a time without a zone, to the microsecond and whatever zone the session has."""
    return (F.col(ts) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second").cast("decimal(20,6)")


def _list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


MSG = f"""messages AS (SELECT id, source, external_id, date, ts, user_id, merchant, {_list(SENDERS)}[user_id % {len(SENDERS)} + 1] AS sender, replace(replace({_list(BODIES)}[id % {len(BODIES)} + 1], '{{a}}', CAST(amount AS VARCHAR)), '{{i}}', 'R' || (id % 3000)) AS body FROM raws)"""
HIT = [f"contains(sender, '{s}') AND " + (f"regexp_matches(lower('notification ' || body), '{p}')" if p else "TRUE") for s, p, *_ in G.RULES]
CLASSED = "classed AS (SELECT *, CASE" + "".join(f" WHEN {h} THEN {i}" for i, h in enumerate(HIT)) + " END AS rule FROM messages)"
RULE = "rules(rule, event_kind, financial_class, confidence, evidence_role) AS (VALUES " + ", ".join(f"({i}, '{k}', '{c}', CAST({n} AS DOUBLE), '{r}')" for i, (_, _, k, c, n, r) in enumerate(G.RULES)) + ")"
RAW = "coalesce(" + ", ".join(f"nullif(regexp_extract(body, '{p}', 1), '')" for p in G.AMOUNT_AT) + ")"
PLAIN = f"TRY_CAST(CASE WHEN regexp_matches({RAW}, ',\\d{{2}}$') THEN replace(replace({RAW}, '.', ''), ',', '.') WHEN regexp_matches({RAW}, '\\.\\d{{2}}$') THEN replace({RAW}, ',', '') ELSE replace(replace({RAW}, '.', ''), ',', '') END AS DECIMAL(18,2))"
REF = r"regexp_extract(body, '(?i)(?:no\.?\s*referensi|no\.?\s*ref|reference|order id|no\.?\s*pesanan|id transaksi)\s*:?\s*([a-zA-Z0-9.\-]+)', 1)"
EVENTS = f"events_ AS (SELECT c.id, c.source, c.external_id, c.date, c.ts, c.user_id, c.merchant, r.event_kind, r.financial_class, r.confidence, r.evidence_role, CASE WHEN r.event_kind <> 'NON_TRANSACTION' AND {PLAIN} > 0 THEN {PLAIN} END AS amount, {REF} AS reference FROM classed c JOIN rules r USING (rule))"


@query(_with(["raws"], [MSG, CLASSED, RULE, EVENTS], f"""SELECT id, event_kind, financial_class, confidence, evidence_role, {D('amount')} AS amount, reference, CASE WHEN financial_class = 'Ignore' THEN 'Ignored' WHEN confidence >= 0.85 AND amount > 0 AND financial_class <> 'Pending Review' THEN 'AutoApproved' ELSE 'Pending' END AS status FROM events_"""))
def classify_messages(spark, d):
    c = G.classify(messages(spark, d))
    return c.select("id", "event_kind", "financial_class", "confidence", "evidence_role", F.col("amount").cast("double").alias("amount"), "reference", G.auto_approve(F.col("confidence"), F.col("amount"), F.col("event_kind"), F.col("financial_class")).alias("status"))


#: What came before is the canonical state, the rest comes in.
SPLIT = "2024-01-16"
CORR = f"""c AS (SELECT id, ts < TIMESTAMP '{SPLIT} 00:00:00' AS old, event_kind, financial_class, amount, evidence_role, reference, CASE WHEN id % 4 = 0 THEN 'O' || (id % 500) ELSE '' END AS order_id, CASE WHEN id % 2 = 0 THEN merchant END AS merchant,
  substr(sha256(source || '|' || external_id), 1, 32) AS event_id FROM events_),
keyed AS (SELECT c.*, 1 AS rank, 'reference' AS by_, reference AS key FROM c UNION ALL SELECT c.*, 2, 'order_id', order_id FROM c UNION ALL SELECT c.*, 3, 'event_id', event_id FROM c),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY by_, key ORDER BY event_id, event_kind, financial_class, amount NULLS FIRST, merchant NULLS FIRST) AS rn FROM keyed WHERE old AND key <> '') WHERE rn = 1),
hit AS (SELECT i.id, k.event_id, i.by_, i.evidence_role <> 'PRIMARY_PAYMENT' OR coalesce(i.event_kind = k.event_kind AND i.financial_class = k.financial_class AND i.amount = k.amount AND coalesce(lower(i.merchant) = lower(k.merchant), TRUE), FALSE) AS ok,
  row_number() OVER (PARTITION BY i.id ORDER BY i.rank) AS rn FROM keyed i JOIN kept k ON i.by_ = k.by_ AND i.key = k.key WHERE NOT i.old)"""


@query(_with(["raws"], [MSG, CLASSED, RULE, EVENTS, CORR], "SELECT c.id, h.event_id AS matched_event, h.by_ AS matched_by, h.ok AS compatible FROM c LEFT JOIN hit h ON h.id = c.id AND h.rn = 1 WHERE NOT c.old"))
def canonical_correlate(spark, d):
    k = F.col("id")
    e = (G.classify(messages(spark, d)).withColumn("event_id", G.event_key(F.col("source"), F.col("external_id"))).withColumn("order_id", F.when(k % 4 == 0, F.concat(F.lit("O"), (k % 500).cast("string"))).otherwise(""))
         .withColumn("merchant", F.when(k % 2 == 0, F.col("merchant"))))
    old = F.col("ts") < F.lit(f"{SPLIT} 00:00:00").cast("timestamp_ntz")
    return G.correlate(e.filter(~old), e.filter(old))


@query(None)
def canonical_ingest(spark, d):
    """Outcome of every classified message, taken up in two batches: which of them SQL would have to find one message after the other."""
    k = F.col("id")
    e = (G.classify(messages(spark, d)).select(k.alias("n"), "ts", "source", "external_id", "reference", F.when(k % 4 == 0, F.concat(F.lit("O"), (k % 500).cast("string"))).otherwise("").alias("order_id"), G.event_key(F.col("source"), F.col("external_id")).alias("event_id"),
         "event_kind", "financial_class", F.when(F.col("event_kind").startswith("INCOMING"), "IN").otherwise("OUT").alias("direction"), "amount", F.when(k % 2 == 0, F.col("merchant")).alias("merchant"), "evidence_role"))
    old = F.col("ts") < F.lit(f"{SPLIT} 00:00:00").cast("timestamp_ntz")
    none = [spark.createDataFrame([], SCHEMAS[t]) for t in ("raws", "events", "evidence")]
    first = {t: cut(df) for t, df in canonicalize(e.filter(old).drop("ts"), *none).items()}
    then = canonicalize(e.filter(~old).drop("ts"), *[first[t] for t in ("raws", "events", "evidence")])
    told = first["outcomes"].withColumn("batch", F.lit(1)).unionByName(then["outcomes"].withColumn("batch", F.lit(2)))
    return told.select("batch", F.col("n").alias("id"), "source", "external_id", "outcome", "event_id")


@query(_with(["raws"], [MSG, CLASSED, RULE, EVENTS], "SELECT id, outcome FROM (SELECT id, CASE WHEN row_number() OVER (PARTITION BY source, external_id ORDER BY ts, id) > 1 THEN 'duplicate' ELSE 'new' END AS outcome FROM events_)"))
def idempotent_ingest(spark, d):
    return G.first_seen(messages(spark, d), ["source", "external_id"], ["ts", "id"]).select("id", "outcome")


@query(_with(["raws"], [], "").rstrip().rstrip(",") + "\nSELECT source, external_id, min(id) AS id, CAST(count(*) AS BIGINT) AS n FROM raws GROUP BY source, external_id")
def nonce_dedupe(spark, d):
    return raw_events(spark, d).groupBy("source", "external_id").agg(F.min("id").alias("id"), F.count("*").alias("n"))


#: Requests of every event: some too old or new, unsigned, badly signed or without a time; those of a quarter of an hour share a nonce.
SECRET = "fixture secret"
REQUESTS = """req AS (SELECT id, epoch_ms(ts) AS received, 'n' || (epoch_ms(ts) // 900000) AS nonce, CASE WHEN id % 19 = 0 THEN '' WHEN id % 17 = 0 THEN 'soon' ELSE CAST(epoch_ms(ts) + CASE id % 9 WHEN 0 THEN 300001 WHEN 1 THEN -300000 ELSE id % 9 * 1000 END AS VARCHAR) || CASE WHEN id % 23 = 0 THEN 'x' ELSE '' END END AS timestamp FROM raws),
first_fault AS (SELECT *, CASE WHEN timestamp = '' OR id % 29 = 0 THEN 'MISSING_HEADERS' WHEN timestamp = 'soon' THEN 'INVALID_TIMESTAMP' WHEN abs(received - CAST(rtrim(timestamp, 'x') AS BIGINT)) > 300000 THEN 'EXPIRED_TIMESTAMP' WHEN id % 11 = 0 THEN 'INVALID_SIGNATURE' END AS fault FROM req),
good AS (SELECT id, nonce, received, CAST(rtrim(timestamp, 'x') AS BIGINT) AS sent, row_number() OVER (PARTITION BY nonce ORDER BY received, id) AS n FROM first_fault WHERE fault IS NULL),
f AS (SELECT id, nonce, n, sent AS reserved, 'VALID' AS outcome FROM good WHERE n = 1
  UNION ALL SELECT g.id, g.nonce, g.n, CASE WHEN f.reserved < g.received - 600000 THEN g.sent ELSE f.reserved END, CASE WHEN f.reserved < g.received - 600000 THEN 'VALID' ELSE 'NONCE_REPLAY' END FROM f JOIN good g ON g.nonce = f.nonce AND g.n = f.n + 1)"""


@query(_with(["raws"], [REQUESTS], "SELECT q.id, coalesce(q.fault, f.outcome) AS outcome FROM first_fault q LEFT JOIN f USING (id)").replace("WITH ", "WITH RECURSIVE ", 1))
def request_guard(spark, d):
    k, received = F.col("id"), F.round(epoch("ts") * 1000).cast("long")  # SQL's epoch_ms takes the nearest millisecond
    off = F.when(k % 9 == 0, 300_001).when(k % 9 == 1, -300_000).otherwise(k % 9 * 1000)
    named = F.when(k % 19 == 0, "").when(k % 17 == 0, "soon").otherwise(F.concat((F.col("received") + off).cast("string"), F.when(k % 23 == 0, "x").otherwise("")))
    e = raw_events(spark, d).select("id", received.alias("received"), "merchant").withColumn("timestamp", named).withColumn("nonce", F.concat(F.lit("n"), F.floor(F.col("received") / 900_000).cast("string")))
    sign = hmac_sha256(SECRET, F.concat_ws(".", "timestamp", "nonce", "merchant"))
    signature = F.when(k % 29 == 0, F.lit(None)).when(k % 11 == 0, F.reverse(sign)).when(k % 13 == 0, F.upper(sign)).otherwise(sign)
    return verify(e.withColumn("signature", signature).withColumnRenamed("merchant", "body"), SECRET, ["id"]).select("id", "outcome")


ACTIONS = "actions AS (SELECT 'cb' || (id % 6000) AS callback_id, id % 2500 AS candidate_id, CASE WHEN k % 2 = 0 THEN 'approve' ELSE 'reject' END AS action, ts, id FROM raws)"


@query(_with(["raws"], [ACTIONS, "a AS (SELECT *, row_number() OVER (PARTITION BY callback_id ORDER BY ts, candidate_id) > 1 AS replay FROM actions)", "b AS (SELECT *, first_value(action) OVER w AS winner, row_number() OVER w AS rn FROM a WINDOW w AS (PARTITION BY candidate_id ORDER BY replay, ts, callback_id))"],
    "SELECT id, CASE WHEN replay THEN 'replay' WHEN rn = 1 THEN 'applied' WHEN action = winner THEN 'idempotent' ELSE 'locked' END AS outcome FROM b"))
def review_first_wins(spark, d):
    a = raw_events(spark, d).select(F.concat(F.lit("cb"), (F.col("id") % 6000).cast("string")).alias("callback_id"), (F.col("id") % 2500).alias("candidate_id"), F.when(F.col("k") % 2 == 0, "approve").otherwise("reject").alias("action"), "ts", "id")
    return G.review(a).select("id", "outcome")


CAND = """cands AS (SELECT id, date + CASE WHEN id % 4 = 1 THEN 1 WHEN id % 4 = 2 THEN 5 ELSE 0 END AS date, transaction_type, amount, account_from, account_to, CASE WHEN id % 8 = 5 THEN source_refs ELSE 'import:none:' || id END AS source_ref FROM tx)"""


def _candidates(spark, d):
    k = F.col("id")
    shift = F.when(k % 4 == 1, 1).when(k % 4 == 2, 5).otherwise(0)
    return transactions(spark, d).select("id", F.date_add("date", shift).alias("date"), "transaction_type", "amount", "account_from", "account_to", F.when(k % 8 == 5, F.col("source_refs")).otherwise(F.concat(F.lit("import:none:"), k.cast("string"))).alias("source_ref"))


SIDES = """own AS (SELECT id AS match, date, transaction_type, amount, account_from AS account FROM tx WHERE NOT is_deleted AND account_from <> '' UNION SELECT id, date, transaction_type, amount, account_to FROM tx WHERE NOT is_deleted AND account_to <> ''),
cs AS (SELECT id, date, transaction_type, amount, account_from AS account FROM cands WHERE account_from <> '' UNION SELECT id, date, transaction_type, amount, account_to FROM cands WHERE account_to <> '')"""
TIERS = """tiers AS (SELECT id, min(struct_pack(r := rank, m := match)) AS b FROM (SELECT c.id, 1 AS rank, t.id AS match FROM cands c JOIN tx t ON NOT t.is_deleted AND t.source_refs = c.source_ref
  UNION ALL SELECT c.id, CASE WHEN c.date = o.date AND c.transaction_type = o.transaction_type THEN 2 ELSE 3 END, o.match FROM cs c JOIN own o ON o.amount = c.amount AND o.account = c.account AND o.date BETWEEN c.date - 1 AND c.date + 1) GROUP BY id)"""


@query(_with(["tx"], [CAND, SIDES, TIERS], "SELECT c.id, CASE b.r WHEN 1 THEN 'SourceRef' WHEN 2 THEN 'Exact' WHEN 3 THEN 'Probable' ELSE 'None' END AS tier, b.m AS matched_id FROM cands c LEFT JOIN tiers USING (id)"))
def duplicate_tiers(spark, d):
    return G.duplicate_tiers(_candidates(spark, d), transactions(spark, d))


@query(_with(["tx"], [CAND, SIDES, TIERS], "SELECT CAST(c.id % 7 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN b.r IS NULL OR b.r = 3 THEN 1 ELSE 0 END) AS BIGINT) AS parsed, CAST(sum(CASE WHEN b.r < 3 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate, CAST(0 AS BIGINT) AS error FROM cands c LEFT JOIN tiers USING (id) GROUP BY 1"))
def import_batch_stats(spark, d):
    t = G.duplicate_tiers(_candidates(spark, d), transactions(spark, d))
    return G.import_stats(t.select((F.col("id") % 7).alias("batch"), F.when(F.col("tier").isin("SourceRef", "Exact"), "duplicate").otherwise("parsed").alias("outcome")))


KINDS = ["MERCHANT_PAYMENT", "TOPUP", "CASH_WITHDRAWAL", "OWN_TRANSFER", "INVESTMENT_MOVEMENT", "EXTERNAL_TRANSFER", "FAILED_ATTEMPT"]
#: Evidence of every ledger row, a few days off and with a kind, reference, merchant and category by its id.
EVID = f"""evid AS (SELECT id, date + CAST(id % 6 AS INTEGER) - 3 AS date, CASE WHEN id % 10 = 9 THEN amount + 1 ELSE amount END AS amount, {_list(KINDS)}[id % {len(KINDS)} + 1] AS event_kind, CASE WHEN id % 13 = 0 THEN 'Ignore' ELSE 'Expense' END AS financial_class,
  CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'TRX#99812' ELSE 'R' || id END AS reference, CASE id % 5 WHEN 0 THEN 'Kopi' WHEN 1 THEN 'padang' ELSE 'unknown shop' END AS merchant, CASE WHEN id % 4 = 0 THEN 'Health' ELSE '' END AS category FROM tx)"""
#: The ledger with every tenth row booked twice.
BOOKED = "booked AS (SELECT id, date, transaction_type, amount, account_from, account_to, category, description FROM tx WHERE NOT is_deleted UNION ALL SELECT id + 1000000000, date, transaction_type, amount, account_from, account_to, category, description FROM tx WHERE NOT is_deleted AND id % 10 = 3)"
MATCHED = """ruled AS (SELECT e.id, t.id AS ledger_id, t.date AS day, CASE
  WHEN e.event_kind IN ('TOPUP', 'CASH_WITHDRAWAL', 'OWN_TRANSFER') AND t.transaction_type = 'Expense' THEN 'CLASSIFICATION_CONFLICT'
  WHEN e.event_kind = 'INVESTMENT_MOVEMENT' AND t.transaction_type IN ('Expense', 'Income') THEN 'CLASSIFICATION_CONFLICT'
  WHEN t.date = e.date AND (e.reference <> '' AND contains(t.description, e.reference) OR contains(lower(t.description), lower(e.merchant)) OR e.reference = '') THEN CASE WHEN t.category <> '' AND e.category <> '' AND t.category <> e.category THEN 'CATEGORY_CONFLICT' ELSE 'MATCHED_EXACT' END
  WHEN abs(t.date - e.date) <= 1 THEN 'MATCHED_LIKELY' END AS match_class
  FROM evid e JOIN booked t ON t.amount = e.amount AND t.date BETWEEN e.date - 2 AND e.date + 2 WHERE e.financial_class <> 'Ignore'),
decided AS (SELECT id, ledger_id, match_class FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day, ledger_id) AS rn FROM ruled WHERE match_class IS NOT NULL) WHERE rn = 1),
matched AS (SELECT e.id AS evidence_id, d.ledger_id, coalesce(d.match_class, CASE WHEN EXISTS (SELECT 1 FROM ruled r WHERE r.id = e.id) THEN 'AMBIGUOUS' ELSE 'EMAIL_EVENT_MISSING_FROM_LEDGER' END) AS match_class FROM evid e LEFT JOIN decided d USING (id) WHERE e.financial_class <> 'Ignore')"""
REPEATED = "repeated AS (SELECT count(*) AS n FROM booked GROUP BY date, transaction_type, amount, account_from, account_to HAVING count(*) > 1)"


def _evidence(spark, d):
    k = F.col("id")
    return transactions(spark, d).select("id", F.date_add("date", (k % 6 - 3).cast("int")).alias("date"), F.when(k % 10 == 9, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(18,2)").alias("amount"), F.element_at(F.array(*map(F.lit, KINDS)), (k % len(KINDS) + 1).cast("int")).alias("event_kind"),
                                         F.when(k % 13 == 0, "Ignore").otherwise("Expense").alias("financial_class"), F.when(k % 3 == 0, "").when(k % 3 == 1, "TRX#99812").otherwise(F.concat(F.lit("R"), k.cast("string"))).alias("reference"),
                                         F.when(k % 5 == 0, "Kopi").when(k % 5 == 1, "padang").otherwise("unknown shop").alias("merchant"), F.when(k % 4 == 0, "Health").otherwise("").alias("category"))


def _booked(spark, d):
    t = L.live(transactions(spark, d)).select("id", *G.LEDGER_KEY, "category", "description")
    return t.unionByName(t.filter("id % 10 = 3").withColumn("id", F.col("id") + 1000000000))


@query(_with(["tx"], [EVID, BOOKED, MATCHED], "SELECT evidence_id, ledger_id, match_class FROM matched"))
def ledger_evidence_match(spark, d):
    return G.match_evidence(_evidence(spark, d), _booked(spark, d))


@query(_with(["tx"], [EVID, BOOKED, MATCHED, REPEATED, "counted AS (SELECT match_class, count(*) AS n FROM matched GROUP BY 1 UNION ALL SELECT 'LEDGER_EVENT_WITHOUT_EMAIL_EVIDENCE', count(*) FROM booked b WHERE NOT EXISTS (SELECT 1 FROM decided d WHERE d.ledger_id = b.id) UNION ALL SELECT 'POSSIBLE_LEDGER_DUPLICATE', sum(n - 1) FROM repeated)"],
    f"SELECT match_class, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest({_list(G.AUDIT_CLASSES)}) AS match_class) LEFT JOIN counted USING (match_class)"))
def match_histogram(spark, d):
    return G.audit(_evidence(spark, d), _booked(spark, d))


@query(_with(["tx"], [EVID, BOOKED, MATCHED], "SELECT id, date FROM booked b WHERE NOT EXISTS (SELECT 1 FROM decided d WHERE d.ledger_id = b.id)"))
def ledger_without_evidence(spark, d):
    return _booked(spark, d).select("id", "date").join(ledger_evidence_match(spark, d).select(F.col("ledger_id").alias("id")), "id", "left_anti")


@query(_with(["tx"], [BOOKED, REPEATED], "SELECT CAST(count(*) AS BIGINT) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra FROM repeated"))
def ledger_duplicate_groups(spark, d):
    return G.duplicate_groups(_booked(spark, d)).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))


@query(_with(["raws"], [MSG, CLASSED, RULE, EVENTS], "SELECT id FROM events_ e WHERE NOT EXISTS (SELECT 1 FROM events_ k WHERE k.reference = e.reference AND k.id <> e.id AND e.reference <> '') AND reference <> ''"))
def evidence_orphans(spark, d):
    e = G.classify(messages(spark, d)).filter("reference != ''").select("id", "reference")
    lone = e.groupBy("reference").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1")
    return lone.select("id")


@query(_with(["raws"], [MSG, CLASSED, RULE, EVENTS], "SELECT reference, CAST(count(DISTINCT event_kind || '|' || financial_class || '|' || coalesce(CAST(amount AS VARCHAR), '')) AS BIGINT) AS kinds FROM events_ WHERE reference <> '' GROUP BY reference HAVING count(DISTINCT event_kind || '|' || financial_class || '|' || coalesce(CAST(amount AS VARCHAR), '')) > 1"))
def canonical_conflicts(spark, d):
    e = G.classify(messages(spark, d)).filter("reference != ''")
    kind = F.concat_ws("|", "event_kind", "financial_class", F.coalesce(F.col("amount").cast("string"), F.lit("")))
    return e.groupBy("reference").agg(F.countDistinct(kind).alias("kinds")).filter("kinds > 1")


FPRINT = "sha256(concat_ws('|', strftime(date, '%Y-%m-%d'), substr(time, 1, 5), account_from, account_to, transaction_type, CAST(amount AS VARCHAR), regexp_replace(lower(description), '[^a-z0-9]', '', 'g')))"


@query(with_tables("tx", body=f"SELECT fingerprint, min(id) AS id, CAST(count(*) AS BIGINT) AS n FROM (SELECT {FPRINT} AS fingerprint, id FROM tx WHERE NOT is_deleted) GROUP BY fingerprint"))
def fingerprint_dedupe(spark, d):
    c = F.col
    t = L.live(transactions(spark, d)).select(T.fingerprint(c("date"), c("time"), c("account_from"), c("account_to"), c("transaction_type"), c("amount"), c("description")).alias("fingerprint"), "id")
    return t.groupBy("fingerprint").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query(with_tables("tx", body=f"SELECT {normalize_sql('description')} AS merchant, CAST(count(*) AS BIGINT) AS n FROM tx GROUP BY 1"))
def normalize_merchant(spark, d):
    return transactions(spark, d).groupBy(T.normalize_merchant("description").alias("merchant")).agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, trim(substr(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{T.CARD}', '•••• \\1\\2\\3\\4', 'g'), '{T.CODES}', '\\1: [REDACTED]', 'g'), '{T.SECRETS}', '\\1: [REDACTED]', 'g'), 1, 2000)) AS redacted FROM documents""")
def redact_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.redact("text").alias("redacted"))


AMOUNTS = ["Rp67.821,80", "IDR 67,821.80", "67821", "DB 50.000,00", "1.418.000,00", "no amount", "12,5", "7.5", "1.000"]
_N = r"regexp_replace(regexp_extract(s, '(-?\d[\d.,]*)', 1), '[.,]+$', '')"


@query(f"""WITH x AS (SELECT event_id AS id, {_list(AMOUNTS)}[event_id % {len(AMOUNTS)} + 1] AS s FROM events), y AS (SELECT id, {_N} AS n FROM x)
SELECT id, CAST(TRY_CAST(CASE WHEN contains(n, '.') AND contains(n, ',') AND instr(reverse(n), ',') < instr(reverse(n), '.') THEN replace(replace(n, '.', ''), ',', '.') WHEN contains(n, '.') AND contains(n, ',') THEN replace(n, ',', '')
WHEN regexp_full_match(n, '-?\\d+,\\d{{1,2}}') THEN replace(n, ',', '.') WHEN regexp_full_match(n, '-?\\d+\\.\\d{{1,2}}') THEN n ELSE replace(replace(n, '.', ''), ',', '') END AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM y""")
def parse_amount(spark, d):
    s = F.element_at(F.array(*map(F.lit, AMOUNTS)), (F.col("event_id") % len(AMOUNTS) + 1).cast("int"))
    return read(spark, d, "events").select(F.col("event_id").alias("id"), M.parse_amount(s).cast("double").alias("amount"))


NAMES = ["BCA Main", "RDN Stockbit", "Receivable: Budi", "SeaBank", "Toko Maju", "Jago: Liburan", "Own Account", "shopee pay", "Poket: Umrah", "tunai"]


@query("SELECT c_custkey AS id, CASE WHEN regexp_matches(n, 'Stockbit|RDN|Sekuritas|Investasi') THEN 'Investment' WHEN starts_with(n, 'Receivable:') THEN 'Receivable' WHEN starts_with(n, 'Suspense:') OR n IN (" + ", ".join(f"'{x}'" for x in T.HELD) + ") THEN 'Suspense' WHEN " + " OR ".join(f"starts_with(n, '{x}')" for x in T.OWNED)
       + " THEN 'Owned' ELSE 'External' END AS kind, substr(n, 1, 3) || '***' AS masked, CASE WHEN contains(l, 'shopee') THEN 'ShopeePay' WHEN contains(l, 'gopay') THEN 'GoPay' WHEN contains(l, 'jago') THEN 'Jago Main' WHEN contains(l, 'poket') THEN 'BCA Poket: ' || coalesce(nullif(trim(split_part(n, ':', 2)), ''), 'Tabungan') WHEN contains(l, 'bca') THEN 'BCA Main'"
       + f" WHEN contains(l, 'cash') OR contains(l, 'tunai') THEN 'Cash' WHEN contains(l, 'rdn') OR contains(l, 'stockbit') THEN 'RDN Stockbit' ELSE n END AS canonical FROM (SELECT *, lower(n) AS l FROM (SELECT c_custkey, {_list(NAMES)}[c_custkey % {len(NAMES)} + 1] AS n FROM customer))")
def account_kind_infer(spark, d):
    n = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("c_custkey") % len(NAMES) + 1).cast("int"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.account_kind(n).alias("kind"), T.mask_account(n).alias("masked"), T.canonical_account(n).alias("canonical"))


@query("""SELECT conv_id, CAST(count(*) AS BIGINT) AS n, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id""")
def chat_history(spark, d):
    c = read(spark, d, "conversations")
    w = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(w, lambda s: s["role"]), ">").alias("roles"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN length(html) > 2000 THEN 1 ELSE 0 END) AS BIGINT) AS over_cap FROM pages GROUP BY 1""")
def page_hosts(spark, d):
    return read(spark, d, "pages").groupBy(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host")).agg(F.count("*").alias("n"), F.sum((F.length("html") > 2000).cast("long")).alias("over_cap"))


@query(with_tables("raws", body="""SELECT source, CAST(date_trunc('day', ts) AS DATE) AS day, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN late THEN 1 ELSE 0 END) AS BIGINT) AS late FROM (SELECT *, id % 10 = 0 AS late FROM raws) GROUP BY 1, 2"""))
def daily_ingest_windows(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return raw_events(spark, d).groupBy("source", w.alias("w")).agg(F.count("*").alias("n"), F.sum((F.col("id") % 10 == 0).cast("long")).alias("late")).select("source", F.col("w.start").cast("date").alias("day"), "n", "late")


@query(with_tables("raws", body="""SELECT id, CASE WHEN gap IS NULL OR gap > 3600 THEN TRUE ELSE FALSE END AS opens FROM (SELECT id, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id), ts) AS gap FROM raws)"""))
def activity_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    second = epoch("ts").cast("long")  # the gap counts the seconds that begin within it, as SQL does, not whole ones that have gone by
    return raw_events(spark, d).select("id", F.coalesce(second - F.lag(second).over(w) > 3600, F.lit(True)).alias("opens"))


# A ledger row stands for a message: its account is the thread, reversals from 1997 on are messages that fail.
@query(with_tables("tx", body=f"""SELECT * EXCLUDE (stop_month, stop_page) FROM (SELECT month, page, threads, messages, failed,
  CASE WHEN stop_month IS NULL OR (month, page) < (stop_month, stop_page) THEN 'done' WHEN month = stop_month AND page = stop_page THEN 'stopped' ELSE 'waiting' END AS outcome,
  CASE WHEN (month, page) >= (stop_month, stop_page) THEN stop_month WHEN threads = {B.PAGE} THEN month ELSE strftime(CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') END AS next_month,
  CAST(CASE WHEN (month, page) >= (stop_month, stop_page) THEN stop_page * {B.PAGE} WHEN threads = {B.PAGE} THEN (page + 1) * {B.PAGE} ELSE 0 END AS BIGINT) AS next_offset, stop_month, stop_page
  FROM (SELECT *, first_value(CASE WHEN failed > 0 THEN month END) OVER w AS stop_month, first_value(CASE WHEN failed > 0 THEN page END) OVER w AS stop_page FROM (
    SELECT month, CAST(place // {B.PAGE} AS BIGINT) AS page, CAST(count(*) AS BIGINT) AS threads, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(failed) AS BIGINT) AS failed FROM (
      SELECT *, row_number() OVER (PARTITION BY month ORDER BY newest DESC, thread) - 1 AS place FROM (
        SELECT strftime(created_at, '%Y-%m') AS month, coalesce(nullif(account_from, ''), account_to) AS thread, max(created_at) AS newest, count(*) AS messages, sum(CASE WHEN reversal_of_id IS NOT NULL AND date >= DATE '1997-01-01' THEN 1 ELSE 0 END) AS failed
        FROM tx WHERE money_context <> 'Third-party' AND strftime(created_at, '%Y-%m') BETWEEN '1993-01' AND '1998-12' GROUP BY 1, 2)) GROUP BY 1, 2)
    WINDOW w AS (ORDER BY failed = 0, month, page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))"""))
def backfill_progress(spark, d):
    t = transactions(spark, d)
    thread = F.coalesce(F.nullif("account_from", F.lit("")), "account_to")
    failed = F.col("reversal_of_id").isNotNull() & (F.col("date") >= F.lit("1997-01-01").cast("date"))
    messages = t.select(thread.alias("thread"), F.col("created_at").alias("ts"), (F.col("money_context") != "Third-party").alias("trusted"), failed.alias("failed"))
    return B.progress(B.page_plan(messages), "1993-01", "1998-12")
