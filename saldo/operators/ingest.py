"""Ingestion: parsers, classification of notifications, tiers of duplicates, correlation of evidence, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions.money import MONEY, parse_amount

# Rules of the notification classifier, the first that holds decides. (sender part, text pattern in RE2 and
# Java syntax over the lower-case subject and body, event kind, financial class, confidence, evidence role)
RULES = [
    ("bca.co.id", r"status transaksi\s*:?\s*gagal|transaksi gagal|transaksi ditolak|gagal", "FAILED_ATTEMPT", "Ignore", 0.99, "LIFECYCLE_STATUS"),
    ("bca.co.id", r"tarik tunai|cardless withdrawal", "CASH_WITHDRAWAL", "Cash Withdrawal", 0.95, "PRIMARY_PAYMENT"),
    ("bca.co.id", r"poket", "ALLOCATION_MOVEMENT", "Internal Transfer", 0.95, "PRIMARY_PAYMENT"),
    ("bca.co.id", r"transfer qris", "EXTERNAL_TRANSFER", "Pending Review", 0.80, "PRIMARY_PAYMENT"),
    ("bca.co.id", r"pembayaran qris", "MERCHANT_PAYMENT", "Expense", 0.95, "PRIMARY_PAYMENT"),
    ("bca.co.id", r"qris", "MERCHANT_PAYMENT", "Pending Review", 0.50, "PRIMARY_PAYMENT"),
    ("bca.co.id", r"shopeepay|airpay|122", "TOPUP", "Top-up", 0.95, "PRIMARY_PAYMENT"),
    ("bca.co.id", r"jago|artos", "OWN_TRANSFER", "Internal Transfer", 0.95, "PRIMARY_PAYMENT"),
    ("bca.co.id", r"transfer dari|kredit|masuk", "INCOMING_TRANSFER", "Pending Review", 0.60, "PRIMARY_PAYMENT"),
    ("bca.co.id", r"", "EXTERNAL_TRANSFER", "Pending Review", 0.60, "PRIMARY_PAYMENT"),
    ("jago.com", r"rdn|stockbit", "INVESTMENT_MOVEMENT", "Investment Movement", 0.95, "PRIMARY_PAYMENT"),
    ("jago.com", r"shopeepay|airpay", "OWN_TRANSFER", "Internal Transfer", 0.95, "PRIMARY_PAYMENT"),
    ("jago.com", r"merchant|pembayaran berhasil", "MERCHANT_PAYMENT", "Expense", 0.95, "PRIMARY_PAYMENT"),
    ("jago.com", r"uang masuk|transfer dari", "INCOMING_TRANSFER", "Pending Review", 0.60, "PRIMARY_PAYMENT"),
    ("jago.com", r"", "EXTERNAL_TRANSFER", "Pending Review", 0.60, "PRIMARY_PAYMENT"),
    ("flip.id", r"", "EXTERNAL_TRANSFER", "Pending Review", 0.75, "INTERMEDIARY"),
    ("googleplay-noreply@google.com", r"cancell?ed|dibatalkan|declined|ditolak", "NON_TRANSACTION", "Ignore", 0.99, "LIFECYCLE_STATUS"),
    ("googleplay-noreply@google.com", r"", "DIGITAL_PURCHASE", "Expense", 0.95, "PRIMARY_PAYMENT"),
    ("cx.byu.id", r"", "NON_TRANSACTION", "Ignore", 0.95, "LIFECYCLE_STATUS"),
    ("byu.id", r"kuota kamu habis|kuota aktif", "NON_TRANSACTION", "Ignore", 0.95, "LIFECYCLE_STATUS"),
    ("byu.id", r"", "DIGITAL_PURCHASE", "Expense", 0.95, "PRIMARY_PAYMENT"),
    ("mailer-esb.com", r"", "INVOICE_EVIDENCE", "Expense", 0.90, "SECONDARY_RECEIPT"),
    ("shopee.co.id", r"dikirim|dalam perjalanan|pesanan diterima|sudahkah menerima", "NON_TRANSACTION", "Ignore", 0.95, "LIFECYCLE_STATUS"),
    ("shopee.co.id", r"", "INVOICE_EVIDENCE", "Expense", 0.90, "INVOICE"),
    ("", r"", "NON_TRANSACTION", "Pending Review", 0.20, "PRIMARY_PAYMENT"),
]
# Where an amount stands in a message, tried in this order.
AMOUNT_AT = [r"(?i)(?:total pembayaran|total|nominal|sebesar|jumlah|amount|bayar)\s*:?\s*(?:rp\.?|idr)?\s*([\d.,]*\d)", r"(?i)(?:rp\.?|idr)\s*([\d.,]*\d)", r"\b([\d.,]*\d)\b"]
OPERATION_STATUSES = ("Approved", "Rejected")


def amount_text(body: Column) -> Column:
    """The number in a message, as it is written; null if there is none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(body, p, 1), F.lit("")) for p in AMOUNT_AT])


def amount_value(raw: Column) -> Column:
    """DECIMAL(18,2) of a written number above zero, else null."""
    value = (F.when(raw.rlike(r",\d{2}$"), F.translate(F.regexp_replace(raw, r"\.", ""), ",", ".")).when(raw.rlike(r"\.\d{2}$"), F.regexp_replace(raw, ",", "")).otherwise(F.regexp_replace(raw, "[.,]", ""))).try_cast(MONEY)
    return F.nullif(F.greatest(value, F.lit(0).cast(MONEY)), F.lit(0).cast(MONEY))


def message_amount(body: Column) -> Column:
    """The amount named in a message, null if there is none above zero."""
    return amount_value(amount_text(body))


def reference(body: Column) -> Column:
    """Transaction or order reference, empty if none."""
    return F.regexp_extract(body, r"(?i)(?:no\.?\s*referensi|no\.?\s*ref|reference|order id|no\.?\s*pesanan|id transaksi)\s*:?\s*([a-zA-Z0-9.\-]+)", 1)


def classify(messages: DataFrame) -> DataFrame:
    """Adds event_kind, financial_class, confidence, evidence_role, amount and reference to rows (sender, subject, body)."""
    sender, text = F.lower("sender"), F.lower(F.concat_ws(" ", "subject", "body"))
    rule = F.lit(len(RULES))
    for i, (part, pattern, *_) in reversed(list(enumerate(RULES, 1))):
        rule = F.when(sender.contains(part) & (text.rlike(pattern) if pattern else F.lit(True)), i).otherwise(rule)
    staged = messages.withColumn("_rule", rule).withColumn("_raw", amount_text(F.col("body")))  # used several times below, computed once
    value = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in RULES]), F.col("_rule"))
    amount = F.when(value(2) != "NON_TRANSACTION", amount_value(F.col("_raw")))
    made = F.struct(value(2).alias("event_kind"), value(3).alias("financial_class"), value(4).alias("confidence"), value(5).alias("evidence_role"), amount.alias("amount"), reference(F.col("body")).alias("reference"))
    return staged.select(*messages.columns, F.inline(F.array(made)))  # a generator: later filters see its columns, not the rules again


def auto_approve(conf: Column, amount: Column, kind: Column, financial_class: Column) -> Column:
    """Ignored, AutoApproved for confident amounts with a clear class, else Pending."""
    return F.when(financial_class == "Ignore", "Ignored").when((conf >= 0.85) & (amount > 0) & (financial_class != "Pending Review") & kind.isNotNull(), "AutoApproved").otherwise("Pending")


def event_key(source: Column, external_id: Column) -> Column:
    """Deterministic id of a canonical event."""
    return F.substring(F.sha2(F.concat(source, F.lit("|"), external_id), 256), 1, 32)


def parse_bank_mail(payload: Column, account: str, inflow: str, default: str) -> Column:
    """Candidate struct of a bank or wallet notification; JSON payloads by field, others by pattern; null without amount or date."""
    is_json = F.trim(payload).startswith("{")
    js = lambda k: F.get_json_object(payload, f"$.{k}")
    raw = F.regexp_extract(payload, r"(?i)(?:sebesar|nominal|jumlah|rp\.?|idr)\s*(?:rp\.?\s*)?([0-9.,]+)", 1)
    date = F.regexp_extract(payload, r"\b(202[0-9]-[0-1][0-9]-[0-3][0-9])\b", 1)
    time = F.coalesce(F.nullif(F.regexp_extract(payload, r"\b([0-2][0-9]:[0-5][0-9])\b", 1), F.lit("")), F.lit("12:00"))
    kind = F.when(is_json, F.coalesce(js("type"), F.lit("Expense"))).when(payload.rlike(inflow), "Income").otherwise("Expense")
    found = F.trim(F.regexp_extract(payload, r"(?i)\b(?:di|ke|merchant|penerima|keterangan)[:\s]+([^,.\n]+?)(?:\s+sebesar\b|[,.\n]|$)", 1))
    desc = F.coalesce(F.when(is_json, js("description")), F.nullif(found, F.lit("")), F.lit(default))
    amount = F.when(is_json, parse_amount(js("amount"))).otherwise(parse_amount(raw))
    own = F.coalesce(F.when(is_json, js("account")), F.lit(account))
    day = F.when(is_json, js("date")).otherwise(date).try_cast("date")
    made = F.struct(day.alias("date"), F.when(is_json, F.coalesce(js("time"), F.lit("12:00"))).otherwise(time).alias("time"), kind.alias("transaction_type"), amount.alias("amount"), F.when(kind == "Income", "").otherwise(own).alias("account_from"),
                    F.when(kind == "Income", own).otherwise("").alias("account_to"), desc.alias("description"), F.lit("high").alias("confidence"))
    return F.when(day.isNotNull() & amount.isNotNull(), made)


def parse_csv_line(payload: Column) -> Column:
    """Candidate struct of `date,type,amount,account[,description[,category]]`."""
    p = F.transform(F.split(payload, ","), F.trim)
    at = lambda i, other=None: F.coalesce(F.nullif(F.get(p, i), F.lit("")), F.lit(other))
    kind = F.when(at(1).isin("Income", "Expense", "Transfer", "Adjustment"), at(1)).otherwise("Expense")
    made = F.struct(at(0).try_cast("date").alias("date"), F.lit("12:00").alias("time"), kind.alias("transaction_type"), parse_amount(at(2)).alias("amount"), F.when(kind.isin("Expense", "Transfer"), at(3)).otherwise("").alias("account_from"),
                    F.when(kind == "Income", at(3)).otherwise("").alias("account_to"), at(4, "Impor CSV").alias("description"), F.lit("high").alias("confidence"))
    return F.when(F.size(p) >= 4, made)


def parse_items(items: DataFrame) -> DataFrame:
    """Raw items (provider, payload, ..) with a `candidate` struct by the first parser that takes the provider."""
    p, payload = F.lower("provider"), F.col("payload")
    made = (F.when(p.isin("bca_email", "bca", "bca_qris"), parse_bank_mail(payload, "BCA Main", r"(?i)\b(dana masuk|cr|credit|transfer masuk|terima)\b", "Transaksi BCA"))
            .when(p.isin("shopeepay_email", "shopeepay", "shopee"), parse_bank_mail(payload, "ShopeePay", r"(?i)\b(top up|isi saldo|terima)\b", "Pembayaran ShopeePay"))
            .when(p.isin("jago_email", "jago", "bank_jago") & F.trim(payload).startswith("{"), parse_bank_mail(payload, "Bank Jago", r"(?i)\bmasuk\b", "Transaksi Jago"))
            .when(p.isin("csv_generic", "csv", "csv_import"), parse_csv_line(payload)))
    return items.withColumn("candidate", made)


def sides(rows: DataFrame, prefix: str = "") -> DataFrame:
    """One row for each account a row touches."""
    return rows.withColumn("account", F.explode(F.array_distinct(F.filter(F.array(f"{prefix}account_from", f"{prefix}account_to"), lambda a: F.coalesce(a, F.lit("")) != ""))))


def duplicate_tiers(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, tier, matched_id) for candidates (id, date, transaction_type, amount, account_from, account_to, source_ref).

    SourceRef: the reference stands in the ledger. Exact: date, type, amount and an account agree. Probable: amount and an
    account agree within a day. Otherwise None. Each tier is an equi-join (references parsed to keys, amounts as decimals,
    days exploded); the smallest matching ledger id counts.
    """
    tx = ledger.filter("not is_deleted")
    refs = tx.select(F.explode(F.split("source_refs", r"[;|]")).alias("source_ref"), F.col("id").alias("match"))
    by_ref = candidates.select("id", "source_ref").join(refs, "source_ref").select("id", F.lit(1).alias("rank"), "match")
    own = sides(tx.select(F.col("id").alias("match"), "date", "transaction_type", "amount", "account_from", "account_to")).select("match", "date", "transaction_type", "amount", "account")
    c = sides(candidates).select("id", F.col("date").alias("day"), F.col("transaction_type").alias("kind"), "amount", "account")
    # Only the smallest id of each type can win: four rows at most for a (date, amount, account), before days are exploded.
    firsts = own.groupBy("date", "amount", "account", "transaction_type").agg(F.min("match").alias("match"))
    near = c.withColumn("date", F.explode(F.array(F.date_sub("day", 1), F.col("day"), F.date_add("day", 1)))).join(firsts, ["date", "amount", "account"])
    by_fact = near.select("id", F.when((F.col("date") == F.col("day")) & (F.col("kind") == F.col("transaction_type")), 2).otherwise(3).alias("rank"), "match")
    best = by_ref.unionByName(by_fact).groupBy("id").agg(F.min(F.struct("rank", "match")).alias("b"))
    tier = F.when(F.col("b.rank") == 1, "SourceRef").when(F.col("b.rank") == 2, "Exact").when(F.col("b.rank") == 3, "Probable").otherwise("None")
    return candidates.select("id").join(best, "id", "left").select("id", tier.alias("tier"), F.col("b.match").alias("matched_id"))


def first_seen(rows: DataFrame, keys: list[str], order: list[str], state: DataFrame | None = None) -> DataFrame:
    """The first row of each key, `outcome` new or duplicate; keys that `state` has are duplicates, too."""
    df = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    known = F.lit(False)
    if state is not None:
        df = df.join(state.select(*keys).distinct().withColumn("_known", F.lit(True)), keys, "left")
        known = F.coalesce("_known", F.lit(False))
    out = df.withColumn("outcome", F.when(known | (F.col("_rn") > 1), "duplicate").otherwise("new")).drop("_rn")
    return out.drop("_known") if state is not None else out


def correlate(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, matched_event, matched_by, compatible): the canonical event each incoming row belongs to.

    Looked for by transaction reference, then order id, then event id. A row of independent payment evidence must agree
    with the event in kind, class, amount, and merchant where both name one; otherwise it is a conflict. Empty keys match nothing.
    """
    want = incoming.select("id", "event_kind", "financial_class", "amount", "evidence_role", "merchant", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("by"), F.col(n).alias("key")) for i, n in enumerate(("reference", "order_id", "event_id"), 1)])).alias("k")).filter("coalesce(k.key, '') != ''").select("*", "k.rank", "k.by", "k.key").drop("k")
    have = existing.select("event_id", F.col("event_kind").alias("e_kind"), F.col("financial_class").alias("e_class"), F.col("amount").alias("e_amount"), F.col("merchant").alias("e_merchant"), F.explode(F.array(*[F.struct(F.lit(n).alias("by"), F.col(n).alias("key")) for n in ("reference", "order_id", "event_id")])).alias("k")).select("*", "k.by", "k.key").drop("k").filter("coalesce(key, '') != ''")
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+", " ")), F.lit(""))
    same = (F.col("event_kind") == F.col("e_kind")) & (F.col("financial_class") == F.col("e_class")) & (F.col("amount").cast(MONEY) == F.col("e_amount").cast(MONEY)) & F.coalesce(clean("merchant") == clean("e_merchant"), F.lit(True))
    ok = (F.col("evidence_role") != "PRIMARY_PAYMENT") | F.coalesce(same, F.lit(False))
    # Only the first event of a key can win, so that the join meets one row a key.
    fields = ["event_id", "e_kind", "e_class", "e_amount", "e_merchant"]
    have = have.groupBy("by", "key").agg(F.min(F.struct(*fields)).alias("first")).select("by", "key", *[F.col(f"first.{c}").alias(c) for c in fields])
    best = want.join(have, ["by", "key"]).groupBy("id").agg(F.min(F.struct("rank", "event_id", "by", ok.alias("ok"))).alias("m"))
    return incoming.select("id").join(best, "id", "left").select("id", F.col("m.event_id").alias("matched_event"), F.col("m.by").alias("matched_by"), F.col("m.ok").alias("compatible"))


# The classes of the audit of evidence against the ledger; the two that no rule gives stay at zero.
AUDIT_CLASSES = ["MATCHED_EXACT", "MATCHED_LIKELY", "EMAIL_EVENT_MISSING_FROM_LEDGER", "LEDGER_EVENT_WITHOUT_EMAIL_EVIDENCE", "POSSIBLE_LEDGER_DUPLICATE", "PARTIAL_TRANSFER_MATCH", "CLASSIFICATION_CONFLICT",
                 "CATEGORY_CONFLICT", "AMOUNT_CONFLICT", "AMBIGUOUS"]
LEDGER_KEY = ["date", "transaction_type", "amount", "account_from", "account_to"]


def match_evidence(evidence: DataFrame, ledger: DataFrame) -> DataFrame:
    """(evidence_id, ledger_id, match_class) of evidence (id, date, amount, event_kind, financial_class, reference, merchant, category).

    Candidates are ledger rows (id, date, transaction_type, amount, category, description) of the same amount within two days, by
    date and id. The first decides of which a rule holds: a move between own accounts booked as an expense, or an investment
    booked as income or expense, is a CLASSIFICATION_CONFLICT; on the same date, with the reference or the merchant in the
    description or without a reference, it is MATCHED_EXACT, or a CATEGORY_CONFLICT where both name another category; within a
    day it is MATCHED_LIKELY. Candidates but no rule: AMBIGUOUS; no candidate: EMAIL_EVENT_MISSING_FROM_LEDGER. Ignored and
    failed events have no row.

    Two days off only the first row that conflicts can decide, nearer the first row of the day always does. So the ledger is
    reduced to one row for each date and amount, and evidence meets five of them at most.
    """
    kind = F.col("transaction_type")
    first = F.min(F.struct("id", "transaction_type", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("description", F.lit("")).alias("note")))
    days = ledger.groupBy(F.col("date").alias("day"), "amount").agg(first.alias("c"), F.min(F.when(kind == "Expense", F.col("id"))).alias("expense"), F.min(F.when(kind.isin("Expense", "Income"), F.col("id"))).alias("booked"))
    e = evidence.filter(~F.coalesce(F.col("financial_class").isin("Ignore", "NON_TRANSACTION", "FAILED_ATTEMPT"), F.lit(False)))
    e = e.select("id", "date", "amount", "event_kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("reference", "merchant", "category")])
    near = e.withColumn("day", F.explode(F.sequence(F.date_sub("date", 2), F.date_add("date", 2)))).join(days, ["day", "amount"])
    own, invested = F.col("event_kind").isin("TOPUP", "CASH_WITHDRAWAL", "OWN_TRANSFER"), F.col("event_kind") == "INVESTMENT_MOVEMENT"
    off = F.abs(F.datediff("day", "date"))
    conflict = F.coalesce((own & (F.col("c.transaction_type") == "Expense")) | (invested & F.col("c.transaction_type").isin("Expense", "Income")), F.lit(False))
    named = ((F.col("reference") != "") & F.col("c.note").contains(F.col("reference"))) | F.lower("c.note").contains(F.lower("merchant")) | (F.col("reference") == "")
    other = (F.col("c.category") != "") & (F.col("category") != "") & (F.col("c.category") != F.col("category"))
    far = F.when(own, F.col("expense")).when(invested, F.col("booked"))
    name = F.when((off == 2) | conflict, "CLASSIFICATION_CONFLICT").when((off == 0) & named, F.when(other, "CATEGORY_CONFLICT").otherwise("MATCHED_EXACT")).otherwise("MATCHED_LIKELY")
    found = F.when(off < 2, F.col("c.id")).otherwise(far)
    best = near.groupBy("id").agg(F.min(F.when(found.isNotNull(), F.struct(F.col("day").alias("day"), found.alias("ledger_id"), name.alias("match_class")))).alias("b"), F.lit(True).alias("some"))
    match = F.when(F.col("some").isNull(), "EMAIL_EVENT_MISSING_FROM_LEDGER").otherwise(F.coalesce("b.match_class", F.lit("AMBIGUOUS")))
    return e.select("id").join(best, "id", "left").select(F.col("id").alias("evidence_id"), F.col("b.ledger_id").alias("ledger_id"), match.alias("match_class"))


def audit(evidence: DataFrame, ledger: DataFrame) -> DataFrame:
    """(match_class, n) for each of AUDIT_CLASSES: matches of the evidence, ledger rows that none matched, and repeated ledger rows."""
    matched = match_evidence(evidence, ledger)
    alone = ledger.select("id").join(matched.select(F.col("ledger_id").alias("id")), "id", "left_anti").agg(F.lit("LEDGER_EVENT_WITHOUT_EMAIL_EVIDENCE").alias("match_class"), F.count("*").alias("n"))
    again = duplicate_groups(ledger).agg(F.lit("POSSIBLE_LEDGER_DUPLICATE").alias("match_class"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    n = matched.groupBy("match_class").agg(F.count("*").alias("n")).unionByName(alone).unionByName(again)
    names = ledger.sparkSession.createDataFrame([(c,) for c in AUDIT_CLASSES], "match_class string")
    return names.join(n, "match_class", "left").select("match_class", F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_groups(ledger: DataFrame) -> DataFrame:
    """Ledger rows that agree in date, type, amount and both accounts: the key and how many there are, two at least."""
    return ledger.groupBy(*LEDGER_KEY).agg(F.count("*").alias("n")).filter("n > 1")


def review(actions: DataFrame) -> DataFrame:
    """Outcome of each review action (callback_id, candidate_id, action, ts): the first terminal action of a candidate is
    applied, the same one again is idempotent, the opposite one locked; a repeated callback is a replay of its first."""
    seen = Window.partitionBy("callback_id").orderBy("ts", "candidate_id")
    first = Window.partitionBy("candidate_id").orderBy("replay", "ts", "callback_id")
    df = actions.withColumn("replay", F.row_number().over(seen) > 1)
    df = df.withColumn("winner", F.first("action").over(first)).withColumn("rn", F.row_number().over(first))
    out = F.when(F.col("replay"), "replay").when(F.col("rn") == 1, "applied").when(F.col("action") == F.col("winner"), "idempotent").otherwise("locked")
    return df.withColumn("outcome", out).drop("winner", "rn", "replay")


def import_stats(outcomes: DataFrame) -> DataFrame:
    """Counts by batch: total, parsed, duplicate (with exact ones), error."""
    n = lambda c: F.sum(c.cast("long"))
    o = F.col("outcome")
    return outcomes.groupBy("batch").agg(F.count("*").alias("total"), n(o == "parsed").alias("parsed"), n(o == "duplicate").alias("duplicate"), n(o == "error").alias("error"))


def repair_queue(evidence: DataFrame, bad_events: DataFrame, payloads: DataFrame) -> DataFrame:
    """Evidence still attached to a bad event, with the checks that a repair needs: known payload, same hash, an amount, one event each."""
    queue = evidence.join(bad_events.select("event_id").distinct(), "event_id", "left_semi")
    df = queue.join(payloads, "raw_id", "left").withColumn("copies", F.count("*").over(Window.partitionBy("raw_id")))
    code = F.when(F.col("payload").isNull(), "MISSING_PAYLOAD").when(F.sha2("payload", 256) != F.col("payload_hash"), "HASH_MISMATCH").when(message_amount(F.col("payload")).isNull(), "NO_AMOUNT").when(F.col("copies") > 1, "AMBIGUOUS")
    return df.withColumn("reject_code", code).withColumn("valid", code.isNull()).drop("copies")


# Senders whose messages are evidence of payments, and those that only accompany them.
PRIMARY_SENDERS = ["bca@bca.co.id", "noreply@jago.com", "no-reply@flip.id", "googleplay-noreply@google.com", "noreply@byu.id", "no-reply@mailer-esb.com"]
SECONDARY_SENDERS = ["info@shopee.co.id", "info@mail.shopee.co.id", "noreply@cx.byu.id"]
# Chat commands (kind, pattern, which group names the own account, the other one, the purpose).
COMMANDS = [
    ("Transfer", r"(?i)(?:transfer|tf)\s+([\d.,k]+)\s+(?:dari\s+)?([a-zA-Z0-9\s:]+?)\s+ke\s+([a-zA-Z0-9\s:]+)", 2, 3, 0),
    ("Expense", r"(?i)(?:keluar|bayar|beli)\s+([\d.,k]+)\s+(?:dari|pakai|via)\s+([a-zA-Z0-9\s:]+?)\s+(?:untuk|buat)\s+(.+)", 2, 0, 3),
    ("Income", r"(?i)(?:masuk|dapat|terima)\s+([\d.,k]+)\s+(?:ke|di)\s+([a-zA-Z0-9\s:]+?)(?:\s+dari\s+([a-zA-Z0-9\s]+?))?(?:\s+(?:untuk|buat)\s+(.+))?$", 2, 0, 4),
]


def sender_trust(header: Column) -> Column:
    """primary, secondary or none, by the exact address in a From header."""
    raw = F.regexp_extract(header, "<([^>]+)>", 1)
    address = F.lower(F.trim(F.when(raw == "", header).otherwise(raw)))
    return F.when(address.isin(*PRIMARY_SENDERS), "primary").when(address.isin(*SECONDARY_SENDERS), "secondary").otherwise("none")


def parse_command(text: Column) -> Column:
    """Struct (kind, amount, account, to_account, category, confidence, status) of a chat command; free text is an expense to review."""
    from saldo.functions import text as T

    c = F.trim(text)

    def chosen(values, other):
        out = other
        for (_, pattern, *_rest), v in reversed(list(zip(COMMANDS, values, strict=True))):
            out = F.when(c.rlike(pattern), v).otherwise(out)
        return out

    group = lambda i, empty: [F.trim(F.regexp_extract(c, k[1], k[i])) if k[i] else F.lit(empty) for k in COMMANDS]
    number = F.replace(F.lower(chosen([F.regexp_extract(c, k[1], 1) for k in COMMANDS], c)), F.lit("k"), F.lit("000"))
    amount = F.coalesce(message_amount(number), F.lit(0).cast(MONEY))
    kind = chosen([F.lit(k[0]) for k in COMMANDS], F.lit("Free"))
    raw = F.struct(kind.alias("kind"), amount.alias("amount"), chosen(group(2, None), F.lit("BCA Main")).alias("account"), chosen(group(3, None), F.lit(None)).cast("string").alias("to_account"), F.lower(chosen(group(4, ""), F.lit(""))).alias("words"))

    def finish(r):
        free, some = r["kind"] == "Free", r["amount"] > 0
        return F.struct(F.when(free, "Expense").otherwise(r["kind"]).alias("kind"), r["amount"].alias("amount"), T.canonical_account(r["account"]).alias("account"), T.canonical_account(r["to_account"]).alias("to_account"),
                        F.when(r["words"] == "", F.lit(T.OTHER)).otherwise(T.keyword_category(r["words"], T.MESSAGE_KEYWORDS)).alias("category"),
                        F.when(free, F.lit(0.3)).when(~some, F.lit(0.4)).when(r["kind"] == "Income", F.lit(0.90)).otherwise(F.lit(0.95)).alias("confidence"), F.when(some & ~free, "AutoApproved").otherwise("Pending").alias("status"))

    return F.transform(F.array(raw), finish)[0]  # bound once: the parts are not computed again in each branch


def to_candidate(events: DataFrame) -> DataFrame:
    """Candidate rows of classified events that move money: type by class and kind, nothing for ignored or zero ones."""
    kind = F.when(F.col("event_kind") == "INCOMING_TRANSFER", "Income").when(F.col("financial_class").isin("Internal Transfer", "Top-up", "Cash Withdrawal", "Investment Movement"), "Transfer").otherwise("Expense")
    keep = (F.col("financial_class") != "Ignore") & (F.col("amount") > 0) & ~F.col("evidence_role").isin("SECONDARY_RECEIPT", "INVOICE")
    return events.filter(keep).withColumn("transaction_type", kind)


def candidate_page(candidates: DataFrame, raws: DataFrame, status: str | None = None, batch: int | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Candidates with their raw event, newest first; limit at most 500, offset at least 0."""
    df = candidates if status is None else candidates.filter(F.col("review_status") == status)
    df = df if batch is None else df.filter(F.col("batch") == batch)
    return df.join(raws, "raw_id").orderBy(F.desc("id")).offset(max(0, offset)).limit(max(1, min(500, limit)))
