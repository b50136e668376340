"""Golden cases on rows of our own making."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from saldo.functions import money as M
from saldo.functions import text as T
from saldo.operators import commands as C
from saldo.operators import ingest as G
from saldo.operators import insights as I
from saldo.operators import ledger as L
from saldo.operators import obligations as O
from saldo.operators import reports as R

D = dt.date.fromisoformat
TX = "id long, date date, time string, transaction_type string, amount decimal(18,2), account_from string, account_to string, description string, category string, money_context string, status string, budget_effect decimal(18,2), exclude_from_budget boolean, budget_rule_version string, is_deleted boolean, created_at timestamp_ntz"


def tx(spark, *rows):
    base = dict(id=1, date=D("2026-08-22"), time="10:00", transaction_type="Expense", amount=Decimal(0), account_from="", account_to="", description="x", category="Other", money_context="Personal", status="Confirmed", budget_effect=Decimal(0), exclude_from_budget=False, budget_rule_version="derived", is_deleted=False, created_at=dt.datetime(2026, 8, 22, 12))
    return spark.createDataFrame([tuple((base | {"id": i} | r).values()) for i, r in enumerate(rows, 1)], TX)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "value"), [("Rp67.821,80", "67821.80"), ("Rp67.821", "67821"), ("IDR 67,821.80", "67821.80"), ("67821.80", "67821.80"), ("67821", "67821"), ("DB 50.000,00", "50000"), ("CR 100.000,00", "100000"), ("1.418.000,00", "1418000"), ("1.000", "1000"), ("1.000.000", "1000000"), ("1234,50", "1234.5"), ("-1.000.000", "-1000000")])
def test_amounts(spark, text, value):
    assert one(spark, M.parse_amount(F.lit(text))) == Decimal(value)


@pytest.mark.parametrize(("text", "want"), [
    ("Top up GoPay via BCA 06/08 14:30 ref #89281 Rp 50.000", "gopay via bca"), ("Bayar Bensin Pertamax Spbu 34 22-08-2026", "bensin pertamax spbu"), ("Transfer ke BCA Poket Tabungan [Rekonsiliasi]", "bca poket tabungan"),
    ("Makan Siang Nasi Padang Sederhana", "makan siang nasi padang sederhana"), ("TRX#99812 Tagihan Listrik PLN 2026-08-20", "tagihan listrik pln"), ("#9981298 2026-08-22", "")])
def test_merchants(spark, text, want):
    assert one(spark, T.normalize_merchant(F.lit(text))) == want


def test_merchant_pairs(spark):
    n = lambda s: one(spark, T.normalize_merchant(F.lit(s)))
    assert n("PLN Postpaid Ref#881923") == n("PLN Postpaid TRX 002918")
    assert n("Kopi Kenangan") != n("Kopi Janji Jiwa") and n("Top up GoPay") != n("Top up ShopeePay")


def test_redaction(spark):
    out = one(spark, T.redact(F.lit("Kartu 4111 2222 3333 4444 dipakai. OTP: 981234. Token: eyJhbGciOiJIUzI1Ni.")))
    assert "•••• 4444" in out and "OTP: [REDACTED]" in out and "4111" not in out and "981234" not in out and "eyJ" not in out


def test_parsers(spark):
    rows = [("bca_email", "Pembayaran di Kafe Kopi Mantap sebesar Rp 45.000 pada 2026-08-25 14:00 WIB"), ("shopeepay", "Pembayaran sebesar Rp 25.500 berhasil pada 2026-08-25 10:15 WIB"), ("csv", "2026-08-25,Expense,120000,BCA Main,Beli Buku,Education"), ("jago", '{"type": "Income", "amount": "75000", "date": "2026-08-25"}'), ("bca", "no amount here"), ("other", "x")]
    got = [r.candidate for r in G.parse_items(spark.createDataFrame(rows, "provider string, payload string")).collect()]
    assert (got[0].amount, got[0].date, got[0].account_from, got[0].transaction_type) == (Decimal(45000), D("2026-08-25"), "BCA Main", "Expense")
    assert (got[1].amount, got[1].account_from) == (Decimal(25500), "ShopeePay")
    assert (got[2].amount, got[2].account_from, got[2].description) == (Decimal(120000), "BCA Main", "Beli Buku")
    assert (got[3].amount, got[3].account_to) == (Decimal(75000), "Bank Jago") and got[4] is None and got[5] is None


@pytest.mark.parametrize(("sender", "body", "kind", "group", "amount"), [
    ("x@bca.co.id", "Pembayaran QRIS berhasil Rp 25.000", "MERCHANT_PAYMENT", "Expense", 25000), ("x@bca.co.id", "QRIS Status Transaksi: Gagal Rp 25.000", "FAILED_ATTEMPT", "Ignore", 25000), ("x@bca.co.id", "Tarik tunai tanpa kartu Rp 100.000", "CASH_WITHDRAWAL", "Cash Withdrawal", 100000),
    ("x@bca.co.id", "Poket top up Rp 500.000", "ALLOCATION_MOVEMENT", "Internal Transfer", 500000), ("x@bca.co.id", "Transfer ke ShopeePay VA Rp 50.000", "TOPUP", "Top-up", 50000), ("a@jago.com", "ShopeePay ke Jago Rp 75.000", "OWN_TRANSFER", "Internal Transfer", 75000),
    ("a@jago.com", "Transfer ke RDN Stockbit Rp 1.000.000", "INVESTMENT_MOVEMENT", "Investment Movement", 1000000), ("googleplay-noreply@google.com", "Order total: Rp 29.000", "DIGITAL_PURCHASE", "Expense", 29000), ("info@byu.id", "Pembelian Rp 50.000", "DIGITAL_PURCHASE", "Expense", 50000),
    ("r@mailer-esb.com", "Total Rp 35.000", "INVOICE_EVIDENCE", "Expense", 35000), ("googleplay-noreply@google.com", "Your subscription to App 365 has been cancelled. Order id GPA.12", "NON_TRANSACTION", "Ignore", None), ("who@x.org", "hello", "NON_TRANSACTION", "Pending Review", None)])
def test_classification(spark, sender, body, kind, group, amount):
    r = G.classify(spark.createDataFrame([(sender, "note", body)], "sender string, subject string, body string")).first()
    assert (r.event_kind, r.financial_class) == (kind, group) and (r.amount == amount if amount else r.amount is None)


def test_balance_cases(spark):
    acc = spark.createDataFrame([(n, "Owned", Decimal(b) if b is not None else None, True) for n, b in (("A", 100000), ("B", 110000), ("C", 5), ("D", 125000), ("I", 100000), ("N", None))], "name string, kind string, current_balance decimal(18,2), active boolean")
    zero = dt.datetime(2026, 8, 22)
    snaps = spark.createDataFrame([(i, n, Decimal(100000), D("2026-08-22"), zero, "initial_anchor") for i, n in enumerate("ABDI")], "id long, account_name string, balance decimal(18,2), snapshot_date date, created_at timestamp_ntz, snapshot_kind string")
    t = tx(spark, dict(transaction_type="Income", amount=Decimal(25000), account_to="D", created_at=dt.datetime(2026, 8, 22, 0, 5)), dict(amount=Decimal(7), account_from="I", created_at=zero), dict(amount=Decimal(9), account_from="A", is_deleted=True))
    issues = {r.account: (r.issue, r.difference) for r in L.verify(L.reconstruct(acc, t, snaps)).collect()}
    assert issues == {"B": ("discrepancy", Decimal(-10000)), "C": ("unverifiable", None), "I": ("unverifiable", None)}


@pytest.mark.parametrize(("actual", "action"), [(150000, "ledger_adjusted"), (100000, "cache_repaired"), (130000, "ledger_adjusted")])
def test_reconcile(spark, actual, action):
    dec = lambda v: F.lit(Decimal(v)).cast("decimal(18,2)")
    assert one(spark, L.reconcile_action(dec(actual), dec(100000), dec(150000))) == action


def safe(spark, liquid, goals, debts, events, upcoming, allocations, pending):
    g = spark.createDataFrame(goals, "id long, status string, allocated_amount decimal(18,2)")
    u = spark.createDataFrame(upcoming, "id long, amount decimal(18,2), status string, reserve_now int, debt_id long, linked_goal_id long")
    a = spark.createDataFrame(allocations, "id long, amount decimal(18,2), status string, covers_upcoming_id long")
    ds = O.debt_status(spark.createDataFrame(debts, "id long, person_name string, kind string"), spark.createDataFrame(events, "debt_id long, effect int, amount decimal(18,2), event_type string"))
    row = lambda v, c: spark.createDataFrame([(Decimal(v),)], f"{c} decimal(18,2)")
    parts = O.effective_payables(ds, u, a).select("effective").unionByName(O.effective_commitments(O.covered_upcoming(u, a, g)).select("effective"))
    custody = ds.filter("kind = 'Custody' and status = 'Active'").agg(F.coalesce(F.sum("outstanding"), F.lit(0)).alias("custody"))
    return O.safe_to_spend(row(liquid, "total").withColumn("complete", F.lit(True)), g.filter("status = 'Active'").agg(F.coalesce(F.sum("allocated_amount"), F.lit(0)).alias("allocated")), custody, parts.agg(F.coalesce(F.sum("effective"), F.lit(0)).alias("commitments")), row(pending, "pending")).first()


def test_safe_to_spend(spark):
    n = Decimal
    r = safe(spark, 15_000_000, [(1, "Active", n(3_000_000)), (2, "Active", n(2_000_000))], [(10, "a", "Custody"), (20, "b", "Receivable"), (30, "c", "Payable")], [(10, 1, n(1_000_000), "Opening"), (20, 1, n(750_000), "Opening"), (30, 1, n(4_000_000), "Opening")],
             [(101, n(1_000_000), "Upcoming", 0, 30, None), (102, n(1_500_000), "Upcoming", 0, None, 2), (103, n(800_000), "Tentative", 0, None, None), (104, n(400_000), "Tentative", 1, None, None), (105, n(600_000), "Upcoming", 0, None, None)], [(1, n(500_000), "Active", 101)], 250_000)
    assert (r.allocated, r.custody, r.commitments, r.pending, r.safe_to_spend, r.state) == (5_000_000, 1_000_000, 4_500_000, 250_000, 4_250_000, "Terkendali")
    r = safe(spark, 10_000_000, [(1, "Active", n(1_000_000))], [(1, "a", "Custody")], [(1, 1, n(0), "Opening")], [(1, n(1_000_000), "Upcoming", 0, None, 1)], [(9, n(1), "Spent", 1)], 0)
    assert (r.commitments, r.safe_to_spend) == (0, 9_000_000)


def test_budget_effect(spark):
    t = tx(spark, dict(budget_rule_version="legacy", amount=Decimal(100000), budget_effect=Decimal(25000)), dict(budget_rule_version="legacy", amount=Decimal(50000)), dict(amount=Decimal(75000)), dict(amount=Decimal(75000), exclude_from_budget=True), dict(amount=Decimal(75000), money_context="Third-party"))
    assert [r.x for r in t.orderBy("id").select(L.budget_spend().alias("x")).collect()] == [25000, 0, 75000, 0, 0]


@pytest.mark.parametrize(("month", "spent", "remaining", "want"), [("2026-07", 310000, 0, (0, 0, 10000)), ("2026-08", 230000, 90000, (9, 10000, 10000)), ("2026-08", 230000, -90000, (9, -10000, 10000)), ("2026-09", 300000, 300000, (30, 10000, 10000))])
def test_calendar(spark, month, spent, remaining, want):
    c = R.calendar_metrics(F.lit(float(spent)), F.lit(float(remaining)), F.lit(month), F.lit("2026-08-23").cast("date"))
    r = spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    assert (r.days_left, r.safe_daily, r.daily_average) == want


def series(spark, *rows):
    return spark.createDataFrame([(i, D(d), Decimal(a), "m") for i, (d, a) in enumerate(rows)], "id long, date date, amount decimal(18,2), merchant string")


@pytest.mark.parametrize(("rows", "as_of", "want"), [
    ([(f"2026-0{m}-10", 100000) for m in (5, 6, 7, 8)], "2026-08-25", ("high", 4)), ([("2026-01-31", 1), ("2026-02-28", 1), ("2026-03-31", 1), ("2026-04-30", 1)], "2026-05-15", ("high", 4)),
    ([("2026-08-01", 20000), ("2026-08-05", 50000), ("2026-08-10", 95000), ("2026-08-15", 35000)], "2026-08-25", ("medium", 4)), ([("2026-08-01", 45000), ("2026-08-09", 45000)], "2026-08-25", ("low", 2)),
    ([("2026-08-10", 60000), ("2026-08-20", 60000), ("2026-08-30", 60000)], "2026-08-25", ("low", 2))])
def test_recurrence(spark, rows, as_of, want):
    r = I.recurring(series(spark, *rows), ["merchant"], as_of).first()
    assert (r.confidence, r.support) == want and r.next_date >= D(as_of) and (r.pattern == "Abstain") == (want[0] == "low")


@pytest.mark.parametrize("amounts", [(50000, 50000, 50000, 120000), (20000, 22000, 21000, 150000)])
def test_anomalies(spark, amounts):
    rows = [(f"2026-08-{10 + i}", a) for i, a in enumerate(amounts)]
    assert [r.amount for r in I.anomalies(series(spark, *rows), ["merchant"], "2026-08-25").collect()] == [amounts[-1]]


@pytest.mark.parametrize(("values", "least", "want"), [("AA", 0.8, None), ("AAAB", 0.8, None), ("AAAA", 0.8, ("A", 1.0)), ("AABB", 0.5, None)])
def test_suggestions(spark, values, least, want):
    df = spark.createDataFrame([("m", v) for v in values], "merchant string, category string")
    got = [(r.suggested, r.confidence) for r in I.suggest(df, ["merchant"], "category", 3, least).collect()]
    assert got == ([want] if want else [])


def test_duplicate_tiers(spark):
    led = tx(spark, dict(amount=Decimal(50000), account_from="BCA", date=D("2026-08-20"))).withColumn("source_refs", F.lit("import:1:bca:x"))
    c = spark.createDataFrame([(1, D("2026-08-20"), "Expense", Decimal(50000), "BCA", "", "n"), (2, D("2026-08-21"), "Expense", Decimal(50000), "BCA", "", "n"), (3, D("2026-08-25"), "Expense", Decimal(50000), "BCA", "", "n"), (4, D("2026-01-01"), "Income", Decimal(1), "", "Z", "import:1:bca:x")], "id long, date date, transaction_type string, amount decimal(18,2), account_from string, account_to string, source_ref string")
    assert {r.id: r.tier for r in G.duplicate_tiers(c, led).collect()} == {1: "Exact", 2: "Probable", 3: "None", 4: "SourceRef"}


def test_bulk_approval(spark):
    df = spark.createDataFrame([(1, "Pending", "high", "None", Decimal(10000), "a"), (2, "Pending", "low", "None", Decimal(20000), "b"), (3, "Pending", "high", "Probable", Decimal(30000), "c")], "id long, review_status string, confidence string, duplicate_status string, amount decimal(18,2), account string")
    r = C.approval_summary(C.bulk_approve(df)).first()
    assert (r.approved_count, r.total, r.accounts, r.skipped) == (1, 10000, ["a"], 2)


def test_debt_commands_and_payment(spark):
    ev = spark.createDataFrame([(1, 1, Decimal(100), "Opening", "k0"), (2, 1, Decimal(100), "Opening", "j0")], "debt_id long, effect int, amount decimal(18,2), event_type string, operation_key string")
    debts = spark.createDataFrame([(1, "a", "Custody"), (2, "b", "Payable")], "id long, person_name string, kind string")
    rows = [(1, 1, "Settlement", 60, "k1"), (2, 1, "Settlement", 60, "k1"), (3, 1, "WriteOff", 1, "k2"), (4, 1, "Settlement", 60, "k3"), (5, 9, "Settlement", 1, "k4"), (6, 1, "Increase", 1, "k0"),
            (7, 1, "Settlement", 40, "k3"), (8, 1, "Increase", 0, None), (9, 2, "Settlement", 80, "j1"), (10, 2, "Settlement", 70, "j1"), (11, 2, "WriteOff", 30, None), (12, 1, "Increase", 5, None), (13, 1, "Settlement", 5, None)]
    req = spark.createDataFrame([(a, b, c, Decimal(x), k) for a, b, c, x, k in rows], "request_no long, debt_id long, event_type string, amount decimal(18,2), operation_key string")
    covered = spark.createDataFrame([(2, Decimal(30))], "debt_id long, covered decimal(18,2)")
    got = {r.request_no: r.outcome for r in C.debt_commands(req, debts, O.outstanding(ev), ev, covered).collect()}
    assert got == {1: "applied", 2: "replay", 3: "not_allowed", 4: "exceeds", 5: "unknown_debt", 6: "replay", 7: "applied", 8: "amount", 9: "covered", 10: "applied", 11: "applied", 12: "applied", 13: "applied"}


def test_audit_of_evidence(spark):
    ledger = spark.createDataFrame([(1, D("2026-01-10"), "Expense", Decimal(50), "a", "", "Food", "Kopi TRX1"), (2, D("2026-01-10"), "Expense", Decimal(50), "a", "", "Food", "lain"), (3, D("2026-01-12"), "Income", Decimal(70), "", "a", "", "gaji"), (4, D("2026-01-20"), "Transfer", Decimal(9), "a", "b", "", "x"),
                                    (5, D("2026-01-20"), "Transfer", Decimal(9), "a", "b", "", "y")], "id long, date date, transaction_type string, amount decimal(18,2), account_from string, account_to string, category string, description string")
    rows = [(1, "2026-01-10", 50, "MERCHANT_PAYMENT", "Expense", "TRX1", "zzz", ""), (2, "2026-01-10", 50, "MERCHANT_PAYMENT", "Expense", "none", "zzz", ""), (3, "2026-01-12", 50, "TOPUP", "Top-up", "", "", ""), (4, "2026-01-12", 50, "MERCHANT_PAYMENT", "Expense", "", "", ""), (5, "2026-01-10", 50, "X", "Expense", "", "", "Fuel"),
            (6, "2026-01-11", 70, "INVESTMENT_MOVEMENT", "x", "", "", ""), (7, "2026-01-11", 70, "X", "x", "", "", ""), (8, "2026-02-01", 70, "X", "x", "", "", ""), (9, "2026-01-10", 50, "X", "Ignore", "", "", "")]
    ev = spark.createDataFrame([(i, D(d), Decimal(a), k, c, r, m, g) for i, d, a, k, c, r, m, g in rows], "id long, date date, amount decimal(18,2), event_kind string, financial_class string, reference string, merchant string, category string")
    got = {r.evidence_id: (r.ledger_id, r.match_class) for r in G.match_evidence(ev, ledger).collect()}
    assert got == {1: (1, "MATCHED_EXACT"), 2: (1, "MATCHED_LIKELY"), 3: (1, "CLASSIFICATION_CONFLICT"), 4: (None, "AMBIGUOUS"), 5: (1, "CATEGORY_CONFLICT"), 6: (3, "CLASSIFICATION_CONFLICT"), 7: (3, "MATCHED_LIKELY"), 8: (None, "EMAIL_EVENT_MISSING_FROM_LEDGER")}
    n = {r.match_class: r.n for r in G.audit(ev, ledger).collect()}
    assert n["POSSIBLE_LEDGER_DUPLICATE"] == 2 and n["LEDGER_EVENT_WITHOUT_EMAIL_EVIDENCE"] == 3 and n["AMOUNT_CONFLICT"] == 0 and set(n) == set(G.AUDIT_CLASSES)


def test_planned_and_estimated(spark):
    rows = [(f"m{i}", t, "Expense", D("2026-08-20"), 10.0, "high") for i, t in enumerate(["Bayar Netflix 22-08-2026", "Kopi", "Sewa kos"])]
    p = spark.createDataFrame(rows, "merchant string, title string, transaction_type string, next_date date, median_amount double, confidence string").withColumn("merchant", F.element_at(F.array(F.lit("netflix"), F.lit("kopi"), F.lit("kos")), F.substring("merchant", 2, 1).cast("int") + 1))
    up = spark.createDataFrame([(7, "Netflix keluarga", "Upcoming"), (9, "sewa", "Tentative"), (1, "kopi", "Paid")], "id long, title string, status string")
    got = I.planned(p, up)
    assert {r.merchant: r.upcoming_id for r in got.collect()} == {"netflix": 7, "kopi": None, "kos": 9}
    est = I.estimated_events(got, "2026-08-19", 7).collect()
    assert [(r.date, r.signed) for r in est] == [(D("2026-08-20"), Decimal("-10.00"))]


def test_review(spark):
    rows = [("c1", 1, "approve", 1), ("c1", 1, "approve", 2), ("c2", 1, "approve", 3), ("c3", 1, "reject", 4)]
    df = spark.createDataFrame(rows, "callback_id string, candidate_id long, action string, ts long")
    assert [r.outcome for r in G.review(df).orderBy("ts").collect()] == ["applied", "replay", "idempotent", "locked"]


def test_idr(spark):
    assert one(spark, M.idr(F.lit(Decimal("1234.50")))) == "Rp1.234,50" and one(spark, M.idr(F.lit(Decimal("-1234.00")))) == "-Rp1.234" and one(spark, M.idr(F.lit(None).cast("decimal(18,2)"))) == "—"
