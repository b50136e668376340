"""Text columns: redaction, merchant normalization, category inference, fingerprints. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading verbs of a payment description.
VERBS = ["transfer ke", "transfer dari", "top up", "bayar", "beli", "pembayaran", "terima", "pemberian"]

# What is removed from the lower-case description, in this order (dates, ISO dates, times, references, amounts, tags).
NOISE = [
    r"\b\d{1,2}[/-]\d{1,2}([/-]\d{2,4})?\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}[:.]\d{2}([:.]\d{2})?\b", r"\b(trx|ref|id|rek|va|no|bca|gopay|spay|shopee|ovo|dana)?\s*#?\d{5,}\b", r"rp\s*[\d.,]+", r"\[.*?\]",
]

OTHER = "Other / Miscellaneous"
# Spending categories.
CATEGORIES = ["Main Meals", "Snacks", "Cafe & Drinks", "Groceries & Daily Needs", "Fuel", "Parking/Toll", "Transport / Other Transport", "Vehicle Service", "Fashion", "Electronics", "Personal Care", "Health", "Education",
              "Campus & Organization", "Phone & Internet", "Subscriptions", "Gifts & Giving", "Travel", OTHER, "Research — Historical Only"]

# Keyword groups of three dialects, the first group with a keyword in the text decides. Ledger rows (upper case):
LEDGER_KEYWORDS = [
    ("Groceries & Daily Needs", ["INDOMARET", "IDM INDOMA", "ALFAMART", "ALFAMIDI"]),
    ("Fuel", ["SPBU", "PERTAMINA"]),
    ("Phone & Internet", ["TELKOMSEL", "BY.U", "BYU", "XL AXIATA", "INDOSAT", "SMARTFREN"]),
    ("Subscriptions", ["SPOTIFY", "NETFLIX", "YOUTUBE PREMIUM", "ICLOUD"]),
    ("Cafe & Drinks", ["COFFEE", "KOPI", "BOBA", "CHATIME", "MIXUE", "ROTI O"]),
    ("Main Meals", ["KANTIN", "WARTEG", "RESTAU", "BAKPAO", "HISANA", "SOTO ", "BAKSO", "NASI ", "AYAM ", "STEAK", "BURGER", "BENTO"]),
]
# Messages (lower case):
MESSAGE_KEYWORDS = [
    ("Main Meals", ["warung mbak yani", "kantin arsitektur", "resto", "makan", "padang"]),
    ("Cafe & Drinks", ["uta ngopi", "kopi studio24", "kopi", "cafe", "coffee", "chatime"]),
    ("Fuel", ["spbu", "pertamina", "shell", "bensin", "pertalite", "pertamax"]),
    ("Phone & Internet", ["xl", "by.u", "telkomsel", "indosat", "tri", "pulsa", "kuota"]),
    ("Education & Career", ["fotocopy sarjana", "fotokopi", "print", "percetakan", "buku", "gramedia"]),
    ("Parking/Toll", ["parkir", "parking", "tol", "etoll"]),
    ("Subscriptions", ["google play", "subscription", "spotify", "netflix", "youtube"]),
]
# Drafts as they are typed (lower case):
DRAFT_KEYWORDS = [
    ("Main Meals", ["makan", "nasi", "ayam", "warteg", "restoran", "lunch", "dinner", "sarapan"]),
    ("Snacks", ["snack", "camilan", "roti", "kue", "martabak", "pisang"]),
    ("Cafe & Drinks", ["kopi", "kafe", "boba", "teh", "jus", "drink", "starbucks", "kenangan"]),
    ("Groceries & Daily Needs", ["belanja", "indomaret", "alfa", "supermarket", "sabun", "shampoo", "beras", "minyak"]),
    ("Fuel", ["bensin", "pertamax", "pertalite", "spbu", "bbm", "shell"]),
    ("Parking/Toll", ["parkir", "tol", "e-toll"]),
    ("Transport / Other Transport", ["gojek", "grab", "gocar", "goride", "bus", "tiket", "kereta", "travel", "ojek"]),
    ("Phone & Internet", ["pulsa", "kuota", "internet", "indihome", "by.u", "telkomsel", "xl", "tri"]),
    ("Subscriptions", ["netflix", "spotify", "youtube", "chatgpt", "langganan"]),
    ("Vehicle Service", ["servis", "bengkel", "oli", "ban", "cuci motor", "cuci mobil"]),
    ("Health", ["obat", "apotek", "dokter", "vitamin", "kesehatan"]),
]
# Card numbers (the last four digits stay), one-time codes, secrets.
CARD = r"\b(?:\d[ -]*?){9,15}(\d)[ -]*?(\d)[ -]*?(\d)[ -]*?(\d)\b"
CODES = r"(?i)\b(otp|kode verifikasi|verification code|one time password)[:\s]*([0-9]{4,8})\b"
SECRETS = r"(?i)\b(token|bearer|password|pin|secret)[:\s]*([a-zA-Z0-9_\-.]{6,})\b"
# Prefixes of owned accounts, and names that are held in suspense.
OWNED = ["BCA Main", "BCA Poket:", "Cash", "ShopeePay", "GoPay", "Jago:", "Jago Main"]
HELD = ["Own Account", "Unknown Payment Account", "SeaBank"]
# Labels.
CONTEXT_LABELS = {"Personal": "Pribadi", "Pass-through": "Uang Titipan / Uang Lewat", "Historical Research": "Riwayat Dana Riset"}
STATUS_LABELS = {"Confirmed": "Terkonfirmasi", "Auto-classified": "Diklasifikasikan Otomatis", "Provisional Neutral": "Belum Jelas - Tidak Dihitung"}


def normalize_merchant(description: Column | str) -> Column:
    """Counterparty words: without the leading verb, dates, times, references, amounts, tags, and tokens of digits or one letter."""
    c = F.trim(F.lower(F.coalesce(F.col(description) if isinstance(description, str) else description, F.lit(""))))
    c = F.regexp_replace(c, "^(" + "|".join(VERBS) + r")\s+", "")
    c = reduce(lambda x, p: F.regexp_replace(x, p, ""), NOISE, c)
    return F.array_join(F.filter(F.split(F.regexp_replace(c, r"[^a-z0-9\s]", " "), r"\s+"), lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d+$")), " ")


def redact(text: Column | str, most: int = 2000) -> Column:
    """Card numbers keep their last four digits; one-time codes and secrets go; at most `most` characters are kept. Null becomes empty."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    c = F.regexp_replace(c, CARD, "•••• $1$2$3$4")
    c = F.regexp_replace(F.regexp_replace(c, CODES, "$1: [REDACTED]"), SECRETS, "$1: [REDACTED]")
    return F.trim(F.substring(c, 1, most))


def keyword_category(text: Column, groups: list[tuple[str, list[str]]], other: str | None = OTHER) -> Column:
    """The first group with a keyword in the text."""
    out = F.lit(other)
    for name, words in reversed(groups):
        out = F.when(reduce(lambda a, b: a | b, [text.contains(w) for w in words]), name).otherwise(out)
    return out


def infer_category(description: Column, category: Column, subtype: Column | None = None) -> Column:
    """The given category, unless it is blank or a catch-all: then by keywords of the description."""
    words = F.upper(F.concat_ws(" ", F.coalesce(description, F.lit("")), subtype if subtype is not None else F.lit("")))
    given = F.coalesce(category, F.lit(""))
    return F.when(~given.isin("", OTHER, "Lain-lain"), given).otherwise(F.coalesce(keyword_category(words, LEDGER_KEYWORDS, None), F.nullif(given, F.lit("")), F.lit(OTHER)))


def label(value: Column, labels: dict[str, str]) -> Column:
    """The label of a value, the value itself if it has none, a dash if it is blank."""
    named = F.lit(None).cast("string")
    for k, v in labels.items():
        named = F.when(value == k, v).otherwise(named)
    return F.coalesce(named, F.nullif(value, F.lit("")), F.lit("-"))


def canonical_account(name: Column) -> Column:
    """The account an alias names, by the words in it; the name itself if none is known."""
    n = F.lower(F.trim(name))
    part = F.coalesce(F.nullif(F.trim(F.split_part(name, F.lit(":"), F.lit(2))), F.lit("")), F.lit("Tabungan"))
    return (F.when(n.contains("shopee"), "ShopeePay").when(n.contains("gopay"), "GoPay").when(n.contains("jago"), "Jago Main").when(n.contains("poket"), F.concat(F.lit("BCA Poket: "), part)).when(n.contains("bca"), "BCA Main")
            .when(n.contains("cash") | n.contains("tunai"), "Cash").when(n.contains("rdn") | n.contains("stockbit"), "RDN Stockbit").otherwise(name))


def fingerprint(date: Column, time: Column, source: Column, target: Column, kind: Column, amount: Column, description: Column) -> Column:
    """SHA-256 over the identifying fields of a candidate; the description counts by its letters and digits only."""
    words = F.regexp_replace(F.lower(F.coalesce(description, F.lit(""))), "[^a-z0-9]", "")
    return F.sha2(F.concat_ws("|", F.date_format(date, "yyyy-MM-dd"), F.substring(F.coalesce(time, F.lit("")), 1, 5), F.coalesce(source, F.lit("")), F.coalesce(target, F.lit("")), kind, amount.cast("decimal(18,2)").cast("string"), words), 256)


def mask_account(name: Column) -> Column:
    """The first three characters."""
    return F.concat(F.substring(name, 1, 3), F.lit("***"))


def account_kind(name: Column) -> Column:
    """Kind by name: Investment goes before Receivable, Suspense, Owned, External."""
    n = F.trim(F.coalesce(name, F.lit("")))
    owned = reduce(lambda a, b: a | b, [n.startswith(p) for p in OWNED])
    return (F.when(n.rlike("Stockbit|RDN|Sekuritas|Investasi"), "Investment").when(n.startswith("Receivable:"), "Receivable").when(n.startswith("Suspense:") | n.isin(*HELD), "Suspense").when(owned, "Owned").otherwise("External"))
