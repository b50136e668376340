"""Verification of signed requests: headers, freshness, HMAC, then the nonce, which only a verified request reserves."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, in milliseconds: how far a request's time may be off, and how long a nonce stays reserved.
TOLERANCE, RESERVED = 300_000, 600_000


def hmac_sha256(secret: str, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hex, of built-in functions: the padded keys are literals."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def check(rows: DataFrame, secret: str) -> DataFrame:
    """Adds `sent` (the milliseconds that a request names) and `fault`, the first check it fails, null if it is verified.

    Takes received (milliseconds), timestamp (text), nonce, body, signature. A timestamp counts as far as its leading digits go; what is
    signed is its text. A body that is null is empty.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    sent = F.regexp_extract("timestamp", r"^\s*([+-]?\d{1,18})", 1).try_cast("long")
    signed = hmac_sha256(secret, F.concat(F.col("timestamp"), F.lit("."), "nonce", F.lit("."), F.coalesce("body", F.lit(""))))
    off = F.abs(F.col("received") - F.col("sent")) > TOLERANCE
    fault = (F.when(F.lit(not secret.strip()), "UNCONFIGURED_SECRET").when(blank("signature") | blank("timestamp") | blank("nonce"), "MISSING_HEADERS").when(F.col("sent").isNull(), "INVALID_TIMESTAMP")
             .when(off, "EXPIRED_TIMESTAMP").when(F.lower("signature") != signed, "INVALID_SIGNATURE"))
    return rows.withColumn("sent", sent).withColumn("fault", fault)


def admits(reserved: int | None, received: int) -> bool:
    """Whether a nonce whose newest reservation names this time may be used again."""
    return reserved is None or reserved < received - RESERVED


def _reserve(batches):
    """Outcomes of verified requests sorted by nonce and time of receipt: one reservation is held."""
    nonce, reserved = None, None
    for b in batches:
        out = []
        for n, at, sent in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("nonce", "received", "sent")], strict=True):
            if n != nonce:
                nonce, reserved = n, None
            ok = admits(reserved, at)
            reserved = sent if ok else reserved
            out.append("VALID" if ok else "NONCE_REPLAY")
        yield b.set_column(b.schema.get_field_index("fault"), "fault", pa.array(out, pa.string()))


def verify(rows: DataFrame, secret: str, order: list[str]) -> DataFrame:
    """Adds `outcome` to each request: VALID, the check it failed, or NONCE_REPLAY. Requests of a nonce are read by time of receipt, then `order`."""
    told = check(rows, secret)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema)
    verified = told.filter("fault is null").repartition("nonce").sortWithinPartitions("nonce", "received", *order).mapInArrow(_reserve, schema)
    return verified.unionByName(told.filter("fault is not null")).withColumnRenamed("fault", "outcome").drop("sent")
