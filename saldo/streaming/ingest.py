"""Structured Streaming: message ingestion, replay guard, freshness, bounded backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.operators import ingest as G
from saldo.operators.guard import hmac_sha256

MESSAGE = "message_id string, source string, sender string, subject string, body string, ts timestamp, nonce string"


def read_messages(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """JSON message files as a stream, a bounded number of files a micro-batch."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", per_trigger).json(path)


def guard_replays(messages: DataFrame, ttl: str = "10 minutes") -> DataFrame:
    """Each nonce once within the time to live; state leaves with the watermark."""
    return messages.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["nonce"])


def in_window(messages: DataFrame, start: str, end: str) -> DataFrame:
    """Messages of [start, end) only: those outside a backfill's month are left for their own."""
    return messages.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))


def ingest(messages: DataFrame, table: str, checkpoint: str, trigger: dict | None = None):
    """Classifies messages and appends canonical events to a Parquet folder by batch.

    Events have deterministic ids. A batch writes its own subfolder and overwrites it, so a repeated batch leaves the same
    rows; a message that an earlier batch has is left out by an anti-join on its key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = G.classify(batch).withColumn("event_id", G.event_key(F.col("source"), F.col("message_id"))).withColumn("status", G.auto_approve(F.col("confidence"), F.col("amount"), F.col("event_kind"), F.col("financial_class")))
        rows = G.first_seen(rows, ["event_id"], ["ts"]).filter("outcome = 'new'").drop("outcome", "body", "subject")
        try:
            earlier = spark.read.parquet(table).filter(F.col("batch") < batch_id).select("event_id")
            rows = rows.join(earlier, "event_id", "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def source_freshness(messages: DataFrame) -> DataFrame:
    """Newest event time and number of messages by source, kept up to date."""
    return messages.groupBy("source").agg(F.max("ts").alias("last_event"), F.count("*").alias("n"))


def daily_counts(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """Messages a day and source; a day closes when the watermark passes it."""
    return messages.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "source").agg(F.count("*").alias("n"))


def signed(rows: DataFrame, secret: str) -> DataFrame:
    """Adds `signature_ok`: whether `signature` is the HMAC-SHA256 of ts.nonce.body."""
    return rows.withColumn("signature_ok", F.coalesce(F.lower("signature") == hmac_sha256(secret, F.concat_ws(".", F.col("ts").cast("string"), "nonce", "body")), F.lit(False)))


def precheck(*conditions: tuple[bool, str]) -> None:
    """Refuses to start a query while a condition fails (poison latch, closed month, schema)."""
    failed = [why for ok, why in conditions if not ok]
    if failed:
        raise RuntimeError("ingestion is blocked: " + "; ".join(failed))
