"""Sources and sinks of the ledger: CSV, JSON lines, SQL dumps, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT_COLUMNS = ["id", "date", "time", "transaction_type", "amount", "account_from", "account_to", "description", "category", "for_with_whom", "money_context", "status", "budget_effect", "budget_rule_version", "source_refs"]
SEED_SCHEMA = "canonical_id string, date string, time string, transaction_type string, amount string, account_from string, account_to string, description string, category string, status string"


def read_seed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Seed rows: a header and an optional byte order mark; unknown types become Expense, amounts absolute, dates null if invalid; the first row of a canonical_id stays, in the order of its columns."""
    raw = spark.read.csv(path, header=True, schema=SEED_SCHEMA, encoding="UTF-8", enforceSchema=True)
    kind = F.when(F.col("transaction_type").isin("Income", "Expense", "Transfer", "Adjustment"), F.col("transaction_type")).otherwise("Expense")
    df = raw.withColumns({"canonical_id": F.regexp_replace("canonical_id", "^﻿", ""), "date": F.col("date").try_cast("date"), "transaction_type": kind, "amount": F.abs(F.col("amount").try_cast("decimal(18,2)")), "status": F.coalesce(F.nullif("status", F.lit("")), F.lit("Confirmed"))})
    rest = [c for c in df.columns if c != "canonical_id"]
    return df.groupBy("canonical_id").agg(F.min(F.struct(*rest)).alias("r")).select("canonical_id", "r.*")


def write_export_csv(tx: DataFrame, path: str, single_file: bool = False) -> None:
    """Ordered export with a header. The rows are range-partitioned by date, so the parts are in order; one file only on request."""
    out = tx.filter("not is_deleted").select(*EXPORT_COLUMNS).orderBy("date", "time", "id")
    (out.coalesce(1) if single_file else out).write.mode("overwrite").csv(path, header=True)


def sql_literal(column: str, kind: str) -> Column:
    """A SQL literal: NULL, a number, or a quoted string."""
    c = F.col(column)
    text = c.cast("string") if kind in ("bigint", "int", "double", "boolean") or kind.startswith("decimal") else F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One idempotent INSERT per row."""
    values = F.concat_ws(", ", *[sql_literal(c, t) for c, t in df.dtypes])
    return df.select(F.concat(F.lit(f"INSERT OR IGNORE INTO {table} ({', '.join(df.columns)}) VALUES ("), values, F.lit(");")).alias("sql"))


def write_sql_dump(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table's INSERTs (in the given order, which respects foreign keys) and returns a manifest (position, table, rows, digest).

    The digest is the sum of row hashes, which needs no order.
    """
    manifest = None
    for i, (name, df) in enumerate(tables.items()):
        lines = insert_statements(df, name)
        lines.write.mode("overwrite").text(f"{path}/{i:02d}_{name}")
        row = lines.agg(F.lit(i).alias("position"), F.lit(name).alias("table"), F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64("sql").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))
        manifest = row if manifest is None else manifest.unionByName(row)
    return manifest


def snapshot(df: DataFrame, root: str, version: int, keep: int = 20) -> None:
    """Writes a numbered Parquet copy and removes all but the newest `keep`, through Hadoop's file system."""
    df.write.mode("overwrite").parquet(f"{root}/v={version:010d}")
    jvm = df.sparkSession._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    for old in sorted(str(s.getPath()) for s in fs.listStatus(base) if s.getPath().getName().startswith("v="))[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def payload(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns as one JSON text, without the body and subject of a message."""
    return df.select("*", F.to_json(F.struct(*columns)).alias("payload"))


def read_payload(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Fields of a JSON text column; a text that is no object gives nulls."""
    return df.withColumn("_p", F.from_json(column, schema)).select("*", "_p.*").drop("_p")


def merge_state(state: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert of sync state: the newest row of each key."""
    both = state.unionByName(updates)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
