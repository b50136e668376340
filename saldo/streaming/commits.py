"""Several tables written as one: a batch is there when its manifest is, and readers follow manifests only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saldo.operators.canonical import SCHEMAS, canonicalize

MANIFEST = "batch long, folder string"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(batch, folder) of the committed batches."""
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).json(f"{root}/manifests")


def read_committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of the committed batches with their `batch`."""
    done = {r.folder: r.batch for r in manifests(spark, root).collect()}  # one short row a batch
    rows = spark.createDataFrame([], f"{SCHEMAS[table]}, batch long")
    if not done:
        return rows
    paths = [f"{root}/{table}/{f}" for f in sorted(done)]
    folders = spark.createDataFrame([(f, b) for f, b in done.items()], "folder string, batch long")
    found = spark.read.schema(SCHEMAS[table]).parquet(*paths).withColumn("folder", F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1))
    return found.join(F.broadcast(folders), "folder").drop("folder")


def current_raws(spark: SparkSession, root: str) -> DataFrame:
    """The newest row of each raw message."""
    newest = Window.partitionBy("source", "external_id").orderBy(F.desc("batch"))
    return read_committed(spark, root, "raws").withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "batch")


def commit(spark: SparkSession, root: str, batch: int, tables: dict[str, DataFrame]) -> None:
    """Writes the tables into folders that nobody reads yet, then the manifest that names them, one file that appears whole."""
    folder = f"{batch:010d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}/{folder}")
    spark.createDataFrame([(batch, folder)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/manifests/{batch:010d}")


def canonical_sink(messages: DataFrame, root: str, checkpoint: str, trigger: dict | None = None, write=commit):
    """Canonicalizes a stream of messages batch by batch. A batch that was cut off leaves nothing that readers see, and is done again; one
    that was committed is not. Messages of a batch are taken in the order of ts, source and external_id."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not manifests(spark, root).filter(F.col("batch") == number).isEmpty():
            return
        # numbers by the rows' own order; a batch's rows are bounded by its trigger
        rows = batch.withColumn("n", F.row_number().over(Window.orderBy("ts", "source", "external_id")).cast("long"))
        write(spark, root, number, canonicalize(rows, current_raws(spark, root), read_committed(spark, root, "events").drop("batch"), read_committed(spark, root, "evidence").drop("batch")))

    messages.sparkSession.createDataFrame([], MANIFEST).write.mode("overwrite").json(f"{root}/manifests/start")  # the folder, without a row
    return messages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
