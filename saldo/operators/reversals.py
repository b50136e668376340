"""Reversals of debt events: each event once, corrections never, each operation key once, with the cash going back."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saldo.operators.canonical import shared

#: Shuffle files of a step go when it has ended, not when the driver happens to collect what refers to them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def _folder(spark: SparkSession) -> str:
    return f"{shared(spark)}/reversals-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows written as compressed Parquet in the shared checkpoint folder and read again: a checkpoint takes several times the disk."""
    path = path or _folder(df.sparkSession)
    with cleaned(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop_open(spark: SparkSession, path: str) -> None:
    """Removes the requests that a step has left open, once the next step has been written: Spark names their folder so."""
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/outcome=__HIVE_DEFAULT_PARTITION__")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def _before(key: str, what: str) -> Column:
    """Whether a request of the same key that comes before is such a one."""
    return F.coalesce(F.max(F.expr(what)).over(Window.partitionBy(key).orderBy("request_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))


LIVE, WON = "outcome is null and not dead", "coalesce(outcome = 'applied', false)"


def _by_event(rows: DataFrame) -> DataFrame:
    """Settles what an event decides: its first request that no live one precedes is `replay` if its key is used, and `applied` if it needs no
    key or is first of it; all after an applied one are `reversed`."""
    rows = rows.withColumn("_won", _before("event_id", WON)).withColumn("_live", _before("event_id", LIVE))
    open_ = F.col("outcome").isNull()
    rows = rows.withColumn("event_first", F.col("event_first") | open_ & ~F.col("_won") & ~F.col("_live"))
    told = F.when(~open_, F.col("outcome")).when(F.col("_won"), "reversed").when(F.col("event_first") & F.col("dead"), "replay").when(F.col("event_first") & (F.col("operation_key").isNull() | F.col("key_first")), "applied")
    rows = rows.withColumn("outcome", told)
    return rows.withColumn("_won", _before("event_id", WON)).withColumn("outcome", F.when(open_ & F.col("_won"), "reversed").otherwise(F.col("outcome")))


def _by_key(rows: DataFrame) -> DataFrame:
    """Settles what a key decides: all after an applied request are dead, so `replay` where they are first of their event; the first that no live
    one precedes is `applied` if it is first of its event too."""
    open_ = F.col("outcome").isNull()
    dead = lambda df: df.withColumn("dead", F.col("dead") | open_ & _before("operation_key", WON))
    replay = F.when(open_ & F.col("event_first") & F.col("dead"), "replay")
    rows = dead(rows).withColumn("_live", _before("operation_key", LIVE)).withColumn("key_first", F.col("key_first") | F.expr(LIVE) & ~F.col("_live"))
    rows = rows.withColumn("outcome", F.coalesce("outcome", replay, F.when(F.col("event_first") & F.col("key_first"), "applied")))
    return dead(rows).withColumn("outcome", F.coalesce("outcome", replay))


def _step(rows: DataFrame, path: str) -> DataFrame:
    """Stores the outcomes of a step beside the requests that stay open; of refused requests only the number is kept."""
    kept = lambda c: F.when(F.coalesce(F.col("outcome") == "applied", F.lit(True)), F.col(c)).alias(c)
    return stored(rows.select("request_no", *map(kept, ["event_id", "operation_key"]), "dead", "event_first", "key_first", "outcome"), path, ("outcome",))


def _settled(first: DataFrame, used: DataFrame) -> DataFrame:
    """(request_no, event_id, operation_key, outcome) of requests taken in order: `reversed` where a request before it has reversed the event,
    else `replay` where its key is used (`used`, or by one before it), else `applied`.

    `first` is what the events have settled; then steps by key and by event take turns. In a step a request learns whether one before it has
    its key (or event), or may still get it; it is settled as soon as it knows both, and what it decides is settled in the next steps. So
    steps are few, however many requests share an event or a key, and each shuffles the requests that are still open, once.
    """
    path = _folder(first.sparkSession)
    steps, turn = [_step(first, f"{path}/0")], 0
    marker = F.col("outcome") == "applied"
    while not steps[-1].filter("outcome is null").isEmpty():
        last = steps[-1]
        open_ = last.filter("outcome is null")
        if turn % 2 == 0:
            won = last.filter(marker & F.col("operation_key").isNotNull())
            if turn == 0:
                won = won.unionByName(used.select("operation_key", F.lit("applied").alias("outcome")), allowMissingColumns=True)
            rows = _by_key(open_.filter("operation_key is not null").unionByName(won).withColumn("_told", marker.eqNullSafe(True)))
            rest = open_.filter("operation_key is null").withColumn("_told", F.lit(False))
            rows = rows.unionByName(rest, allowMissingColumns=True)
        else:
            rows = _by_event(open_.unionByName(last.filter(marker)).withColumn("_told", marker.eqNullSafe(True)))
        steps.append(_step(rows.filter("not _told"), f"{path}/{turn + 1}"))
        _drop_open(first.sparkSession, f"{path}/{turn}")
        turn += 1
    return reduce(DataFrame.unionByName, [s.filter("outcome is not null").select("request_no", "event_id", "operation_key", "outcome") for s in steps])


def reverse_debt_events(requests: DataFrame, events: DataFrame, transactions: DataFrame, today: str) -> dict[str, DataFrame]:
    """Row sets of reversing debt events: outcomes, corrections, cash.

    Requests are (request_no, event_id, operation_key or null); events (event_id, debt_id, transaction_id, event_type, effect, amount,
    reversal_of_id, operation_key). Outcomes, in the order in which they are looked for: `unknown` event, `correction` (never reversed),
    `reversed` already, `replay` of a used key, `applied`. An applied one appends a correction of the opposite effect, and, where the event
    had a transaction, that one's opposite between the same accounts, with the account and delta that its balance moves by. Refused requests
    change nothing.
    """
    keys = events.select("event_id", F.col("debt_id").isNotNull().alias("known"), F.coalesce(F.col("event_type") == "Correction", F.lit(False)).alias("correction"), F.lit(False).alias("gone"))
    gone = events.filter("reversal_of_id is not null").select(F.col("reversal_of_id").alias("event_id"), F.lit(False).alias("known"), F.lit(False).alias("correction"), F.lit(True).alias("gone"))
    facts = keys.unionByName(gone).groupBy("event_id").agg(*[F.max(c).alias(c) for c in ("known", "correction", "gone")])
    early = F.when(~F.coalesce("known", F.lit(False)), "unknown").when(F.col("correction"), "correction").when(F.col("gone"), "reversed")
    first = requests.select("request_no", "event_id", "operation_key").join(facts, "event_id", "left").withColumn("outcome", early)
    no = F.lit(False)
    first = _by_event(first.withColumn("dead", no).withColumn("event_first", no).withColumn("key_first", no))
    told = _settled(first, events.filter("operation_key is not null").select("operation_key").distinct())
    known = events.select("event_id", "debt_id", "transaction_id", "effect", "amount")
    won = told.filter("outcome = 'applied'").drop("outcome").join(known, "event_id")
    tx = transactions.select(F.col("id").alias("transaction_id"), F.col("transaction_type").alias("_type"), F.col("account_from").alias("_from"), F.col("account_to").alias("_to"), F.col("description").alias("_words"))
    back = F.when(F.col("_type") == "Income", "Expense").otherwise("Income")
    cash = won.join(tx, "transaction_id").select("request_no", F.col("event_id").alias("reversal_of_event"), F.lit(today).cast("date").alias("date"), back.alias("transaction_type"), "amount", F.col("_to").alias("account_from"), F.col("_from").alias("account_to"),
                                                 F.concat(F.lit("[Reversal Event #"), F.col("event_id").cast("string"), F.lit("] "), "_words").alias("description"), F.when(F.coalesce("_to", F.lit("")) != "", F.col("_to")).otherwise(F.col("_from")).alias("account"),
                                                 F.when(back == "Expense", -F.col("amount")).otherwise(F.col("amount")).alias("delta"))
    corrections = won.select("request_no", "debt_id", F.lit("Correction").alias("event_type"), (-F.col("effect")).alias("effect"), "amount", F.lit(today).cast("date").alias("event_date"), F.col("event_id").alias("reversal_of_id"), "operation_key")
    return {"outcomes": told.select("request_no", "outcome"), "corrections": corrections, "cash": cash}
