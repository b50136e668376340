"""Canonical events from messages: duplicates, retries of what was left without evidence, correlation within and beyond the batch, conflicts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["reference", "order_id", "event_id"]  # looked for in this order
FACTS = ["event_kind", "financial_class", "direction", "amount", "merchant"]
#: Columns of the tables that a batch leaves.
_BODY = ", ".join(f"{c} string" for c in ("source", "external_id", *KEYS, "event_kind", "financial_class", "direction")) + ", amount decimal(18,2), merchant string"
SCHEMAS = {"events": ", ".join(f"{c} {'decimal(18,2)' if c == 'amount' else 'string'}" for c in [*KEYS, *FACTS]), "evidence": "source string, external_id string, event_id string, evidence_role string",
           "raws": f"{_BODY}, evidence_role string, attempts int", "outcomes": "n long, source string, external_id string, outcome string, event_id string"}
#: Times that a raw message without evidence is taken up again.
ATTEMPTS = 3


def shared(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only a local session may take a folder of its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="saldo-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def _merchant(c: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(~plain.isin("", "qris merchant"), plain)  # a parser's placeholder names nobody


def compatible(event: Column) -> Column:
    """Whether a row may be evidence of an event: a primary payment must agree with it in kind, class, direction, amount, and in the merchant
    where both name one."""
    same = (F.col("event_kind") == event["event_kind"]) & (F.col("financial_class") == event["financial_class"]) & F.col("direction").eqNullSafe(event["direction"])
    money = F.abs(F.round("amount", 2) - F.round(event["amount"], 2)) < 0.005
    return (F.coalesce(F.col("evidence_role"), F.lit("")) != "PRIMARY_PAYMENT") | F.coalesce(same & money & F.coalesce(_merchant(F.col("merchant")) == _merchant(event["merchant"]), F.lit(True)), F.lit(False))


def _keyed(rows: DataFrame, *columns: str) -> DataFrame:
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("by"), F.col(k).alias("key")) for i, k in enumerate(KEYS, 1)]))
    return rows.select(*columns, key.alias("k")).select(*columns, "k.*").filter("coalesce(key, '') != ''")


def assign(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Adds `target` (event_id of the event a row belongs to), `matched_by` (null: it makes the event) and `ok` (false: a conflict).

    Rows are taken in the order of `n`: each looks for its keys among `events` and the events that rows before it have made. Rows are
    settled in rounds, each a few joins on keys: a row waits only while a row before it may still make the event that it would find first, so
    all rows of one key follow its first in the next round, and rounds are as many as the longest chain of rows that wait for each other.
    """
    facts = F.struct("event_id", *FACTS)
    columns = ["n", *KEYS, *FACTS, "evidence_role"]
    open_ = cut(rows.select(*columns))
    known = _keyed(events.select(*KEYS, *FACTS).withColumn("event", facts), "event").groupBy("by", "key").agg(F.min("event").alias("event"))
    done = None
    while not open_.isEmpty():
        keys = _keyed(open_, "n")
        first = keys.groupBy("by", "key").agg(F.min("n").alias("first"))
        seen = keys.join(first, ["by", "key"]).join(known, ["by", "key"], "left")
        wait = F.when(F.col("event").isNull() & (F.col("first") < F.col("n")), F.col("rank"))
        hit = F.min(F.when(F.col("event").isNotNull(), F.struct("rank", "by", "event")))
        told = open_.join(seen.groupBy("n").agg(hit.alias("hit"), F.min(wait).alias("wait")), "n", "left")
        settled = F.when(F.col("hit").isNotNull(), F.col("wait").isNull() | (F.col("wait") > F.col("hit.rank"))).otherwise(F.col("wait").isNull())
        told = cut(told.withColumn("settled", settled).withColumn("target", F.coalesce("hit.event.event_id", "event_id")).withColumn("matched_by", F.col("hit.by")).withColumn("ok", F.col("hit").isNull() | compatible(F.col("hit.event"))))
        part = told.filter("settled").select("n", "target", "matched_by", "ok")
        done = part if done is None else done.unionByName(part)
        made = _keyed(told.filter("settled and hit is null").withColumn("event", facts), "event").groupBy("by", "key").agg(F.min("event").alias("event"))
        known = cut(known.unionByName(made))  # a key that is made was not known
        open_ = told.filter("not settled").select(*columns)
    return rows.join(done, "n", "left") if done is not None else rows.select("*", F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("matched_by"), F.lit(None).cast("boolean").alias("ok"))


def canonicalize(messages: DataFrame, raws: DataFrame, events: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """Row sets of a batch: outcomes, raws, events, evidence.

    Messages have n (their order), source, external_id, the KEYS, the FACTS and evidence_role; raws has what was taken up before (the same
    but for n, and attempts). A message whose raw has evidence is a `duplicate`, as is a further copy within the batch; one whose raw has
    none is an earlier attempt that failed: it is taken up again, as are such raws that no message names, before the others, up to ATTEMPTS
    times in all. What is taken up makes an event (`created`), becomes evidence of one (`evidence`), or contradicts it (`conflict`): then
    its raw stays without evidence. Events and evidence are to be appended, `raws` replaces the rows of its keys.
    """
    name = ["source", "external_id"]
    body = [*name, *KEYS, *FACTS, "evidence_role"]
    known = raws.join(evidence.select(*name).distinct().withColumn("_evident", F.lit(True)), name, "left")
    state = known.select(*name, F.coalesce("_evident", F.lit(False)).alias("_evident"), F.col("attempts").alias("_before"))
    copy = F.row_number().over(Window.partitionBy(*name).orderBy("n"))
    new = messages.select("n", *body).withColumn("_copy", copy).join(state, name, "left")
    spent = F.coalesce("_before", F.lit(0)) >= ATTEMPTS
    skip = F.when((F.col("_copy") > 1) | F.coalesce("_evident", F.lit(False)), "duplicate").when(spent, "given_up")
    new = cut(new.withColumn("_skip", skip))
    again = known.filter(F.col("_evident").isNull() & (F.col("attempts") < ATTEMPTS)).join(messages.select(*name), name, "left_anti")
    again = again.select(F.lit(None).cast("long").alias("n"), *body, F.col("attempts").alias("_before"))
    taken = again.unionByName(new.filter("_skip is null").select("n", *body, "_before"))
    # old attempts come first, by name
    order = F.struct(F.col("_n").isNotNull().alias("new"), F.coalesce("_n", F.lit(0)).alias("n"), *name)
    told = cut(assign(taken.withColumnRenamed("n", "_n").withColumn("n", order), events))
    outcome = F.when(F.col("matched_by").isNull(), "created").when(F.col("ok"), "evidence").otherwise("conflict")
    told = told.withColumn("outcome", outcome)
    skipped = new.filter("_skip is not null").select(F.col("n"), *name, F.col("_skip").alias("outcome"), F.lit(None).cast("string").alias("event_id"))
    outcomes = told.select(F.col("_n").alias("n"), *name, "outcome", F.col("target").alias("event_id")).unionByName(skipped)
    kept = told.filter("outcome != 'conflict'")
    return {"outcomes": outcomes, "raws": told.select(*body, (F.coalesce("_before", F.lit(0)) + 1).cast("int").alias("attempts")),
            "events": told.filter("outcome = 'created'").select(*KEYS, *FACTS), "evidence": kept.select(*name, F.col("target").alias("event_id"), "evidence_role")}
