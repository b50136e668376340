"""Reversals of debt events: chains and hot keys against a plain loop, and what stays on disk."""

import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from saldo.operators.canonical import shared
from saldo.operators.reversals import CLEANUP, reverse_debt_events

EVENT = "event_id long, debt_id long, transaction_id long, event_type string, effect int, amount decimal(18,2), reversal_of_id long, operation_key string"
TX = "id long, transaction_type string, account_from string, account_to string, description string"


def events_of(spark, n):
    return spark.range(1, n + 1).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("debt_id"), F.col("id").alias("transaction_id"), F.lit("Increase").alias("event_type"), F.lit(1).alias("effect"), F.lit(Decimal(5)).cast("decimal(18,2)").alias("amount"),
                                        F.lit(None).cast("long").alias("reversal_of_id"), F.lit(None).cast("string").alias("operation_key"))


def one_by_one(requests):
    gone, used, told = set(), set(), {}
    for n, e, k in sorted(requests):
        told[n] = "reversed" if e in gone else "replay" if k in used else "applied"
        if told[n] == "applied":
            gone.add(e)
            used |= {k} - {None}
    return told


@pytest.mark.parametrize("seed", range(4))
def test_random_requests_of_few_events_and_keys(spark, seed):
    rng = random.Random(seed)
    hot = seed % 2
    requests = [(n, 1 if hot and n % 3 else rng.randrange(1, 120), "hot" if hot and n % 2 else rng.choice([None, f"k{rng.randrange(60)}"])) for n in range(400)]
    want = one_by_one(requests)
    got = reverse_debt_events(spark.createDataFrame(requests, "request_no long, event_id long, operation_key string"), events_of(spark, 120), spark.createDataFrame([], TX), "2026-01-02")["outcomes"].collect()
    assert len(got) == len(want) and {r.request_no: r.outcome for r in got} == want


def test_a_chain_of_waiting_requests(spark):
    # each request shares its event with the one before it and its key with the one after it
    requests = [(n, n // 2 + 1, f"k{(n + 1) // 2}") for n in range(16)]
    got = reverse_debt_events(spark.createDataFrame(requests, "request_no long, event_id long, operation_key string"), events_of(spark, 20), spark.createDataFrame([], TX), "2026-01-02")["outcomes"].collect()
    assert {r.request_no: r.outcome for r in got} == one_by_one(requests)


def held(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


@pytest.mark.parametrize("part", ["outcomes", "cash"])
def test_little_stays_on_disk(spark, part):
    folder, n, was = shared(spark).removeprefix("file:"), 40_000, spark.conf.get(CLEANUP)
    before = held(folder)
    key = F.when(F.col("id") % 3 == 0, F.concat(F.lit("k"), (F.col("id") % 4000).cast("string")))
    requests = spark.range(2 * n).select(F.col("id").alias("request_no"), (F.floor(F.col("id") / 2) + 1).alias("event_id"), key.alias("operation_key"))
    tx = spark.range(1, n + 1).select("id", F.lit("Expense").alias("transaction_type"), F.lit("purse").alias("account_from"), F.lit("").alias("account_to"), F.lit("paid").alias("description"))
    rows = reverse_debt_events(requests, events_of(spark, n), tx, "2026-01-02")[part]
    applied = rows.filter("outcome = 'applied'") if part == "outcomes" else rows
    want = one_by_one([(i, i // 2 + 1, f"k{i % 4000}" if i % 3 == 0 else None) for i in range(2 * n)])
    assert {r.request_no for r in applied.select("request_no").collect()} == {i for i, w in want.items() if w == "applied"}
    assert held(folder) - before < 30 * 2 * n and spark.conf.get(CLEANUP) == was
