"""Thresholds and flags that don't depend on partitions, on the way of scoring, or on how trusted ids fall into halves."""

import math
import random

import pytest
from pyspark.sql import functions as F

from saldo.llm import kneser_ney as K


@pytest.mark.parametrize("quantile", [0.0, 0.5, 0.995, 1.0])
def test_order_statistic_against_sorting(spark, quantile):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), rng.choice([rng.uniform(1, 9), 5.0, 5.0000001])) for _ in range(2000)] + [("one", 3.5)]
    want = {k: sorted(v for x, v in rows if x == k) for k in ("a", "b", "one")}
    for parts in (1, 3, 8):
        df = spark.createDataFrame(rows, "k string, v double").repartition(parts)
        got = {r.k: r.q for r in K.order_statistic(df, "k", "v", quantile).collect()}
        assert got == {k: v[max(1, math.ceil(quantile * len(v))) - 1] for k, v in want.items()}
    assert K.order_statistic(df.limit(0), "k", "v", quantile).collect() == []


def test_same_numbers_for_all_partitions_and_both_ways(spark):
    rng = random.Random(8)
    words = "the a big red house tree sees and river runs дом".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), "en" if i % 3 else "ru") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = df.filter("doc_id < 60").select("doc_id")
    runs = []
    for parts, most in ((1, 12_000_000), (3, 12_000_000), (8, 12_000_000), (5, 0)):
        got = K.quality_filter(df.repartition(parts), trusted, most_broadcast=most, quantile=0.9, slack=1.0)
        runs.append(sorted((r.doc_id, r.perplexity, r.threshold, r.keep) for r in got.collect()))
    assert runs[0] == runs[1] == runs[2] == runs[3]
    assert any(p == t and keep for _, p, t, keep in runs[0])  # the row that sets a threshold is kept


def test_one_trusted_text_is_the_only_model(spark):
    good = "the big house sees a red tree and the river runs by the old mill " * 20
    rng = random.Random(9)
    junk = ["".join(chr(rng.randrange(33, 127)) for _ in range(600)) for _ in range(10)]
    df = spark.createDataFrame([(1, good, "en"), (2, good.replace("red", "big"), "en"), *[(10 + i, t, "en") for i, t in enumerate(junk)]], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in K.quality_filter(df, df.filter("doc_id = 1").select("doc_id"), slack=1.5).collect()}
    assert got[1].keep and got[1].perplexity < 3 and got[2].keep
    assert not any(got[10 + i].keep for i in range(10))
    none = K.quality_filter(df, df.filter("doc_id = 1").select((F.col("doc_id") + 500).alias("doc_id"))).collect()
    assert len(none) == 12 and not any(r.keep for r in none)
