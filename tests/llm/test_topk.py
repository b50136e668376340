import math
import random

from pyspark.sql import functions as F

from saldo.llm.topk import top_k


def brute(rows, k):
    ok = [(i, [math.floor(64 * x) if abs(x) < 2**50 else 64 * int(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, vec) in enumerate(ok):
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(vec, v)), i) for m, (i, v) in enumerate(ok) if m != n and len(v) == len(vec))
            out += [(q, r, i, min(2**63 - 1, max(1 - 2**63, -x))) for r, (x, i) in enumerate(s[:k], 1)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(130)]
    rows += [(i, [0.5] * 6) for i in range(130, 190)]  # many ties
    rows += [(200, None), (201, []), (202, [None] * 6), (203, [float("nan")] * 6), (220, [float("inf")] * 6), (None, [1.0] * 6), (240, [1.0, 2.0]), (241, [3.0, 1.0]), (300, [1e5] * 6)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).withColumn("score", F.lit("x"))
    rows = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    for k, block in ((20, 16), (3, 1000)):
        got = sorted(map(tuple, top_k(df, k, block=block, query_block=8).collect()))
        assert got == brute(rows, k)


def test_few_and_none(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(empty).collect() == []
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df).collect()] == [(0, 1, 1, 64 * 128)]


def test_large_components(spark):
    rows = [(0, [4e7]), (1, [4e7]), (2, [1e3]), (20, [-4e7]), (40, [1.7e308]), (41, [-1.7e308]), (3, [0.3])]
    rows += [(100 + i, [1e7 * (i + 1) / 3] * 64) for i in range(5)] + [(105 + i, [float(i)] * 64) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, 4, block=3, query_block=2).collect())) == brute(rows, 4)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 0.5]), (1, [0.25, 3.0]), (2, [1.0, 1.0])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, 3, block=4, query_block=3).collect())) == brute(rows, 3)


def test_many_scores_equal_to_the_kth(spark):
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(i, [2.0, 0.0]) for i in range(1000, 1003)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert sorted(map(tuple, top_k(df, 5, block=32, query_block=4).collect())) == brute(rows, 5)


def test_scores_beyond_a_long_are_ranked_exactly(spark):
    rows = [(20, [1e9]), (1, [1e11]), (2, [1e12]), (3, [1e12]), (4, [5e11]), (5, [2.0]), (40, [-1e9]), (60, [1.7e308]), (6, [-1e12]), (7, [-3e13])] + [(100 + 2 * i + 1, [1e11 + i]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for k, block in ((4, 5), (30, 4096)):
        got = sorted(map(tuple, top_k(df, k, block=block, query_block=2).collect()))
        assert got == brute(rows, k)
    assert [r[2] for r in got if r[0] == 20][:3] == [60, 2, 3]
