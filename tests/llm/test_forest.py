"""Neighbours against brute force: exact where all leaves are taken, recall where they aren't."""

import math

import numpy as np
from pyspark.sql import functions as F

from saldo.llm import forest as N

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k, every):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % every == 0:
            found = sorted((math.dist(a, b), i) for m, (i, b) in enumerate(ok) if m != n and len(b) == len(a))
            out += [(q, r, i, d) for r, (d, i) in enumerate(found[:k], 1)]
    return sorted(out)


def close(got, want):
    got = sorted(map(tuple, got))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(g[3], w[3], rel_tol=1e-12) for g, w in zip(got, want, strict=True))


def test_exact_with_all_leaves(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(i, [1.0] * 6) for i in range(300, 360)] + [(i, [1.0, 2.0]) for i in (400, 401, 402)] + [(500, [3.0])]
    rows += [(i, [float(rng.integers(0, 2)) for _ in range(6)]) for i in range(600, 700)]  # ties
    rows += [(1000, None), (1100, []), (1200, [None] * 6), (1300, [float("nan")] * 6), (1400, [float("inf")] * 6), (1500, [0.0] * 6), (None, [1.0] * 6)]
    rows += [(100, rows[100][1]), (100, [9.0] * 6), (7, rows[7][1])]  # repeated ids
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("uid", F.lit("x")).withColumn("score", F.lit(1))
    for k, every, leaf in ((10, 100, 16), (3, 10, 8), (10, 50, 256)):
        close(N.nearest_neighbours(df, k, every, leaf=leaf, effort=1e9).collect(), brute(rows, k, every))


def test_scores_at_the_ends_of_the_range(spark):
    rows = [(0, [1.7e308, 0.0]), (1, [-1.7e308, 0.0]), (2, [1e-200, 0.0]), (3, [3e-200, 1e-200]), (4, [1.0, 1.0]), (100, [2e-200, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.query_id, r.vec_id): r.score for r in N.nearest_neighbours(df).collect()}
    assert got[0, 4] == 1.7e308 and got[0, 1] == math.inf and math.isclose(got[100, 2], 1e-200) and math.isclose(got[100, 3], math.sqrt(2) * 1e-200)
    assert len(got) == 10


def test_copies_chunks_and_split_leaves(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [0.5, 0.25]) for i in range(900)] + [(i, rng.normal(size=2).tolist()) for i in range(900, 1500)]
    monkeypatch.setattr(N, "QUERIES", 3)
    monkeypatch.setattr(N, "ROWS", 40)
    close(N.nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(4), every=50, leaf=64, effort=1e9).collect(), brute(rows, 10, 50))


def test_recall_of_a_partial_search(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAST", 1)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24))
    rows = [(i, (centres[i % 20] + rng.normal(size=24)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = {(r[0], r[2]) for r in brute(rows, 10, 100)}
    got = {(r.query_id, r.vec_id) for r in N.nearest_neighbours(df, leaf=64, sample=2000).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_search_ends_where_planes_are_farther_than_k_vectors():
    rng = np.random.default_rng(4)
    sample = np.concatenate([c + rng.normal(size=(40, 8)) * 1e-3 for c in rng.normal(size=(50, 8)) * 10])
    forest = N.fit(sample, len(sample), trees=4, leaf=32, effort=1e9)
    for q in sample[::97]:
        leaves, bound = forest.search(q, 10)
        d = np.sort(np.linalg.norm(sample - q, axis=1))
        assert bound >= d[10] * (1 - 1e-9) and len(leaves) < len(forest.members) / 4
        got = np.unique(np.concatenate([forest.members[x] for x in leaves]))
        assert np.allclose(np.sort(np.linalg.norm(sample[got] - q, axis=1))[:11], d[:11])


def test_empty(spark):
    assert N.nearest_neighbours(spark.createDataFrame([], SCHEMA)).collect() == []
    assert N.nearest_neighbours(spark.createDataFrame([(0, [1.0])], SCHEMA)).collect() == []
