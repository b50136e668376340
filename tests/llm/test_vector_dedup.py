import random

import numpy as np
from pyspark.sql import functions as F

from saldo.llm.vector_dedup import close_pairs, vector_near_dedup


def brute(rows, t=0.98):
    def fit(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = [[] for _ in rows]
    for a in range(n):
        for b in range(n):
            (_, v, x), (_, w, y) = rows[a], rows[b]
            if a != b and x == y and fit(v, x) and fit(w, y) and len(v) == len(w):
                v, w = np.array(v, float), np.array(w, float)
                if v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= t:
                    links[a].append(b)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        low = min(rows[b][0] for b in seen)
        out.append((rows[a][0], len(links[a]), low, low == rows[a][0]))
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(25):
            base = rng.normal(0, 1, 24)
            for k in range(int(rng.integers(1, 7))):
                v = base + rng.normal(0, rng.choice([0, 0.05, 0.12, 0.2]), 24)
                rows.append((n, v.astype(np.float32).tolist(), label))
                n += 1
    rows += [(n, None, 0), (n + 1, [0.0] * 24, 0), (n + 2, [float("nan")] * 24, 1), (n + 3, rows[0][1], None), (n + 4, rows[0][1], 0), (n + 5, [1.0, 2.0], 0), (n + 6, [2.0, 4.0], 0), (n + 7, [], 1), (n + 8, [None] * 24, 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x")).withColumn("tile", F.lit(2))
    assert sorted(map(tuple, vector_near_dedup(df, tile=9).collect())) == brute(rows)
    assert vector_near_dedup(df.limit(0)).collect() == []


def test_bound_keeps_all_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (60, 40))
    x[30:] = x[:30] + rng.normal(0, 0.15, (30, 40))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = close_pairs(u, u, x, x, 0.98, True)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if u[a] @ u[b] >= 0.98}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_repeated_ids_and_extreme_components(spark):
    a, b, c = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1], [1e300, 0.0, 1e299]
    rows = [(5, a, 1), (5, b, 1), (6, [2.0, 0.0, 0.21], 1), (7, [0.0, 3.0, 0.3], 1), (8, b, 1), (8, b, 1), (2, c, 1), (9, [1e-300, 0.0, 1e-301], 1), (3, a, 2)]
    got = vector_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile=2, partners=2)
    small = [(i, [x / max(map(abs, v)) for x in v], g) for i, v, g in rows]
    assert sorted(map(tuple, got.collect())) == brute(small)
