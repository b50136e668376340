import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from saldo.llm.suffix_array import permuted_prefixes, suffix_array
from saldo.llm.suffix_dedup import suffix_array_dedup


def brute(rows, length=50):
    low = {}
    for i, text in rows:
        b = (text or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            low[w] = min(low.get(w, i), i)
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if low[b[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


def result(df, **kw):
    rows = suffix_array_dedup(df, **kw).collect()
    return sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in rows)


def test_against_brute_force(spark):
    rng = random.Random(3)
    letters = "abcdeé ß\nö"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(n) for n in (20, 45, 49, 50, 51, 90, 400)] + ["a" * 120, "ab" * 80]
    rows = []
    for i in range(60):
        parts = [make(rng.randrange(0, 90)) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randrange(0, 7))]
        rows.append((i, "".join(parts)))
    rows += [(60, rows[7][1]), (61, rows[7][1]), (62, None), (63, ""), (64, "short"), (65, "short"), (66, "a" * 49), (67, make(40_000) + shared[6])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("anchors", F.lit("x"))
    want = brute(rows)
    assert result(df, shard_bytes=3000) == want
    assert result(df, shard_bytes=3000, hot_share=0.0, hot_least=3) == want  # many anchors are hot
    assert result(df, shard_bytes=3000, hot_share=0.0, hot_least=1) == want  # all are


def test_empty_null_ids_and_repeats(spark):
    assert suffix_array_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    t = "0123456789" * 7
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (9, "x" + t)], "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffix_array_dedup(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 70, 0, t.encode()), (5, 70, 0, t.encode()), (5, 70, 0, t.encode()), (9, 71, 1, b"x")], key=str)


def test_repeated_ids_with_other_texts(spark):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
    p, q, r = make(80), make(80), make(70)
    rows = [(1, p), (5, p + q), (5, q + "zz"), (5, q + "zz"), (6, q), (6, r), (7, r + make(10) + p), (7, make(5) + r), (7, None), (8, make(300)), (8, q + q)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=120), st.integers(1, 20))
def test_permuted_prefixes(symbols, most):
    t = [*symbols, 0]
    order = sorted(range(len(t)), key=lambda i: t[i:])
    want = [0] * len(t)
    for a, b in zip(order, order[1:], strict=False):
        while want[b] < min(most, len(t) - max(a, b)) and t[a + want[b]] == t[b + want[b]]:
            want[b] += 1
    assert permuted_prefixes(np.array(t, np.uint8), np.array(order), most).tolist() == want


def test_whole_characters(spark):
    t = "é" * 40
    df = spark.createDataFrame([(1, t), (2, "x" + t[:30] + "y")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix_array_dedup(df, length=51, whole_characters=True).collect()}
    assert got[1] == t and set(got[2]) <= set("xéy")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80), st.sampled_from([None, 1, 5, 12]))
def test_suffix_array(symbols, depth):
    t = [*symbols, 0]
    got, want = suffix_array(np.array(t), 5, depth).tolist(), sorted(range(len(t)), key=lambda i: t[i:])
    if depth is None:
        assert got == want
    assert sorted(got) == sorted(want) and [t[i : i + (depth or 99)] for i in got] == [t[i : i + (depth or 99)] for i in want]
