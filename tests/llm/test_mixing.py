import math

from pyspark.sql import functions as F

from saldo.llm.mixing import mix_sources, poisson_cdf


def test_poisson_cdf(spark):
    row = spark.range(1).select(*[poisson_cdf(F.lit(x)).alias(f"c{i}") for i, x in enumerate((0.3, 4.0, 900.0))]).first()
    for got, rate in zip(row, (0.3, 4.0, 900.0)):
        total = 0.0
        for k, c in enumerate(got[:40]):
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
            assert abs(c - total) < 1e-9
        assert abs(got[-1] - 1) < 1e-9


def test_shares_counts_and_order(spark):
    rows = [(i, "big" if i % 3 else "small", f"t{i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mix_sources(df, weights={"big": 1.0, "small": 3.0}, total=8000).cache()
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 250 and abs(n["small"] - 6000) < 400
    per = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy_no").alias("m"))
    assert per.filter("n != m").count() == 0
    keys = [r.shuffle_key for r in out.select("shuffle_key").collect()]
    assert len(set(keys)) == len(keys) and 0.45 < sum(keys) / len(keys) < 0.55
    again = mix_sources(df.repartition(7), weights={"big": 1.0, "small": 3.0}, total=8000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    other = mix_sources(df, weights={"big": 1.0, "small": 3.0}, total=8000, seed=5)
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, out.collect()))


def test_nulls_empty_repeats_and_clashes(spark):
    rows = [(1, None, None, 7), (None, "a", "", 8), (2, "a", "x", 9), (2, "a", "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copy_no int")
    out = mix_sources(df, total=400.0).collect()
    assert {r.source for r in out} == {None, "a"}
    assert sum(r.doc_id == 2 for r in out) % 2 == 0
    assert mix_sources(df.limit(0)).collect() == []
    assert mix_sources(df, weights={}).collect() == []


def test_columns_that_clash_and_null_ids(spark):
    rows = [(i if i % 4 else None, "a", i, 0.5, "y", 1, f"t{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, copy_no int, shuffle_key double, _mix_cdf string, n int, `odd name.x` string")
    out = mix_sources(df, total=800.0)
    assert out.columns == ["doc_id", "source", "_mix_cdf", "n", "odd name.x", "copy_no", "shuffle_key"]
    got = out.collect()
    assert {(r._mix_cdf, r.n) for r in got} == {("y", 1)} and min(r.copy_no for r in got) == 1
    lost = [r for r in got if r.doc_id is None]
    assert len({r.shuffle_key for r in lost}) == len(lost) > 100  # null ids don't share their numbers
    assert sorted(map(str, mix_sources(df.repartition(5), total=800.0).collect())) == sorted(map(str, got))
