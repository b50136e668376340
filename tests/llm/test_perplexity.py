import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from saldo.llm import kneser_ney as K


def plain_kneser_ney(texts):
    """The textbook formula on symbols, with the same discount bounds, by dictionaries."""
    top = Counter()
    for t in texts:
        s = [0] * (K.ORDER - 1) + [b + 1 for b in t.encode()]
        for i in range(K.ORDER - 1, len(s)):
            top[tuple(s[i - K.ORDER + 1 : i + 1])] += 1
    counts = {K.ORDER: top}
    for n in range(K.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def discount(n):
        c = Counter(min(v, 5) for v in counts[n].values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0.5
        out = []
        for k in (1, 2, 3):
            d = k - (k + 1) * y * c[k + 1] / c[k] if c[k] else 0.5 * k
            out.append(min(k, max(0.05 * k, d)))
        return out

    ds = {n: discount(n) for n in counts}

    def prob(g):
        if not g:
            return 1 / 256
        n = len(g)
        inside = {h: v for h, v in counts[n].items() if h[:-1] == g[:-1]}
        if not inside:
            return prob(g[1:])
        total = sum(inside.values())
        d = lambda v: ds[n][min(v, 3) - 1]
        own = (inside[g] - d(inside[g])) / total if g in inside else 0
        return own + sum(map(d, inside.values())) / total * prob(g[1:])

    return prob


def by_byte(prob, text):
    s = [0] * (K.ORDER - 1) + [b + 1 for b in text.encode()]
    logs = [math.log(prob(tuple(s[i - K.ORDER + 1 : i + 1]))) for i in range(K.ORDER - 1, len(s))]
    return math.exp(-sum(logs) / len(logs))


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_scores_and_thresholds_match_the_formula(spark, most):
    rng = random.Random(4)
    words = {"en": "the a big red house tree sees and".split(), "ru": "мир дом и река".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 25))), lang) for i in range(40) for lang in [rng.choice(["en", "ru"])]]
    rows += [(100, "the novel tree 東京", "en"), (101, "x", None), (102, "дома", "zh"), (103, "", "en"), (104, None, "en"), (None, "the house", "en"), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("m", F.lit("clash")).withColumn("key", F.lit(1))
    half = {r.doc_id: r.h for r in df.select("doc_id", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)), F.lit(0)).alias("h")).collect()}
    trusted = df.filter("doc_id < 30").select("doc_id")
    models = {h: plain_kneser_ney([t for i, t, _ in rows if i is not None and i < 30 and half[i] == h]) for h in (0, 1)}
    want = [by_byte(models[1 - half[i]], t) if t else None for i, t, _ in rows]
    got = K.quality_filter(df, trusted, most_broadcast=most, quantile=0.9, slack=1.1).collect()

    def limit(lang):
        own = sorted(w for w, (i, _, x) in zip(want, rows, strict=True) if w is not None and i is not None and i < 30 and (lang is None or x == lang))
        return 1.1 * own[math.ceil(0.9 * len(own)) - 1]

    limits = {lang: limit(lang if lang in words else None) for lang in ("en", "ru", None, "zh")}
    key = lambda r: (-1 if r[0] is None else r[0], r[1] or 0)
    expected = sorted([(i, w, limits[x], w is not None and w <= limits[x] + 1e-6) for w, (i, _, x) in zip(want, rows, strict=True)], key=key)
    for r, (i, w, m, keep) in zip(sorted([(r.doc_id, r.perplexity, r.threshold, r.keep) for r in got], key=key), expected, strict=True):
        assert r[0] == i and r[3] == keep and (r[1] is None) == (w is None)
        assert w is None or math.isclose(r[1], w, rel_tol=1e-5) and math.isclose(r[2], m, rel_tol=1e-5)


def test_every_context_sums_to_one(spark):
    table = K.kneser_ney_tables(spark.createDataFrame([("abcabcabd", 0), ("bcda", 0)], "_text string, m int"))[0].toPandas()
    key = K.tagged(table.gram.to_numpy(), 0, table.kind.astype("int64").to_numpy())
    t = K.Table(key, table.value.to_numpy())
    import numpy as np

    for text in (b"abca", b"zz", b"bcdab"):
        data = np.frombuffer(text + b"x", np.uint8)
        g = K.grams(data, np.array([0, len(data)]))[-1]
        every = (g >> K.BITS << K.BITS) + np.arange(1, 257)
        assert abs(np.exp(K.log_probs(t, every, np.zeros(256, np.int64))).sum() - 1) < 1e-4


def test_junk_outside_ascii_and_word_salad_go(spark):
    rng = random.Random(5)
    cyr = ["мы видим большой дом", "он читает новую книгу", "она пишет длинное письмо", "река течёт через город"]
    lat = ["we see the large house", "he reads a new book", "she writes one long letter", "that river runs through town"]
    text = lambda parts: ". ".join(rng.choice(parts) for _ in range(20))
    rows = [(i, text(cyr if i % 2 else lat), "ru" if i % 2 else "en") for i in range(120)]

    def salad(t):
        w = t.replace(".", "").split()
        rng.shuffle(w)
        return " ".join(w)

    def shuffled(t):
        return " ".join("".join(rng.sample(x, len(x))) for x in t.split())

    rows += [(200 + i, salad(rows[i][1]), rows[i][2]) for i in range(10)] + [(300 + i, shuffled(rows[2 * i + 1][1]), "ru") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.keep for r in K.quality_filter(df, df.filter("doc_id < 120 and doc_id % 3 > 0").select("doc_id")).collect()}
    assert sum(got[i] for i in range(120)) >= 116
    assert not any(got[i] for i in got if i >= 200)


def test_equal_rows_and_texts_in_the_wrong_column(spark):
    rows = [(i, "the big house sees a tree " * (3 + i % 3), "en") for i in range(20)] + [(3, "the big house sees a tree " * 3, "en")]
    df = spark.createDataFrame([*rows, (50, None, "abc"), (50, "abc", None)], "doc_id long, text string, lang string")
    got = K.quality_filter(df, df.filter("doc_id < 10").select("doc_id")).collect()
    assert len(got) == 23 and len({r.perplexity for r in got if r.doc_id == 3}) == 1
    assert [r.perplexity is None for r in sorted((r for r in got if r.doc_id == 50), key=lambda r: r.lang or "")] == [False, True]


def test_the_driver_holds_a_broadcast_table_packed_only(spark):
    import tracemalloc

    import numpy as np

    n = 400_000
    table = spark.range(n).select(F.lit(1).alias("m"), F.lit(12).alias("kind"), F.xxhash64("id").bitwiseAND((1 << 54) - 1).alias("gram"), (F.col("id") % 1000 / -100).cast("float").alias("value")).localCheckpoint()
    src = spark.createDataFrame([("the house", 1, 5, "en", False)], "_text string, m int, _id long, _lang string, _trusted boolean")
    tracemalloc.start()
    try:
        scored = K.perplexity(src, table, n)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30 * n
    assert abs(scored.first().perplexity - 256) < 1e-3  # none of its n-grams is known

    rows = table.toPandas()
    keys = K.tagged(rows.gram.to_numpy(), 1, 12)
    made, plain = K.sent(table).unpacked(), K.Table(keys, rows.value.to_numpy())
    assert (made.keys == plain.keys).all() and (made.values == plain.values).all() and (made.first == plain.first).all()
    assert (made.find(keys) == rows.value.to_numpy()).all() and np.isnan(made.find(keys ^ (1 << 60))).all()
    assert np.isnan(K.sent(table.limit(0)).unpacked().find(keys[:5])).all()


def test_no_row_of_a_table_goes_through_the_driver(spark, monkeypatch):
    import pickle

    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame

    n = 100_000
    table = spark.range(n).select(F.lit(1).alias("m"), F.lit(12).alias("kind"), F.xxhash64("id").bitwiseAND((1 << 54) - 1).alias("gram"), (F.col("id") % 1000 / -100).cast("float").alias("value")).localCheckpoint()

    def told(*_):
        raise AssertionError("rows came to the driver")

    with monkeypatch.context() as m:
        for name in ("collect", "toArrow", "toPandas", "toLocalIterator"):
            m.setattr(DataFrame, name, told)
        m.setattr(type(spark.sparkContext), "broadcast", told)
        sent = K.sent(table)
    assert len(pickle.dumps(sent)) < 2000  # names of files, which do not grow with the table

    rows = table.toPandas()
    keys = K.tagged(rows.gram.to_numpy(), 1, 12)

    def look(batches):
        import pyarrow as pa

        for b in batches:
            found = sent.unpacked().find(keys[b.column(0).to_numpy()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["id", "value"])

    got = spark.range(0, n, 1, 4).mapInArrow(look, "id long, value double").orderBy("id").toPandas()
    assert (got.value.to_numpy() == rows.value.to_numpy()).all()
    other = K.sent(table.limit(10))  # another table takes the place of the first
    assert np.isfinite(other.unpacked().find(keys)).sum() == 10 and np.isfinite(sent.unpacked().find(keys)).all()


def test_files_go_by_rows_and_not_by_partitions(spark):
    rows = [(f"the house {i} sees a tree", i % 2) for i in range(40)]
    texts = spark.createDataFrame(rows, "_text string, m int")
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    plain, plain_size, models = K.kneser_ney_tables(texts)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        table, size, _ = K.kneser_ney_tables(texts)
        files = table.inputFiles()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) <= 2 * K.ORDER * spark.sparkContext.defaultParallelism  # two tables for each order; 32 files each before
    assert size == plain_size and models == [0, 1] and sorted(table.collect()) == sorted(plain.collect())
