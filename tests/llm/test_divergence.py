"""Source divergences against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from saldo.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least, top):
    words, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall(fold(text))
        words[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for x, s in groups if x == lang]

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = shares(words[lang, source]), shares(sum((words[lang, s] for s in sources), Counter()))
        pairs = [(sum(abs(p[t] - x) for t, x in shares(words[lang, s]).items()), s) for s in sources if s != source]
        terms = [(p[t] - q[t], t) for t in kept if words[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, r) for r, (value, item) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return sorted(out)


def check(spark, rows, least=2, top=5, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("x")).withColumn("n", F.lit(1)).withColumn("value", F.lit(2))
    got = sorted(tuple(r) for r in D.source_divergence(df, least, top, **more).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain(rows, least, top)
    return got


def corpus(rng, n):
    words = ["the", "The", "Ünï", "ünï", "İx", "日本", "a_b", "x9y", "zebra", "KK", "é", "é"] + [f"w{chr(97 + i)}" for i in range(26)]
    return [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30))) + rng.choice(["", ".", "\n\x00"]), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s2", "é", "z", None])) for i in range(n)]


def test_against_plain_counting(spark):
    rng = random.Random(1)
    rows = corpus(rng, 150) + [(900, None, "en", "empty"), (901, "", "xx", "a"), (902, "one only", "xx", "b"), (903, "12 34", "yy", "c")]
    rows += rows[:20]
    for shard in (5, 1000):
        check(spark, rows, shard=shard)


def test_weak_digests_are_verified_by_bytes(spark):
    check(spark, corpus(random.Random(2), 80), digest=lambda w: len(w) % 2)
    check(spark, corpus(random.Random(2), 40), digest=len)


def test_empty_and_long(spark):
    assert check(spark, []) == []
    check(spark, [(1, "word " * 100_000, "en", "a"), (2, "Wörd" * 60_000 + " word", "en", "b")], least=1)


def test_shares_beyond_64_bits(spark):
    counts, over = np.array([0, 10, 3 * 10**12, 9 * 10**12]), np.array([7 * 10**9, 10**13, 9 * 10**12 + 5, 10**13])
    want = [1 + 1_000_000_000 * (int(c) + 5) // int(o) for c, o in zip(counts, over, strict=True)]
    assert D.exact_shares(counts, over).tolist() == want
    df = spark.createDataFrame([(int(c), int(o) - 500) for c, o in zip(counts, over, strict=True)], "n long, total long")
    assert [r[0] for r in df.select(D.share(F.col("n"), F.col("total"), F.lit(100).cast("long"))).collect()] == want
