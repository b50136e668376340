import random

from pyspark.sql import functions as F

from saldo.llm.ngram_join import least_matches, ngram_jaccard_join


def grams(text, k=5):
    w = (text or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, t=0.8):
    sets = [grams(x) for _, x in rows]
    links = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if n >= t * (len(sets[i]) + len(sets[j]) - n) - 1e-12:
                    links[i].append(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], min(rows[j][0] for j in seen), len(links[i])))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows, n = [], 0
    vocab = [f"w{i}" for i in range(400)]
    for base in range(12):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 2, 30])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n, rng.choice([" ", "  ", "\n"]).join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "one"), (n + 4, "one"), (n + 5, "one two three four"), (n + 6, "x " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("clash")).withColumn("band", F.lit(1))
    got = sorted(map(tuple, ngram_jaccard_join(df, block=7).select("doc_id", "class_id", "n_links").collect()))
    assert got == brute(rows)


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard_join(df).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in ngram_jaccard_join(df).collect()] == [(1, 1, 0)]


def test_posterior_bounds():
    need = least_matches(0.8, 1e-6)
    assert list(need) == sorted(need) and need[0] >= 1 and need[-1] < 0.8 * 128


def test_repeated_ids_are_rows_of_their_own(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (8, b), (8, b), (9, "x " + a), (9, "y " + a), (5, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_jaccard_join(df, block=2)
    assert sorted(map(tuple, got.select("doc_id", "class_id", "n_links").collect())) == brute(rows)
    kept = got.filter("kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [5, 5, 5, 5]
