import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from saldo.llm import kneser_ney as K
from saldo.llm.langid import WINDOW, ByteCnn, detect_language, train_language_model, windows
from saldo.llm.toxicity import FOLD, STYLE, PuModel, score_toxicity, train_toxicity_model, word_features

rng = random.Random(9)
WORDS = {"en": ["the", "house", "and", "with", "think", "which"], "de": ["das", "haus", "und", "mit", "größe", "nicht"], "fr": ["la", "maison", "et", "avec", "été", "où"]}


def sentence(lang, n=60):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_windows_cover_every_byte():
    data = np.arange(1, 256, dtype=np.uint8).repeat(3)
    x, row = windows(data, np.array([0, 0, 300, 765]))
    assert row.tolist() == [1, 1, 2, 2] and x.shape == (4, WINDOW)
    assert x[0].tolist() + x[1][:44].tolist() == data[:300].tolist() and (x[1][44:] == 0).all()


def test_language_held_out_and_edges(spark):
    rows = [(i, sentence(lang), lang) for i, lang in enumerate(list(WORDS) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = train_language_model(df.filter("doc_id % 4 != 0"), "doc_id", "text", "lang", epochs=6)
    out = detect_language(df.filter("doc_id % 4 = 0"), model, keep_cols=("doc_id", "lang")).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95 and all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, sentence("de", 30_000)), (5, sentence("de")), (5, sentence("de"))], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred) for r in detect_language(odd, model).collect()]
    assert sorted(got) == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "de"), (5, "de")]
    assert detect_language(odd.limit(0), model).collect() == []
    assert {r.lang_pred for r in detect_language(odd, None).collect()} == {"und"}
    assert train_language_model(odd.withColumn("lang", F.lit(None).cast("string")), "doc_id", "text", "lang") is None


def test_sample_does_not_depend_on_partitions(spark):
    rows = [(i, sentence(lang, 400), lang) for i, lang in enumerate(list(WORDS) * 30)] + [(None, "null id", "en")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (train_language_model(df.repartition(n), "doc_id", "text", "lang", texts_per_language=20, windows_per_text=2, epochs=1) for n in (1, 7))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
    few = train_language_model(df, "doc_id", "text", "lang", epochs=1, most_languages=2)
    assert few.labels == sorted(few.labels) and len(few.labels) == 2


def test_language_scores_match_the_plain_network(spark):
    rows = [(i, sentence(lang, 90), lang) for i, lang in enumerate(list(WORDS) * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = train_language_model(df, "doc_id", "text", "lang", epochs=2)

    def plain(text):
        data, total = text.encode(), np.zeros(len(m.labels))
        for at in range(0, len(data), WINDOW):
            part = data[at : at + WINDOW]
            x = [*part, *bytes(WINDOW - len(part)), 0, 0, 0]
            e = [m.p["emb"][c] for c in x]
            z = m.p["base"].astype(float).copy()
            for f in range(m.p["conv"].shape[1]):
                best = max(float(np.concatenate(e[i : i + 4]) @ m.p["conv"][:, f]) for i in range(WINDOW))
                z += max(best + m.p["bias"][f], 0) * m.p["out"][f]
            total += z * sum(c != 0 for c in part)
        p = np.exp(total / len(data) - (total / len(data)).max())
        return m.labels[int(p.argmax())], float((p / p.sum()).max())

    got = {r.doc_id: r for r in detect_language(df, m).collect()}
    for i in (0, 1, 2):
        lang, score = plain(rows[i][1])
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-3


def test_toxicity_scores_match_plain_sums(spark):
    bias, rnd = -1.5, np.random.default_rng(1)
    model = PuModel(rnd.normal(0, 1, 1 << 18) * (rnd.random(1 << 18) < 0.5), bias)
    texts = ["One one two THREE!!", "", None, "a " * 300 + "!", "é 漢 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in score_toxicity(df, model).collect():
        data = np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8)
        words = set(word_features(data, np.array([0, len(data)]))[0].tolist())
        single = set()
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", bytes(FOLD[data])):
            single |= {b for b in word_features(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0].tolist() if b < STYLE}
        assert single == {b for b in words if b < STYLE}
        assert abs(r.score - 1 / (1 + math.exp(-(bias + sum(model.weights[list(words)]))))) < 1e-9


def test_network_gradient():
    net = ByteCnn(["a", "b"], seed=3)
    x = np.random.default_rng(0).integers(1, 255, (40, WINDOW)).astype(np.uint8)
    y = (x[:, 7] > 128).astype(int)
    x[y == 1, 20:23] = (65, 66, 67)
    x[y == 0, 20:23] = (67, 66, 65)
    net.fit(x, y, epochs=60, batch=20)
    assert (net.logits(x).argmax(1) == y).mean() > 0.95


def test_toxicity_held_out(spark):
    rows = []
    for i in range(1200):
        toxic = i % 8 == 0
        text = sentence("en", rng.choice([20, 300])) + (" you " + rng.choice(["idiot", "loser"]) + "." if toxic else "")
        rows.append((i, text, 1 if toxic and i % 3 else None if i % 5 else 0 if not toxic else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = train_toxicity_model(df.filter("doc_id % 5 != 0"), df.select("doc_id", "toxic"), prior=0.12)
    out = {r.doc_id: r.score for r in score_toxicity(df.filter("doc_id % 5 = 0"), model).collect()}
    pos, neg = [s for i, s in out.items() if i % 8 == 0], [s for i, s in out.items() if i % 8]
    assert min(pos) > 0.5 > max(neg)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50_000), (3, "x")], "doc_id long, text string").withColumn("score", F.lit(1))
    assert all(0 <= r.score <= 1 for r in score_toxicity(odd, model).collect())
    assert score_toxicity(odd.limit(0), model).collect() == []
    none = train_toxicity_model(odd, odd.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert all(r.score < 0.5 for r in score_toxicity(odd, none).collect())


def test_non_negative_risk_learns_rare_words():
    p = [np.array([3, 4]), np.array([3, 5])] * 20
    u = [np.array([4, 6])] * 150 + [np.array([3, 6])] * 10
    m = PuModel.fit(p, u, 0.06)
    assert m.weights[3] > 1 and abs(m.weights[6]) < 1e-9


def test_quality_filter(spark):
    rows = [(i, sentence("en", 50), "en") for i in range(80)] + [(i, sentence("de", 50), "de") for i in range(80, 160)]
    rows += [(200, "$$$ #%% xqzj " * 20, "en"), (201, None, "en"), (202, "", "de"), (203, sentence("en"), None), (204, sentence("en", 20_000), "xx"), (None, "zzz", "en"), (1, rows[1][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("perplexity", F.lit("clash"))
    trusted = df.filter("doc_id < 160 and doc_id % 2 = 0").select("doc_id")
    got = {r.doc_id: r for r in K.quality_filter(df, trusted).collect()}
    assert sum(got[i].keep for i in range(160)) >= 156
    assert not got[200].keep and not got[201].keep and got[201].perplexity is None and not got[202].keep and not got[None].keep
    assert got[203].keep and got[204].keep
    assert K.quality_filter(df.limit(0), trusted).collect() == []
    assert not any(r.keep for r in K.quality_filter(df, trusted.limit(0)).collect())
