from pyspark.sql import functions as F

from saldo.llm import sentencepieces as P
from saldo.llm.common import beside
from saldo.llm.langid import detect_language
from saldo.llm.suffix_dedup import suffix_array_dedup
from saldo.llm.toxicity import score_toxicity, train_toxicity_model


def test_beside():
    assert beside(("doc_id", "Score", "lang", "LANG", "text"), "score") == ("doc_id", "lang", "text")
    assert beside((), "score") == ()


def test_results_come_once_beside_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "the house"), (2, None)], "doc_id long, text string")
    for name in ("score", "LANG_PRED", "kept", "n_bytes", "ids", "round_trip", "decoded"):
        docs = docs.withColumn(name, F.lit("mine"))
    every = tuple(docs.columns)

    def once(df, *results):
        names = [c.lower() for c in df.columns]
        assert sorted(names) == sorted(set(names)) and set(results) <= set(df.columns)
        assert set(names) == {c.lower() for c in every} | {r.lower() for r in results}
        rows = df.orderBy("doc_id").collect()
        assert len(rows) == 2
        return rows

    assert [r.lang_pred for r in once(detect_language(docs, None, keep_cols=every), "lang_pred", "score")] == ["und", "und"]
    model = train_toxicity_model(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    assert all(0 <= r.score <= 1 for r in once(score_toxicity(docs, model, keep_cols=every), "score"))
    table = P.PieceTable(P.default_model_path())
    assert all(r.round_trip for r in once(P.encode(docs, table, keep_cols=every, verify=True), "ids", "round_trip"))
    out = suffix_array_dedup(docs, keep_cols=every)
    assert [bytes(r.kept) for r in once(out, "doc_id", "n_bytes", "spans", "kept")] == [b"the house", b""]
