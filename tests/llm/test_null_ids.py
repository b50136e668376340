from pyspark.sql import functions as F

import corpus_pipeline
from saldo.llm.queries import QUERIES


def test_rows_without_an_id_stay(spark, tmp_path):
    rows = [(None, "a b c d e f", "en"), (1, "a b c d e f", "en"), (2, "u v w x y z", "en"), (None, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_ngram_jaccard_join"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 1, 0), (2, 2, 0), (None, None, 0), (None, None, 0)]
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(1, "a b c d e f"), (2, "u v w x y z")]
    assert sum(r.doc_id is None for r in kept) == 2
    passages = corpus_pipeline.repeated_passages(spark, docs, "").collect()
    assert sorted(r.text for r in passages if r.doc_id is None) == ["a b c d e f"]


def test_stage_keeps_different_texts_of_one_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (None, "c d e f g h"), (2, a + " more"), (3, b), (1, a), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    got = sorted([(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()], key=str)
    assert got == sorted([(1, a), (1, b), (None, "c d e f g h"), (4, None)], key=str)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
    assert none.count() == 0
