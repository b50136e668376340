from pyspark.sql import functions as F

import corpus_pipeline


def test_language_stage_keeps_clean_texts_without_labels(spark):
    rows = [(1, "a clean text"), (2, "чистый текст"), (3, "12 34"), (4, None), (5, ""), (None, "one more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert sorted(r.text for r in kept.collect()) == ["a clean text", "one more", "чистый текст"] and kept.columns == corpus_pipeline.COLUMNS
