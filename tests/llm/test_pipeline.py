import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from saldo.llm.sentencepieces import default_model_path


def test_stages_on_planted_documents(spark, tmp_path):
    en = "The river runs through the old town and turns the wheel of the mill number {} every day of the year. "
    clean = ["".join(en.format(i * 50 + k) for k in range(6)) for i in range(8)]
    passage = "this passage of more than fifty bytes stands in two documents, word for word. "
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(clean)]
    rows += [(20, clean[0], "en", "s0"), (21, clean[1].replace("wheel", "stone", 1), "en", "s1"), (22, "12345 67890", "en", "s0"), (23, None, "en", "s0"), (24, "alpha beta " + passage, "en", "s0"), (25, "gamma delta " + passage, "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).select(*corpus_pipeline.COLUMNS)
    told = corpus_pipeline.language_id(spark, docs, "")
    assert {r.doc_id for r in told.collect()} == {r[0] for r in rows} - {22, 23} and told.columns == corpus_pipeline.COLUMNS
    one = corpus_pipeline.near_duplicates(spark, told, "")
    assert sorted(r.doc_id for r in one.collect()) == [*range(8), 24, 25]
    twice = corpus_pipeline.near_duplicates(spark, told.unionByName(told), "")
    assert sorted(r.doc_id for r in twice.collect()) == [*range(8), 24, 25]
    cut = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, one, "").collect()}
    assert cut[24].endswith(passage) and passage.strip() not in cut[25] and "gamma" in cut[25]
    mixed = corpus_pipeline.source_mix(spark, one, "")
    assert mixed.columns == corpus_pipeline.COLUMNS
    last = corpus_pipeline.piece_ids(spark, mixed, "").collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model_path())
    texts = {r.doc_id: r.text for r in one.collect()}
    assert all(r.round_trip and list(r.ids) == lib.encode(texts[r.doc_id]) for r in last)
    assert len(corpus_pipeline.STAGES) == 5


def test_run(spark, tmp_path):
    rows = [(i, f"some words of text number {i} and {i * i} more of them in the house", "en", "a", 10) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.round_trip for r in out)
