"""Corpus pipeline: language ID, near-duplicate removal, repeated passages, source mixing, SentencePiece ids.

Every stage takes (spark, docs, sf_dir), docs with the columns of `documents`, and works on all its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.llm import langid, mixing, ngram_join, sentencepieces, suffix_dedup
from saldo.llm.common import ensure_checkpoint_dir
from saldo.llm.queries import fold

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of whole texts in an Arrow batch: with Spark's 10 000 a batch of the stages after each other fills an executor's buffers.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """The pipeline's session sends 1000 rows a batch, unless it has a size of its own."""
    if spark.conf.get(BATCH, "0") == "0":
        spark.conf.set(BATCH, "1000")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose best language has a probability under 0.5.

    Where no row has both text and a language, there is no model: only null texts and those without a letter go.
    """
    small_batches(spark)
    model = langid.train_language_model(docs.filter(fold(F.col("doc_id"), 4) != 2), "doc_id", "text", "lang")
    if model is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select(*COLUMNS)
    told = langid.detect_language(docs, model, keep_cols=tuple(COLUMNS))
    return told.filter("lang_pred != 'und' and score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document, by id, of each class of near copies, once; ids that stand for several texts are told apart by them.

    Texts without a word and rows without an id are in no class and stay. An empty table stays empty.
    """
    key = ngram_join.text_key("text").alias("text_key")
    worded = F.col("doc_id").isNotNull() & ngram_join.has_words("text")
    src = docs.filter(worded).select(*COLUMNS, key)
    first = ngram_join.ngram_jaccard_join(docs.filter(worded)).filter("kept").select("doc_id", "text_key").distinct()
    kept = src.join(first, ["doc_id", "text_key"], "left_semi")
    if ngram_join.has_repeats(src.select(F.col("doc_id").alias("id"), "text_key")):
        kept = kept.dropDuplicates(["doc_id", "text_key"])
    return kept.select(*COLUMNS).unionByName(docs.filter(~worded).select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes and more that a smaller id has, at character bounds; texts with nothing left (also null and empty ones) go."""
    out = suffix_dedup.suffix_array_dedup(docs, whole_characters=True, keep_cols=("lang", "source"))
    text = F.decode("kept", "UTF-8")
    return out.withColumn("text", text).filter("trim(text) != ''").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources weigh as the square root of their size, in random order. A null source is one of its own."""
    return mixing.mix_sources(docs).select(*COLUMNS)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each text (none for null), and whether decoding gives the text back."""
    small_batches(spark)
    table = sentencepieces.PieceTable(sentencepieces.default_model_path())
    ids = sentencepieces.encode(docs, table, keep_cols=("doc_id", "source", "lang"), verify=True)
    return ids.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("SentencePiece encoding", piece_ids),
]

#: The stages train a network, compare MinHash values and segment words: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is written as Parquet in the shared checkpoint folder and read again. A stage's
    input is removed as soon as its result is written; the last result stays."""
    ensure_checkpoint_dir(spark)
    own = spark.conf.get(BATCH, "0")
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    if own == "0":
        spark.conf.unset(BATCH)
    return docs
