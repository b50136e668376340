import contextlib
import io

from saldo.llm import kneser_ney as K


def test_thresholds_meet_rows_without_gathering_a_language(spark):
    rows = [(i, "the big house sees a tree " * (3 + i % 3), "en" if i % 3 else None) for i in range(20)] + [(30, "das haus", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = df.filter("doc_id < 12").select("doc_id")
    few, many = K.quality_filter(df, trusted), K.quality_filter(df, trusted, most_languages=0)
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        few.explain()
    assert "BroadcastHashJoin" in told.getvalue() and "SortMergeJoin" not in told.getvalue() and "hashpartitioning(_lang" not in told.getvalue()
    key = lambda df: sorted((r.doc_id, r.lang or "", round(r.perplexity, 9), round(r.threshold, 9), r.keep) for r in df.collect())
    assert key(few) == key(many) and len(key(few)) == 21
