"""Texts that hashes by powers modulo 2^64 can't tell apart, and the hashes that replaced these."""

import numpy as np
import pytest

import corpus_pipeline
from saldo.llm.common import SpanHash, prefix_hash, span_hash, text_buffer, word_digests
from saldo.llm.ngram_join import ngram_jaccard_join
from saldo.llm.suffix_dedup import suffix_array_dedup


def pair(space=""):
    """Two texts that differ in one letter of every 30 bytes, by the parity of the block's number and its opposite."""
    return ["".join(f"{'the same anchor of a block' + space}{i:04d}{'ab'[(i.bit_count() + flip) % 2]}" for i in range(1024)) for flip in (0, 1)]


def test_the_pair_has_one_hash_modulo_a_power_of_two():
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in pair())
    ends = np.array([0]), np.array([len(a)])
    assert span_hash(prefix_hash(a), *ends) == span_hash(prefix_hash(b), *ends)
    for _ in range(50):
        h = SpanHash()
        assert h.of(h.sums(a), *ends) != h.of(h.sums(b), *ends)


def test_equal_spans_have_equal_hashes_wherever_they_stand():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 4, 70_000).astype(np.uint8)
    data[50_000:50_300] = data[100:400]
    h = SpanHash((12345, 678910))
    sums = h.sums(data)
    starts = np.arange(100, 350)
    assert (h.of(sums, starts, starts + 50) == h.of(sums, starts + 49_900, starts + 49_950)).all()
    s = np.arange(10_000)
    values = h.of(sums, s, s + 30)
    assert len(np.unique(values)) == len({bytes(data[i : i + 30]) for i in s})


def test_word_digests_by_bytes(spark):
    import pyarrow as pa

    data, at = text_buffer(pa.array(["abc", "abcdefgh", "abcdefghi", "abc", "abcdefghi", "é"]))
    got = word_digests(data, at[:-1], at[1:])
    assert got[0] == got[3] and got[2] == got[4] and len(set(got.tolist())) == 4


@pytest.mark.parametrize("space", ["", " "])
def test_different_texts_stay(spark, space):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(pair(space))], "doc_id long, text string, lang string, source string, n_chars long")
    assert all(r.n_bytes == len(r.kept) for r in suffix_array_dedup(docs).collect())
    assert sorted(map(tuple, ngram_jaccard_join(docs).select("doc_id", "class_id", "n_links").collect())) == [(0, 0, 0), (1, 1, 0)]
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 2
