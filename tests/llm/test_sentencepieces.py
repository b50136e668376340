import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from saldo.llm.sentencepieces import MARK, PieceTable, TrieEncoder, decode, default_model_path, encode

LIB = sentencepiece.SentencePieceProcessor(model_file=default_model_path())
TABLE = PieceTable(default_model_path())
ENCODER = TrieEncoder(TABLE)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "e", "s", "t", "th", "he", "in", "ing", " ", "  ", "é", "漢", "\n", "ß", "ll", "1", "!", "🙂"]), min_size=1, max_size=25).map("".join))
def test_words_match_the_library(text):
    import re

    words = re.findall(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+", MARK + text.replace(" ", MARK))
    ENCODER.encode_words(set(words))
    got = [int.from_bytes(ENCODER.memo[w][i : i + 4], "little") for w in words for i in range(0, len(ENCODER.memo[w]), 4)]
    assert got == LIB.encode(text)


def test_documents(spark):
    texts = ["Hello  world\n x\tÿ漢𐀀 é ½", "", None, "  lead  trail  ", "a", "a", "word " * 20_000, "<s> </s> <0x41>", "\n\n", "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    enc = encode(df, TABLE)
    got = {r.doc_id: list(r.ids) for r in enc.collect()}
    assert got == {i: LIB.encode(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: r.decoded for r in decode(enc, TABLE).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert {(r.doc_id, r.round_trip) for r in encode(df, TABLE, verify=True).collect()} == {(i, True) for i in range(len(texts))}
    assert [r.round_trip for r in encode(df.limit(1).withColumn("text", F.lit("a\u2581b")), TABLE, keep_cols=("text",), verify=True).collect()] == [False]
    assert encode(df.limit(0), TABLE).collect() == []


def test_unigram_best_path():
    class Toy:
        ids = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}
        scores = [-2.0, -2.0, -2.5, -3.5, -4.4]
        endings, unigram, byte_ids = ids, True, list(range(256))

    e = TrieEncoder(Toy)
    e.encode_words(["ab", "aba", "abab", "b"])
    ids = lambda w: list(memoryview(e.memo[w]).cast("i"))
    assert ids("ab") == [2] and ids("aba") == [4] and ids("abab") == [2, 2] and ids("b") == [1]


def test_a_character_takes_few_steps():
    """Calls of built-in functions for each character that words don't share; it was about twice as many when each looked up every ending of the prefix."""
    import random
    import sys

    rng = random.Random(1)
    parts = ["the", "ing", "er", "on", "st", "al", "qu", "x", "é", "house", "漢"]
    words = {MARK + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(2000)}
    encoder, calls = TrieEncoder(TABLE), 0
    encoder.encode_words(words)  # pairs of pieces are known from here on

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "c_call"

    sys.setprofile(count)
    try:
        encoder.encode_words(words)
    finally:
        sys.setprofile(None)
    assert calls < 10 * len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_moves_that_are_forgotten_come_back(monkeypatch):
    from saldo.llm import sentencepieces

    monkeypatch.setattr(sentencepieces, "MOVES", 3)
    encoder = TrieEncoder(TABLE)
    encoder.encode_words([MARK + "tree", MARK + "trees漢", MARK + "house"])
    assert encoder.moves <= 3
    for text in ("tree", "trees漢", "house"):
        assert list(memoryview(encoder.memo[MARK + text]).cast("i")) == LIB.encode(text)
