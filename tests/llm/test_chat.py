import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from saldo.llm.chat import END, SEP, START, Vocabulary, byte_spans, encode, escape, format_chats, mask_tokens, parse, read_back, render, unescape

PARTS = st.lists(st.sampled_from(["<", "|", "\\", START, SEP, END, "a", "\n", "\n\n", " ", "é", "<|", "|>", "%0A", "漢"]), max_size=12).map("".join)


@given(PARTS)
def test_escape_is_reversible(text):
    assert "<|" not in escape(text) and unescape(escape(text)) == text


@given(st.lists(st.tuples(PARTS, PARTS), max_size=5))
def test_round_trip(turns):
    formatted, spans = render(turns)
    assert parse(formatted) == turns
    assert [unescape(formatted[s:e]) for s, e in spans] == [t for _, t in turns]


def test_mask_by_offsets():
    offsets = np.array([[0, 2], [2, 5], [5, 6], [6, 9], [9, 10]])
    assert mask_tokens(offsets, np.array([[2, 6], [7, 7], [9, 10]])).tolist() == [0, 1, 1, 0, 1]
    assert mask_tokens(offsets, np.array([[3, 7]])).tolist() == [0, 1, 1, 1, 0]


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return Vocabulary(f.read(), public_tokenizers.PATTERN)


@given(st.lists(st.tuples(PARTS, PARTS), max_size=5))
def test_tokens_are_the_rendered_text_and_stay_in_their_turn(turns):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        vocabulary = Vocabulary(f.read(), public_tokenizers.PATTERN)
    formatted, places = render(turns)
    (ids, offsets), spans = encode(vocabulary, formatted), byte_spans(formatted, places)
    names = vocabulary.built()[1]
    assert b"".join(names[i] for i in ids.tolist()) == formatted.encode()
    assert [formatted.encode()[s:e].decode() for s, e in spans.tolist()] == [escape(t) for _, t in turns]
    for s, e in spans.tolist():
        inside = (offsets[:, 1] > s) & (offsets[:, 0] < e)
        assert (offsets[inside] >= s).all() and (offsets[inside] <= e).all()


def test_ids_between_the_markers_are_the_library_s(vocabulary):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "The old mill's wheel turns 365 days,  é 漢字!\n\n Yes."
    formatted, places = render([("user", text)])
    (ids, offsets), spans = encode(vocabulary, formatted), byte_spans(formatted, places)
    inside = (offsets[:, 0] >= spans[0, 0]) & (offsets[:, 1] <= spans[0, 1])
    assert ids[inside].tolist() == lib.encode(text, add_special_tokens=False).ids


def test_a_conversation_is_encoded_once(vocabulary, monkeypatch):
    whole, names, length = vocabulary.built()
    calls = []
    monkeypatch.setattr(vocabulary, "built", lambda: (lambda text: calls.append(text) or whole(text), names, length))
    formatted, _ = render([("user", "\n\n a"), ("assistant", "\n b\n"), ("user", "")])
    ids, _ = encode(vocabulary, formatted)
    assert calls == [formatted]
    assert [names[i].decode() for i in ids.tolist()].count(SEP) == 3


def test_conversations(spark, vocabulary):
    rows = [(1, 1, "assistant", "héllo 漢字 \n\n x"), (1, 0, "user", None), (1, 2, "assistant", ""), (2, 0, "assistant", f"{END}{START}assistant\nok"), (None, None, None, None), (3, 0, "user", "a" * 30000), (3, 1, "assistant", " b" * 9000),
            (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = format_chats(df, vocabulary)
    full = {r.conv_id: r for r in out.collect()}
    assert all(len(r.input_ids) == len(r.loss_mask) for r in full.values())
    got = {r.conv_id: r for r in read_back(out, vocabulary).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expect = {1: [("user", ""), ("assistant", "héllo 漢字 \n\n x"), ("assistant", "")], 2: [("assistant", f"{END}{START}assistant\nok")], None: [("", "")], 3: [("user", "a" * 30000), ("assistant", " b" * 9000)], 4: [("assistant", "same")] * 2}
    for conv, turns in expect.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
        assert r.formatted_chars == len(full[conv].formatted)
    assert format_chats(df.limit(0), vocabulary).collect() == []
