"""Words that a worker meets again are not encoded anew when its table of words is full."""

import pyarrow as pa

from saldo.llm import sentencepieces as S


def test_words_met_again_outlive_a_full_table(monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 2_000)
    table, encoded = S.PieceTable(S.default_model_path()), []

    class Sent:
        value = table

    encode = S.TrieEncoder.encode_words
    monkeypatch.setattr(S.TrieEncoder, "encode_words", lambda self, words: (encoded.extend(words), encode(self, words))[1])
    texts = [" ".join(["house", "tree", *(f"w{i}x{k}" for k in range(20))]) for i in range(30)]
    batches = [pa.RecordBatch.from_arrays([pa.array([t])], names=["_text"]) for t in texts]
    got = [r for b in S._encode(iter(batches), Sent, False, True) for r in b.to_pylist()]
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=S.default_model_path())
    assert [r["ids"] for r in got] == library.encode(texts) and all(r["round_trip"] for r in got)
    assert encoded.count(S.MARK + "house") == encoded.count(S.MARK + "tree") == 1
    assert len(table.encoder.memo) + len(table.encoder.older) < 150  # 600 words were met
