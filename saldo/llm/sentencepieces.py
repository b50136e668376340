"""SentencePiece encoding by a forward pass over a trie of distinct words, and decoding."""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import pieces as row_ranges
from saldo.llm.common import beside, spread, text_buffer

MARK = "▁"
#: Size of the words whose ids a worker keeps from batch to batch (characters, and OVERHEAD for each word). At half of it the table
#: becomes the older one and a new one begins, which takes over what is met again. Long words weigh as much as they take, so texts
#: without spaces don't fill a worker.
REMEMBERED, OVERHEAD = 6_000_000, 20
#: Piece pairs whose separation a task keeps, and moves between the automaton's states.
PAIRS, MOVES = 300_000, 300_000


class PieceTable:
    """The pieces of a SentencePiece model file (BPE or unigram) as plain lists: what an executor needs, and no more."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(names) if plain[i]}
        self.scores = [sp.get_score(i) for i in range(n)]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unk = sp.unk_id()
        self.unigram = self._kind(sp.serialized_model_proto()) == 1
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() if plain[i] else b"" for i, p in enumerate(names)]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces of this model cross words")
        self.breaks = "\n" not in "".join(self.ids)
        self.encoder: TrieEncoder | None = None

    @staticmethod
    def _kind(proto: bytes) -> int:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(proto)
        if m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models that keep the text as it is, behind one mark, are supported")
        return m.trainer_spec.model_type


class TrieEncoder:
    """Ids of words. Words are sorted, so that a word shares the forward states of the prefix it has in common with the
    word before it: a depth-first walk of their trie that holds the states of one path.

    A state is the last piece of the best segmentation of the prefix. For a unigram model the best has the highest sum of
    scores. For a BPE model it is the segmentation that the merges give; its last piece is the one piece that ends here,
    follows the last piece of the shorter prefix, and whose pair with it the merges leave apart.

    Which pieces end at a character is told by an automaton over the beginnings of pieces (Aho-Corasick), made as far as words
    need it: a node is the longest ending of the prefix that begins a piece, a list of its moves by character, the pieces that
    end it, long ones first, and its string.
    """

    def __init__(self, table: PieceTable):
        self.t = table
        self.apart: dict[int, dict[int, bool]] = {}  # by piece, by the piece before it
        self.pairs = 0
        self.names = {i: p for p, i in table.ids.items()}
        self.sizes = [1] * (max(self.names) + 2)  # by last piece; its last entry is for -1, an unknown character
        for i, p in self.names.items():
            self.sizes[i] = len(p)
        self.begins = {p[:k] for p in table.ids for k in range(len(p) + 1)}
        self.nodes: dict[str, tuple] = {}
        self.moves = 0
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best-scored adjacent pair first, leftmost of equals."""
        parts, ids, scores = list(text), self.t.ids, self.t.scores
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, where = scores[k], i
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def _apart(self, a: int, b: int) -> bool:
        """Whether the merges leave piece a before piece b apart."""
        x, y = self.names[a], self.names[b]
        ok = self.merge(x + y) == [x, y]
        if self.pairs >= PAIRS:
            for pairs in self.apart.values():
                pairs.clear()
            self.pairs = 0
        self.apart[b][a] = ok
        self.pairs += 1
        return ok

    def _node(self, text: str) -> tuple:
        """The automaton's node after `text`: (its moves, its pieces with their lengths and pairs, its string). For BPE only pieces that the merges build."""
        at = 0
        while text[at:] not in self.begins:
            at += 1
        text = text[at:]
        if text not in self.nodes:
            found = [(self.t.ids[text[k:]], len(text) - k) for k in range(len(text)) if text[k:] in self.t.ids]
            self.nodes[text] = {}, [(c, n, self.apart.setdefault(c, {})) for c, n in found if self.t.unigram or n == 1 or self.merge(self.names[c]) == [self.names[c]]], text
        return self.nodes[text]

    def _move(self, node: tuple, char: str) -> tuple:
        to = self._node(node[2] + char)
        if self.moves >= MOVES:
            for x in self.nodes.values():
                x[0].clear()
            self.moves = 0
        node[0][char] = to
        self.moves += 1
        return to

    def learn(self, words: set[str]) -> None:
        """Have all words in `memo`."""
        if self.held > REMEMBERED // 2:
            self.older, self.memo, self.held = self.memo, {}, 0
        fresh = words - self.memo.keys()
        self.held += sum(map(len, fresh)) + OVERHEAD * len(fresh)
        met = fresh & self.older.keys()
        self.memo.update(zip(met, map(self.older.__getitem__, met), strict=True))
        self.encode_words(fresh - met)

    def encode_words(self, words) -> None:
        """Fill `memo` for all words."""
        unigram, scores, memo, sizes, byte_ids = self.t.unigram, self.t.scores, self.memo, self.sizes, self.t.byte_ids
        worst = min(scores) - 10.0
        last, total, nodes = [-1], [0.0], [self._node("")]  # by prefix length: last piece (-1: none or unknown), score, node
        prev = ""
        for word in sorted(words):
            k, top = 0, min(len(prev), len(word))
            while k < top and prev[k] == word[k]:
                k += 1
            del last[k + 1 :], nodes[k + 1 :], total[k + 1 :]
            node = nodes[k]
            end = k
            for char in word[k:]:
                end += 1
                node = node[0].get(char) or self._move(node, char)
                nodes.append(node)
                got = -1
                if unigram:
                    best = total[end - 1] + worst
                    for c, n, _ in reversed(node[1]):
                        if got < 0 or total[end - n] + scores[c] > best:
                            best, got = total[end - n] + scores[c], c
                    total.append(best)
                else:
                    for c, n, pairs in node[1]:
                        before = last[end - n]
                        if before < 0 or (pairs[before] if before in pairs else self._apart(before, c)):
                            got = c
                            break
                last.append(got)
            out, end = [], len(word)
            while end:
                got = last[end]
                if got < 0:
                    out.extend(byte_ids[b] for b in reversed(word[end - 1].encode()))
                else:
                    out.append(got)
                end -= sizes[got]
            out.reverse()
            memo[word] = array("i", out).tobytes()
            prev = word


def _encode(batches, sent, keep_text, verify=False):
    table = sent.value
    if table.encoder is None:  # kept with the table for the worker's later tasks
        table.encoder = TrieEncoder(table)
    encoder = table.encoder
    cut_words = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+" if table.breaks else f"{MARK}+[^{MARK}]*").findall
    for b in batches:
        col = b.column(0)
        _, at = text_buffer(col)
        for i, j in row_ranges(at, 1 << 20):
            split = [cut_words((MARK + x.replace(" ", MARK))) if x else [] for x in col.slice(i, j - i).to_pylist()]
            encoder.learn(set(chain.from_iterable(split)))
            get = encoder.memo.__getitem__
            rows = [b"".join(map(get, words)) for words in split]
            offs = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(rows), "<i4")))
            kept = [c.slice(i, j - i) for c in (b.columns if keep_text else b.columns[1:])]
            names = ["ids", "_same", *b.schema.names[1:]] if keep_text else ["ids", *b.schema.names[1:]]
            if verify:
                back = [_text(np.frombuffer(r, "<i4").tolist(), table.raw) for r in rows]
                kept.append(pa.array([x == (y or "") for x, y in zip(back, col.slice(i, j - i).to_pylist(), strict=True)]))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays([ids, *kept], names=names)


def _text(ids: list[int], raw: list[bytes]) -> str:
    """The text of a row of ids: bytes joined, without the space that stands for the first mark."""
    text = b"".join(map(raw.__getitem__, ids))
    return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def _decode(batches, sent, _, verify=False):
    raw = sent.value
    for b in batches:
        lists = b.column(0)
        texts = []
        for row in lists:
            ids = row.values.to_numpy().tolist() if row.is_valid and row.values is not None else []
            texts.append(_text(ids, raw))
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *b.columns[1:]], names=["decoded", *b.schema.names[1:]])


def _through(df: DataFrame, first: Column, same: str | None, name: str, kind: str, f, table, keep_cols, verify: bool = False) -> DataFrame:
    """df's column `first` through f, with keep_cols beside it; `same` is the kept column that equals `first`, if there is one,
    and so is not sent again. A kept column named like a result gives way to it."""
    keep_cols = beside(keep_cols, name, *["round_trip"] * verify)
    sent = df.sparkSession.sparkContext.broadcast(table)  # the model file's pieces: its size doesn't depend on the data
    others = [c for c in keep_cols if c != same]
    src = df.select(first, *[F.col(c).alias(f"_k{i}") for i, c in enumerate(others)])
    extra = "".join(f", `_k{i}` {df.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    if same is not None:
        extra = f", _same string{extra}"
    out = src.mapInArrow(lambda it: f(it, sent, same is not None, verify), f"{name} {kind}{extra}{', round_trip boolean' if verify else ''}")
    return out.select(*[(F.col("_same") if c == same else F.col(f"_k{others.index(c)}")).alias(c) for c in keep_cols], name, *["round_trip"] * verify)


def encode(docs: DataFrame, table: PieceTable, text_col: str = "text", keep_cols: tuple[str, ...] = ("doc_id",), verify: bool = False) -> DataFrame:
    """(*keep_cols, ids array<int>): the ids of each whole text, as the SentencePiece library gives them.

    With `verify` there is a column round_trip besides: whether the ids decode to the text (null: empty), told in the same pass.

    Null and empty texts have no ids; rows that repeat an id or have none are encoded like any other, and an empty table gives no
    rows. Characters without a piece become the pieces of their bytes. Each batch's distinct
    words (runs of marks and what follows, which no piece crosses) are encoded once, in sorted order. A kept column named
    like a result gives way to it.
    """
    keep_cols = beside(keep_cols, "ids", *["round_trip"] * verify)
    same = text_col if text_col in keep_cols and docs.schema[text_col].dataType.simpleString() == "string" else None
    return _through(spread(docs), F.col(text_col).cast("string").alias("_text"), same, "ids", "array<int>", _encode, table, keep_cols, verify)


def decode(encoded: DataFrame, table: PieceTable, ids_col: str = "ids", keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep_cols, decoded string). Gives back the encoded text, but that U+2581 in a text comes back as a space."""
    return _through(encoded, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("_ids"), None, "decoded", "string", _decode, table.raw, keep_cols)


def default_model_path() -> str:
    """The public BPE model with byte fallback that this machine offers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
