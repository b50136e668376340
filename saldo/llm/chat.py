"""Chat formatting: one text for a whole conversation, encoded once with offsets, and a loss mask aligned to its turns."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
SPAN = "array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    """No `<|` is left: a backslash is put before the bar, and before any backslashes that stand between already."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and where each turn's text stands in it (code points)."""
    out, spans, n = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        out += [head, body, END, "\n"]
        spans.append((n + len(head), n + len(head) + len(body)))
        n += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from the formatted text alone."""
    turns = []
    for block in formatted.split(START)[1:]:
        role, _, rest = block.partition(SEP)
        turns.append((unescape(role), unescape(rest[: rest.rindex(END)])))
    return turns


def mask_tokens(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Loss mask of the tokens that share a place with a turn, from sorted token spans and sorted turn spans (start, end): each
    turn's first and last tokens are found by binary search."""
    mask = np.zeros(len(offsets), np.int32)
    some = spans[spans[:, 0] < spans[:, 1]]
    first, last = np.searchsorted(offsets[:, 1], some[:, 0], "right"), np.searchsorted(offsets[:, 0], some[:, 1], "left")
    for i, j in zip(first.tolist(), last.tolist(), strict=True):
        mask[i:j] = 1
    return mask


class Vocabulary:
    """Byte-level BPE from the lines of a ranks file (base64 of a token, its id) and a pattern, with an id of its own for each marker.

    Every role and text stands between two markers, each of which is one token, so no token reaches out of a turn; escaped
    texts hold no marker. What is sent to executors are the lines; a worker process builds the encoder once.
    """

    _built: dict[tuple[int, str], tuple] = {}

    def __init__(self, lines: bytes, pattern: str):
        self.lines, self.pattern = lines, pattern

    def built(self):
        """(encode a rendered text, bytes of each token, lengths of these)."""
        key = (hash(self.lines), self.pattern)
        if key not in self._built:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.lines.splitlines()) if a}
            markers = {marker: i for i, marker in enumerate((START, SEP, END), max(ranks.values()) + 1)}
            names = [b""] * (max(markers.values()) + 1)
            for token, i in (ranks | {m.encode(): i for m, i in markers.items()}).items():
                names[i] = token
            whole = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=markers)
            self._built.clear()
            self._built[key] = lambda text: whole.encode(text, allowed_special="all"), names, np.array([len(x) for x in names])
        return self._built[key]


def byte_spans(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Spans of code points as spans of the text's UTF-8 bytes."""
    at = np.array(spans, np.int64).reshape(-1, 2)
    if text.isascii():
        return at
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[at]  # where each code point starts


def encode(vocabulary: Vocabulary, formatted: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a whole rendered conversation, encoded once, and the bytes (start, end) that each token covers."""
    whole, _, length = vocabulary.built()
    ids = np.array(whole(formatted), np.int64)
    ends = np.cumsum(length[ids])
    return ids, np.stack([ends - length[ids], ends], 1)


def _format(batches, sent, trained):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        texts, ids, masks, under, spans = [], [], [], [], []
        for turns in b.column(1).to_pylist():
            turns = [(t["role"] or "", t["text"] or "") for t in turns]
            formatted, places = render(turns)
            tokens, offsets = encode(sent.value, formatted)
            mine = np.array([role == trained for role, _ in turns], bool)
            texts.append(formatted)
            ids.append(tokens)
            masks.append(mask_tokens(offsets, byte_spans(formatted, places)[mine]))
            spans.append([{"start": x, "end": y} for x, y in places])
            under.append([s for s, m in zip(spans[-1], mine.tolist(), strict=True) if m and s["start"] < s["end"]])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int32())), pa.array(under, span), pa.array(spans, span)],
            names=["conv", "formatted", "input_ids", "loss_mask", "loss_spans", "turn_spans"])


def format_chats(rows: DataFrame, vocabulary: Vocabulary, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: (conv_col, formatted, input_ids, loss_mask, loss_spans, turn_spans).

    Turns stand in the order of (turn, role, text); null turns come first; null roles and texts count as empty. Rows with a
    null conversation id form one conversation. Repeated rows are turns of their own. Other columns, also such that have the
    name of a result, are ignored; an empty table gives no rows. Control strings inside a text get a backslash, reversibly.
    loss_mask marks exactly the tokens of `trained_role` texts, markers and roles left out; spans are code points.
    A conversation is one record, so its turns meet in one task; the conversations are spread by their id.
    """
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file: its size doesn't depend on the data
    turns = (rows.select(F.col(conv_col).cast("long").alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
             .groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")))
    out = turns.mapInArrow(lambda it: _format(it, sent, trained_role), f"conv long, formatted string, input_ids array<int>, loss_mask array<int>, loss_spans {SPAN}, turn_spans {SPAN}")
    return out.withColumnRenamed("conv", conv_col)


def masked_text(ids: np.ndarray, mask: np.ndarray, names: list[bytes]) -> str:
    """The text under a loss mask: the bytes of each unbroken run of masked tokens, unescaped."""
    at = np.flatnonzero(mask)
    runs = np.split(ids[at], np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []
    return "".join(unescape(b"".join(names[i] for i in run.tolist()).decode()) for run in runs)


def _read_back(batches, sent):
    import hashlib

    names = sent.value.built()[1]
    for b in batches:
        n, digest, loss_n, loss = [], [], [], []
        ids, masks = ([x.values.to_numpy() for x in b.column(k)] for k in (2, 3))
        for text, i, m in zip(b.column(1).to_pylist(), ids, masks, strict=True):
            turns = parse(text)
            n.append(len(turns))
            digest.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            under = masked_text(i, m, names)
            loss_n.append(len(under))
            loss.append(hashlib.sha256(under.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest), pa.array(loss_n, pa.int64()), pa.array(loss), b.column(4)],
                                         names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame, vocabulary: Vocabulary, conv_col: str = "conv_id") -> DataFrame:
    """Digests of the turns, from the formatted text, and of the text under the mask, from input_ids and loss_mask."""
    sent = formatted.sparkSession.sparkContext.broadcast(vocabulary)
    src = formatted.select(F.col(conv_col).alias("conv_id"), "formatted", "input_ids", "loss_mask", F.length("formatted").cast("long").alias("n"))
    return src.mapInArrow(lambda it: _read_back(it, sent), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
