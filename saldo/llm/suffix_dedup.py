"""Removal of passages that repeat across documents, by sharded suffix arrays; equal runs of bytes are told by hashes with bases drawn for
each call (see SpanHash for the chance that two different runs count as equal)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import U64, SpanHash, beside, keyed_groups, mix, pieces, prefix_hash, span_hash, spread, text_buffer
from saldo.llm.suffix_array import permuted_prefixes, suffix_array

#: Bytes of an anchor. Any `length` bytes contain length - ANCHOR + 1 runs of so many bytes; their smallest hash is the anchor.
ANCHOR = 20
#: What travels between the steps: packed columns under a key.
PACKED = "key int, kind int, blob binary"
GONE, COPY, OPEN, TEXT = 0, 1, 2, 3


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for each i that has them all."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def window_runs(data: np.ndarray, at: np.ndarray, length: int, hot: np.ndarray, hashes: SpanHash) -> tuple[np.ndarray, ...]:
    """Maximal runs of neighbouring windows of `length` bytes, each within one row, that have the same anchor.

    Returns the first window's start, the number of windows, the anchor, and a hash of all bytes of the run. Where the
    anchor is one of `hot` (sorted), each window is a run of its own and its own hash the anchor.
    """
    w, n = length - ANCHOR + 1, len(data) - length + 1
    inside = np.diff(at) - length + 1
    has = inside > 0
    if n <= 0 or not has.any():
        z = np.zeros(0, np.int64)
        return z, z, z.astype(U64), z.astype(U64)
    sums = prefix_hash(data)
    starts = np.arange(len(data) - ANCHOR + 1)
    least = _sliding_min(span_hash(sums, starts, starts + ANCHOR), w)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, at[:-1][has], 1)
    np.add.at(edge, at[:-1][has] + inside[has], -1)
    idx = np.flatnonzero(np.cumsum(edge)[:n] > 0)
    v = least[idx]
    first = np.concatenate([[0], np.flatnonzero((v[1:] != v[:-1]) | (idx[1:] != idx[:-1] + 1)) + 1])
    count = np.diff(np.append(first, len(idx)))
    s, anchor = idx[first], v[first]
    often = _inside(anchor, hot)
    if often.any():
        times = np.where(often, count, 1)
        of = np.repeat(np.arange(len(s)), times)
        s = s[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        count, anchor, often = np.where(often, 1, count)[of], anchor[of], often[of]
        anchor[often] = span_hash(sums, s[often], s[often] + length)
    return s, count, anchor, hashes.of(hashes.sums(data), s, s + count - 1 + length)


def _inside(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of x stand in a sorted array."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return ordered[at] == x


def _blob(**columns) -> bytes:
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _open(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def _rows(key, kind, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(kind, pa.int32()), pa.array(blobs, pa.binary())], names=["key", "kind", "blob"])


def bucket_of(rows: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(rows + U64(3)) % U64(buckets)).astype(np.int32)


def row_names(ids: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """One number for a row from its id and, where ids repeat, the hash of its text (else 0: then the id's own number)."""
    return mix(ids.astype(np.int64).view(U64) ^ mix(texts.astype(np.int64).view(U64)))


def text_hashes(data: np.ndarray, at: np.ndarray, repeats: bool, hashes: SpanHash) -> np.ndarray:
    """63 bits of a text's hash where some id stands in several rows, else 0."""
    if not repeats or not len(data):
        return np.zeros(len(at) - 1, np.int64)
    return (hashes.of(hashes.sums(data), at[:-1], at[1:]) >> U64(1)).view(np.int64)


def _narrow(x: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs (none for zeros), behind one byte that says how many."""
    if not x.any():
        return bytes(1)
    kind = np.dtype(np.min_scalar_type(int(x.max(initial=0))))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _pack(n: int, ids: np.ndarray, *columns: np.ndarray, tail: np.ndarray | None = None) -> bytes:
    """Sorted ids by their differences, small integers narrowed, hashes (uint64) and `tail` as they are."""
    first = int(ids[0])
    head = np.array([n, first], np.int64).tobytes() + _narrow(ids - np.concatenate([ids[:1], ids[:-1]]))
    return head + b"".join(c.tobytes() if c.dtype == U64 else _narrow(c) for c in columns) + (b"" if tail is None else tail.tobytes())


def _unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    """Ids and columns of a packed row; kinds: a letter for each column (n narrowed, h hash, t five bytes of a hash)."""
    n, first = np.frombuffer(blob, np.int64, 2)
    at, out = 16, []
    for k in "n" + kinds:
        if k == "n":
            width = blob[at]
            out.append(np.frombuffer(blob, f"u{width}", n, at + 1).astype(np.int64) if width else np.zeros(n, np.int64))
            at += 1 + n * width
        elif k == "h":
            out.append(np.frombuffer(blob, U64, n, at))
            at += 8 * n
        else:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, at).reshape(n, 5)
            out.append(wide.view(U64).ravel())
            at += 5 * n
    out[0] = first + np.cumsum(out[0])
    return out


def _deal(key: np.ndarray, kind: int, ids: np.ndarray, *columns: np.ndarray, tail: np.ndarray | None = None) -> pa.RecordBatch:
    """One packed row per distinct key, its entries sorted by id."""
    order = np.lexsort((ids, key))
    key, ids, columns, tail = key[order], ids[order], [c[order] for c in columns], None if tail is None else tail[order]
    cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).tolist() if len(key) else [0]
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))
    return _rows([int(key[x]) for x, _ in parts], [kind] * len(parts), [_pack(y - x, ids[x:y], *[c[x:y] for c in columns], tail=None if tail is None else tail[x:y]) for x, y in parts])


def merged(ids: np.ndarray, texts: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union of the spans [s, e) of each row (id, hash of its text)."""
    order = np.lexsort((s, texts, ids))
    ids, texts, s, e = ids[order], texts[order], s[order], e[order]
    if not len(ids):
        return ids, texts, s, e
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])])
    shift = np.cumsum(new) * (int(e.max()) + 1)  # so that a running maximum doesn't reach into the next id
    top = np.maximum.accumulate(e + shift)
    new[1:] |= (s + shift)[1:] > top[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1
    return ids[first], texts[first], s[first], top[last] - shift[last]


def _all_runs(data: np.ndarray, at: np.ndarray, length: int, hot: np.ndarray, hashes: SpanHash) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, anchor, run hash) of all runs of a batch."""
    out = []
    for i, j in pieces(at, 1 << 17):
        local = at[i : j + 1] - at[i]
        s, n, h, c = window_runs(data[at[i] : at[j]], local, length, hot, hashes)
        row = np.searchsorted(local, s, "right") - 1
        out.append((row + i, s - local[row], n, h, c))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5


def _portions(batches, most: int = 1 << 23):
    """(ids, bytes, offsets) of batches (id, text), at most some megabytes of text at a time unless one text is longer."""
    for b in batches:
        ids = b.column(0).to_numpy()
        data, at = text_buffer(b.column(1))
        for i, j in pieces(at, most):
            yield ids[i:j], data[at[i] : at[j]], at[i : j + 1] - at[i]


def _sampled_anchors(batches, length, hashes):
    """(anchor, number of rows that have it) of each portion."""
    none = np.zeros(0, U64)
    for _, data, at in _portions(batches):
        row, _, _, h, _ = _all_runs(data, at, length, none, hashes)
        if not len(h):
            continue
        order = np.lexsort((row, h))
        h, row = h[order], row[order]
        h = h[np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])]
        value, n = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["h", "n"])


def hot_anchors(named: DataFrame, length: int, hashes: SpanHash, share: float = 0.01, least: int = 32, sample: int = 20_000) -> np.ndarray:
    """Anchors that a hundredth of a sample of about `sample` rows has, sorted. They only decide how runs are dealt: no result
    depends on them. At most 1 / share times a row's mean number of anchors."""
    n = named.count()
    if not n:
        return np.zeros(0, U64)
    part = named.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(np.ceil(1_000_003 * min(1.0, sample / n))))
    most = max(least, int(share * min(n, sample)))
    got = part.mapInArrow(lambda it: _sampled_anchors(it, length, hashes), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= most).select("h").toArrow()
    return np.sort(got.column("h").to_numpy().astype(np.int64).view(U64))


def _requests(batches, length, parts, buckets, hot, repeats, hashes):
    """Runs, dealt by anchor. Of equal runs in some megabytes of text only those of the smallest id are sent; the others are copies here already."""
    for ids, data, at in _portions(batches):
        row, s, n, h, c = _all_runs(data, at, length, hot, hashes)
        if not len(row):
            continue
        owner, text = ids[row], text_hashes(data, at, repeats, hashes)[row]
        order = np.lexsort((owner, c, h))
        row, s, n, h, c, owner, text = (x[order] for x in (row, s, n, h, c, owner, text))
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        low = owner[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
        gone = owner > low
        if gone.any():
            # spans go along under their text's bucket: the receiving step hands them on
            i, z, x, y = merged(owner[gone], text[gone], s[gone], (s + n - 1 + length)[gone])
            yield _deal(bucket_of(row_names(i, z), buckets) % parts, GONE, i, z, x, y)
        h, c, owner, text = h[~gone], c[~gone], owner[~gone], text[~gone]
        rest = (h // U64(parts)).view(np.uint8).reshape(-1, 8)[:, :5]
        yield _deal((h % U64(parts)).astype(np.int32), OPEN, owner, text, c, tail=rest)


def _answers(batches, buckets, wanted):
    """For each run that other ids may share, dealt by its text's bucket: COPY (a smaller id has it all; with them the spans
    that are known already) or OPEN (it is the first of its kind, and other kinds have the same anchor)."""
    for _, t in keyed_groups(batches, "key"):
        asked, spans = [], []
        for kind, blob in zip(t.column("kind").to_pylist(), t.column("blob").to_pylist(), strict=True):
            if kind == OPEN:
                asked.append(_unpack(blob, "nht"))
            elif wanted == COPY:
                spans.append(_unpack(blob, "nnn"))
        if spans:
            i, z, x, y = (np.concatenate(c) for c in zip(*spans, strict=True))
            yield _deal(bucket_of(row_names(i, z), buckets), GONE, i, z, x, y)
        if not asked:
            continue
        ids, texts, c, h = (np.concatenate(x) for x in zip(*asked, strict=True))
        order = np.lexsort((ids, c, h))
        ids, texts, c, h = ids[order], texts[order], c[order], h[order]
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
        low = ids[np.maximum.accumulate(np.where(new_c, np.arange(len(ids)), 0))]
        if wanted == COPY:
            mask = ids > low
        else:
            group = np.cumsum(new_h) - 1
            at = np.flatnonzero(new_h)
            shared = np.minimum.reduceat(ids, at) < np.maximum.reduceat(ids, at)
            several = np.add.reduceat(new_c.astype(np.int64), at) > 1
            mask = (ids == low) & (shared & several)[group]
        if mask.any():
            yield _deal(bucket_of(row_names(ids[mask], texts[mask]), buckets), wanted, ids[mask], texts[mask], c[mask])


def _texts(batches, buckets, repeats, hashes):
    """Whole rows (id, text, ..) packed by bucket."""
    for b in batches:
        key = bucket_of(row_names(b.column(0).fill_null(0).to_numpy(), text_hashes(*text_buffer(b.column(1)), repeats, hashes)), buckets)
        order = np.argsort(key, kind="stable")
        names = [f"f{i}" for i in range(b.num_columns)]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(order)]]).tolist()
        parts = [order[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True) if x < y]
        yield _rows([int(key[p[0]]) for p in parts], [TEXT] * len(parts), [_blob(**{n: c.take(pa.array(p)) for n, c in zip(names, b.columns, strict=True)}) for p in parts])


def _join(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(rows * U64(0x9E3779B97F4A7C15) ^ c)


class Notes:
    """What a bucket was told of its texts: spans that are gone, and runs, by row name."""

    def __init__(self, gone: list, runs: list):
        z = np.zeros(0, np.int64)
        i, t, s, e = (np.concatenate(c) for c in zip(*gone, strict=True)) if gone else (z, z, z, z)
        self.gone = row_names(i, t), s, e
        ids, texts, c = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (z, z, z.astype(U64))
        rows = row_names(ids, texts)
        self.rows, self.runs = np.unique(rows), np.unique(_join(rows, c))

    def find(self, batch: pa.RecordBatch, names: np.ndarray, length: int, hot: np.ndarray, hashes: SpanHash):
        """Noted runs of the batch's rows: (row of the batch, first window, windows, anchor, bytes, offsets, place in the bytes)."""
        rows = np.flatnonzero(_inside(names, self.rows))
        if not len(rows):
            return None
        data, at = text_buffer(batch.column(1).take(pa.array(rows)))
        row, s, n, h, c = _all_runs(data, at, length, hot, hashes)
        hit = _inside(_join(names[rows][row], c), self.runs)
        row, s, n, h = row[hit], s[hit], n[hit], h[hit]
        return rows[row], s, n, h, data, at[row] + s


def _bucket_groups(batches):
    """For each bucket the notes, and its text batches one by one."""
    for _, t in keyed_groups(batches, "key"):
        gone, runs, texts = [], [], []
        for kind, blob in zip(t.column("kind").to_pylist(), t.column("blob").to_pylist(), strict=True):
            if kind == TEXT:
                texts.append(blob)
            elif kind == GONE:
                gone.append(_unpack(blob, "nnn"))
            else:
                runs.append(_unpack(blob, "nh"))
        yield Notes(gone, runs), map(_open, texts)


def _contexts(batches, length, shards, hot, repeats, hashes):
    """The bytes of each OPEN run, dealt by anchor, a row for each bucket and shard."""
    for notes, texts in _bucket_groups(batches):
        if not len(notes.rows):
            continue
        owner, text, start, anchor, size, body = [], [], [], [], [], []
        for b in texts:
            every, told = b.column(0).to_numpy(), text_hashes(*text_buffer(b.column(1)), repeats, hashes)
            got = notes.find(b, row_names(every, told), length, hot, hashes)
            if got is None or not len(got[0]):
                continue
            row, s, n, h, data, at = got
            m = n - 1 + length
            to = np.concatenate([[0], np.cumsum(m)])
            body.append(data[np.repeat(at - to[:-1], m) + np.arange(to[-1])])
            for into, x in zip((owner, text, start, anchor, size), (every[row], told[row], s, h, m), strict=True):
                into.append(x)
        if not owner:
            continue
        owner, text, start, anchor, size, body = (np.concatenate(x) for x in (owner, text, start, anchor, size, body))
        ctx = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(body)])
        key = (mix(anchor) % U64(shards)).astype(np.int32)
        order = np.argsort(key, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(order)]]).tolist()
        parts = [order[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        yield _rows([int(key[p[0]]) for p in parts], [OPEN] * len(parts), [_blob(id=owner[p], text=text[p], s=start[p].astype(np.int32), ctx=ctx.take(pa.array(p))) for p in parts])


def repeated_runs(ctx: list[bytes], low: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Rows, ranges [a, b) of window starts, and the smallest id that has those windows, for the texts ctx with ids low."""
    size = np.array([len(x) for x in ctx])
    at = np.concatenate([[0], np.cumsum(size + 1)])
    t = np.zeros(at[-1] + 1, np.int64)
    joined = np.frombuffer(b"\0".join(ctx) + b"\0", np.uint8)
    t[:-1] = joined.astype(np.int64) + 2
    t[at[1:] - 1] = 1  # a mark after each text, below every byte
    sa = suffix_array(t, 258, length)
    folded = np.zeros(len(t), np.uint8)
    folded[:-1] = joined
    row = np.repeat(np.arange(len(ctx)), size + 1)
    fits = np.zeros(len(t), bool)
    fits[:-1] = at[1:][row] - 1 - np.arange(len(row)) >= length
    shared = permuted_prefixes(folded, sa, length)[sa] >= length
    shared[1:] &= fits[sa[1:]] & fits[sa[:-1]]
    shared[0] = False
    group = np.cumsum(~shared)
    keep = fits[sa]
    pos, group = sa[keep], group[keep]
    if not len(pos):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
    first = np.minimum.reduceat(low[row[pos]], cuts)
    best = np.full(len(t), -1, low.dtype)
    best[pos] = np.repeat(first, np.diff(np.append(cuts, len(pos))))
    starts = np.flatnonzero(fits)
    r, v = row[starts], best[starts]
    brk = np.concatenate([[0], np.flatnonzero((r[1:] != r[:-1]) | (v[1:] != v[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1])
    end = np.append(brk[1:], len(starts)) - 1
    return r[brk], starts[brk] - at[r[brk]], starts[end] + 1 - at[r[brk]], v[brk]


def _shards(batches, length, buckets):
    """Spans whose windows a smaller id has, from the suffix array of each shard, dealt by their text's bucket."""
    for _, t in keyed_groups(batches, "key"):
        got = [_open(x) for x in t.column("blob").to_pylist()]
        ids, texts = (np.concatenate([x.column(c).to_numpy() for x in got]) for c in ("id", "text"))
        s = np.concatenate([x.column("s").to_numpy().astype(np.int64) for x in got])
        r, a, b, v = repeated_runs([c for x in got for c in x.column("ctx").to_pylist()], ids, length)
        k = v < ids[r]
        if k.any():
            i, z, x, y = merged(ids[r[k]], texts[r[k]], s[r[k]] + a[k], s[r[k]] + b[k] - 1 + length)
            yield _deal(bucket_of(row_names(i, z), buckets), GONE, i, z, x, y)


def _up(text: bytes, x: int) -> int:
    while x < len(text) and text[x] & 0xC0 == 0x80:
        x += 1
    return x


def _down(text: bytes, y: int) -> int:
    while 0 < y < len(text) and text[y] & 0xC0 == 0x80:
        y -= 1
    return y


def _apply(batches, length, chars, hot, repeats, hashes):
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for notes, texts in _bucket_groups(batches):
        for b in texts:
            ids = b.column(0)
            data, at = text_buffer(b.column(1))
            known = row_names(ids.fill_null(0).to_numpy(), text_hashes(data, at, repeats, hashes))
            gone = notes.gone
            got = notes.find(b, known, length, hot, hashes)
            if got is not None:
                gone = tuple(np.concatenate(x) for x in zip(gone, (known[got[0]], got[1], got[1] + got[2] - 1 + length), strict=True))
            i, _, s, e = merged(gone[0], np.zeros(len(gone[0]), np.int64), *gone[1:])
            lo, hi = np.searchsorted(i, known), np.searchsorted(i, known, "right")
            valid = ids.is_valid().to_pylist()
            raw = data.tobytes()
            kept, spans = [], []
            for r in range(b.num_rows):
                text = raw[at[r] : at[r + 1]]
                cut = list(zip(s[lo[r] : hi[r]].tolist(), e[lo[r] : hi[r]].tolist(), strict=True)) if valid[r] else []
                if chars:  # keep every character that is not removed as a whole
                    cut = [(x, y) for x, y in ((_up(text, x), _down(text, y)) for x, y in cut) if x < y]
                out, last = [], 0
                for x, y in cut:
                    out.append(text[last:x])
                    last = y
                out.append(text[last:])
                kept.append(b"".join(out))
                spans.append([{"start": x, "end": y} for x, y in cut])
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), pa.array(spans, span_type), pa.array(kept, pa.binary()), *b.columns[2:]],
                                             names=["id", "n_bytes", "spans", "kept", *[f"_k{k}" for k in range(b.num_columns - 2)]])


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, whole_characters: bool = False,
                       keep_cols: tuple[str, ...] = (), shard_bytes: int = 8_000_000, hot_share: float = 0.01, hot_least: int = 32, most_parts: int = 20_000) -> DataFrame:
    """Each row of `docs` without the bytes covered by a `length`-byte string that also starts in a row with a smaller id.

    Returns (id_col, n_bytes long, spans array<struct<start,end>>, kept binary, *keep_cols); a kept column named like one of
    these gives way to it. Strings are judged on the
    input, never across rows; null text counts as empty. Rows that repeat an id, with the same text or another, are judged one by
    one against smaller ids, never against each other. Rows with a null id come back whole and are no source. `whole_characters` shrinks each span to whole UTF-8
    characters, so that what is kept is valid text.

    Every window of `length` bytes has an anchor, the smallest hash of the 20-byte runs in it, so equal windows have equal
    anchors. Where an anchor is hot (`hot_share` of a sample of rows has it) each of its windows stands for itself, so that no
    shard gathers what stands around a very common line. Neighbouring windows with one anchor are a run. Runs are dealt by
    anchor, equal ones of a batch once. Of runs with the same bytes the smallest id's stands for all. Where several kinds have
    one anchor, the bytes of the first of each kind go to that anchor's shard. A shard is one generalized suffix array, built by
    induced sorting; its permuted common prefixes of `length` bytes and more give the classes of equal windows, and each class
    its smallest id. The spans found then meet the texts by a bucket of the row. Between the steps packed, compressed columns
    travel, in about one partition for each `shard_bytes` of text (`most_parts` at most).
    """
    keep_cols = beside(keep_cols, id_col, "n_bytes", "spans", "kept")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep_cols)])
    named = spread(src.select("id", "text").filter("id is not null"))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = buckets = int(max(16, total // shard_bytes))
    shards = 3 * parts  # a suffix array takes some ten times its text
    hashes = SpanHash()
    hot = hot_anchors(named, length, hashes, hot_share, hot_least)
    repeats = named.groupBy("id").count().filter("count > 1").limit(1).count() > 0  # decides what is sent, not what comes out
    own = lambda df: df.repartition(min(parts, most_parts), "key").sortWithinPartitions("key", "kind")
    asked = own(named.mapInArrow(lambda it: _requests(it, length, parts, buckets, hot, repeats, hashes), PACKED))
    notes = lambda kind: asked.mapInArrow(lambda it: _answers(it, buckets, kind), PACKED)
    plain = named.mapInArrow(lambda it: _texts(it, buckets, repeats, hashes), PACKED)
    open_runs = own(notes(OPEN).unionByName(plain)).mapInArrow(lambda it: _contexts(it, length, shards, hot, repeats, hashes), PACKED)
    found = own(open_runs).mapInArrow(lambda it: _shards(it, length, buckets), PACKED)
    full = spread(src).mapInArrow(lambda it: _texts(it, buckets, repeats, hashes), PACKED)
    extra = "".join(f", `_k{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep_cols))
    out = own(notes(COPY).unionByName(found).unionByName(full)).mapInArrow(
        lambda it: _apply(it, length, whole_characters, hot, repeats, hashes), f"id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary{extra}")
    return out.select(F.col("id").alias(id_col), "n_bytes", "spans", "kept", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep_cols)])
