"""Source divergence audit: how far the word frequencies of each source are from those of the other sources of its language.

Words are found on the UTF-8 bytes of whole batches; counts are exact integers. Languages are split into shards of terms, each a CSR
matrix of sources by terms, so that a hot language or source is never in one task.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldo.llm.common import MASKS, cut, eights, keyed_groups, pieces, spread, text_buffer, word_digests

LEAST_DOCUMENTS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Kept (source, term) counts of a shard, about; as many as pairs of sources at least, so that pairs don't outgrow the counts.
SHARD = 1 << 15
_BYTES = np.arange(256)
_LETTER = (_BYTES >= 0x80) | ((_BYTES | 0x20) >= ord("a")) & ((_BYTES | 0x20) <= ord("z"))
#: Lower-case byte of a word's byte, 0 for the others.
TABLE = np.where(_LETTER, np.where(_BYTES < 0x80, _BYTES | 0x20, _BYTES), 0).astype(np.uint8)


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts and ends of the words, and the row each is in. Words don't cross rows."""
    folded = TABLE[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = folded > 0
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    inner = at[(at > 0) & (at < len(data))]
    first[inner] = inside[inner]
    starts = np.flatnonzero(first)
    last = inside[:-1] & ~inside[1:]
    last[inner - 1] |= inside[inner - 1]
    return folded, starts, np.flatnonzero(last) + 1, np.searchsorted(at, starts, "right") - 1


def same_bytes(folded: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] equals data[b:b+size], eight bytes at a time."""
    words = eights(folded)
    same, live, k = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live):
        differs = (words[a[live] + k] ^ words[b[live] + k]) & MASKS[np.minimum(size[live] - k, 8)]
        same[live[differs != 0]] = False
        k += 8
        live = live[size[live] > k]
    return same


def group_words(folded, starts, ends, rows, groups, digest=xxhash.xxh3_64_intdigest):
    """Distinct (group of a row, word): a place where it stands, its group, its occurrences and the rows that have it.

    Words meet by digest; whatever differs in a byte from the first of its run is grouped by its bytes instead."""
    if not len(starts):
        return np.zeros((4, 0), np.int64)
    size, group = ends - starts, groups[rows]
    key = word_digests(folded, starts, ends, digest)
    key ^= group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # one run is of one group, but for chance, which the check below finds
    bits = np.uint64(int(len(key)).bit_length())  # the low bits give way to the word's place, so that values are sorted and rows stay in order
    packed = np.sort(key >> bits << bits | np.arange(len(key), dtype=np.uint64))
    order, k = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), packed >> bits
    new = np.concatenate([[True], k[1:] != k[:-1]])
    leader = order[new][np.cumsum(new) - 1]
    alike = (group[order] == group[leader]) & (size[order] == size[leader]) & same_bytes(folded, starts[order], starts[leader], np.minimum(size[order], size[leader]))
    found = []
    if not alike.all():
        raw = folded.tobytes()
        by_bytes: dict[tuple[int, bytes], list] = {}
        for t in order[~alike].tolist():
            got = by_bytes.setdefault((int(group[t]), raw[starts[t] : ends[t]]), [t, 0, set()])
            got[1] += 1
            got[2].add(int(rows[t]))
        found = [(t, group[t], n, len(r)) for t, n, r in by_bytes.values()]
        order, new = order[alike], new[alike]  # a leader is always like itself
    at = np.flatnonzero(new)
    row = rows[order]
    fresh = new | np.concatenate([[True], row[1:] != row[:-1]])
    told = np.stack([order[at], group[order[at]], np.diff(np.append(at, len(order))), np.add.reduceat(fresh.astype(np.int64), at)])
    return np.concatenate([told, np.array(found, np.int64).reshape(-1, 4).T], axis=1)


def slices(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Words as an Arrow column, gathered without an object for each."""
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    body = folded[np.repeat(starts - at[:-1], np.diff(at)) + np.arange(at[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body)).cast(pa.string())


def _count(batches, digest):
    """Words of each (lang, source), with the occurrences in a piece of some texts and the texts that have them; a row with a null word for each group of a batch."""
    for b in batches:
        lang, source = (b.column(i).dictionary_encode() for i in (0, 1))
        pair = lang.indices.to_numpy() * np.int64(len(source.dictionary)) + source.indices.to_numpy()
        pairs, groups = np.unique(pair, return_inverse=True)
        langs, sources = lang.dictionary.take(pa.array(pairs // len(source.dictionary))), source.dictionary.take(pa.array(pairs % len(source.dictionary)))
        none = pa.array(np.zeros(len(pairs), np.int64))
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(pairs), pa.string()), none, none], names=["lang", "source", "term", "n", "docs"])
        data, at = text_buffer(b.column(2))
        for i, j in pieces(at, 1 << 22):
            part = slice(at[i], at[j])
            folded, starts, ends, rows = word_bounds(data[part], at[i : j + 1] - at[i])
            place, group, n, docs = group_words(folded, starts, ends, rows, groups[i:j], digest)
            terms = slices(folded, starts[place], ends[place])
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(group)), sources.take(pa.array(group)), terms, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def share(count, n, terms):
    """1 + floor(SCALE * (count + 5) / (n + 5 * terms)), exact; null without terms."""
    over = n + SMOOTHING * terms
    wide = (F.lit(SCALE).cast("decimal(20,0)") * (count + SMOOTHING).cast("decimal(18,0)"))
    small = F.call_function("div", F.lit(SCALE).cast("long") * (count + SMOOTHING), over)
    return F.when(terms > 0, 1 + F.when(count < 2**33, small).otherwise(F.call_function("div", wide, over.cast("decimal(20,0)"))))


def exact_shares(counts: np.ndarray, over: np.ndarray) -> np.ndarray:
    """The same on arrays: long division by thousands keeps every step within 64 bits."""
    a = counts.astype(np.int64) + SMOOTHING
    out, rest = a // over, a % over
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // over, rest % over
    return out + 1


def divergences(source: np.ndarray, term: np.ndarray, count: np.ndarray, over: np.ndarray, terms: int):
    """For each source in turn, the sum of |p - q| over `terms` terms against every source. The counts are a CSR matrix, sorted by source and of terms below `terms`;
    absent ones have the source's least share."""
    k = len(over)
    zero, p = exact_shares(np.zeros(k, np.int64), over), exact_shares(count, over[source])
    at = np.searchsorted(source, np.arange(k + 1))
    full = np.flatnonzero(np.diff(at))
    for a in range(k):
        own = p[at[a] : at[a + 1]]
        dense = np.full(terms, zero[a])
        dense[term[at[a] : at[a + 1]]] = own
        # every source b as if it had no count: |zero[b] - q| over the terms, by sums below and above
        ranked = np.sort(own)
        sums, below = np.concatenate([[0], np.cumsum(ranked)]), np.searchsorted(ranked, zero)
        base = zero * below - sums[below] + (sums[-1] - sums[below]) - zero * (len(own) - below) + (terms - len(own)) * np.abs(zero - zero[a])
        if len(full):  # and what its counts change
            q = dense[term]
            base[full] += np.add.reduceat(np.abs(p - q) - np.abs(zero[source] - q), at[full])
        yield base


def _compare(batches):
    """Each shard's part of the divergences of all its sources."""
    for key, t in keyed_groups(batches, "shard"):
        lang, term = t.column("lang")[0].as_py(), t.column("term")
        heads = np.flatnonzero(term.is_null().to_numpy(zero_copy_only=False))
        names = t.column("source").take(pa.array(heads)).to_pylist()
        over = t.column("over").take(pa.array(heads)).to_numpy()
        body = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
        at = {s: i for i, s in enumerate(names)}
        source = np.array([at[s] for s in t.column("source").take(pa.array(body)).to_pylist()], np.int64)
        words = term.take(pa.array(body)).combine_chunks().dictionary_encode()
        order = np.argsort(source, kind="stable")
        told = divergences(source[order], words.indices.to_numpy()[order], t.column("n").take(pa.array(body)).to_numpy()[order], over, len(words.dictionary))
        for a, sums in enumerate(told):
            n = len(names) - a - 1
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([names[a]] * n, pa.string()), pa.array(names[a + 1 :], pa.string()), pa.array(sums[a + 1 :])], names=["lang", "source", "item", "value"])


def word_counts(docs: DataFrame, digest=xxhash.xxh3_64_intdigest) -> DataFrame:
    """(lang, source, term, n, docs) of whole texts; a null term stands for the group. Null lang, source and text are ''."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    told = spread(docs.select(blank("lang"), blank("source"), blank("text"))).mapInArrow(partial(_count, digest=digest), "lang string, source string, term string, n long, docs long")
    return told.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcasts a table of at most so many rows, which is counted; a larger one is joined by its keys, whose hot ones Spark splits."""
    return F.broadcast(df) if df.count() <= most else df


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, shard: int = SHARD, digest=xxhash.xxh3_64_intdigest) -> DataFrame:
    """Divergence of every (lang, source) from the other sources of its lang, and the terms that it has more of than its lang.

    Terms are runs of letters and bytes from 0x80 on, with A-Z lower-cased; a lang keeps those in at least `least_documents` of its rows.
    Shares are integers per thousand million. Returns lang, source, part, item, value, rank: part `pair` has each other source with
    the summed difference of shares (0 without kept terms), part `term` the `top` terms by difference from the lang's share. Ties go to
    the item that is first by its UTF-8 bytes. Null lang, source and text are ''; repeated rows count as often as they stand; other
    columns are ignored; an empty table gives an empty result.
    """
    counts = cut(word_counts(docs, digest))
    groups = counts.filter("term is null").select("lang", "source")
    by_term = Window.partitionBy("lang", "term")
    kept = cut(counts.filter("term is not null").withColumn("all_docs", F.sum("docs").over(by_term)).withColumn("all_n", F.sum("n").over(by_term))
               .filter(F.col("all_docs") >= least_documents).select("lang", "source", "term", "n", "all_n"))
    vocabulary = kept.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_n"))
    totals = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells")), ["lang", "source"], "left").na.fill(0, ["total", "cells"])
    shards = totals.groupBy("lang").agg(F.greatest(F.ceil(F.sum("cells") / F.greatest(F.lit(shard), F.count("*") * F.count("*"))), F.lit(1)).alias("shards"))
    sizes = cut(totals.join(vocabulary, "lang", "left").na.fill(0, ["terms", "lang_n"]).join(shards, "lang").drop("cells"))
    known = kept.join(few(sizes), ["lang", "source"])

    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("all_n"), F.col("lang_n"), F.col("terms"))
    more = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = more.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    # shards of a lang by the hash of the term; each has all its sources, as those without a count differ, too
    name = lambda k: F.concat(k.cast("string"), F.lit(":"), "lang").alias("shard")
    over = (F.col("total") + SMOOTHING * F.col("terms")).alias("over")
    heads = sizes.filter("terms > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("k")).select(name(F.col("k")), "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), over)
    body = known.select(name(F.pmod(F.xxhash64("term"), "shards")), "lang", "source", "term", "n", over)
    told = heads.unionByName(body).repartition("shard").sortWithinPartitions("shard", "term").mapInArrow(_compare, "lang string, source string, item string, value long")
    half = told.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    mute = sizes.filter("terms = 0").select("lang", "source")
    silent = mute.join(mute.select("lang", F.col("source").alias("item")), "lang").filter("source < item").withColumn("value", F.lit(0).cast("long"))
    one = half.unionByName(silent)
    both = one.unionByName(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return pairs.unionByName(terms)
