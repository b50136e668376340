"""Near-duplicate join on word n-grams: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import U64, connected_components, cut, keyed_groups, local_roots, mix, pieces, shingles, spread, text_buffer

HASHES, BANDS, STEP = 128, 32, 16


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For n = STEP, 2*STEP, .. HASHES compared values: the fewest matches at which P(J >= threshold | matches) >= tolerance.

    Under a uniform prior the posterior is Beta(m+1, n-m+1), whose upper tail is the binomial sum P(Bin(n+1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def signatures(hashes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """HASHES MinHash values (uint32) for each row that has shingles; other rows get zeros."""
    out = np.zeros((len(offs) - 1, HASHES), np.uint32)
    mult = mix(np.arange(1, HASHES + 1, dtype=U64)) | U64(1)
    full = np.flatnonzero(np.diff(offs))
    for i, j in pieces(offs[np.concatenate([full, [len(offs) - 1]])], 1 << 14):
        rows = full[i:j]
        part, starts = hashes[offs[rows[0]] : offs[rows[-1] + 1]], offs[rows] - offs[rows[0]]
        for h in range(HASHES):
            out[rows, h] = np.minimum.reduceat(part * mult[h], starts) >> U64(32)
    return out


def _describe(batches, size):
    for b in batches:
        data, at = text_buffer(b.column(1))
        for i, j in pieces(at):
            hashes, offs = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
            n = np.diff(offs)
            keep = np.flatnonzero(n)
            if not len(keep):
                continue
            place = np.arange(len(hashes), dtype=U64) - np.repeat(offs[:-1], n).astype(U64)
            one = np.add.reduceat(mix(hashes + place * U64(0xD6E8FEB86659FD93)), offs[keep])
            two = np.add.reduceat(mix(hashes ^ mix(place + U64(77))), offs[keep])
            sig = signatures(hashes, offs)[keep]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).slice(i, j - i).take(pa.array(keep)) for c in (0, 2)], pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                 pa.FixedSizeBinaryArray.from_buffers(pa.binary(HASHES * 4), len(keep), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())],
                names=["id", "text_key", "d1", "d2", "sig"])


def _bands(batches):
    rows = HASHES // BANDS
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, rows).astype(U64)
        key = np.full(sig.shape[:2], 1, U64) * mix(np.arange(BANDS, dtype=U64) + U64(1))
        for r in range(rows):
            key = mix(key * U64(0x9E3779B97F4A7C15) + sig[:, :, r])
        ids = np.repeat(b.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(key.ravel().view(np.int64))], names=["rep", "band"])


def _sets(batches, size):
    for b in batches:
        data, at = text_buffer(b.column(b.schema.get_field_index("text")))
        out = []
        for i, j in pieces(at):
            hashes, offs = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
            out += [np.unique(hashes[s:e]).tobytes() for s, e in zip(offs[:-1], offs[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("rep")), pa.array(out, pa.binary())], names=["rep", "grams"])


def _live_pairs(s1, s2, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two lists of signatures that the posterior doesn't rule out, STEP values at a time."""
    need = least_matches(threshold, tolerance)
    hits = (s1[:, None, :STEP] == s2[None, :, :STEP]).sum(2)
    ok = hits >= need[0]
    if same:
        ok &= np.triu(np.ones_like(ok), 1)
    x, y = np.nonzero(ok)
    got = hits[x, y]
    for k in range(1, len(need)):
        if not len(x):
            break
        for part in np.array_split(np.arange(len(x)), len(x) // 200_000 + 1):
            got[part] += (s1[x[part], k * STEP : (k + 1) * STEP] == s2[y[part], k * STEP : (k + 1) * STEP]).sum(1)
        live = got >= need[k]
        x, y, got = x[live], y[live], got[live]
    return x, y


def _verified(g1: list, g2: list, x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the index pairs whose sets reach the threshold; the sets are counted against each other as 0/1 matrices."""
    if not len(x):
        return x, y
    ux, lx = np.unique(x, return_inverse=True)
    uy, ly = np.unique(y, return_inverse=True)
    n1, n2 = np.array([len(g1[i]) for i in ux]), np.array([len(g2[i]) for i in uy])
    a, b = np.concatenate([g1[i] for i in ux]), np.concatenate([g2[i] for i in uy])
    ra, rb = np.repeat(np.arange(len(ux)), n1), np.repeat(np.arange(len(uy)), n2)
    both = np.intersect1d(a, b)
    common = np.zeros((len(ux), len(uy)), np.float32)
    ca, cb = np.searchsorted(both, a), np.searchsorted(both, b)
    ina, inb = (ca < len(both)), (cb < len(both))
    ina[ina] = both[ca[ina]] == a[ina]
    inb[inb] = both[cb[inb]] == b[inb]
    ca, ra, cb, rb = ca[ina], ra[ina], cb[inb], rb[inb]
    for s in range(0, len(both), 8192):
        ma, mb = np.zeros((len(ux), min(8192, len(both) - s)), np.float32), np.zeros((len(uy), min(8192, len(both) - s)), np.float32)
        k = (ca >= s) & (ca < s + 8192)
        ma[ra[k], ca[k] - s] = 1
        k = (cb >= s) & (cb < s + 8192)
        mb[rb[k], cb[k] - s] = 1
        common += ma @ mb.T
    inter = common[lx, ly].astype(np.float64)
    ok = inter >= threshold * (n1[lx] + n2[ly] - inter) - 1e-9
    return x[ok], y[ok]


def _cells(batches, threshold, tolerance):
    """For each cell (a pair of blocks of one component) its table, the rows of both blocks, and the pairs that stay live."""
    for _, t in keyed_groups(batches, "cell"):
        block = t.column("block").to_numpy()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        mi, mj = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if len(mi) and len(mj):
            yield t, mi, mj, *_live_pairs(sig[mi], sig[mj], i == j, threshold, tolerance)


def _prune(batches, threshold, tolerance):
    """The rows of each cell that have a live pair there: only their sets are sent."""
    for t, mi, mj, x, y in _cells(batches, threshold, tolerance):
        if len(x):
            yield from t.take(np.union1d(mi[x], mj[y])).combine_chunks().to_batches()


def _compare(batches, threshold, tolerance):
    for t, mi, mj, x, y in _cells(batches, threshold, tolerance):
        rep, mult = (t.column(c).to_numpy() for c in ("rep", "mult"))
        grams = [np.frombuffer(v, U64) for v in t.column("grams").to_pylist()]
        x, y = _verified([grams[k] for k in mi], [grams[k] for k in mj], x, y, threshold)
        x, y = mi[x], mj[y]
        if not len(x):
            continue
        links = np.bincount(x, mult[y], len(rep)) + np.bincount(y, mult[x], len(rep))
        order = np.argsort(rep, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = rep[order][local_roots(len(rep), place[x], place[y])][place]
        hit = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])], names=["rep", "links", "root"])


def text_key(text_col: str):
    """64-bit hash of a text, as the column text_key of the join has it."""
    return F.xxhash64(F.col(text_col).cast("string"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8,
                       tolerance: float = 1e-6, block: int = 192, null_ids: bool = False) -> DataFrame:
    """One row per row of `docs`: (id_col, class_id, n_links, text_key, kept).

    n_links counts the other rows whose set of `size`-word shingles has a Jaccard similarity of at least `threshold`;
    class_id is the smallest id reachable through such links. Words are runs of characters above the ASCII space. A text
    of fewer words has one shingle, of all its words; null and empty texts link with nothing. Rows with a null id link
    with nothing; with `null_ids` they are returned, with a null class_id and no links, else left out. Rows that repeat an
    id, with the same text or another, count as rows of their own. `kept` tells the first row of each class, by id and then
    text_key (a 64-bit hash of the text); rows equal in both share it. Other columns of any name are ignored; an empty table
    gives no rows.

    Texts with the same words are one representative with a number and a multiplicity from the first shuffle on, so copies
    never meet. Candidates: 32 bands of 4 of 128 MinHash values (a pair at 0.8 is missed with probability 5e-8). A band's
    bucket is joined to its smallest member only. Within a component of candidates, blocks of `block` texts meet each other
    once: 16 MinHash values at a time are compared, and a pair is dropped when the posterior probability of reaching the
    threshold falls below `tolerance`. Signatures are sent to the block pairs first; the exact sets, by which what is left is
    verified, only of texts that have a live pair there. Only counts and one root for each text leave a block pair, never
    the pairs.
    """
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("text_key"))
    src = every.filter("id is not null")
    told = cut(spread(src).mapInArrow(lambda it: _describe(it, size), "id long, text_key long, d1 long, d2 long, sig binary"))
    first = F.min(F.struct("id", "text_key"))
    reps = (told.groupBy("d1", "d2").agg(first.alias("first"), F.count("*").alias("mult"), F.any_value("sig").alias("sig"))
            .select("d1", "d2", F.col("first.id").alias("id"), F.col("first.text_key").alias("text_key"), "mult", "sig", F.monotonically_increasing_id().alias("rep")))
    reps = cut(reps)  # the numbers hold from here on
    rows = reps.select("rep", "sig").mapInArrow(_bands, "rep long, band long")
    low = rows.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("top")).filter("low < top").select("band", "low")
    near = cut(connected_components(rows.join(low, "band").filter("rep != low").select(F.col("rep").alias("a"), F.col("low").alias("b"))))
    sizes = near.groupBy("component").agg(F.count("*").alias("n")).select("component", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    some = cut(near.join(sizes, "component").join(reps.select(F.col("rep").alias("node"), "id", "text_key", "mult", "sig"), "node")
               .select(F.col("node").alias("rep"), "id", "text_key", "mult", "sig", F.col("component").alias("comp"), "blocks",
                       F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    mate = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = (some.select("rep", "mult", "sig", "comp", "block", mate.alias("other")).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
             .select("rep", "mult", "sig", "block", "i", "j", F.concat_ws("/", "comp", "i", "j").alias("cell")))
    own = lambda df: df.repartition("cell").sortWithinPartitions("cell", "rep")
    fields = "rep long, mult long, sig binary, block int, i int, j int, cell string"
    live = cut(own(cells).mapInArrow(lambda it: _prune(it, threshold, tolerance), fields))
    # Any one row of a representative gives its set: those of equal id and hash have the same words.
    wanted = some.join(live.select("rep").distinct(), "rep", "left_semi").select("rep", "id", "text_key")
    texts = wanted.join(src, ["id", "text_key"]).select("rep", "text")
    if has_repeats(src):
        texts = texts.groupBy("rep").agg(F.any_value("text").alias("text"))
    sets = texts.mapInArrow(lambda it: _sets(it, size), "rep long, grams binary")
    found = cut(own(live.join(sets, "rep")).mapInArrow(lambda it: _compare(it, threshold, tolerance), "rep long, links long, root long"))
    comp = cut(connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    member = comp.join(reps.select(F.col("rep").alias("node"), "id", "text_key"), "node")
    heads = member.groupBy("component").agg(first.alias("head"))
    classes = member.join(heads, "component").select(F.col("node").alias("rep"), "head")
    known = (reps.join(links, "rep", "left").join(classes, "rep", "left")
             .select("d1", "d2", F.coalesce("head", F.struct("id", "text_key")).alias("head"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
    full = (told.select("id", "text_key", "d1", "d2").join(known, ["d1", "d2"])
            .select("id", F.col("head.id").alias("class_id"), "n_links", "text_key", ((F.col("id") == F.col("head.id")) & (F.col("text_key") == F.col("head.text_key"))).alias("kept")))
    alone = lambda df: df.select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "text_key", F.lit(True).alias("kept"))
    bare = alone(src.filter(~has_words("text")))
    if null_ids:
        bare = bare.unionByName(alone(every.filter("id is null")))
    return full.unionByName(bare).withColumnRenamed("id", id_col)


def has_words(text_col: str):
    """Whether a text has a character above the ASCII space; false for null."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike("[^\\x00-\\x20]")


def has_repeats(src: DataFrame) -> bool:
    """Whether an id and text hash stand in several rows (a count of a groupBy; the rows stay on the executors)."""
    return src.groupBy("id", "text_key").count().filter("count > 1").limit(1).count() > 0
