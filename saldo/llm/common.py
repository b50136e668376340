"""Helpers shared by the training-data operators: Arrow text buffers, word shingles, checkpoints, graph components."""

from __future__ import annotations

import secrets
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir. Where none is set a local session (tests) takes a folder of its own; on a cluster
    that is an error, as executors can't see the driver's folders."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="saldo-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of executors and ends the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows that a task writes where their number is known; some megabytes.
ROWS_A_FILE = 1 << 17


def written(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Like `cut`, as a compressed table in the same folder: checkpoints hold whole rows, several times as large.

    Where a bound of its rows is known, no more tasks write it than those rows need: a file of a few rows costs as much as a large one,
    on a local file system several processes (chmod), each of which shares the executor's memory until it has begun."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    if most_rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-most_rows // ROWS_A_FILE)))
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """Scans of one small file come as one task; deal them over the cores. Larger scans stay as they are."""
    sc = df.sparkSession.sparkContext
    return df if df.rdd.getNumPartitions() >= sc.defaultParallelism else df.repartition(sc.defaultParallelism)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one uint8 array, and n+1 offsets into it. Null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    col = col.cast(pa.large_binary())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, most: int = 1 << 20):
    """Row ranges [i, j) of about `most` bytes each, so that work arrays stay small; a longer row stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for name, base in (("p", _MULT), ("q", _INV)):
            out = np.empty(size, U64)
            out[0], done, step = 1, 1, base
            while done < size:
                out[done : 2 * done] = out[:done] * U64(step)
                done, step = 2 * done, step * step % (1 << 64)
            _POWERS[name] = out
    return _POWERS["p"], _POWERS["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (multiply and xor-shift)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(32)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums c of byte * m^i modulo 2^64; (c[e] - c[s]) * m^-s is then the hash of data[s:e].

    Different spans of a thousand bytes can have the same one whatever m is, so it only deals out work and names features."""
    p, _ = _powers(len(data) + 1)
    c = np.empty(len(data) + 1, U64)
    c[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * p[: len(data)], out=c[1:])
    return c


def span_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, q = _powers(len(c))
    return mix((c[ends] - c[starts]) * q[starts])


class SpanHash:
    """Hashes of spans that decide whether bytes are equal: two polynomials over the field of 2^31 - 1 elements, at bases drawn for a run.

    Two different spans of n bytes have the same hash for at most (n / 2^31)^2 of the bases: 2e-15 at 100 bytes, 2e-10 at 30 000."""

    PRIME = (1 << 31) - 1

    def __init__(self, bases: tuple[int, int] | None = None):
        self.bases = bases or tuple(2 + secrets.randbelow(self.PRIME - 2) for _ in range(2))
        self.tables: list[np.ndarray] = []

    def __reduce__(self):
        return SpanHash, (self.bases,)  # tables are made where they are used

    def _powers(self, n: int) -> list[np.ndarray]:
        """Powers of each base and of its inverse."""
        if not self.tables or len(self.tables[0]) < n:
            size, self.tables = max(1 << 16, 1 << int(n - 1).bit_length()), []
            for b in self.bases:
                for step in (b, pow(b, -1, self.PRIME)):
                    out = np.ones(size, U64)
                    done = 1
                    while done < size:
                        out[done : 2 * done] = out[:done] * U64(step) % U64(self.PRIME)
                        done, step = 2 * done, step * step % self.PRIME
                    self.tables.append(out)
        return self.tables

    def sums(self, data: np.ndarray) -> list[np.ndarray]:
        """Prefix sums for `of`."""
        out = []
        for p in self._powers(len(data) + 1)[::2]:
            terms = (data.astype(U64) + U64(1)) * p[: len(data)]
            if len(data) >= 1 << 24:
                terms %= U64(self.PRIME)
            out.append(np.concatenate([np.zeros(1, U64), np.cumsum(terms)]))
        return out

    def of(self, sums: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        one, two = ((c[ends] - c[starts]) % U64(self.PRIME) * q[starts] % U64(self.PRIME) for c, q in zip(sums, self._powers(len(sums[0]))[1::2], strict=True))
        return mix(one << U64(31) | two)


#: Masks of the lowest 0 to 8 bytes.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as an integer."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> np.ndarray:
    """A digest of every word (none with a zero byte); one of up to eight bytes, which are an integer, is computed once for all its places."""
    raw, size = data.tobytes(), ends - starts
    out, short = np.empty(len(starts), U64), size <= 8
    of = lambda at: np.array([digest(raw[s:e]) for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], U64)
    _, first, back = np.unique(eights(data)[starts[short]] & MASKS[size[short]], return_index=True, return_inverse=True)
    out[short] = of(np.flatnonzero(short)[first])[back]
    out[~short] = of(np.flatnonzero(~short))
    return out


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs of bytes above the space) and, per row, the first word's index (n+1)."""
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(at), np.int64)
    is_word = data > 32
    before = np.empty_like(is_word)
    before[0], before[1:] = False, is_word[:-1]
    after = np.empty_like(is_word)
    after[-1], after[:-1] = False, is_word[1:]
    inner = at[(at > 0) & (at < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    return starts, np.flatnonzero(is_word & ~after) + 1, np.searchsorted(starts, at)


def shingles(data: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, row after row, and n+1 offsets. A row of fewer words has one, of all its words."""
    starts, ends, first = word_spans(data, at)
    if len(starts) == 0:
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    words = word_digests(data, starts, ends)
    coef = mix(np.arange(1, size + 1, dtype=U64) * U64(_MULT))
    n = np.diff(first)
    padded = np.concatenate([words, np.zeros(size, U64)])
    runs = sum(padded[j : j + len(words)] * coef[j] for j in range(size))
    short = np.flatnonzero((n > 0) & (n < size))
    for i in short:
        runs[first[i]] = (words[first[i] : first[i + 1]] * coef[: n[i]]).sum(dtype=U64)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    offs = np.concatenate([[0], np.cumsum(count)])
    take = np.repeat(first[:-1] - offs[:-1], count) + np.arange(offs[-1])
    return mix(runs[take]), offs


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with component = the smallest node reachable, for every node that stands in an edge.

    Alternates large-star and small-star joins (each a keyed shuffle that Spark can split when a hub is hot) until the
    edge set, always as large as the graph at most, stops changing. Nothing but its checksum reaches the driver.
    """
    big, small = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    e = cut(edges.filter(F.col(a) != F.col(b)).select(big.alias("u"), small.alias("v")).distinct())
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
                .unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions through the given links."""
    root = np.arange(n)
    while len(left):
        m = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, m)
        np.minimum.at(new, right, m)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def keyed_groups(batches, key: str):
    """(key, table) for each run of equal keys in a stream of Arrow batches sorted by that column."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if b.num_rows == 0:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if held and k[s] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = k[s]
            held.append(b.slice(s, e - s))
    if held:
        yield now, pa.Table.from_batches(held)


def beside(keep_cols: tuple[str, ...], *results: str) -> tuple[str, ...]:
    """The columns to keep beside results: one that has a result's name, in whatever case, gives way to it; one named twice comes once."""
    taken = {r.lower() for r in results}
    return tuple({c.lower(): c for c in reversed(keep_cols) if c.lower() not in taken}.values())[::-1]
