"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text, over n-grams of whole bytes."""

from __future__ import annotations

from posixpath import basename

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.llm.common import U64, cut, keyed_groups, mix, pieces, spread, text_buffer, written

#: A symbol is a byte plus one, 0 before the text: nine bits; six of them and a few more bits for the kind of a row fit a long.
ORDER, BITS = 6, 9
#: What an unknown byte costs under the empty context: all 256 are alike.
UNIFORM = float(np.log(1 / 256))
_ODD = U64(0x9E3779B97F4A7C15)
#: Bits of a key's product that tell the range with which its row is packed for the executors, and files that the ranges are dealt into.
RANGE_BITS, FILES = 5, 8


def grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code of the n-gram of ORDER symbols that ends at each byte, the last symbol in the lowest bits."""
    gap = ORDER - 1
    place = np.arange(len(data)) + gap * (np.repeat(np.arange(len(at) - 1), np.diff(at)) + 1)
    s = np.zeros(len(data) + gap * len(at), np.int64)
    s[place] = data.astype(np.int64) + 1
    back = lambda x, n: np.concatenate([np.zeros(n, np.int64), x[:-n]])
    two = s | back(s, 1) << BITS
    three = two | back(s, 2) << 2 * BITS
    return (three | back(three, 3) << 3 * BITS)[place]


def tagged(gram, model, kind):
    """Key of a table's row: a gram of 54 bits, four bits for the kind (twice the order; one more: what its context leaves), the model."""
    return gram | kind << 54 | model << 58


def _pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys by their differences, and their counts or values, byte by byte of the same rank, compressed: some three bytes a key."""
    planes = lambda x: x.view(np.uint8).reshape(len(x), -1).T.tobytes()
    return len(keys).to_bytes(8, "little") + pa.compress(planes(np.diff(keys, prepend=0)) + planes(values), codec="zstd", asbytes=True)


def _rows(blob: bytes) -> int:
    return int.from_bytes(blob[:8], "little")


def _unpack(blob: bytes, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    size, width = _rows(blob), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=(8 + width) * size, codec="zstd", asbytes=True), np.uint8).reshape(8 + width, size)
    flat = lambda x, kind: np.ascontiguousarray(x.T).view(kind).ravel()
    return np.cumsum(flat(planes[:8], np.int64)), flat(planes[8:], kind)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _counts(batches, shards):
    """Counts of the n-grams of some megabytes of text, a packed row for each shard. Grams with equal first halves have one shard, so
    that differences are small."""
    held, size = [], 0

    def deal():
        key, n = _summed(*[np.concatenate(x) for x in zip(*held, strict=True)])
        shard = (mix((key >> 3 * BITS).view(U64)) % U64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]]).tolist()
        parts = [order[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([int(shard[p[0]]) for p in parts], pa.int32()), pa.array([_pack(key[p], n[p]) for p in parts], pa.binary())], names=["shard", "blob"])

    for b in batches:
        data, at = text_buffer(b.column(0))
        model = b.column(1).to_numpy().astype(np.int64)
        for i, j in pieces(at, 1 << 21):
            g = grams(data[at[i] : at[j]], at[i : j + 1] - at[i])
            if not len(g):
                continue
            held.append(np.unique(tagged(g, np.repeat(model[i:j], np.diff(at[i : j + 1])), 0), return_counts=True))
            size += len(held[-1][0])
            if size > 2_000_000:
                yield deal()
                held, size = [], 0
    if held:
        yield deal()


def _shard_counts(batches):
    """Summed counts of a shard; what is held grows with its distinct n-grams only."""
    for _, t in keyed_groups(batches, "shard"):
        held, size = [], 0
        for blob in t.column("blob").to_pylist():
            held.append(_unpack(blob))
            size += len(held[-1][0])
            if size > 4_000_000:
                held = [_summed(*[np.concatenate(x) for x in zip(*held, strict=True)])]
                size = 0
        key, n = _summed(*[np.concatenate(x) for x in zip(*held, strict=True)])
        for k in range(0, len(key), 100_000):
            part = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array((key[part] >> 58).astype(np.int32)), pa.array(key[part] & ((1 << 54) - 1)), pa.array(n[part])], names=["m", "gram", "c"])


def discounts() -> list[Column]:
    """d1, d2, d3 of modified Kneser-Ney from the counts of counts n1 to n4."""
    y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    cut_at = lambda k, up, low: F.least(F.lit(float(k)), F.greatest(F.lit(0.05 * k), F.coalesce(k - (k + 1) * y * F.try_divide(up, low), F.lit(0.5 * k))))
    return [cut_at(1, "n2", "n1").alias("d1"), cut_at(2, "n3", "n2").alias("d2"), cut_at(3, "n4", "n3").alias("d3")]


def kneser_ney_tables(texts: DataFrame) -> tuple[DataFrame, int, list[int]]:
    """(m, kind, gram, value float) of the models m of `texts` (_text, m), a bound of the number of rows, and the models that have text: for each order k
    the log probability of every n-gram seen (kind 2 k), and the log share that every context seen leaves to the next shorter one
    (kind 2 k + 1, gram = context). Shares are made of counts, so that no sum depends on the order of rows.

    Counts of the highest order are aggregated in the tasks and packed before they are shuffled to their shards; lower orders count distinct predecessors.
    Every step is keyed by model and gram, context or suffix, of which one has 257 rows at most, so no key is hot; all tables
    are as large as the trusted texts make them. Each step is written, so that the union of the tables is a plan of scans: adaptive execution
    plans a query anew after each of its shuffles, and the plans of all orders in one query fill the driver's heap. The number of files
    goes by the rows of the order above, however many partitions shuffles have.
    """
    shards = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = spread(texts.select("_text", "m")).mapInArrow(lambda it: _counts(it, shards), "shard int, blob binary")
    counts = [written(packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shard_counts, "m int, gram long, c long"))]
    sizes = [counts[0].count()]
    for k in range(ORDER - 1, 0, -1):
        short = F.col("gram").bitwiseAND((1 << BITS * k) - 1)
        counts.append(written(counts[-1].groupBy("m", short.alias("gram")).agg(F.count("*").alias("c")), sizes[-1]))
        sizes.append(counts[-1].count())
    low, out = None, []
    for k in range(1, ORDER + 1):
        c, size = counts[ORDER - k], sizes[ORDER - k]
        n = c.groupBy("m").agg(*[F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)])
        marks = F.broadcast(n.select("m", *discounts()))  # one row for each model
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = F.shiftright("gram", BITS).alias("context")
        rows = c.join(marks, "m").select("m", "gram", context, "c", off.alias("off"))
        # how many rows of a context have a count of one, two and more: 257 at most, so that one long holds the three
        kinds = F.sum(F.when(F.col("c") == 1, 1).when(F.col("c") == 2, 1 << 10).otherwise(1 << 20).cast("long"))
        totals = c.groupBy("m", context).agg(F.sum("c").alias("total"), kinds.alias("kinds")).join(marks, "m")
        part = lambda i: F.shiftright("kinds", 10 * i).bitwiseAND(1023)
        totals = written(totals.select("m", "context", "total", (part(0) * F.col("d1") + part(1) * F.col("d2") + part(2) * F.col("d3")).alias("left")), size)
        rows = rows.join(totals.hint("merge"), ["m", "context"])  # files are far smaller than what a broadcast of them takes
        own, spare = (F.col("c") - F.col("off")) / F.col("total"), F.col("left") / F.col("total")
        if low is None:
            p = own + spare / 256
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1)).join(low.withColumnRenamed("gram", "suffix").hint("merge"), ["m", "suffix"])
            p = own + spare * F.col("p")
        low = written(rows.select("m", "gram", p.alias("p")), size)
        out.append(low.select("m", F.lit(2 * k).alias("kind"), "gram", F.log("p").cast("float").alias("value")))
        out.append(totals.select("m", F.lit(2 * k + 1).alias("kind"), F.col("context").alias("gram"), F.log(spare).cast("float").alias("value")))
    table = out[0]
    for t in out[1:]:
        table = table.unionByName(t)
    models = sorted(x.m for x in counts[-1].select("m").distinct().collect())
    return table, 2 * sum(sizes), models  # an order has no more contexts than n-grams


class Table:
    """Rows by key, sorted by a product of the key, with the place of each range of products: a key is found in a probe or two."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self._fill(len(keys), values.dtype, [(keys, values)])

    @classmethod
    def unpacked(cls, ranges: list[list[bytes]]) -> Table:
        """The table of rows packed by ranges of products, the least first; what is needed beside it grows with one range only."""
        table = cls.__new__(cls)
        rows = ([np.concatenate(x) for x in zip(*[_unpack(b, np.float32) for b in blobs], strict=True)] for blobs in ranges if blobs)
        table._fill(sum(_rows(b) for blobs in ranges for b in blobs), np.float32, rows)
        return table

    def _fill(self, size: int, kind: np.dtype, ranges) -> None:
        bits = max(1, size.bit_length())
        self.shift = U64(64 - bits)
        self.keys, self.values, self.first = np.empty(size, np.int64), np.empty(size, kind), np.zeros((1 << bits) + 1, np.int32)
        done = 0
        for keys, values in ranges:
            if not len(keys):
                continue
            order = np.argsort(keys.view(U64) * _ODD)
            part = slice(done, done := done + len(keys))
            self.keys[part], self.values[part] = keys[order], values[order]
            del order
            at = (self.keys[part].view(U64) * _ODD >> self.shift).view(np.int64)
            self.first[at[0] + 1 : at[-1] + 2] += np.bincount(at - at[0]).astype(np.int32)
        np.cumsum(self.first, out=self.first)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The value of each key, NaN where there is none."""
        at = (key.view(U64) * _ODD >> self.shift).view(np.int64)
        pos, end = self.first[at], self.first[at + 1]
        out = np.full(len(key), np.nan)
        live = np.flatnonzero(pos < end)
        while len(live):
            p = pos[live]
            hit = self.keys[p] == key[live]
            out[live[hit]] = self.values[p[hit]]
            live = live[~hit]
            pos[live] += 1
            live = live[pos[live] < end[live]]
        return out


class Sent:
    """A table that the executors have as files, packed by ranges of products; a worker's first task unpacks it."""

    #: The last table that this worker has unpacked, by the names of its files.
    held: dict[tuple[str, ...], Table] = {}

    def __init__(self, names: tuple[str, ...]):
        self.names = names

    def unpacked(self) -> Table:
        if self.names not in Sent.held:
            Sent.held.clear()  # before the next one takes its memory
            ranges: list[list[bytes]] = [[] for _ in range(1 << RANGE_BITS)]
            for name in self.names:
                rows = pq.read_table(SparkFiles.get(name), partitioning=None)
                for at, blob in zip(rows.column("range").to_pylist(), rows.column("blob").to_pylist(), strict=True):
                    ranges[at].append(blob)
                del rows
            Sent.held[self.names] = Table.unpacked(ranges)
        return Sent.held[self.names]


def _ranges(batches):
    """Rows (key, value) of a table, packed for each range of products."""
    held, size = [], 0

    def deal():
        key, value = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key)
        key, value = key[order], value[order]
        at = (key.view(U64) * _ODD >> U64(64 - RANGE_BITS)).astype(np.uint8)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange((1 << RANGE_BITS) + 1)).tolist()
        parts = [(i, order[x:y]) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([_pack(key[p], value[p]) for _, p in parts], pa.binary())], names=["range", "blob"])

    for b in batches:
        if b.num_rows:
            held.append([b.column(0).to_numpy(), b.column(1).to_numpy()])
            size += b.num_rows
        if size > 500_000:
            yield deal()
            held, size = [], 0
    if held:
        yield deal()


def sent(table: DataFrame) -> Sent:
    """The rows of a table (m, kind, gram, value) for every executor. The tasks pack and write them, and Spark's files go to the
    executors with the next job: the driver handles names, no rows."""
    key = F.col("gram").bitwiseOR(F.shiftleft(F.col("kind").cast("long"), 54)).bitwiseOR(F.shiftleft(F.col("m").cast("long"), 58))
    packed = table.select(key.alias("key"), "value").mapInArrow(_ranges, "range int, blob binary")
    files = sorted(written(packed.repartition(FILES, "range")).inputFiles())
    for file in files:
        table.sparkSession.sparkContext.addFile(file)
    return Sent(tuple(map(basename, files)))


def log_probs(table: Table, gram: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Log probability of the last symbol of each gram after the others: what the longest seen part of it has, after what its unseen
    longer contexts leave."""
    back, out, live = np.zeros(len(gram)), np.zeros(len(gram)), np.arange(len(gram))
    for k in range(ORDER, 0, -1):
        g, m = gram[live] & ((1 << BITS * k) - 1), model[live]
        found = table.find(tagged(g, m, 2 * k))
        hit = ~np.isnan(found)
        out[live[hit]] = back[live[hit]] + found[hit]
        live, g, m = live[~hit], g[~hit], m[~hit]
        if not len(live):
            return out
        back[live] += np.nan_to_num(table.find(tagged(g >> BITS, m, 2 * k + 1)))
    out[live] = back[live] + UNIFORM
    return out


def _perplexities(data: np.ndarray, at: np.ndarray, model: np.ndarray, lookup) -> np.ndarray:
    """Perplexity by byte of each row's whole text; NaN for an empty one."""
    out = np.full(len(at) - 1, np.nan)
    for i, j in pieces(at):
        n = np.diff(at[i : j + 1])
        logp = lookup(grams(data[at[i] : at[j]], at[i : j + 1] - at[i]), np.repeat(model[i:j].astype(np.int64), n))
        some = n > 0
        if some.any():  # a sum for each text, which its neighbours don't touch
            out[i:j][some] = np.exp(-np.add.reduceat(logp, (at[i:j] - at[i])[some]) / n[some])
    return out


def _score(batches, told):
    for b in batches:
        table = told.unpacked()
        p = _perplexities(*text_buffer(b.column(0)), b.column(1).to_numpy(), lambda g, m: log_probs(table, g, m))  # noqa: B023
        yield pa.RecordBatch.from_arrays([pa.array(p, from_pandas=True), *b.columns[1:]], names=["perplexity", *b.schema.names[1:]])


def _asked(batches):
    """The distinct n-grams of each piece of a bucket's texts."""
    for b in batches:
        data, at = text_buffer(b.column(0))
        model, bucket = b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy()
        for x in np.unique(bucket):
            rows = np.flatnonzero(bucket == x)
            part, own = text_buffer(b.column(0).take(pa.array(rows)))
            for i, j in pieces(own, 1 << 22):
                g = grams(part[own[i] : own[j]], own[i : j + 1] - own[i])
                key = np.unique(tagged(g, np.repeat(model[rows[i:j]], np.diff(own[i : j + 1])), 0))
                for k in range(0, len(key), 100_000):
                    part_key = key[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part_key), x)), pa.array(part_key)], names=["bucket", "key"])


def _score_bucket(batches):
    """Texts of a bucket under the answers that stand before them."""
    for _, t in keyed_groups(batches, "bucket"):
        text = np.array(t.column("is_text").to_pylist(), bool)
        told, docs = t.filter(pa.array(~text)), t.filter(pa.array(text))
        table = Table(told.column("key").to_numpy(), told.column("value").to_numpy())
        lookup = lambda g, m: table.find(tagged(g, m, 0))  # noqa: E731, B023
        for b in docs.to_batches():
            data, at = text_buffer(b.column(b.schema.get_field_index("_text")))
            p = _perplexities(data, at, b.column(b.schema.get_field_index("m")).to_numpy(), lookup)
            yield pa.RecordBatch.from_arrays([pa.array(p, from_pandas=True), *[b.column(b.schema.get_field_index(c)) for c in ("m", "_id", "_lang", "_trusted")]], names=["perplexity", "m", "_id", "_lang", "_trusted"])


def resolve(asked: DataFrame, table: DataFrame) -> DataFrame:
    """(key, value double) for each distinct key (gram and model) of `asked`, by joins with the sharded tables from the longest
    n-grams down; rows that an order has answered don't go on to the next. Orders one and two are bounded by the alphabet, and broadcast."""
    q = asked.select("key", F.shiftright("key", 58).cast("int").alias("m"), F.col("key").bitwiseAND((1 << 54) - 1).alias("gram"), F.lit(0.0).alias("back"))
    done = []
    for k in range(ORDER, 0, -1):
        side = (lambda df: F.broadcast(df)) if k <= 2 else (lambda df: df)
        prob = table.filter(F.col("kind") == 2 * k).select("m", F.col("gram").alias("_g"), F.col("value").cast("double").alias("found"))
        left = table.filter(F.col("kind") == 2 * k + 1).select("m", F.col("gram").alias("_g"), F.col("value").cast("double").alias("spare"))
        q = cut(q.withColumn("_g", F.col("gram").bitwiseAND((1 << BITS * k) - 1)).join(side(prob), ["m", "_g"], "left"))
        done.append(q.filter("found is not null").select("key", (F.col("back") + F.col("found")).alias("value")))
        q = q.filter("found is null").withColumn("_g", F.shiftright("_g", BITS)).join(side(left), ["m", "_g"], "left")
        q = q.select("key", "m", "gram", (F.col("back") + F.coalesce("spare", F.lit(0.0))).alias("back"))
    out = q.select("key", (F.col("back") + UNIFORM).alias("value"))
    for d in done:
        out = out.unionByName(d)
    return out


def perplexity(src: DataFrame, table: DataFrame, size: int, most_broadcast: int = 12_000_000, bucket_bytes: int = 24_000_000) -> DataFrame:
    """`src` (_text, m, _id, _lang, _trusted) without its text, and with the perplexity of each row under model m.

    Tables of `size` rows, up to `most_broadcast` (12 bytes each in a worker, fewer on the way), go to every executor as files, so that texts stay where they are. Beyond that the texts
    are dealt into buckets of about `bucket_bytes`; each bucket asks for its distinct n-grams once, all buckets' distinct ones
    meet the tables by keyed joins, and the answers go back to the buckets. Both ways give the same numbers.
    """
    rest = ["m", "_id", "_lang", "_trusted"]
    kinds = "perplexity double, m int, _id long, _lang string, _trusted boolean"
    if size <= most_broadcast:
        told = sent(table)
        return spread(src.select("_text", *rest)).mapInArrow(lambda it: _score(it, told), kinds)
    table = cut(table)
    total = src.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = int(max(4, total // bucket_bytes))
    dealt = src.withColumn("bucket", F.pmod(F.xxhash64("_id", "_lang", "_text"), F.lit(buckets)))
    asked = cut(dealt.repartition(buckets, "bucket").select("_text", "m", "bucket").mapInArrow(_asked, "bucket long, key long").distinct())
    answers = asked.join(resolve(asked.select("key").distinct(), table), "key").select("bucket", "key", "value", F.lit(False).alias("is_text"))
    both = answers.unionByName(dealt.withColumn("is_text", F.lit(True)), allowMissingColumns=True)
    return both.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_score_bucket, kinds)


def order_statistic(values: DataFrame, key: str, column: str, quantile: float) -> DataFrame:
    """(key, q): the value at place ceil(quantile * n) of the n values of each key, exactly, however the rows are partitioned.

    Values are counted in bins of 1/1024, the bin of that place is found among the counts, and then only its rows are counted by
    value: no task gets more than a key's bins, or the distinct values of one bin.
    """
    def at(counts, by, place):
        upto = F.sum("_n").over(Window.partitionBy(key).orderBy(by))
        ranked = counts.withColumn("_place", place).withColumn("_upto", upto)
        return ranked.filter("_upto >= _place and _upto - _n < _place").withColumn("_place", F.col("_place") - F.col("_upto") + F.col("_n"))

    binned = values.select(key, column, F.floor(F.col(column) * 1024).alias("_bin"))
    total = F.sum("_n").over(Window.partitionBy(key))
    bins = at(binned.groupBy(key, "_bin").agg(F.count("*").alias("_n")), "_bin", F.greatest(F.lit(1), F.ceil(F.lit(float(quantile)) * total)))
    rows = binned.join(bins.select(key, "_bin", "_place"), [key, "_bin"]).groupBy(key, column).agg(F.count("*").alias("_n"), F.max("_place").alias("_place"))
    return at(rows, column, F.col("_place")).select(key, F.col(column).alias("q"))


def quality_filter(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.995, slack: float = 1.05, most_ids: int = 500_000,
                   most_languages: int = 100_000, most_broadcast: int = 12_000_000) -> DataFrame:
    """(id_col, lang, perplexity, threshold, keep) for each row of `docs`.

    The rows whose id is in `trusted_ids` (one column, id_col) are dealt into two halves by a hash of the id, and a model of
    order six over whole bytes is counted on each. Every row is scored under the half that its id is not in, so that trusted
    rows set the thresholds by texts that their model hasn't seen. Where only one half has text, its model scores every row, the
    trusted ones too. A row is kept if its perplexity is at most `slack` times the
    `quantile` (ties included) of the trusted rows of its language; a language without trusted rows, or null, takes the quantile
    of all trusted rows. Null and empty texts have no perplexity and are not kept; nor is any row where nothing is trusted.
    Repeated rows and ids are rows of their own; rows with a null id are scored, but never trusted. Other columns are ignored.

    Up to `most_ids` trusted ids are broadcast, so that texts stay where they are; beyond that they meet by a keyed join.
    Thresholds of up to `most_languages` languages are broadcast; beyond that a language's rows are dealt over 32 keys.
    """
    ids = trusted_ids.select(F.col(id_col).cast("long").alias("_id")).filter("_id is not null").distinct()
    few = ids.limit(most_ids + 1).count() <= most_ids
    ids = ids.withColumn("_trusted", F.lit(True))
    half = F.coalesce(F.pmod(F.xxhash64("_id"), F.lit(2)), F.lit(0)).cast("int")
    src = (docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
           .join(F.broadcast(ids) if few else ids, "_id", "left").select("_id", "_lang", "_text", F.coalesce("_trusted", F.lit(False)).alias("_trusted"), (1 - half).alias("m")))
    tables, size, models = kneser_ney_tables(src.filter("_trusted").select("_text", (1 - F.col("m")).alias("m")))
    if len(models) == 1:
        src = src.withColumn("m", F.lit(models[0]))
    scored = cut(perplexity(src, tables, size, most_broadcast))
    good = scored.filter("_trusted and perplexity is not null")
    by_lang = written(order_statistic(good.filter("_lang is not null"), "_lang", "perplexity", quantile))  # one row for each language
    overall = order_statistic(good.withColumn("_all", F.lit(0)), "_all", "perplexity", quantile).first()
    limit = F.coalesce(F.col("q"), F.lit(overall and overall.q).cast("double")) * slack
    if by_lang.limit(most_languages + 1).count() <= most_languages:
        scored = scored.join(F.broadcast(by_lang), "_lang", "left")
    else:
        salt = F.pmod(F.xxhash64("_id", "perplexity"), F.lit(32))
        scored = scored.withColumn("_salt", salt).join(by_lang.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long")))), ["_lang", "_salt"], "left")
    return (scored
            .select(F.col("_id").alias(id_col), F.col("_lang").alias("lang"), "perplexity", limit.alias("threshold"),
                    F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("keep")))
