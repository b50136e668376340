"""Exact top-k search by inner product: global score histograms locate each query's kth value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldo.llm.common import U64, cut, keyed_groups, spread

BINS = 1024
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: A score beyond a long is ordered by its bytes, moved above zero: 64 x is under 2^1030, so that any inner product is under 2^2111.
WIDE_BYTES = 264
#: Components of the candidates of a cell, which its task holds.
CELL_BYTES = 32_000_000
#: Blocks of rows: `tag` names a row, `kind` is the letter of the components' type.
BLOCK = "dim int, query boolean, size long, kind string, ids binary, tags binary, vecs binary, peak double"


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(64 x) in the narrowest integer type that holds it; components beyond int64 stay doubles, which are whole there."""
    with np.errstate(over="ignore"):
        v = np.floor(64.0 * x)
    top = np.abs(v).max(initial=0)
    if top >= 2.0**62:
        return x.astype(np.float64)  # 64 x may be no double; _exact() multiplies
    for kind in (np.int8, np.int16, np.int32):
        if top <= np.iinfo(kind).max:
            return v.astype(kind)
    return v.astype(np.int64)


def _exact(v: np.ndarray) -> np.ndarray:
    """Components as Python integers."""
    if v.dtype != np.float64:
        return v.astype(object)
    return np.array([int(np.floor(64.0 * x)) if abs(x) < 2.0**50 else 64 * int(x) for x in v.ravel().tolist()], object).reshape(v.shape)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: by doubles where these are exact, by int64 where it holds them, else by Python integers."""
    if q.dtype != np.float64 and x.dtype != np.float64:
        reach = q.shape[1] * int(np.abs(q.astype(np.int64)).max(initial=0)) * int(np.abs(x.astype(np.int64)).max(initial=0))
        if reach < 2**53:
            return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        if reach < 2**63:
            return q.astype(np.int64) @ x.astype(np.int64).T
    return _exact(q) @ _exact(x).T


def _scores(products: np.ndarray) -> np.ndarray:
    """Products as int64, those beyond it as its nearest value: the order is kept, only ties are added."""
    return products if products.dtype == np.int64 else np.clip(products, LOW + 1, HIGH).astype(np.int64)


def _behind(products: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """What orders equal scores, smallest first: the exact product of those at the ends of the range, negated; 0 for the rest."""
    out = np.zeros(len(scores), np.int64)
    ends = np.flatnonzero((scores == HIGH) | (scores <= LOW + 1))
    if len(ends):
        out = out.astype(object)
        out[ends] = [-int(v) for v in products[ends].tolist()]
    return out


def _wide(behind: np.ndarray) -> pa.Array:
    """Exact products of the scores at the ends as bytes in their order; null for the rest."""
    offset = 1 << (8 * WIDE_BYTES - 1)
    return pa.array([None if v == 0 else (offset - v).to_bytes(WIDE_BYTES, "big") for v in behind.tolist()], pa.binary())


def _pack(batches, block_rows, query_rows):
    """Rows in blocks of one length, group and magnitude: ids, tags and integer components as bytes.

    Huge components have blocks of their own, so that others keep the fast product."""
    from pyspark import TaskContext

    tag = TaskContext.get().partitionId() << 40
    held: dict[tuple[int, bool, bool], list] = {}

    def block(key, ids, tags, vecs):
        v = _whole(vecs)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([len(ids)]), pa.array([v.dtype.char]), pa.array([ids.tobytes()]), pa.array([tags.tobytes()]),
             pa.array([v.tobytes()]), pa.array([float(np.abs(vecs).max(initial=0))])], names=[c.split()[0] for c in BLOCK.split(", ")])

    for b in batches:
        ids, lists, query = b.column(0).to_numpy(), b.column(1), np.array(b.column(2).to_pylist(), bool)
        offs, flat, tags = lists.offsets.to_numpy(), lists.values.to_numpy(), tag + np.arange(b.num_rows)
        tag += b.num_rows
        size = np.diff(offs)
        huge = np.maximum.reduceat(np.abs(flat[offs[0] : offs[-1]]), offs[:-1] - offs[0]) >= 2.0**15 if b.num_rows else query
        for d in np.unique(size):
            for q in (False, True):
                for h in (False, True):
                    rows = np.flatnonzero((size == d) & (huge == h) & (query if q else True))  # a query is a candidate of the others, too
                    if not len(rows):
                        continue
                    key, most = (int(d), q, h), query_rows if q else block_rows
                    held.setdefault(key, []).append((ids[rows], tags[rows], flat[offs[rows][:, None] + np.arange(d)]))
                    while sum(len(x[0]) for x in held[key]) >= most:
                        parts = [np.concatenate(x) for x in zip(*held[key], strict=True)]
                        yield block(key, *[x[:most] for x in parts])
                        held[key] = [tuple(x[most:] for x in parts)]
    for key, rows in held.items():
        if sum(len(r[0]) for r in rows):
            yield block(key, *[np.concatenate(x) for x in zip(*rows, strict=True)])


class Block:
    """A packed block as arrays."""

    def __init__(self, row: dict):
        self.ids, self.tags = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["tags"], np.int64)
        self.vecs = np.frombuffer(row["vecs"], row["kind"]).reshape(len(self.ids), row["dim"])
        if row["query"]:
            self.low, self.width = np.frombuffer(row["lows"], np.int64), np.frombuffer(row["widths"], U64)


def _cells(batches):
    """(query block, its blocks of candidates, one at a time) of each cell; the queries of a cell come first."""
    for _, t in keyed_groups(batches, "cell"):
        rows = t.select([c for c in t.column_names if c != "cell"])
        first = rows.slice(0, int(np.count_nonzero(np.array(rows.column("query").to_pylist(), bool))))
        for q in first.to_pylist():
            yield Block(q), (Block(rows.slice(i, 1).to_pylist()[0]) for i in range(first.num_rows, rows.num_rows))


def _histograms(batches):
    """Per query of a cell the counts of all its scores by bin of [low, low + BINS * width); the last bin counts what lies above."""
    for q, candidates in _cells(batches):
        total = np.zeros((len(q.ids), BINS + 1), np.int64)
        for x in candidates:
            s = _scores(_products(q.vecs, x.vecs))
            live = (s >= q.low[:, None]) & (q.tags[:, None] != x.tags[None])
            bins = np.minimum((s.view(U64) - q.low.view(U64)[:, None]) // q.width[:, None], U64(BINS)).astype(np.int64)
            bins += np.arange(len(q.ids))[:, None] * (BINS + 1)
            total += np.bincount(bins[live], minlength=total.size).reshape(total.shape)
        for i in range(0, len(q.ids), 256):
            part = slice(i, i + 256)
            yield pa.RecordBatch.from_arrays([pa.array(q.tags[part]), pa.array(q.ids[part]), pa.array(q.low[part]), pa.array(q.width[part].view(np.int64)), pa.array([x.astype(np.int32 if x.max(initial=0) < 2**31 else np.int64).tobytes() for x in total[part]], pa.binary())],
                                             names=["tag", "query_id", "low", "width", "counts"])


def _refine(batches, k):
    """The bin of each query's kth score, from the summed histogram, as its next range. With fewer than k scores all are wanted."""
    for tag, t in keyed_groups(batches, "tag"):
        total = sum(np.frombuffer(x, np.int64 if len(x) > 4 * (BINS + 1) else np.int32).astype(np.int64) for x in t.column("counts").to_pylist())
        low, width = t.column("low")[0].as_py(), t.column("width").to_numpy()[:1].view(U64)[0]
        reached = np.flatnonzero(np.cumsum(total[::-1]) >= k)
        if not len(reached):
            low, width = LOW, 1
        else:
            low, width = low + (BINS - int(reached[0])) * int(width), -(-int(width) // BINS) if width > 1 else 1
        yield pa.RecordBatch.from_arrays([pa.array([int(tag)], pa.int64()), pa.array([low], pa.int64()), pa.array([width], pa.int64())], names=["tag", "low", "width"])


def _select(batches, k):
    """Scores above the query's kth value, and those equal to it with the smallest ids: k at most of a cell."""
    for q, candidates in _cells(batches):
        held = None
        for x in candidates:
            products = _products(q.vecs, x.vecs)
            s = _scores(products)
            row, col = np.nonzero((s >= q.low[:, None]) & (q.tags[:, None] != x.tags[None]))
            got = (row, x.ids[col], s[row, col], _behind(products[row, col], s[row, col]))
            row, ids, s, behind = got if held is None else (np.concatenate(c) for c in zip(held, got, strict=True))
            order = np.lexsort((ids, behind, -1 - s, row))  # -1 - s: falling scores without overflow
            row, ids, s, behind = row[order], ids[order], s[order], behind[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            held = tuple(c[place < k] for c in (row, ids, s, behind))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(q.tags[held[0]]), pa.array(q.ids[held[0]]), pa.array(held[1]), pa.array(held[2]), _wide(held[3])], names=["tag", "query_id", "vec_id", "score", "wide"])


def _query_rows(batches):
    for b in batches:
        for r in b.to_pylist():
            tags = np.frombuffer(r["tags"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tags), r["block"])), pa.array(tags), pa.array(np.arange(len(tags), dtype=np.int32))], names=["block", "tag", "pos"])


def _attach(batches):
    """Query blocks with each query's range, from rows (pos, low, width)."""
    for b in batches:
        for r in b.to_pylist():
            ranges = sorted(r.pop("ranges"), key=lambda x: x["pos"])
            r["lows"] = np.array([x["low"] for x in ranges], np.int64).tobytes()
            r["widths"] = np.array([x["width"] for x in ranges], np.int64).tobytes()
            yield pa.RecordBatch.from_pylist([r], schema=pa.schema([("block", pa.int64()), ("lows", pa.binary()), ("widths", pa.binary())]))


def top_k(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", query: str = "vec_id % 20 = 0", block: int = 4096, query_block: int = 1024) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k highest integer inner products of floor(64 x).

    Rows that meet the SQL condition `query` are the queries; all rows but the query's own are candidates. Ties go to the
    smaller id. A repeated id stands for rows of their own: each is a query with k results of its own, and a candidate of the
    others. Vectors that are null, empty, or hold null or non-finite components, and rows with a null id, take no part;
    vectors of another length than the query's are no candidates. Any finite components are computed and ranked exactly; a score
    beyond the range of a long is told as the nearest long. Other columns are ignored; an empty table gives no rows.

    Rows are packed into blocks, in the narrowest integer type. A cell is a query block with a group of candidate blocks of some
    CELL_BYTES on average, which its task holds packed and scores one at a time; cells have keys of their own, so no key gathers more than that. A round scores
    everything and counts all scores into BINS bins per query; the summed histogram says in which bin the kth score lies,
    and the next round splits that bin, until bins are one score wide (two rounds for components of at most one, more for
    larger ones). A last round filters what reaches the kth value and breaks ties.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    ok = F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    src = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(F.expr(query), F.lit(False)).alias("query"))
           .filter(F.col("id").isNotNull() & ok))
    packed = cut(spread(src).mapInArrow(lambda it: _pack(it, block, query_block), BLOCK).withColumn("block", F.monotonically_increasing_id()))
    # Numbers of the blocks and their sums are small tables, one row a block.
    place = packed.select("block", "dim", "query", (F.row_number().over(Window.partitionBy("dim", "query").orderBy("block")) - 1).alias("place"))
    sums = packed.groupBy("dim").agg(F.count_if("query").alias("n_q"), F.count_if(~F.col("query")).alias("n_x"), F.max("peak").alias("peak"), F.sum(F.when(~F.col("query"), F.octet_length("vecs"))).alias("bytes"))
    groups = F.least(F.col("n_x"), F.greatest(F.ceil(2 * cores / F.col("n_q")), F.ceil(F.col("n_x") / 256), F.ceil(F.col("bytes") / CELL_BYTES)))
    sums = cut(sums.filter("n_q > 0").withColumn("groups", groups))
    known = packed.join(place.select("block", "place"), "block").join(sums.select("dim", "n_q", "groups"), "dim")
    queries = cut(known.filter("query"))
    dealt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_q") - 1)).alias("q")
    shared = [c for c in packed.columns if c not in ("block", "peak")]
    bases = cut(known.filter("not query").select(*shared, F.pmod("place", "groups").alias("g"), "n_q")).select(*shared, "g", dealt)
    reach = F.least(F.col("dim") * F.pow(64 * F.col("peak") + 1, F.lit(2)), F.lit(2.0**62))
    state = (queries.select("block", "tags").mapInArrow(_query_rows, "block long, tag long, pos int").join(queries.select("block", "dim"), "block").join(sums.select("dim", "peak"), "dim")
             .select("block", "tag", "pos", F.when(reach < 2.0**62, -F.ceil(reach)).otherwise(F.lit(LOW + 1)).alias("low"),
                     F.when(reach < 2.0**62, F.ceil((2 * reach + 3) / BINS)).otherwise(F.lit(2**64 // BINS)).cast("long").alias("width")))
    state = cut(state)

    def cells(state):
        ranges = state.groupBy("block").agg(F.collect_list(F.struct("pos", "low", "width")).alias("ranges")).mapInArrow(_attach, "block long, lows binary, widths binary")  # of one block: bounded
        mine = queries.join(ranges, "block").select(*shared, F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"), F.col("place").cast("long").alias("q"), "lows", "widths")
        both = mine.unionByName(bases, allowMissingColumns=True).withColumn("cell", F.concat_ws("/", "dim", "q", "g"))
        return both.repartition(4 * cores, "cell").sortWithinPartitions("cell", F.desc("query")).drop("g", "q")

    while True:
        widest = state.agg(F.max("width")).first()[0]
        if widest is None:
            break
        counts = cells(state).mapInArrow(_histograms, "tag long, query_id long, low long, width long, counts binary")
        kth = counts.drop("query_id").repartition("tag").sortWithinPartitions("tag").mapInArrow(lambda it: _refine(it, k), "tag long, low long, width long")
        state = cut(state.select("block", "tag", "pos").join(kth, "tag"))
        if widest == 1:
            break
    best = cells(state).mapInArrow(lambda it: _select(it, k), "tag long, query_id long, vec_id long, score long, wide binary")
    rank = Window.partitionBy("tag").orderBy(F.desc("score"), F.desc("wide"), "vec_id")
    return best.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
