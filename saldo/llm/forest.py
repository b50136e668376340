"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue for each query.

The trees are fitted on a bounded sample; every row is indexed, in a leaf of each tree. A query takes leaves from all trees by their
distance from it; leaves meet their queries as cells on the executors, where candidates are ranked by their exact distance.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldo.llm.common import cut, spread

TREES, LEAF = 8, 256
#: The sample: so many rows, and so many bytes of components as doubles, at most.
SAMPLE, SAMPLE_BYTES = 65_536, 1 << 26
#: A query visits about EFFORT * n ** GROWTH of n distinct vectors over all trees, and at least LEAST.
EFFORT, GROWTH, LEAST = 5.0, 0.85, 16_384
ROWS, QUERIES = 65_536, 16_384  # of a cell, about
BLOCK = (2048, 256)
#: Lengths that get a forest, the most frequent first; vectors of others are compared whole.
LENGTHS = 64
CELL = "cell string, query boolean, tag long, first long, bound double, raw binary"


@dataclass
class Forest:
    """Trees over vectors of one length. Nodes of all trees stand in one table; a child below 0 is a leaf, its number inverted."""

    planes: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    roots: list[int]
    share: np.ndarray  # rows that a leaf stands for, about
    members: list[np.ndarray]  # the sample's rows in each leaf
    sample: np.ndarray
    budget: float

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (live := np.flatnonzero(at >= 0)).size:
                node = at[live]
                with np.errstate(over="ignore", invalid="ignore"):
                    side = np.einsum("ij,ij->i", x[live], self.planes[node]) >= self.cuts[node]
                at[live] = self.children[node, side.astype(np.int64)]
            out[:, t] = ~at
        return out

    def search(self, q: np.ndarray, k: int) -> tuple[list[int], float]:
        """Leaves for a query, nearest first, and a distance within which at least k other vectors are.

        A plane's distance is one of all vectors beyond it, so the search ends when the next leaf is farther than k vectors of the
        sample are from the query, or else when the budget is used up."""
        with np.errstate(over="ignore", invalid="ignore"):
            far = np.einsum("ij,j->i", self.planes, q) - self.cuts
        queue, leaves, visited, bound = [(0.0, r) for r in self.roots], [], 0.0, np.inf
        while queue and visited < self.budget:
            margin, node = heapq.heappop(queue)
            if margin > bound:
                break
            while node >= 0:
                side = far[node]
                away = abs(side) * (1 - 1e-9)
                heapq.heappush(queue, (max(margin, away) if away == away else margin, int(self.children[node, 0 if side >= 0 else 1])))
                node = int(self.children[node, 1 if side >= 0 else 0])
            leaves.append(~node)
            visited += self.share[~node]
            if len(leaves) == len(self.roots):
                near = np.unique(np.concatenate([self.members[x] for x in leaves]))
                d = distances(q[None], np.zeros(len(near), np.int64), self.sample, near)
                d = np.sort(d[d > 0])
                bound = float(d[k - 1]) if len(d) >= k else np.inf
        return leaves, bound


def distances(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distance of the rows i of a from the rows j of b: squares are summed in the order of components, whatever rows stand
    beside them, and scaled by a power of two where they leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        total = np.zeros(len(i))
        for c in range(a.shape[1]):
            total += np.square(a[i, c] - b[j, c])
        out = np.sqrt(total)
        for n in np.flatnonzero(~((total > 2.0**-900) & (total < 2.0**900))):
            shrink = 1.0 if total[n] < 1 else 4.0
            diff = a[i[n]] / shrink - b[j[n]] / shrink
            if top := np.abs(diff).max():
                scale = np.exp2(np.floor(np.log2(top)))
                out[n] = np.sqrt(np.square(diff / scale).sum()) * scale * shrink
    return out


def fit(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, effort: float = EFFORT, seed: int = 0) -> Forest:
    """Splits the sample at the median of a random projection (on the line through two of its rows), down to `leaf` rows, in each tree."""
    rng = np.random.default_rng(seed)
    planes, cuts, children, roots, members = [], [], [], [], []

    def grow(ix: np.ndarray) -> int:
        side = None
        if len(ix) > leaf:
            a, b = rng.choice(ix, 2, replace=False)
            with np.errstate(over="ignore", invalid="ignore"):
                plane = sample[a] / 2 - sample[b] / 2
                plane = plane / np.abs(plane).max()
                plane = plane / np.linalg.norm(plane)
                p = np.einsum("ij,j->i", sample[ix], plane)
                at = np.median(p)
                side = p >= at
        if side is None or side.all() or not side.any() or not np.isfinite(at):
            members.append(ix)
            return ~(len(members) - 1)
        node = len(planes)
        planes.append(plane)
        cuts.append(at)
        children.append([0, 0])
        children[node] = [grow(ix[~side]), grow(ix[side])]
        return node

    for _ in range(trees if len(sample) > leaf else 1):
        roots.append(grow(np.arange(len(sample))))
    d = sample.shape[1]
    share = np.array([len(m) for m in members]) * (rows / max(1, len(sample)))
    return Forest(np.array(planes).reshape(-1, d), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), roots, share, members, sample, max(LEAST, effort * rows**GROWTH))


def _matrices(b: pa.RecordBatch, column: str):
    """Row numbers and components of the vectors of each length in a batch."""
    lists = b.column(column)
    offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    size = np.diff(offs)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), rows, flat[offs[rows][:, None] + np.arange(d)]


def _fixed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    step = x.shape[1] * x.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int64) * step), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _cell_rows(d: int, leaves: np.ndarray, parts: np.ndarray, query: bool, tag, first, bound, x) -> pa.RecordBatch:
    names = pa.array([f"{d}/{a}/{b}" for a, b in zip(leaves.tolist(), parts.tolist(), strict=True)], pa.string())
    n = len(leaves)
    return pa.RecordBatch.from_arrays([names, pa.array(np.full(n, query)), pa.array(tag), pa.array(first), pa.array(bound), _fixed(x)], names=[c.split()[0] for c in CELL.split(", ")])


def _index(model, chunks):
    """Every row under its leaf of each tree, for each chunk of queries; large leaves are split by the row's number."""
    def run(batches):
        for b in batches:
            uid, first = b.column("uid").to_numpy(), b.column("first").to_numpy()
            for d, rows, x in _matrices(b, "vec"):
                forest = model.value.get(d)
                for i in range(0, len(rows), BLOCK[0]):
                    part, y = rows[i : i + BLOCK[0]], x[i : i + BLOCK[0]]
                    leaves = forest.assign(y.astype(np.float64)) if forest else np.zeros((len(part), 1), np.int64)
                    for t in range(leaves.shape[1]):
                        split = np.maximum(1, np.ceil(forest.share[leaves[:, t]] / ROWS).astype(np.int64)) if forest else np.ones(len(part), np.int64)
                        for c in range(chunks):
                            yield _cell_rows(d, leaves[:, t], c + chunks * (uid[part] % split), False, uid[part], first[part], np.zeros(len(part)), y)
    return run


def _ask(model, chunks, k):
    """Every query under the leaves that its search takes, in each part of them."""
    def run(batches):
        for b in batches:
            qid, tag = b.column("vec_id").to_numpy(), b.column("tag").to_numpy()
            for d, rows, x in _matrices(b, "vec"):
                forest = model.value.get(d)
                for i, r in enumerate(rows):
                    leaves, bound = forest.search(x[i].astype(np.float64), k) if forest else ([0], np.inf)
                    split = np.maximum(1, np.ceil(forest.share[leaves] / ROWS).astype(np.int64)) if forest else np.ones(1, np.int64)
                    leaf, part = np.repeat(leaves, split), np.concatenate([np.arange(s) for s in split])
                    n = len(leaf)
                    yield _cell_rows(d, leaf, tag[r] % chunks + chunks * part, True, np.full(n, tag[r]), np.full(n, qid[r]), np.full(n, bound), np.repeat(x[i : i + 1], n, 0))
    return run


def _vectors(part: pa.RecordBatch) -> np.ndarray:
    cell, raw = part.column("cell")[0].as_py(), part.column("raw")
    d = int(cell.partition("/")[0])
    return np.frombuffer(b"".join(raw.to_pylist()), np.float32 if len(raw[0].as_py()) == 4 * d else np.float64).reshape(-1, d).astype(np.float64)


class _Cell:
    """The queries of a cell and the k best of the rows that have passed."""

    def __init__(self, k: int):
        self.k, self.parts, self.q, self.held, self.found = k, [], None, 0, []

    def rows(self, part: pa.RecordBatch) -> None:
        if not self.parts:
            return
        if self.q is None:
            self.q, self.tag, self.qid, self.bound = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        x, uid, first = _vectors(part), part.column("tag").to_numpy(), part.column("first").to_numpy()
        for i in range(0, len(x), BLOCK[0]):
            y = x[i : i + BLOCK[0]]
            for j in range(0, len(self.q), BLOCK[1]):
                q, bound = self.q[j : j + BLOCK[1]], self.bound[j : j + BLOCK[1]]
                with np.errstate(over="ignore", invalid="ignore"):
                    sums = np.square(q).sum(1)[:, None] + np.square(y).sum(1)[None]
                    a, b = np.nonzero(~(sums - 2 * (q @ y.T) > np.square(bound)[:, None] * (1 + 1e-9) + 1e-9 * sums))
                score = distances(q, a, y, b)
                near = score <= bound[a]
                self.found.append(np.rec.fromarrays([a[near] + j, score[near], first[i + b[near]], uid[i + b[near]]], names="q,score,first,uid"))
                self.held += len(self.found[-1])
                if self.held > 1 << 19:
                    self.best()

    def best(self) -> np.ndarray:
        """Keeps the k best of each query by score, then id, and lowers its bound."""
        f = np.concatenate(self.found)
        f = f[np.lexsort((f["uid"], f["first"], f["score"], f["q"]))]
        at = np.searchsorted(f["q"], f["q"])
        f = f[np.arange(len(f)) - at < self.k]
        full, last = np.flatnonzero(np.bincount(f["q"], minlength=len(self.q)) == self.k), np.searchsorted(f["q"], np.arange(len(self.q)), "right") - 1
        self.bound[full] = np.minimum(self.bound[full], f["score"][last[full]])
        self.found, self.held = [f], len(f)
        return f

    def told(self):
        if not self.found:
            return
        f = self.best()
        q = f["q"]
        yield pa.RecordBatch.from_arrays([pa.array(self.tag[q]), pa.array(self.qid[q]), pa.array(np.ascontiguousarray(f["uid"])), pa.array(np.ascontiguousarray(f["first"])), pa.array(np.ascontiguousarray(f["score"]))], names=["tag", "query_id", "uid", "first", "score"])


def _rank(k):
    """The best rows of each query of a cell; the rows pass in batches behind the cell's queries."""
    def run(batches):
        cell, now = None, None
        for b in batches:
            if b.num_rows == 0:
                continue
            key, query = b.column("cell").to_numpy(zero_copy_only=False), b.column("query").to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (query[1:] != query[:-1])) + 1, [len(key)]])
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if key[s] != now:
                    if cell is not None:
                        yield from cell.told()
                    cell, now = _Cell(k), key[s]
                part = b.slice(s, e - s)
                if query[s]:
                    cell.parts.append((_vectors(part), part.column("tag").to_numpy(), part.column("first").to_numpy(), part.column("bound").to_numpy()))
                else:
                    cell.rows(part)
        if cell is not None:
            yield from cell.told()
    return run


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100, trees: int = TREES, leaf: int = LEAF, effort: float = EFFORT, sample: int = SAMPLE) -> DataFrame:
    """The k nearest rows found for each row whose vec_id is divisible by `every`, by Euclidean distance in doubles.

    Takes vec_id and embedding; other columns are ignored. Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. Rows
    with a null id and vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of other lengths
    are no candidates. Equal vectors are one entry of the index with its k + 1 smallest ids, so groups of copies cost one comparison; each
    row is a candidate, and repeated query rows have a result each. The sample has `sample` rows about, fewer of long vectors; lengths
    with `leaf` sampled rows at most are compared whole, which is exact. An empty table gives none.
    """
    spark = vectors.sparkSession
    fine = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = spread(vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & fine).withColumnRenamed("embedding", "vec"))
    first_ids = Window.partitionBy("vec").orderBy("vec_id")
    reps = cut(rows.withColumn("n", F.row_number().over(first_ids)).filter(F.col("n") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
               .select("vec", "ids", F.element_at("ids", 1).alias("first"), F.monotonically_increasing_id().alias("uid")))
    queries = cut(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "vec").agg(F.count("*").alias("times")).withColumn("tag", F.monotonically_increasing_id()))
    asked, total = queries.count(), reps.count()
    sizes = reps.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count")).limit(LENGTHS).collect()
    count = {r.d: r["count"] for r in sizes}
    rate = min(1.0, min(sample, SAMPLE_BYTES / (8 * max(count, default=1))) / max(1, total))
    drawn = reps.filter(F.size("vec").isin(*count) & (F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(1 << 30)) < int(rate * (1 << 30)))).select("vec").toArrow()
    parts: dict[int, list] = {}
    for b in drawn.to_batches():
        for d, _, x in _matrices(b, "vec"):
            parts.setdefault(d, []).append(x.astype(np.float64))
    forests = {d: fit(np.concatenate(x), count[d], trees, leaf, effort) for d, x in parts.items()}
    told = spark.sparkContext.broadcast(forests)
    chunks = max([1, *(int(np.ceil(asked * min(1.0, f.budget / f.share.sum()) / QUERIES)) for f in forests.values())])
    cells = reps.select("uid", "first", "vec").mapInArrow(_index(told, chunks), CELL).unionByName(spread(queries.select("vec_id", "tag", "vec")).mapInArrow(_ask(told, chunks, k), CELL))
    found = cells.repartition("cell").sortWithinPartitions("cell", F.desc("query")).mapInArrow(_rank(k + 1), "tag long, query_id long, uid long, first long, score double")
    by_query = Window.partitionBy("tag").orderBy("score", "first", "uid")
    near = found.dropDuplicates(["tag", "uid"]).withColumn("n", F.row_number().over(by_query)).filter(F.col("n") <= k + 1)
    near = near.join(reps.select("uid", "ids"), "uid").join(queries.select("tag", "times"), "tag")
    # a query is its own first copy: one of the ids at distance 0 is left out
    own = F.array_position("ids", F.col("query_id"))
    others = F.when((F.col("score") == 0) & (own > 0), F.concat(F.slice("ids", 1, F.greatest(own - 1, F.lit(0)).cast("int")), F.slice("ids", (own + 1).cast("int"), k + 1))).otherwise(F.col("ids"))
    ids = near.select("tag", "times", "query_id", "score", "uid", F.posexplode(others).alias("place", "vec_id"))
    ranked = ids.withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy("score", "vec_id", "uid", "place"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("col")
