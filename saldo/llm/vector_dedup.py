"""Near-duplicate vectors: PCA-ordered tiles, compared by leading dimensions first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldo.llm.common import connected_components, cut, keyed_groups, local_roots

STEP = 16
#: Leading axes by which tiles are bounded, and how many of them order the rows.
BOX, SORTED = 8, 3
MOMENTS = "dim int, part int, n long, s array<double>, m array<double>"


def _add(acc: dict, d: int, n: int, s: np.ndarray, m: np.ndarray) -> None:
    got = acc.setdefault(d, [0, np.zeros(d), np.zeros((d, d))])
    got[0] += n
    got[1] += s
    got[2] += m


def _tell(acc: dict, part: int):
    for d, (n, s, m) in acc.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))],
                                         names=["dim", "part", "n", "s", "m"])


def _moments(batches):
    """Sums and second moments of the unit vectors, by length."""
    from pyspark import TaskContext

    acc: dict[int, list] = {}
    for b in batches:
        lists = b.column(0)
        offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        size = np.diff(offs)
        for d in np.unique(size):
            x = unit(flat[offs[:-1][size == d][:, None] + np.arange(d)])
            _add(acc, int(d), len(x), x.sum(0), x.T @ x)
    yield from _tell(acc, TaskContext.get().partitionId() % 32)


def _sum_moments(batches):
    acc: dict[int, list] = {}
    for b in batches:
        for r in b.to_pylist():
            _add(acc, r["dim"], r["n"], np.array(r["s"]), np.array(r["m"]).reshape(r["dim"], r["dim"]))
    yield from _tell(acc, 0)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, which is exact, so that no square leaves the range of doubles."""
    return x / np.exp2(np.floor(np.log2(np.abs(x).max(1, keepdims=True))))


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Orthonormal axes for each vector length, by falling variance. Moments are summed on the executors in two steps; one moment
    matrix for each length comes to the driver."""
    told = vectors.select("vec").mapInArrow(_moments, MOMENTS)
    for keys in (["dim", "part"], ["dim"]):
        told = told.repartition(*keys).mapInArrow(_sum_moments, MOMENTS)
    axes = {}
    for r in told.collect():
        mean = np.array(r.s) / r.n
        _, v = np.linalg.eigh(np.array(r.m).reshape(r.dim, r.dim) / r.n - np.outer(mean, mean))
        axes[r.dim] = np.ascontiguousarray(v[:, ::-1])
    return axes


def _rotate(batches, axes, width):
    """Each vector with its cells on the first axes, its place on those that bound tiles, and its components as bytes (of four
    bytes each where these hold them)."""
    for b in batches:
        lists = b.column(b.schema.get_field_index("vec"))
        offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        cells, box, raw = np.zeros((b.num_rows, SORTED), np.int32), [None] * b.num_rows, [None] * b.num_rows
        size = np.diff(offs)
        for d in np.unique(size):
            rows = np.flatnonzero(size == d)
            x = flat[offs[rows][:, None] + np.arange(d)]
            with np.errstate(over="ignore"):
                small = x.astype(np.float32)
            exact = (small == x).all(1)
            y = (unit(x) @ axes[int(d)])[:, :BOX]
            cells[rows, : min(SORTED, d)] = np.floor(y[:, :SORTED] / width)
            for k, r in enumerate(rows):
                box[r], raw[r] = y[k].tolist(), (small[k] if exact[k] else x[k]).tobytes()
        keep = [b.column(b.schema.get_field_index(c)) for c in ("rep", "mult", "label")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(size.astype(np.int32)), *[pa.array(cells[:, k]) for k in range(SORTED)], pa.array(box, pa.list_(pa.float64())), pa.array(raw, pa.binary())],
                                         names=["rep", "mult", "label", "dim", *[f"c{k}" for k in range(SORTED)], "box", "raw"])


def _tiles(batches, most):
    """Rows sorted by (label, dim, cells), in tiles of one label and length and at most `most` rows, with their bounding box."""
    schema = pa.schema([("tile", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("wide", pa.bool_()), ("reps", pa.binary()), ("mults", pa.binary()), ("raw", pa.binary())])

    def close(rows):
        d, box = rows[0]["dim"], np.array([r["box"] for r in rows])
        wide = any(len(r["raw"]) > 4 * d for r in rows)
        raw = [np.frombuffer(r["raw"], np.float32 if len(r["raw"]) == 4 * d else np.float64).astype(np.float64 if wide else np.float32) for r in rows]
        tile = {"tile": rows[0]["rep"], "label": rows[0]["label"], "dim": d, "lo": box.min(0).tolist(), "hi": box.max(0).tolist(), "wide": wide, "reps": np.array([r["rep"] for r in rows], np.int64).tobytes(),
                "mults": np.array([r["mult"] for r in rows], np.int64).tobytes(), "raw": np.concatenate(raw).tobytes()}
        return pa.RecordBatch.from_pylist([tile], schema=schema)

    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and (len(held) >= most or held[0]["label"] != r["label"] or held[0]["dim"] != r["dim"]):
                yield close(held)
                held = []
            held.append(r)
    if held:
        yield close(held)


def close_pairs(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose cosine is at least `threshold`. a and b are rotated unit vectors, ra and rb the vectors as given.

    After the leading dimensions of a step the rest of the product is at most the product of the suffix norms; pairs that
    can't reach the threshold any more are left out of the next step. What is left is decided on the vectors as given.
    """
    d = a.shape[1]
    tail = lambda x: np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], 1)[:, ::-1], 0))
    ta, tb = np.pad(tail(a), ((0, 0), (0, 1))), np.pad(tail(b), ((0, 0), (0, 1)))
    k = min(STEP, d)
    part = a[:, :k] @ b[:, :k].T
    live = part + ta[:, k][:, None] * tb[:, k][None] >= threshold - 1e-9
    if same:
        live &= np.triu(np.ones_like(live), 1)
    x, y = np.nonzero(live)
    got = part[x, y]
    while k < d and len(x):
        n = min(STEP, d - k)
        got = got + np.einsum("ij,ij->i", a[x, k : k + n], b[y, k : k + n])
        k += n
        ok = got + ta[x, k] * tb[y, k] >= threshold - 1e-9
        x, y, got = x[ok], y[ok], got[ok]
    if len(x):
        ok = np.einsum("ij,ij->i", ra[x], rb[y]) / (np.linalg.norm(ra[x], axis=1) * np.linalg.norm(rb[y], axis=1)) >= threshold
        x, y = x[ok], y[ok]
    return x, y


class Tile:
    """A packed tile as arrays: numbers, multiplicities, vectors as given and as turned unit vectors."""

    def __init__(self, row: dict, axes: dict):
        self.number, self.reps, self.mults = row["tile"], np.frombuffer(row["reps"], np.int64), np.frombuffer(row["mults"], np.int64)
        raw = np.frombuffer(row["raw"], np.float64 if row["wide"] else np.float32).reshape(-1, row["dim"]).astype(np.float64)
        self.raw = scaled(raw)
        self.turned = unit(raw) @ axes[row["dim"]]


def _compare(batches, axes, threshold):
    """In a cell its first tile meets the others (or itself), which come one at a time."""
    for _, t in keyed_groups(batches, "cell"):
        rows = t.drop_columns(["cell"])
        a = Tile(rows.slice(0, 1).to_pylist()[0], axes)
        for k in range(1, rows.num_rows):
            b = Tile(rows.slice(k, 1).to_pylist()[0], axes)
            same = a.number == b.number
            x, y = close_pairs(a.turned, b.turned, a.raw, b.raw, threshold, same)
            if not len(x):
                continue
            reps = np.concatenate([a.reps] if same else [a.reps, b.reps])
            y2 = y if same else y + len(a.reps)
            links = np.bincount(x, b.mults[y], len(reps)) + np.bincount(y2, a.mults[x], len(reps))
            order = np.argsort(reps, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            root = reps[order][local_roots(len(reps), place[x], place[y2])][place]
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(reps[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])], names=["rep", "links", "root"])


def vector_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tile: int = 2048, partners: int = 16) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row: links are pairs of equal non-null labels and cosine >= `threshold`.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label, link with
    nothing; so do vectors of different lengths. Rows with a null id are left out. Rows that repeat an id, with the same vector
    or another, count as rows of their own. `kept` tells rows whose id is the smallest of their component. Other columns are
    ignored; an empty table gives no rows.

    Equal vectors of one label (by 128 bits of hashes) are one representative with a number and a multiplicity. They are sorted
    by label and their cells on the first principal axes into tiles of `tile` rows, each with its bounding box on BOX leading
    axes. Unit vectors within the threshold are at most sqrt(2 - 2 t) apart, so only tiles whose boxes come as near meet: an
    equi-join on cells of that width of the first axis finds them. A tile is sent with up to `partners` tiles that it meets;
    the products are accumulated over leading dimensions and bounded by the suffix norms. Counts and one root per vector leave.
    """
    ok = F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0) & F.col("label").isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label")).filter("id is not null")
    keyed = rows.withColumn("fit", F.coalesce(ok, F.lit(False)))
    good = keyed.filter("fit").withColumn("h1", F.xxhash64("label", "vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec", "label"))
    reps = cut(good.groupBy("h1", "h2").agg(F.any_value("label").alias("label"), F.any_value("vec").alias("vec"), F.min("id").alias("id"), F.count("*").alias("mult"))
               .withColumn("rep", F.monotonically_increasing_id()))  # the numbers hold from here on
    axes = principal_axes(reps)
    reach = 2 - 2 * threshold + 1e-9
    width = float(np.sqrt(max(reach, 1e-12)))
    turned = reps.mapInArrow(lambda it: _rotate(it, axes, width), f"rep long, mult long, label string, dim int, {', '.join(f'c{k} int' for k in range(SORTED))}, box array<double>, raw binary")
    parts = max(12, vectors.sparkSession.sparkContext.defaultParallelism * 2)
    order = ["label", "dim", *[f"c{k}" for k in range(SORTED)], "rep"]
    tiles = cut(turned.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                .mapInArrow(lambda it: _tiles(it, tile), "tile long, label string, dim int, lo array<double>, hi array<double>, wide boolean, reps binary, mults binary, raw binary"))
    cell = lambda c: F.floor(F.col(c)[0] / width)
    span = tiles.select("tile", "label", "dim", "lo", "hi", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    near = span.select(F.col("tile").alias("tile2"), "label", "dim", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    gaps = F.zip_with(F.arrays_zip("lo", "hi"), F.arrays_zip("lo2", "hi2"), lambda a, b: F.greatest(F.lit(0.0), a["lo"] - b["hi2"], b["lo2"] - a["hi"]))
    apart = F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)
    pairs = span.join(near, ["label", "dim", "cell"]).filter((F.col("tile") <= F.col("tile2")) & (apart <= reach)).select("tile", "tile2").distinct()
    place = F.row_number().over(Window.partitionBy("tile").orderBy("tile2")) - 1  # over numbers of tiles only
    pairs = cut(pairs.withColumn("cell", F.concat_ws("/", "tile", F.floor(place / partners))))
    sent = pairs.select("cell", "tile", F.lit(0).alias("turn")).distinct().unionByName(pairs.select("cell", F.col("tile2").alias("tile"), F.lit(1).alias("turn")))
    blocks = sent.join(tiles.drop("label", "lo", "hi"), "tile").repartition(parts, "cell").sortWithinPartitions("cell", "turn", "tile").drop("turn")
    found = cut(blocks.mapInArrow(lambda it: _compare(it, axes, threshold), "rep long, links long, root long"))
    comp = cut(connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    member = comp.withColumnRenamed("node", "rep").join(reps.select("rep", "id"), "rep")
    heads = member.join(member.groupBy("component").agg(F.min("id").alias("head")), "component").select("rep", "head")
    known = (reps.select("rep", "h1", "h2", "id", "mult").join(links, "rep", "left").join(heads, "rep", "left")
             .select("h1", "h2", F.coalesce("head", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
    full_rows = good.select("id", "h1", "h2").join(known, ["h1", "h2"]).select("id", "n_links", "component_id")
    rest = keyed.filter("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return full_rows.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
