"""Toxicity scores by non-negative positive-unlabelled learning over hashed words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import U64, beside, pieces, prefix_hash, span_hash, spread, text_buffer, word_spans

BITS = 18
#: Lower-case ASCII letters; every ASCII byte that is no letter or digit ends a word; other bytes stand for themselves.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


#: Buckets kept for the manner of writing: the share of capitals among ASCII letters, and of exclamation marks among bytes.
STYLE = (1 << BITS) - 32


def word_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket, and the row, of each word; sorted by row. Each row that is not empty has two buckets of style besides."""
    rows = np.flatnonzero(np.diff(at))
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    folded = FOLD[data]
    starts, ends, first = word_spans(folded, at)
    h = (span_hash(prefix_hash(folded), starts, ends) >> U64(64 - BITS)).astype(np.int64) % STYLE
    count = lambda mask: np.add.reduceat(mask.astype(np.int64), at[rows])
    upper, lower = count((data >= 65) & (data <= 90)), count((data >= 97) & (data <= 122))
    shout = STYLE + np.minimum(10 * upper // np.maximum(upper + lower, 1), 9)
    marks = STYLE + 16 + np.searchsorted([1, 5, 20, 50], 1000 * count(data == 33) // np.diff(at)[rows], "right")
    bucket = np.concatenate([h, shout, marks])
    row = np.concatenate([np.repeat(np.arange(len(at) - 1), np.diff(first)), rows, rows])
    order = np.argsort(row, kind="stable")
    return bucket[order], row[order]


def _bags(batches):
    for b in batches:
        data, at = text_buffer(b.column(0))
        bags = []
        for i, j in pieces(at):
            word, row = word_features(data[at[i] : at[j]], at[i : j + 1] - at[i])
            offs = np.searchsorted(row, np.arange(j - i + 1))
            bags += [np.unique(word[s:e]).astype(np.int32).tobytes() for s, e in zip(offs[:-1], offs[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), b.column(1)], names=["bag", "positive"])


class PuModel:
    """Linear scores over the words a text holds, fitted under the non-negative PU risk with the logistic loss.

    risk = prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)]); while the second term is negative its gradient is
    reversed, so that the unlabelled toxic texts are not learned as clean.
    """

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 150, rate: float = 0.1, shrink: float = 2e-4) -> PuModel:
        size = 1 << BITS
        share = lambda bags: np.bincount(np.concatenate(bags), minlength=size) / len(bags)
        in_p, in_u = share(positive), share(unlabelled)
        # buckets that stand out among the positive texts beyond chance: the Chernoff bound on a Poisson count at the
        # unlabelled rate, shared out over all buckets that occur
        seen = in_p * len(positive)
        expected = (in_u * len(unlabelled) + 1) / len(unlabelled) * len(positive)
        excess = np.where(seen > expected, seen * np.log(np.maximum(seen, 1e-9) / expected) - seen + expected, 0)
        words = np.flatnonzero(excess > np.log(20.0 * max(1, np.count_nonzero(seen))))
        weights = np.zeros(size)
        bias = float(np.log(prior / (1 - prior)))
        if not len(words):
            return cls(weights, bias)
        place = np.full(size, -1)
        place[words] = np.arange(len(words))

        def sparse(bags):
            row = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
            col = place[np.concatenate(bags)]
            return row[col >= 0], col[col >= 0], len(bags)

        p, u = sparse(positive), sparse(unlabelled)
        theta = np.zeros(len(words) + 1)
        theta[-1] = bias
        mean, var = np.zeros_like(theta), np.zeros_like(theta)
        score = lambda s: np.bincount(s[0], theta[s[1]], s[2]) + theta[-1]
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        pull = lambda s, g: np.append(np.bincount(s[1], g[s[0]], len(words)), g.sum()) / s[2]
        for step in range(1, epochs + 1):
            zp, zu = score(p), score(u)
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g_clean = pull(u, sig(zu)) - prior * pull(p, sig(zp))
            grad = prior * pull(p, sig(zp) - 1) + g_clean if rest >= 0 else -g_clean
            mean = 0.9 * mean + 0.1 * grad
            var = 0.999 * var + 0.001 * grad * grad
            theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
            theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - shrink * rate, 0)
        weights[words] = theta[:-1]
        return cls(weights, float(theta[-1]))

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = np.full(len(at) - 1, self.bias)
        for i, j in pieces(at):
            word, row = word_features(data[at[i] : at[j]], at[i : j + 1] - at[i])
            hit = self.weights[word] != 0
            pair = np.unique((row[hit] << BITS) | word[hit])
            np.add.at(z, i + (pair >> BITS), self.weights[pair & ((1 << BITS) - 1)])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train_toxicity_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_positive: int = 4000,
                         most_unlabelled: int = 12_000, prior: float | None = None, seed: int = 11) -> PuModel:
    """Fit on a bounded sample of `docs` chosen by a hash of the id: about `most_positive` rows with label 1 in `labels`
    (id_col, label_col) and `most_unlabelled` of the others, whatever their label. `prior` defaults to the share of 1 among
    the labelled rows, which is right if rows were chosen for labelling at random: else give it. The choice is made on ids and
    labels; only the chosen ids, a bounded number, meet the texts. Rows with a null id are never learned from; of an id's several
    labels the largest counts, and all rows of a chosen id are learned. Without a row of either kind nothing is told apart, and
    every score is low."""
    label = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(id_col).alias("id")).join(label, "id", "left").withColumn("h", F.xxhash64(F.lit(seed), "id"))
    seen = rows.agg(F.count("*"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)), F.count("y")).first()
    n, n_pos, n_lab = seen[0], seen[1] or 0, seen[2]
    if not n_pos or n == n_pos:
        return PuModel(np.zeros(1 << BITS), -4.0)
    pos = F.coalesce(F.col("y") == 1, F.lit(False))
    u = F.pmod("h", F.lit(1_000_003)) / F.lit(1_000_003.0)
    ids = rows.filter(u < F.when(pos, most_positive / n_pos).otherwise(most_unlabelled / (n - n_pos))).select("id", pos.alias("positive")).dropDuplicates(["id"])
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen = src.join(F.broadcast(ids), "id").select("text", "positive")
    got = chosen.mapInArrow(_bags, "bag binary, positive boolean").toArrow()
    bags, flag = got.column("bag").to_pylist(), got.column("positive").to_pylist()
    sets = {k: sorted(b for b, f in zip(bags, flag, strict=True) if f is k) for k in (True, False)}
    as_arrays = {k: [np.frombuffer(b, np.int32) for b in v] for k, v in sets.items()}
    if not as_arrays[True] or not as_arrays[False]:
        return PuModel(np.zeros(1 << BITS), -4.0)
    rate = prior if prior is not None else min(0.9, max(1e-4, n_pos / n_lab))
    return PuModel.fit(as_arrays[True], as_arrays[False], rate)


def _score(batches, model):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(model.score(*text_buffer(b.column(0)))), *b.columns[1:]], names=["score", *b.schema.names[1:]])


def score_toxicity(docs: DataFrame, model: PuModel, text_col: str = "text", keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep_cols, score double): the modelled probability that label 1 applies, from all words of the text.

    Null and empty texts get the score of a text without words. Nothing but the text enters a score: rows that repeat an id or have
    none are scored like any other. An empty table gives no rows. A kept column named like a result gives way to it.
    """
    keep_cols = beside(keep_cols, "score")
    src = spread(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep_cols)]))
    extra = "".join(f", `_k{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep_cols))
    out = src.mapInArrow(lambda it: _score(it, model), f"score double{extra}")
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep_cols)], "score")
