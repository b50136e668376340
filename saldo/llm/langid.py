"""Language ID by a byte convolutional network, trained in numpy on labelled text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import U64, beside, mix, pieces, spread, text_buffer

WINDOW, DIM, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
REACH = max(WIDTHS)


class ByteCnn:
    """Byte embedding, filters of several widths, max pooling over a window of WINDOW bytes, ReLU, softmax."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.labels = labels
        self.p = {
            "emb": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "conv": rng.normal(0, 0.25, (REACH * DIM, n)).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": rng.normal(0, 0.2, (n, len(labels))).astype(np.float32),
            "base": np.zeros(len(labels), np.float32),
        }
        #: a filter of width w sees the first w bytes of its place only
        self.mask = np.concatenate([np.repeat((np.arange(REACH) < w).astype(np.float32), DIM)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1)
        self.p["conv"] *= self.mask

    def _patches(self, x: np.ndarray) -> np.ndarray:
        e = self.p["emb"][np.pad(x, ((0, 0), (0, REACH - 1)))]
        n = x.shape[0]
        view = np.lib.stride_tricks.as_strided(e, (n, WINDOW, REACH * DIM), (e.strides[0], e.strides[1], e.strides[2]))
        return view.reshape(n * WINDOW, REACH * DIM)

    def forward(self, x: np.ndarray):
        """Window logits, and what the backward pass needs."""
        patches = self._patches(x)
        maps = (patches @ self.p["conv"]).reshape(len(x), WINDOW, -1)
        return patches, maps

    def logits(self, x: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.forward(x)[1].max(1) + self.p["bias"], 0)
        return pooled @ self.p["out"] + self.p["base"]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> ByteCnn:
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        var = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                xb, yb = x[rows], y[rows]
                patches, maps = self.forward(xb)
                where = maps.argmax(1)
                pre = np.take_along_axis(maps, where[:, None, :], 1)[:, 0] + self.p["bias"]
                pooled = np.maximum(pre, 0)
                z = pooled @ self.p["out"] + self.p["base"]
                z -= z.max(1, keepdims=True)
                prob = np.exp(z)
                prob /= prob.sum(1, keepdims=True)
                prob[np.arange(len(yb)), yb] -= 1
                prob /= len(yb)
                up = (prob @ self.p["out"].T) * (pre > 0)
                at = (np.arange(len(xb)) * WINDOW)[:, None] + where
                chosen = patches[at]  # rows x filters x patch
                grad = {"out": pooled.T @ prob, "base": prob.sum(0), "bias": up.sum(0),
                        "conv": np.einsum("nfp,nf->pf", chosen, up) * self.mask}
                back = (up[:, :, None] * self.p["conv"].T[None]).reshape(len(xb), -1, REACH, DIM)
                seen = np.pad(xb, ((0, 0), (0, REACH - 1)))
                symbols = np.take_along_axis(seen[:, None, :], (where[:, :, None] + np.arange(REACH)).reshape(len(xb), 1, -1), 2).reshape(back.shape[:3])
                grad["emb"] = np.zeros_like(self.p["emb"])
                np.add.at(grad["emb"], symbols.ravel(), back.reshape(-1, DIM))
                step += 1
                for k, g in grad.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    var[k] = 0.999 * var[k] + 0.001 * g * g
                    self.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of WINDOW bytes of each row (the last one padded with zeros), and the row of each."""
    n = np.diff(at)
    count = -(-n // WINDOW)
    first = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    out = np.zeros((first[-1], WINDOW), np.uint8)
    to = np.repeat(first[:-1] * WINDOW - at[:-1], n) + np.arange(len(data))
    out.ravel()[to] = data
    return out, row


def _sample_windows(batches, per_text, seed):
    for b in batches:
        data, at = text_buffer(b.column(0))
        x, row = windows(data, at)
        place = np.arange(len(row)) - np.searchsorted(row, row)
        luck = mix(b.column(2).to_numpy().view(U64)[row] + mix(place.astype(U64) + U64(seed)))  # of the row and the window alone
        order = np.lexsort((luck, row))
        pick = np.sort(order[np.arange(len(row)) - np.searchsorted(row, row) < per_text])
        yield pa.RecordBatch.from_arrays([pa.array([x[k].tobytes() for k in pick], pa.binary()), b.column(1).take(pa.array(row[pick]))], names=["window", "lang"])


def train_language_model(rows: DataFrame, id_col: str, text_col: str, lang_col: str, texts_per_language: int = 500, windows_per_text: int = 4,
                         epochs: int = 12, seed: int = 7, most_languages: int = 1000) -> ByteCnn | None:
    """Fit on a bounded sample: about `texts_per_language` texts of each of the `most_languages` most frequent languages, chosen by
    a hash of id and text over all rows (null ids included; repeated rows once), and `windows_per_text` windows anywhere in each,
    chosen by a hash of row and window. None if no row has text and a language. Other columns are ignored."""
    src = rows.select(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and text != '' and lang is not null")
    counts = {r.lang: r.n for r in src.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not counts:
        return None
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, texts_per_language / n)))])
    chosen = src.filter((F.pmod("h", F.lit(1_000_003)) / F.lit(1_000_003.0)) < share[F.col("lang")]).select("text", "lang", "h").dropDuplicates(["h", "lang"])
    got = chosen.mapInArrow(lambda it: _sample_windows(it, windows_per_text, seed), "window binary, lang string").orderBy("lang", "window").toArrow()
    labels = sorted(set(got.column("lang").to_pylist()))
    x = np.frombuffer(b"".join(got.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    y = np.array([labels.index(v) for v in got.column("lang").to_pylist()])
    return ByteCnn(labels, seed).fit(x, y, epochs, seed=seed)


def _predict(batches, model, keep_text):
    for b in batches:
        data, at = text_buffer(b.column(0))
        known = np.array(b.column(1).to_pylist(), bool)
        n = b.num_rows
        total = np.zeros((n, len(model.labels)))
        for i, j in pieces(at, 1 << 17):
            lo = 0
            x, row = windows(data[at[i] : at[j]], at[i : j + 1] - at[i])
            while lo < len(x):
                part = slice(lo, lo + 512)
                weight = (x[part] != 0).sum(1)[:, None]
                np.add.at(total, i + row[part], model.logits(x[part]) * weight)
                lo += 512
        z = total / np.maximum(np.diff(at), 1)[:, None]
        prob = np.exp(z - z.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        best = prob.argmax(1)
        names = np.array(model.labels, object)[best]
        names[~known] = "und"
        score = np.where(known, prob[np.arange(n), best], 0.0)
        kept, called = (b.columns[2:] + b.columns[:1], [*b.schema.names[2:], "_text"]) if keep_text else (b.columns[2:], b.schema.names[2:])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(score), *kept], names=["lang_pred", "score", *called])


def detect_language(docs: DataFrame, model: ByteCnn | None, text_col: str = "text", keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep_cols, lang_pred string, score double) for each row of `docs`, from every byte of its text.

    A text is cut into windows of 256 bytes, batched through the network; its logits are the mean of its windows',
    weighted by their bytes, and score is the softmax of the best. `und`, with score 0, where the text is null, empty or
    without a letter, or where there is no model. Nothing but the text enters a prediction: rows that repeat an id or have none
    are told like any other. An empty table gives no rows. A kept column named like a result gives way to it.
    """
    keep_cols = beside(keep_cols, "lang_pred", "score")
    text = F.col(text_col).cast("string")
    known = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)) if model is not None else F.lit(False)
    same = text_col if text_col in keep_cols and docs.schema[text_col].dataType.simpleString() == "string" else None  # sent once
    others = [c for c in keep_cols if c != same]
    src = spread(docs.select(text.alias("_text"), known.alias("_known"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(others)]))
    model = model or ByteCnn(["und"])
    extra = "".join(f", `_k{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others)) + ", _text string" * (same is not None)
    out = src.mapInArrow(lambda it: _predict(it, model, same is not None), f"lang_pred string, score double{extra}")
    return out.select(*[F.col("_text" if c == same else f"_k{others.index(c)}").alias(c) for c in keep_cols], "lang_pred", "score")
