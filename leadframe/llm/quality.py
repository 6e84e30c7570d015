"""Quality by compression: a text goes to the class whose zstandard dictionary compresses it better.

Half of a bounded sample of labelled texts becomes the content of two dictionaries, one good and one bad; the other half
calibrates. The size under the bad dictionary less that under the good one, divided by the text's length, is what a text is
judged by. A logistic regression makes it a probability: its slope and its constant change with the text's length, linearly
between a few quantiles of it, as a short text has less to tell it apart. Both kinds are weighted as they occur among the
labels, so 0.5 is where either is as likely.

Defined cases: null and empty texts are compressed as empty and get that score. Without labels of both kinds to learn
from every score is 0.5, so an empty table of labels gives that and an empty table of documents no rows. Texts of any length
are compressed whole; only texts up to TEXT_BYTES are learned from. Repeated rows are each scored. Labels, lang, source and
ids are never inputs of a score. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import label_counts, labelled_sample, tidy

ROWS, TEXT_BYTES, DICTIONARY, LEVEL, KNOTS = 3000, 1 << 16, 1 << 21, 9, 5


class Compressors:
    """One for each dictionary; made on the worker, as they can't be sent."""

    def __init__(self, dictionaries: list[bytes]):
        import zstandard

        self.all = []
        for content in dictionaries:
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            self.all.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False))

    def difference(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(size under the bad dictionary less that under the good one, by length; logarithm of the length) of each text."""
        size = np.array([[len(c.compress(t)) for c in self.all] for t in texts], float).reshape(-1, len(self.all))
        n = np.array([len(t) for t in texts], float) + 16
        return (size[:, 1] - size[:, 0]) / n, np.log(n)


def features(difference: np.ndarray, length: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """The difference in bands of length, and the bands: hat functions over the knots, of which the first is the constant."""
    if len(knots) < 2:
        return difference[:, None]
    hats = np.stack([np.interp(length, knots, x) for x in np.eye(len(knots))], axis=1)
    return np.concatenate([hats[:, 1:], hats * difference[:, None]], axis=1)


class QualityModel:
    def __init__(self, dictionaries: list[bytes] | None, knots=None, mean=None, scale=None, weights=None):
        self.dictionaries, self.knots, self.mean, self.scale, self.weights = dictionaries, knots, mean, scale, weights

    def probability(self, difference: np.ndarray, length: np.ndarray) -> np.ndarray:
        z = self.weights[0] + (features(difference, length, self.knots) - self.mean) / self.scale @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (the constant first) by Newton's method."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        gradient = a.T @ (weight * (p - y)) / len(y) + ridge * w
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = ROWS, text_bytes: int = TEXT_BYTES, dictionary: int = DICTIONARY, seed: int = 0) -> QualityModel:
    """Fit on at most `rows` labelled ids of each kind for which `learn` holds; dictionaries of `dictionary` bytes each."""
    got = labelled_sample(docs, labels, "quality", learn, rows, text_bytes, seed)
    texts = [t.encode() for t in got.column("text").to_pylist()]
    y = np.array(got.column("label").to_pylist(), float)
    if not 0 < y.sum() < len(y):
        return QualityModel(None)
    half = np.zeros(len(y), bool)
    for kind in (0, 1):
        half[np.flatnonzero(y == kind)[::2]] = True
    content = [b"\n".join(t for t, k, h in zip(texts, y, half) if h and k == kind)[:dictionary] for kind in (1, 0)]
    rest = ~half if 0 < y[~half].sum() < (~half).sum() else np.ones(len(y), bool)
    difference, length = Compressors(content).difference([t for t, r in zip(texts, rest) if r])
    y = y[rest]
    knots = np.unique(np.quantile(length, np.linspace(0, 1, KNOTS)))
    x = features(difference, length, knots)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    # The sample holds both kinds in other shares than the labels do.
    occur, here = label_counts(labels, "quality", learn, docs), np.bincount(y.astype(int), minlength=2)
    weight = (occur / occur.sum() / (here / len(y)))[y.astype(int)]
    return QualityModel(content, knots, mean, scale, logistic((x - mean) / scale, y, weight))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Compressors(model.dictionaries) if model.dictionaries else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                p = model.probability(*made.difference(texts)) if made else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], names=["id", "score"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumnRenamed("id", id_col)
