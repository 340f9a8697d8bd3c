"""Quality classifier: learned vectors of hashed words and character n-grams, averaged for each document, and a softmax.

Vectors and output weights are trained together by stochastic gradient descent in numpy, with a falling rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, slices, texts_of
from .vectors import code_points, gram_ids, word_ids

GRAMS, BUCKETS = (3, 4), 1 << 13  # a table of buckets for words, one for pairs of words and one for each n-gram size
KINDS = 2 + len(GRAMS)
WIDTH = KINDS * BUCKETS


@dataclass
class Model:
    vectors: np.ndarray  # WIDTH x dimensions
    out: np.ndarray  # dimensions x 2
    bias: np.ndarray


def features(texts: list[str]) -> np.ndarray:
    """Shares (texts x WIDTH) of words, word pairs and n-grams of the whole texts; each kind sums to 1 / KINDS.

    A pair of one word twice is the same feature whatever the word.
    """
    cp, doc = code_points(texts, letters_only=False)
    cp = np.where(cp <= 32, np.uint32(32), cp)
    m = np.zeros((len(texts), WIDTH), np.float32)
    ids, of = word_ids(cp, doc, BUCKETS)
    twice, near = ids[1:] == ids[:-1], of[1:] == of[:-1]
    pairs = np.where(twice, 0, (ids[:-1] * 7919 + ids[1:] * 104729) % (BUCKETS - 1) + 1)
    kinds = [(ids, of), (pairs[near], of[1:][near])]
    for size in GRAMS:
        g = gram_ids(cp, size, BUCKETS)
        same = doc[: len(g)] == doc[size - 1 : size - 1 + len(g)]
        kinds.append((g[same], doc[: len(g)][same]))
    for k, (ids, of) in enumerate(kinds):
        c = np.bincount(of * BUCKETS + ids, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
        m[:, k * BUCKETS : (k + 1) * BUCKETS] = c / np.maximum(KINDS * c.sum(axis=1, keepdims=True), 1)
    return m


def train(docs: DataFrame, labels: DataFrame, most: int = 2000, dimensions: int = 16, epochs: int = 12, rate: float = 0.5) -> Model | None:
    """Learn ``quality`` (0 or 1) of ``labels`` from the whole texts of rows outside the held-out fold, at most ``most`` of each class.

    Classes weigh as they do among all labelled rows of these folds. None if there is no labelled row.
    """
    told = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = {r[0]: r[1] for r in told.groupBy("quality").count().collect()}
    if not share:
        return None

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            m = features([t or "" for t in b.column(1).to_pylist()])
            at = [np.flatnonzero(x) for x in m]
            yield pa.RecordBatch.from_pydict({"y": b.column(0), "i": [a.astype(np.uint16).tobytes() for a in at], "x": [v[a].tobytes() for v, a in zip(m, at)]})

    picked = bounded_sample(told, ["quality"], most, "doc_id", "quality")
    sample = texts_of(docs, picked).select("quality", "text").mapInArrow(sparse, "y int, i binary, x binary")
    got = sorted((bytes(r["i"]), bytes(r["x"]), r["y"]) for r in sample.collect())
    if not got:
        return None
    y = np.array([g[2] for g in got])
    data = [(np.frombuffer(i, np.uint16), np.frombuffer(x, np.float32)) for i, x, _ in got]
    total, fitted = sum(share.values()), np.bincount(y, minlength=2)
    weight = np.array([share.get(k, 0) / total * len(y) / max(1, fitted[k]) for k in (0, 1)])
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1, 1, (WIDTH, dimensions)) / dimensions
    out, bias = np.zeros((dimensions, 2)), np.zeros(2)
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for k in rng.permutation(len(y)).tolist():
            i, x = data[k]
            now = rate * (1 - done / steps)
            done += 1
            h = x @ vectors[i]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            p *= weight[y[k]]
            back = out @ p
            out -= now * np.outer(h, p)
            bias -= now * 0.1 * p
            vectors[i] -= (now * 20 * x)[:, None] * back  # a share is small, so vectors need a larger step than weights
    return Model(vectors, out, bias)


def predict(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (of quality 1) and predicted of every row of ``docs``; only ``text`` is read for the score.

    A null or empty text has no features and gets the score of the bias alone; without a model every score is 0.5.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            texts = [t or "" for t in b.column(1).to_pylist()]
            if model is None:
                s = np.full(len(texts), 0.5)
            else:
                z = features(texts) @ model.vectors.astype(np.float32) @ model.out + model.bias
                s = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": np.asarray(s, np.float64), "predicted": (s >= threshold).astype(np.int32)})

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
