"""Language identification by the nearest of several centroids for each language.

A text is the vector of its character 2- and 3-grams (letters only), weighted by term and inverse document frequency and scaled to
length 1. Spherical k-means gives each language a few centroids; a text gets the language of the centroid with the largest cosine,
and is rejected when even that one is too far away.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_sample, held_out, slices
from .encoding import forget
from .vectors import gram_counts, has_letter

SIZES, BUCKETS = (2, 3), 2048
WIDTH = len(SIZES) * BUCKETS


@dataclass
class Model:
    labels: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: dict[str, float]  # the smallest cosine that a language accepts


def vectors(texts: list[str], idf: np.ndarray | None) -> np.ndarray:
    """Unit vectors; a text without letters is all zero."""
    m = np.log1p(gram_counts(texts, SIZES, BUCKETS, letters_only=True))
    if idf is not None:
        m *= idf
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=m, where=norm > 0)


def _kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; each first centroid is the point farthest from those before it, so the result is always the same."""
    c = x.mean(axis=0, keepdims=True)
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[np.argmin((x @ c.T).max(axis=1))]])
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        c = np.vstack([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
    return c


def train(docs: DataFrame, centroids: int = 4, most: int = 500, slack: float = 0.5) -> Model:
    """Learn from ``text`` and non-null ``lang`` of rows outside the held-out fold (see ``common.held_out``).

    Document frequencies are counted over all these rows; centroids are fitted to at most ``most`` of each language. A language's
    floor is ``slack`` times the smallest cosine of its own sample. Texts without letters teach nothing.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~held_out()).select("doc_id", "lang", "text")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        df, n = np.zeros(WIDTH, np.int64), 0
        for b in slices(batches, 128, 2 << 20):
            m = gram_counts([t or "" for t in b.column(0).to_pylist()], SIZES, BUCKETS, letters_only=True)
            df += (m > 0).sum(axis=0)
            n += int((m.sum(axis=1) > 0).sum())
        yield pa.RecordBatch.from_pydict({"gram": np.arange(WIDTH + 1), "n": np.append(df, n)})  # one array for each task

    counted = rows.select("text").mapInArrow(frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    df = np.zeros(WIDTH + 1)
    for r in counted.collect():
        df[r["gram"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128, 2 << 20):
            v = vectors([t or "" for t in b.column(1).to_pylist()], idf).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"lang": b.column(0), "v": [x.tobytes() for x in v]})

    sample = bounded_sample(rows, ["lang"], most, "doc_id", "language").select("lang", "text").mapInArrow(embed, "lang string, v binary")
    by: dict[str, list] = {}
    for r in sample.collect():
        v = np.frombuffer(r["v"], np.float32).astype(np.float64)
        if v.any():
            by.setdefault(r["lang"], []).append(v)
    labels, found, floor = [], [], {}
    for lang in sorted(by):
        x = np.array(sorted(by[lang], key=lambda v: v.tobytes()))
        c = _kmeans(x, centroids)
        found.append(c)
        labels += [lang] * len(c)
        floor[lang] = slack * float((x @ c.T).max(axis=1).min())
    return Model(labels, np.vstack(found) if found else np.zeros((0, WIDTH)), idf, floor)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred (``und`` for a null text or one without letters), score (the cosine, 0 to 1) and rejected.

    Only ``text`` is read for it. Columns of these names are replaced. A model that has learned no language says ``und``.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    place = docs.columns.index("text")
    out = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        names = np.array([*model.labels, "und"], object)
        floors = np.array([model.floor[x] for x in model.labels] + [0.0])
        for b in slices(batches, 128, 2 << 20):
            texts = [t or "" for t in b.column(place).to_pylist()]
            cos = vectors(texts, model.idf) @ model.centroids.T
            best = cos.argmax(axis=1) if len(model.labels) else np.zeros(len(texts), np.int64)
            score = np.clip(cos[np.arange(len(texts)), best], 0.0, 1.0) if len(model.labels) else np.zeros(len(texts))
            none = np.array([not has_letter(t) for t in texts]) if len(model.labels) else np.ones(len(texts), bool)
            best[none], score[none] = len(model.labels), 0.0
            rejected = none | (score < floors[best])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)], names=[*b.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(label, out)
