"""Toxicity by non-negative positive-unlabelled learning.

The positives are confirmed toxic examples; the other set is a sample of all texts, whose labels are not looked at. A linear
classifier over the counts of words and word beginnings minimises the class-prior-corrected risk ``prior * R+(positives) + max(0, R-(unlabelled) -
prior * R-(positives))``: the part of the negative risk that toxic texts among the unlabelled cause is taken off, and never below 0.
A few classifiers on halves of the sample are averaged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, slices, texts_of

BITS = 24
PREFIXES = (4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    features: np.ndarray  # hashed words, sorted
    weights: np.ndarray  # classifiers x features
    bias: np.ndarray


class Words:
    """Hashed words (runs of letters, lower case) of whole texts and their first ``PREFIXES`` letters where longer, with log2(1 + count).

    The hashes of at most ``most`` words are remembered.
    """

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        known, found = self.known, []
        for w in _WORD.findall((text or "").lower()):
            h = known.get(w)
            if h is None:
                h = known[w] = _hashes(w)
            found += h
        if len(known) > self.most:
            known.clear()
        at, n = np.unique(np.array(found, np.int64), return_counts=True)
        return at, np.log2(1 + n)


def _hashes(word: str) -> tuple[int, ...]:
    import xxhash

    shift = 64 - BITS
    return tuple(xxhash.xxh3_64_intdigest(x) >> shift for x in [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)])


def _fit(x: np.ndarray, positive: np.ndarray, prior: float, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Gradient steps (Adam) on the non-negative risk with the logistic loss."""
    p, u = x[positive], x[~positive]
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    with_one = lambda a: np.hstack([a, np.ones((len(a), 1), a.dtype)])
    p, u = with_one(p), with_one(u)
    for t in range(1, rounds + 1):
        v32 = w.astype(p.dtype)
        sp, su = (1 / (1 + np.exp(-(a @ v32).astype(np.float64))) for a in (p, u))
        plus = p.T @ (sp - 1).astype(p.dtype) / len(p)  # gradient of the positives' loss as positives
        minus_p, minus_u = p.T @ sp.astype(p.dtype) / len(p), u.T @ su.astype(u.dtype) / len(u)
        loss_u, loss_p = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean(), -np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        g = prior * plus + (minus_u - prior * minus_p) if loss_u - prior * loss_p >= 0 else -(minus_u - prior * minus_p)
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 1500, most_unlabelled: int = 4500, features: int = 1024, classifiers: int = 3, rounds: int = 400) -> Model:
    """Learn from rows of ``docs`` (doc_id, text) outside the held-out fold; ``labels`` has doc_id and ``toxic``.

    The prior is the toxic share of all labelled rows of these folds. At most ``most_positive`` confirmed and
    ``most_unlabelled`` other texts are fitted. Features are the words whose share among the positives is most above that among
    the unlabelled. Without a positive example the model scores everything 0.
    """
    told = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = told.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("int"))).first()
    empty = Model(np.zeros(0, np.int64), np.zeros((1, 0)), np.array([-20.0]))
    if not toxic:
        return empty
    prior = min(0.9, toxic / n)
    rows = docs.where(~held_out())
    positives = bounded_sample(told.where("toxic = 1").select("doc_id", F.lit(True).alias("p")), ["p"], most_positive, "doc_id", "positive")
    others = bounded_sample(rows.select("doc_id", F.lit(False).alias("p")), ["p"], most_unlabelled, "doc_id", "unlabelled")
    confirmed, other = texts_of(rows, positives), texts_of(rows, others)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches):
            got = [words(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"p": b.column(0), "w": [a.astype(np.int32).tobytes() for a, _ in got], "n": [n.astype(np.float32).tobytes() for _, n in got]})

    sample = confirmed.select("p", "text").unionByName(other.select("p", "text")).mapInArrow(sets, "p boolean, w binary, n binary")
    got = sorted((r["p"], bytes(r["w"]), bytes(r["n"])) for r in sample.collect())
    positive = np.array([g[0] for g in got], bool)
    lists = [np.frombuffer(g[1], np.int32) for g in got]
    if not positive.any() or positive.all():
        return empty
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    in_p, c_p = np.unique(np.concatenate([x for x, p in zip(lists, positive) if p]), return_counts=True)
    in_u, c_u = np.unique(np.concatenate([x for x, p in zip(lists, positive) if not p]), return_counts=True)
    at = np.searchsorted(in_u, in_p)
    seen = np.where(in_u[np.minimum(at, len(in_u) - 1)] == in_p, c_u[np.minimum(at, len(in_u) - 1)], 0) if len(in_u) else np.zeros(len(in_p), int)
    share_p, share_u = c_p / n_p, seen / n_u
    gain = (share_p - share_u) / np.sqrt((share_p * (1 - share_p)) / n_p + (share_u * (1 - share_u)) / n_u + 1.0 / min(n_p, n_u) ** 2)
    best = np.argsort(-gain, kind="stable")[:features]
    chosen = np.sort(in_p[best[(c_p[best] >= 3) & (gain[best] > 3)]]).astype(np.int64)
    if not len(chosen):
        return empty
    x = np.zeros((len(lists), len(chosen)), np.float32)
    for i, s in enumerate(lists):
        x[i] = _chosen(s, np.frombuffer(got[i][2], np.float32), chosen)
    del got, lists, in_p, in_u
    rng, fitted = np.random.default_rng(7), []
    for _ in range(classifiers):
        pick = rng.random(len(x)) < 0.7
        if positive[pick].any() and not positive[pick].all():
            fitted.append(_fit(x[pick], positive[pick], prior, rounds, 0.05, 1e-4))
    if not fitted:
        fitted = [_fit(x, positive, prior, rounds, 0.05, 1e-4)]
    return Model(chosen, np.array([w for w, _ in fitted]), np.array([b for _, b in fitted]))


def _chosen(found: np.ndarray, value: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The values of the chosen features, 0 for one that a text does not have."""
    if not len(found) or not len(chosen):
        return np.zeros(len(chosen))
    at = np.minimum(np.searchsorted(found, chosen), len(found) - 1)
    return np.where(found[at] == chosen, value[at], 0.0)


def predict(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; only ``text`` is read for the score, the whole of it.

    A null or empty text has no word and gets the score of no evidence. Repeated rows are scored alike.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            x = np.array([_chosen(*words(t), model.features) for t in texts], np.float64).reshape(len(texts), len(model.features))
            z = x @ model.weights.T + model.bias
            s = (1 / (1 + np.exp(-np.clip(z, -50, 50)))).mean(axis=1)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": s, "predicted": (s >= threshold).astype(np.int32)})

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
