"""Short codes for vectors: integer codebooks for each part, searched through the Walsh-Hadamard transform without floating point.

A component becomes floor(256 * x). Parts and entries, padded with zeros to a power of two p, are multiplied by the Walsh-Hadamard
matrix, whose rows stand in sequency order (by sign changes). That keeps distances up to the factor p, and puts most of a part into
its first coefficients: squared differences are added coefficient by coefficient, and an entry is given up as soon as its sum exceeds
that of an entry already computed in full. All sums are integers, of 64 bits where a bound shows that they fit and else of any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import slices

SCALE = 256
SMALL = 48  # bits of numbers of which a batch (at most 4096 rows) can be added up in 64 bits
LIMB = 40  # bits of the pieces in which sums of any size travel


def hadamard(p: int) -> np.ndarray:
    """The p x p Walsh-Hadamard matrix (p a power of two), rows by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < p:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")]


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite doubles, as 64-bit integers if all fit with room to spare, else as Python's."""
    scaled = np.floor(x * float(SCALE))  # exact, as 256 is a power of two
    if not scaled.size or np.abs(scaled).max() < 2.0**SMALL:
        return scaled.astype(np.int64)
    return np.array([int(v) if np.isfinite(v) else int(u) * SCALE for v, u in zip(scaled.ravel(), x.ravel())], object).reshape(x.shape)


def _fits(p: int, *arrays: np.ndarray) -> bool:
    """Whether p times the squared distance of any two rows stays below 2^62: a coefficient is at most p times the largest number."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return p * (2 * p * most) ** 2 < 1 << 62


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``parts`` (n x width) the index of the nearest row of ``entries`` (lower index on ties) and the squared distance."""
    width = parts.shape[1]
    p = 1 << max(0, width - 1).bit_length()
    kind = np.int64 if parts.dtype != object and entries.dtype != object and _fits(p, parts, entries) else object
    h = hadamard(p)[:, :width].T.astype(kind)  # zeros of the padding add nothing
    x, e = parts.astype(kind) @ h, entries.astype(kind) @ h
    first = x[:, :1] - e[None, :, 0]
    sums = first * first
    guess = sums.argmin(axis=1)
    full = x - e[guess]
    bound = (full * full).sum(axis=1)  # of an entry computed in full
    row, entry = np.nonzero(sums <= bound[:, None])
    sums = sums[row, entry]
    for j in range(1, p):
        d = x[row, j] - e[entry, j]
        sums = sums + d * d
        stay = (sums <= bound[row]).astype(bool)
        row, entry, sums = row[stay], entry[stay], sums[stay]
    at = np.flatnonzero(np.diff(row, prepend=-1))  # entries of a row stand in ascending order
    best = np.minimum.reduceat(sums, at) if len(at) else sums
    hit = np.flatnonzero(sums == np.repeat(best, np.diff(np.append(at, len(row)))))
    hit = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
    return entry[hit], best // p


def _cut(values: pa.Array, parts: int, width: int) -> np.ndarray:
    """n x parts x width integers of a batch of lists of one length, padded with zeros to parts * width."""
    n = len(values)
    flat = pc.list_flatten(values).to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    x = np.zeros((n, parts * width))
    x[:, : flat.shape[1]] = flat
    return integers(x).reshape(n, parts, width)


def _summed(kept: DataFrame, books: list[np.ndarray], width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> number and componentwise sum of the parts assigned to it; partial sums are merged by Spark."""
    parts = len(books)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, len(books[0])), np.int64)
        total = np.zeros((parts, len(books[0]), width), object)
        for b in slices(batches, 4096):
            x = _cut(b.column(1), parts, width)
            for k, book in enumerate(books):
                found, _ = nearest(x[:, k], book)
                count[k] += np.bincount(found, minlength=len(book))
                part = np.zeros((len(book), width), x.dtype)
                np.add.at(part, found, x[:, k])
                total[k] = total[k] + part
        rows = {"part": [], "entry": [], "at": [], "limb": [], "value": []}
        for k, e in zip(*np.nonzero(count)):
            for at, v in [(-1, int(count[k, e])), *enumerate(map(int, total[k, e]))]:
                low, limb = abs(v), 0
                while low or (at < 0 and not limb):
                    piece = (low & ((1 << LIMB) - 1)) * (1 if v >= 0 else -1)
                    for name, value in zip(rows, (int(k), int(e), at, limb, piece)):
                        rows[name].append(value)
                    low, limb = low >> LIMB, limb + 1
        yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in rows.items()})

    sent = kept.mapInArrow(of, "part long, entry long, at long, limb long, value long").groupBy("part", "entry", "at", "limb").agg(F.sum("value").alias("value"))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sent.collect():  # parts x entries x width numbers, whatever the number of vectors
        n, sums = out.setdefault((r["part"], r["entry"]), (0, [0] * width))
        value = r["value"] << (LIMB * r["limb"])
        if r["at"] < 0:
            out[r["part"], r["entry"]] = (n + value, sums)
        else:
            sums[r["at"]] += value
    return out


def _array(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(v) < 1 << SMALL for r in rows for v in r)
    return np.array(rows, np.int64 if small else object).reshape(len(rows), -1)


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for the kept rows of ``vectors`` (vec_id, embedding, label).

    A row goes when its vector is null or holds null or non-finite components, or has another length than the kept vector that comes
    first by vec_id. A length that ``parts`` does not divide is padded with zeros. The ``entries`` kept rows that come first by vec_id
    (null last, then by vector) start the codebooks; fewer rows give fewer entries. Rows that share a vec_id are coded one by one.
    An error beyond 64 bits is null, and so is the error of its label. A table without kept rows gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("label"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = v.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", odd))
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = kept.select("vec_id", "embedding").orderBy(*order).limit(1).collect()
    schema = f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"
    if not first:
        none = spark.createDataFrame([], schema)
        return none.select("vec_id", "code", "error", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dims = len(first[0]["embedding"])
    width = -(-dims // parts)
    kept = kept.where(F.size("embedding") == dims)
    start = kept.select("vec_id", "embedding").orderBy(*order).limit(entries).toArrow().column(1).combine_chunks()
    cut = _cut(start, parts, width)
    books = [_array([[int(n) for n in row] for row in cut[:, k]]) for k in range(parts)]
    for _ in range(rounds):
        sums = _summed(kept.select("vec_id", "embedding"), books, width)
        books = [_array([[s // sums[k, e][0] for s in sums[k, e][1]] if (k, e) in sums else [int(n) for n in book[e]] for e in range(len(book))]) for k, book in enumerate(books)]
    digest = hashlib.sha256(",".join(str(int(n)) for book in books for row in book for n in row).encode()).hexdigest()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            x = _cut(b.column(1), parts, width)
            found, error = zip(*(nearest(x[:, k], book) for k, book in enumerate(books)))
            codes = np.stack(found, axis=1).astype(np.uint8 if entries <= 256 else np.uint16)
            digits = 2 if entries <= 256 else 4
            text = codes.astype(codes.dtype.newbyteorder(">")).tobytes().hex()
            size = digits * parts
            total = sum(e.astype(object) for e in error)
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column(0), "label": b.column(2), "code": [text[i * size : (i + 1) * size] for i in range(b.num_rows)],
                "error": pa.array([e if e < 1 << 63 else None for e in total], pa.int64()),
            })

    coded = written(kept.select("vec_id", "embedding", "label").mapInArrow(code, schema), "vector-codes")
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = coded.groupBy("label").agg(whole.alias("_sum"))
    sums = written(sums.select(F.col("label").alias("_label"), F.expr("try_cast(_sum as long)").alias("label_error")), "label-errors")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
