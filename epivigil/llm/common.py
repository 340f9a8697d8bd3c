"""Reading tables, walking Arrow batches and numbering rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of at most ``rows`` rows and about ``most_bytes`` (one row may be longer)."""
    for b in batches:
        n = b.num_rows
        if n == 0:
            continue
        step = max(1, min(rows, int(n * most_bytes / max(1, b.get_total_buffer_size()))))
        for i in range(0, n, step):
            yield b.slice(i, step)
    pa.default_memory_pool().release_unused()  # the worker lives on for other operators


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """True where crc32 of the id, as text, leaves no remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0


def bounded_sample(df: DataFrame, by: list[str], most: int, key: str, seed: str) -> DataFrame:
    """At most ``most`` rows of each combination of ``by``, chosen by a hash of the column ``key``.

    The hash thins each group to about twice the bound before its rows meet in one window, so a group of any size is never
    gathered. Used only to pick training rows.
    """
    keyed = df.withColumn("_u", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    n = {tuple(r)[:-1]: tuple(r)[-1] for r in df.groupBy(*by).count().collect()}  # one row for each class label
    share = F.lit(0.0)
    for values, rows in n.items():
        same = F.lit(True)
        for c, v in zip(by, values):
            same = same & F.col(c).eqNullSafe(F.lit(v))
        share = F.when(same, F.lit((2.0 * most + 20) / rows)).otherwise(share)
    thin = keyed.where(F.col("_u") < share)
    w = W.partitionBy(*by).orderBy("_u")
    return thin.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_u", "_r")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) of a bounded sample ``ids`` (doc_id and other columns), one row for each id.

    Only the sample is sent to all tasks, and only its texts are shuffled.
    """
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
