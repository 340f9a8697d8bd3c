"""Token ids of documents in binary files: written in ascending id order, read back as arrays or digests.

A file set is a Parquet folder of segments. A segment has some whole documents of one shard (a range of ids): their ids, how many
tokens each has, the tokens of the shard before it, and all token ids as one Simple-8b payload. Spark's committer puts only the
files of finished tasks in place, so a lost executor leaves no half-written shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import simple8b
from .common import slices
from .encoding import encoder

SEGMENT = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()),
])
SEGMENT_IDS = 1 << 19  # a segment is closed at this many ids; one longer document is a segment of its own


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None) -> None:
    """Encode ``text`` of every row of ``docs`` (doc_id long, text; other columns are ignored) and write the files to ``path``.

    A null text is empty and has the end id alone. Rows are ordered by doc_id, null ids first, and rows that share an id by their
    text; each repeated row is written. An empty table gives an empty file set. ``tokenizer`` is a file that each worker can open.
    """
    spark = docs.sparkSession
    n = shards or 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, code = TaskContext.get().partitionId(), encoder(tokenizer, end_id)
        state = {"segment": 0, "start": 0}

        def close(rows: list, counts: list, parts: list) -> pa.RecordBatch:
            ids = np.concatenate(parts)
            out = {"shard": [shard], "segment": [state["segment"]], "start": [state["start"]], "n_ids": [len(ids)], "doc_ids": [rows], "counts": [counts], "payload": [simple8b.encode(ids)]}
            state["segment"] += 1
            state["start"] += len(ids)
            return pa.RecordBatch.from_pydict(out, schema=ARROW)

        rows, counts, parts, held = [], [], [], 0
        for b in slices(batches, 2048):
            ids, n_ids = code.encode(b.column(1).to_pylist())
            rows += b.column(0).to_pylist()
            counts += n_ids.tolist()
            parts.append(ids)
            held += len(ids)
            if held >= SEGMENT_IDS:
                yield close(rows, counts, parts)
                rows, counts, parts, held = [], [], [], 0
        if rows:
            yield close(rows, counts, parts)

    ordered.mapInArrow(segments, SEGMENT).write.mode("errorifexists").parquet(path)


ARROW = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary()),
])


def _each(spark: SparkSession, path: str, fields: str, of_segment) -> DataFrame:
    """One row for each document of the files; ``start`` counts the ids of all documents before it."""
    files = spark.read.schema(SEGMENT).parquet(path)
    # one number for each writing task, so the running sum has as many rows as there are shards
    upto = files.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = upto.select("shard", (F.sum("_n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))).alias("_before"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                counts = np.array(r["counts"], np.int64)
                ends = np.cumsum(counts)
                ids = simple8b.decode(r["payload"]).astype("<u4")
                first = {"doc_id": pa.array(r["doc_ids"], pa.int64()), "shard": pa.array(np.full(len(counts), r["shard"], np.int32)), "start": r["start"] + ends - counts, "n_tokens": counts}
                yield pa.RecordBatch.from_pydict(first | of_segment(ids, ends - counts, ends))

    flat = files.mapInArrow(rows, f"doc_id long, shard int, start long, n_tokens long, {fields}")
    return flat.join(before, "shard").withColumn("start", F.col("start") + F.coalesce("_before", F.lit(0))).drop("_before", "shard")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids as an array of each document."""

    def arrays(ids, starts, ends):
        return {"ids": pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.astype(np.int64)))}

    return _each(spark, path, "ids array<long>", arrays)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian 32-bit integers."""

    def sums(ids, starts, ends):
        data = memoryview(ids.tobytes())
        return {"ids_crc32": np.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)}

    return _each(spark, path, "ids_crc32 long", sums)
