"""Stored outputs: parquet, CSV and JSON tables, and writes that can be resumed by partition."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import exists

BOM = "﻿"


def save_table(df: DataFrame, path: str, formats: Sequence[str] = ("parquet",), partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """One folder per format. CSV starts with a byte-order mark in its header, as spreadsheet programs expect."""
    for f in formats:
        d = df
        if f == "csv":
            first = [c for c in df.columns if c not in partition_by][0]
            d = df.withColumnRenamed(first, BOM + first)
        w = d.write.mode(mode)
        if partition_by:
            w = w.partitionBy(*partition_by)
        if f == "csv":
            w = w.option("header", True)
        w.format(f).save(f"{path}/{f}" if len(formats) > 1 else path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Only the partitions present in ``df`` are replaced. The setting is per write, so the session keeps its own.

    Rows are first gathered by partition value: a task then opens few files. Hot values are split by AQE's rebalance.
    """
    d = df.hint("rebalance", *[F.col(c) for c in partition_by])
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def done_partitions(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    """Distinct key values already stored, from the names of the partition folders; no row is read."""
    if not exists(spark, path):
        return None
    files = spark.read.parquet(path).inputFiles()
    # names are escaped once as folder names and once more as parts of a URI
    parts = [{k: unquote(v) for k, v in (p.split("=", 1) for p in unquote(f).split("/") if "=" in p)} for f in files]
    found = sorted({tuple(p.get(k) for k in keys) for p in parts}, key=str)
    kinds = spark.read.parquet(path).select(*keys).schema
    named = spark.createDataFrame(found, ", ".join(f"`{k}` string" for k in keys))
    none = "__HIVE_DEFAULT_PARTITION__"
    return named.select(*[F.when(F.col(k) != none, F.col(k)).cast(kinds[k].dataType).alias(k) for k in keys])


def resume_write(spark: SparkSession, todo: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, keys: Sequence[str]) -> DataFrame:
    """Compute and store only the (mode, year) style work items not stored yet, then read everything back.

    ``todo`` lists the items; ``make`` turns the missing ones into result rows carrying the keys.
    """
    done = done_partitions(spark, path, keys)
    left = todo if done is None else todo.join(done, list(keys), "left_anti")
    if not left.isEmpty():
        overwrite_partitions(make(left), path, keys)
    return spark.read.parquet(path)
