"""Session defaults, the shared scratch folder, and tables written between stages."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple[str, str], str] = {}
_LOCAL_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: their Python workers import it wherever they start."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="epivigil-"), f"epivigil-{uuid.uuid4().hex[:8]}.zip")  # the driver serves this file itself
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests) gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/epivigil/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="epivigil-")
    return _LOCAL_SCRATCH[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the scratch folder that no earlier call has handed out."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition into twice the configured number of partitions ahead of steps that cost much per row.

    Adaptive execution merges small partitions by bytes, which would leave few long tasks where few bytes mean much work;
    it keeps an explicit count. Windows and grouped maps on the same keys need no further shuffle.
    """
    n = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if keys else df


def written(df: DataFrame, name: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name or "stage")
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _state_of(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of the files in ``folder``, as text; empty for what is not a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return ""
    return ";".join(sorted(f"{x.getPath().getName()},{x.getLen()},{x.getModificationTime()}" for x in fs.listStatus(p)))


def written_once(spark: SparkSession, key: str, make, reads: str | None = None) -> DataFrame:
    """``written`` at most once per application, ``key`` and state of the folder ``reads``; later calls read the stored table."""
    k = (spark.sparkContext.applicationId, key + "|" + (_state_of(spark, reads) if reads else ""))
    if k not in _WRITTEN:
        df = make()
        path = new_path(spark, "table")
        df.write.mode("errorifexists").parquet(path)
        _WRITTEN[k] = path
    return spark.read.parquet(_WRITTEN[k])
