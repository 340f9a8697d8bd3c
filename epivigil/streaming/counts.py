"""Daily counts kept current from a stream of cases, and snapshot upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import new_path
from ..sources.sinks import overwrite_partitions


def daily_counts(cases: DataFrame, by: Sequence[str], onset: str = "onset", n: Column | None = None, max_delay: str = "120 days") -> DataFrame:
    """Cases per series and onset day, in state that forgets days older than the largest tracked delay.

    Reports later than that are dropped; ``additive_counts`` takes them all.
    """
    amount = F.sum(n) if n is not None else F.count("*")
    return (
        cases.withWatermark(onset, max_delay).groupBy(*by, F.window(onset, "1 day")).agg(amount.alias("n"))
        .select(*by, F.col("window.start").cast("date").alias("day"), "n")
    )


def sliding_counts(cases: DataFrame, by: Sequence[str], onset: str = "onset", n: Column | None = None, max_delay: str = "120 days",
                   length: str = "7 days") -> DataFrame:
    """Cases per series in the windows of ``length`` that end each day: (by, day = last day of the window, n)."""
    amount = F.sum(n) if n is not None else F.count("*")
    return (
        cases.withWatermark(onset, max_delay).groupBy(*by, F.window(onset, length, "1 day")).agg(amount.alias("n"))
        .select(*by, F.date_sub(F.col("window.end").cast("date"), 1).alias("day"), "n")
    )


def additive_counts(cases: DataFrame, by: Sequence[str], path: str, checkpoint: str, onset: str = "onset", n: Column | None = None, once: bool = True) -> StreamingQuery:
    """Counts per series and onset day that take every report, however late: no watermark, no state that grows with the days.

    Each micro-batch stores its own sums in a partition with its number. A batch that runs again after a failure replaces them, so each
    report counts once. ``current_counts`` adds the batches up; ``fold_counts`` keeps their number small.
    """
    amount = F.sum(n) if n is not None else F.count("*")

    def store(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*by, F.to_date(onset).alias("day")).agg(amount.alias("n"))
        overwrite_partitions(sums.withColumns({"folded": F.lit(0), "batch": F.lit(number).cast("long")}), path, ["folded", "batch"])

    w = cases.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def _batches(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Stored sums that count: the newest folded part, and the batches behind it; and the last batch that part holds (-1: none)."""
    d = spark.read.parquet(path)
    last = d.where("folded = 1").agg(F.max("batch")).first()[0]
    last = -1 if last is None else last
    return d.where(((F.col("folded") == 1) & (F.col("batch") == last)) | ((F.col("folded") == 0) & (F.col("batch") > last))), last


def current_counts(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """(by, day, n) of all reports that ``additive_counts`` has stored so far."""
    return _batches(spark, path)[0].groupBy(*by, "day").agg(F.sum("n").alias("n"))


def fold_counts(spark: SparkSession, path: str, by: Sequence[str]) -> None:
    """Store the sum of all batches so far as one part, named after the last of them; readers take it instead as soon as it is there."""
    d, _ = _batches(spark, path)
    upto = d.agg(F.max("batch")).first()[0]
    if upto is not None:
        sums = d.where(F.col("batch") <= upto).groupBy(*by, "day").agg(F.sum("n").alias("n"))
        overwrite_partitions(sums.withColumns({"folded": F.lit(1), "batch": F.lit(upto).cast("long")}), path, ["folded", "batch"])


def upsert_snapshots(snapshots: DataFrame, path: str, checkpoint: str, run: str, date_col: str = "fetched_on", once: bool = True) -> StreamingQuery:
    """Store snapshots by (date, run, batch). ``run`` names one fetch, in an order that sorts (a time, for instance).

    A date that is split over several micro-batches adds up within its run; a batch that runs again writes the same partitions; a later
    run of the same date replaces the earlier one for ``read_snapshots``.
    """

    def store(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            overwrite_partitions(batch.withColumns({"run": F.lit(run), "batch": F.lit(number).cast("long")}), path, [date_col, "run", "batch"])

    w = snapshots.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def read_snapshots(spark: SparkSession, path: str, schema: str, date_col: str = "fetched_on") -> DataFrame:
    """All parts of each date's newest run. ``schema``: the snapshot's columns with the date. Which run is newest is seen by folder names."""
    d = spark.read.schema(f"{schema}, run string, batch long").parquet(path)
    newest = d.select(date_col, "run").distinct().groupBy(date_col).agg(F.max("run").alias("run"))
    return d.join(newest, [date_col, "run"], "left_semi").drop("run", "batch")


def run_to_table(stream: DataFrame, mode: str = "complete", name: str = "stream") -> DataFrame:
    """Run a stream over what is available now and give the result as a table; state and result are in the shared folder.

    'append' results go to a file sink. 'complete' and 'update' results replace the stored table batch by batch.
    """
    spark = stream.sparkSession
    out, ck = new_path(spark, name), new_path(spark, name + "-state")
    if mode == "append":
        w = stream.writeStream.format("parquet").option("path", out)
    else:
        w = stream.writeStream.foreachBatch(lambda b, _i: b.write.mode("overwrite").parquet(out))
    q = w.outputMode(mode).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
