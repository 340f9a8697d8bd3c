"""Streaming forms, run over what is available and given back as tables."""

from pyspark.sql import functions as F

from ..operators import detectors as dt
from ..operators import period as pd
from ..session import new_path
from ..streaming import alarms, counts
from .registry import R, big, chain, query, rnd, text
from .states_queries import C_WAVE
from .testbed import county_panel, daily, table
from .warning_queries import C_CUSUM


def event_stream(spark, sf):
    """The events as a stream of cases: onset = day of the event, reported a few days later."""
    schema = table(spark, sf, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    onset = F.date_trunc("day", F.col("ts").cast("timestamp"))
    return s.select("event_id", "event_type", onset.alias("onset"), F.pmod("event_id", F.lit(13)).alias("delay"))


@query("l1_streaming_counts", "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(*) AS n FROM events GROUP BY 1, 2")
def l1(spark, sf):
    t = counts.run_to_table(counts.daily_counts(event_stream(spark, sf), ["event_type"]), "complete", "l1")
    return t.select("event_type", text("day").alias("day"), "n")


@query("l1b_streaming_windows", """WITH e AS (SELECT event_type, CAST(ts AS DATE) AS d FROM events) SELECT event_type, CAST(d + CAST(k AS INTEGER) AS VARCHAR) AS day, COUNT(*) AS n FROM e CROSS JOIN (SELECT unnest(range(0, 7)) AS k) GROUP BY 1, 2""")
def l1b(spark, sf):
    t = counts.run_to_table(counts.sliding_counts(event_stream(spark, sf), ["event_type"]), "complete", "l1b")
    return t.select("event_type", text("day").alias("day"), "n")


def event_files(spark, sf, files=4):
    """The events in several files, days shuffled over them, as a stream that reads one file a time."""
    path = new_path(spark, "event-files")
    e = table(spark, sf, "events").select("event_id", "event_type", "ts")
    e.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(files))).write.partitionBy("part").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("l1c_late_reports", "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(*) AS n FROM events GROUP BY 1, 2")
def l1c(spark, sf):
    """Micro-batches with days in any order: all reports count, before and after the batches are folded."""
    path, state = new_path(spark, "l1c"), new_path(spark, "l1c-state")
    s = event_files(spark, sf).select("event_type", F.col("ts").cast("timestamp").alias("onset"))
    counts.additive_counts(s, ["event_type"], path, state).awaitTermination()
    counts.fold_counts(spark, path, ["event_type"])
    t = counts.current_counts(spark, path, ["event_type"])
    return t.select("event_type", text("day").alias("day"), "n")


_SNAPSHOT = "event_type string, event_id long, fetched_on string"


@query("l2_snapshot_upsert", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS fetched_on, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def l2(spark, sf):
    """The same snapshots streamed twice leave one copy."""
    path = new_path(spark, "l2")
    schema = table(spark, sf, "events").schema
    for run in ("first", "second"):
        s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        s = s.select(F.date_format("ts", "yyyy-MM-dd").alias("fetched_on"), "event_type", "event_id")
        counts.upsert_snapshots(s, path, new_path(spark, "l2-state"), run).awaitTermination()
    return counts.read_snapshots(spark, path, _SNAPSHOT).groupBy("fetched_on", "event_type").agg(F.count("*").alias("n"))


@query("l2b_split_snapshots", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS fetched_on, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def l2b(spark, sf):
    """Snapshots whose dates are split over several micro-batches, streamed twice."""
    path = new_path(spark, "l2b")
    for run in ("first", "second"):
        s = event_files(spark, sf).select(F.date_format("ts", "yyyy-MM-dd").alias("fetched_on"), "event_type", "event_id")
        counts.upsert_snapshots(s, path, new_path(spark, "l2b-state"), run).awaitTermination()
    return counts.read_snapshots(spark, path, _SNAPSHOT).groupBy("fetched_on", "event_type").agg(F.count("*").alias("n"))


def _as_stream(df, name):
    """A stored table read back as a stream."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@query("l3_stateful_cusum", chain(C_CUSUM, "SELECT series, COUNT(*) AS days, COUNT(*) FILTER (alarm) AS alarms, true AS same FROM cz GROUP BY 1", recursive=True))
def l3(spark, sf):
    """Streamed alarms beside the batch alarms of the same days; ``same`` must be true in every row."""
    d = daily(spark, sf).select("series", "day", F.col("n").cast("double").alias("value"))
    stream = alarms.newest(counts.run_to_table(alarms.cusum_stream(_as_stream(d, "l3-in")), "append", "l3"))
    batch = dt.cusum(d, ["series"], "value", "day").select("series", "day", F.col("s").alias("bs"), F.col("alarm").alias("ba"))
    j = stream.join(batch, ["series", "day"], "full_outer")
    same = F.coalesce((F.abs(F.col("s") - F.col("bs")) < 1e-9) & (F.col("alarm") == F.col("ba")), F.lit(False))
    return j.groupBy("series").agg(F.count("*").alias("days"), F.count_if(F.col("alarm")).alias("alarms"), F.min(same).alias("same"))


@query("l3c_days_out_of_order", chain(C_CUSUM, "SELECT series, COUNT(*) AS days, COUNT(*) FILTER (alarm) AS alarms, true AS same FROM cz GROUP BY 1", recursive=True))
def l3c(spark, sf):
    """Days in shuffled blocks of two weeks, one file a time: late days go back and correct the alarms behind them."""
    d = daily(spark, sf).select("series", "day", F.col("n").cast("double").alias("value"))
    lo = d.agg(F.min("day")).scalar()
    path = new_path(spark, "l3c-in")
    n = F.datediff("day", lo)
    # every other block of 14 days is put off to the next file
    order = F.floor(n / 28) * 2 + F.when(F.floor(n / 14) % 2 == 0, 2).otherwise(1)
    blocks = F.floor(order / 40)
    d.withColumn("part", blocks.cast("int")).repartition(1).sortWithinPartitions(F.xxhash64("series", "day")).write.partitionBy("part").parquet(path)
    src = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream = alarms.newest(counts.run_to_table(alarms.cusum_stream(src, replay=4000), "append", "l3c"))
    batch = dt.cusum(d, ["series"], "value", "day").select("series", "day", F.col("s").alias("bs"), F.col("alarm").alias("ba"))
    j = stream.join(batch, ["series", "day"], "full_outer")
    same = F.coalesce((F.abs(F.col("s") - F.col("bs")) < 1e-9) & (F.col("alarm") == F.col("ba")), F.lit(False))
    return j.groupBy("series").agg(F.count("*").alias("days"), F.count_if(F.col("alarm")).alias("alarms"), F.min(same).alias("same"))


@query("l3b_stateful_wave", chain(C_WAVE, "SELECT county AS series, COUNT(*) AS weeks, COUNT(*) FILTER (inp) AS in_period, true AS same FROM wave GROUP BY 1", recursive=True))
def l3b(spark, sf):
    from ..operators import calendar as cal

    p = county_panel(spark, sf).select(F.col("county").alias("series"), cal.start_of_index(F.col("week_idx")).alias("day"), F.col("total").cast("double").alias("value"))
    stream = counts.run_to_table(alarms.wave_stream(_as_stream(p, "l3b-in")), "append", "l3b")
    batch = pd.wave_flags(p, ["series"], "value", "day").select("series", "day", F.col("level").alias("bl"), F.col("in_period").alias("bi"))
    j = stream.join(batch, ["series", "day"], "full_outer")
    same = F.coalesce((F.col("level") == F.col("bl")) & (F.col("in_period") == F.col("bi")), F.lit(False))
    return j.groupBy("series").agg(F.count("*").alias("weeks"), F.count_if(F.col("in_period")).alias("in_period"), F.min(same).alias("same"))
