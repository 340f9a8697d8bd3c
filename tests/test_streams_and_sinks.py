"""Streams fed in several batches equal the batch form; stored outputs can be resumed and replaced."""

import numpy as np
from pyspark.sql import functions as F

from epivigil.operators import detectors as dt
from epivigil.operators import period
from epivigil.session import new_path
from epivigil.sources import readers, sinks
from epivigil.streaming import alarms, counts

RNG = np.random.default_rng(3)


def fed(spark, df, cuts, build, name):
    """Run a stream three times, each time with the next days added; gives all emitted rows."""
    src, out, ck = (new_path(spark, f"{name}-{x}") for x in ("in", "out", "ck"))
    for lo, hi in cuts:
        df.where((F.col("i") >= lo) & (F.col("i") < hi)).drop("i").coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(df.drop("i").schema).parquet(src)
        q = build(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def series(spark, n=150):
    rows = [(f"s{k}", i, float(v)) for k in range(3) for i, v in enumerate(RNG.poisson(2 + 5 * (k == 1), n))]
    d = spark.createDataFrame(rows, "series string, i int, value double")
    return d.withColumn("day", F.date_add(F.lit("2022-01-02").cast("date"), F.col("i"))).select("series", "day", "value", "i")


def test_cusum_stream(spark):
    d = series(spark)
    got = fed(spark, d, [(0, 40), (40, 90), (90, 150)], alarms.cusum_stream, "cs")
    exp = dt.cusum(d.drop("i"), ["series"], "value", "day")
    j = got.alias("a").join(exp.alias("b"), ["series", "day"], "full_outer").select((F.abs(F.col("a.s") - F.col("b.s")) < 1e-9).alias("x"), (F.col("a.alarm") == F.col("b.alarm")).alias("y"))
    assert j.count() == 450 and j.where("not coalesce(x and y, false)").count() == 0


def test_cusum_stream_fills_days(spark):
    """Days without a row count 0, as on the dense panel."""
    d = series(spark).withColumn("value", F.when(F.col("i") % 5 == 3, 0.0).otherwise(F.col("value")))
    got = fed(spark, d.where("i % 5 <> 3"), [(0, 77), (77, 150)], alarms.cusum_stream, "cz")
    exp = dt.cusum(d.drop("i"), ["series"], "value", "day")
    assert got.count() == 450 and got.join(exp.where("alarm"), ["series", "day"], "left_semi").where("not alarm").count() == 0


def test_cusum_stream_with_days_out_of_order(spark):
    """Late days, a repeated one with another value, and one too old to go back to."""
    d = series(spark)
    order = F.when((F.col("i") >= 60) & (F.col("i") < 65), 1).when(F.col("i") == 90, 2).when(F.col("i") < 3, 1).when(F.col("i") < 120, 0).otherwise(1)
    wrong = d.where("i = 100").withColumns({"value": F.col("value") + 50, "i": F.lit(0)})
    rows = d.withColumn("i", order).unionByName(wrong).unionByName(d.where("i = 100").withColumn("i", F.lit(2)))
    rows = rows.where(~((F.col("day") == "2022-04-12") & (F.col("i") == 0)) | (F.col("value") >= 50))
    got = fed(spark, rows, [(0, 1), (1, 2), (2, 3)], alarms.cusum_stream, "co")
    exp = dt.cusum(d.drop("i"), ["series"], "value", "day")
    j = alarms.newest(got).alias("a").join(exp.alias("b"), ["series", "day"], "full_outer")
    j = j.select((F.abs(F.col("a.s") - F.col("b.s")) < 1e-9).alias("x"), (F.col("a.alarm") == F.col("b.alarm")).alias("y"))
    assert j.count() == 450 and j.where("not coalesce(x and y, false)").count() == 0
    old = fed(spark, d.withColumn("i", F.when(F.col("i") == 10, 1).otherwise(0)), [(0, 1), (1, 2)], lambda s: alarms.cusum_stream(s, replay=5), "ct")
    assert {str(r["day"]) for r in old.where("s is null").collect()} == {"2022-01-12"} and old.where("s is null").count() == 3


def test_wave_stream(spark):
    d = series(spark)
    got = fed(spark, d, [(0, 30), (30, 31), (31, 150)], alarms.wave_stream, "wv")
    exp = period.wave_flags(d.drop("i"), ["series"], "value", "day")
    cols = ["series", "day", "level", "rises", "falls", "in_period", "entered", "exited"]
    assert got.select(cols).exceptAll(exp.select(cols)).count() == 0 and got.count() == exp.count()


def test_late_reports_are_dropped(spark):
    rows = [("a", "2022-01-01"), ("a", "2022-06-30"), ("a", "2022-01-02"), ("a", "2022-06-29")]
    d = spark.createDataFrame(rows, "k string, d string").withColumn("i", F.monotonically_increasing_id())
    src, out, ck = (new_path(spark, x) for x in ("lt", "lto", "ltc"))
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, "k string, d string").select("k", F.col("d").cast("timestamp").alias("onset")).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema("k string, onset timestamp").parquet(src)
        q = counts.daily_counts(s, ["k"]).writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("append").parquet(out)).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
    days = {str(r["day"]) for r in spark.read.parquet(out).collect()}
    assert days == {"2022-01-01", "2022-06-30", "2022-06-29"} and d.count() == 4


def test_late_reports_count_in_additive_counts(spark):
    """The rows that the watermark drops, a batch that runs again, and folding."""
    src, path, ck = (new_path(spark, x) for x in ("ad", "adp", "adc"))
    parts = [[("a", "2022-01-01"), ("a", "2022-06-30")], [("a", "2022-01-02"), ("b", "2022-06-29")], [("a", "2022-01-02"), ("a", "2022-01-01")]]
    expected = {}
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "k string, d string").select("k", F.col("d").cast("timestamp").alias("onset")).coalesce(1).write.mode("append").parquet(src)
        counts.additive_counts(spark.readStream.schema("k string, onset timestamp").parquet(src), ["k"], path, ck).awaitTermination()
        for key in part:
            expected[key] = expected.get(key, 0) + 1
        got = {(r["k"], str(r["day"])): r["n"] for r in counts.current_counts(spark, path, ["k"]).collect()}
        assert got == expected
        if i == 1:
            counts.fold_counts(spark, path, ["k"])
            assert {(r["k"], str(r["day"])): r["n"] for r in counts.current_counts(spark, path, ["k"]).collect()} == expected


def test_snapshots_split_over_batches(spark):
    path = new_path(spark, "sn")
    for run, values in (("1", [1, 2, 3]), ("2", [4, 5])):
        src = new_path(spark, f"sn-in{run}")
        for v in values:
            spark.createDataFrame([("2024-01-01", v)], "fetched_on string, v long").coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema("fetched_on string, v long").option("maxFilesPerTrigger", 1).parquet(src)
        counts.upsert_snapshots(s, path, new_path(spark, "sn-ck"), run).awaitTermination()
        assert sorted(r["v"] for r in counts.read_snapshots(spark, path, "v long, fetched_on string").collect()) == values


def test_partition_overwrite_and_resume(spark):
    path = new_path(spark, "parts")
    a = spark.createDataFrame([("x", 1, 1), ("y", 1, 2)], "mode string, year int, v int")
    sinks.overwrite_partitions(a, path, ["mode", "year"])
    sinks.overwrite_partitions(spark.createDataFrame([("y", 1, 9)], a.schema), path, ["mode", "year"])
    assert {(r["mode"], r["v"]) for r in spark.read.parquet(path).collect()} == {("x", 1), ("y", 9)}
    todo = spark.createDataFrame([("x", 1), ("z", 2)], "mode string, year int")
    out = sinks.resume_write(spark, todo, lambda items: items.withColumn("v", F.lit(5)), path, ["mode", "year"])
    assert {(r["mode"], r["v"]) for r in out.collect()} == {("x", 1), ("y", 9), ("z", 5)}


def test_encodings(spark):
    d = spark.createDataFrame([("台北市", "1"), ("臺東縣", "2")], ["縣市", "n"])
    spark.conf.set(readers.JAVA_CHARSETS, "true")
    for enc, mark in (("UTF-8", sinks.BOM), (readers.BIG5, "")):
        path = new_path(spark, "enc")
        d.withColumnRenamed("縣市", mark + "縣市").coalesce(1).write.option("header", True).option("encoding", enc).csv(path)
        assert readers.sniff_encoding(spark, path) == enc
        assert {r["縣市"] for r in readers.read_csv_auto(spark, path).collect()} == {"台北市", "臺東縣"}
