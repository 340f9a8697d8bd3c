"""Case line lists with report delay: daily panels, the sparse delay histogram, and what was known on any past day.

The histogram keeps one row per (series, onset, delay) that occurs and is never made dense. A row known from
``onset + delay`` on is placed on the origins it can affect by ``sequence``; no origin is ever paired with all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as lb
from .panel import bounds

DMAX = 120


def delay_days(onset: Column, report: Column, dmax: int = DMAX) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(dmax), F.datediff(report, onset)))


def delay_histogram(
    line_list: DataFrame, cities: Sequence[str] | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Local cases as (series, onset, delay, n). The aggregate combines on the map side before its one shuffle."""
    d = line_list.where(~F.col("imported") & F.col("county").isNotNull() & F.col("township").isNotNull())
    if cities:
        d = d.where(F.col("county").isin(*cities))
    if start:
        d = d.where(F.col("onset") >= F.lit(start).cast("date"))
    if end:
        d = d.where(F.col("onset") <= F.lit(end).cast("date"))
    return d.groupBy(F.concat("county", F.lit("|"), "township").alias("series"), "onset", "delay").agg(
        F.sum("n").cast("long").alias("n")
    )


def dense_days(series: DataFrame, first: Column, last: Column) -> DataFrame:
    """Every series (column series) on every day first..last."""
    return series.withColumn("day", F.explode(F.sequence(first, last)))


def daily_panel(hist: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Final counts (series, day, n) on every day, zeros included."""
    lo, hi = bounds(hist, "onset")
    lo, hi = lo if first is None else first, hi if last is None else last
    sums = hist.groupBy("series", F.col("onset").alias("day")).agg(F.sum("n").alias("n"))
    grid = dense_days(hist.select("series").distinct(), lo, hi)
    return grid.join(sums, ["series", "day"], "left").select("series", "day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def known_counts(hist: DataFrame, origins: DataFrame, back: int | None = None) -> DataFrame:
    """Counts by onset day as known at each origin (column origin): (origin, series, onset, k, n), k = origin - onset.

    ``back`` keeps onset days origin-back+1..origin. A histogram row is spread over the origins that see it inside
    that window, then joined to the wanted origins by equality. Without ``back`` every past onset day is returned.
    """
    last = origins.agg(F.max("origin").alias("v")).scalar()
    until = F.least(F.date_add("onset", back - 1), last) if back else last
    known = F.date_add("onset", F.col("delay"))
    rows = hist.where(known <= until).withColumn("origin", F.explode(F.sequence(known, until)))
    rows = rows.join(origins.select("origin").distinct(), "origin", "left_semi")
    return rows.groupBy("origin", "series", "onset").agg(F.sum("n").alias("n")).select(
        "origin", "series", "onset", F.datediff("origin", "onset").alias("k"), "n"
    )


def known_window_sum(hist: DataFrame, length: int, first: Column, last: Column) -> DataFrame:
    """Sum over the last ``length`` onset days as known at each day, for every series and day: (series, day, n).

    A case enters on its report day and leaves when its onset falls out of the window, so two signed rows per
    histogram row and one running sum answer all origins at once. Steps before ``first`` count as steps of that day, so cases
    that are in the window when the grid begins are in its first sum.
    """
    late = hist.where(F.col("delay") < length)
    steps = late.select("series", F.date_add("onset", F.col("delay")).alias("day"), "n").unionByName(
        late.select("series", F.date_add("onset", length).alias("day"), (-F.col("n")).alias("n"))
    )
    d = steps.groupBy("series", F.greatest("day", first).alias("day")).agg(F.sum("n").alias("step"))
    grid = dense_days(hist.select("series").distinct(), first, last)
    w = W.partitionBy("series").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return grid.join(d, ["series", "day"], "left").select(
        "series", "day", F.coalesce(F.sum("step").over(w), F.lit(0)).cast("long").alias("n")
    )


def completeness(hist: DataFrame, origins: DataFrame, lookback: int = 730, dmax: int = DMAX, floor: float = 0.05) -> DataFrame:
    """Share reported within k = 0..dmax days per origin, from onset days [origin-lookback-dmax, origin-dmax).

    Cases per (onset, delay) are summed over series once. Each origin then differs from the day before only by the
    onset days that enter and leave the window, so running sums per delay replace a range join. No data -> share 1.
    """
    h = hist.groupBy("onset", "delay").agg(F.sum("n").alias("n"))
    moves = h.select("delay", F.date_add("onset", dmax + 1).alias("day"), "n").unionByName(
        h.select("delay", F.date_add("onset", lookback + dmax + 1).alias("day"), (-F.col("n")).alias("n"))
    )
    o = origins.select("origin").distinct()
    delays = o.withColumn("delay", F.explode(F.sequence(F.lit(0), F.lit(dmax))))
    marks = delays.select("delay", F.col("origin").alias("day"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("want"))
    run = W.partitionBy("delay").orderBy("day").rangeBetween(W.unboundedPreceding, 0)
    both = moves.withColumn("want", F.lit(False)).unionByName(marks)
    per = both.withColumn("n", F.sum("n").over(run)).where("want").select(F.col("day").alias("origin"), "delay", "n")
    upto = W.partitionBy("origin").orderBy("delay").rowsBetween(W.unboundedPreceding, 0)
    total = W.partitionBy("origin")
    share = F.sum("n").over(upto) / F.nullif(F.sum("n").over(total), F.lit(0))
    return per.select("origin", F.col("delay").alias("k"), F.greatest(F.coalesce(share, F.lit(1.0)), F.lit(floor)).alias("share"))


def adjusted_counts(known: DataFrame, comp: DataFrame, dmax: int = DMAX, floor: float = 0.2) -> DataFrame:
    """Known counts divided by max(share(k), floor) for onset days up to dmax back; older days stay as they are."""
    c = comp.select("origin", "k", F.greatest("share", F.lit(floor)).alias("_c"))
    return known.join(c, ["origin", "k"], "left").withColumn(
        "n", F.when(F.col("k") <= dmax, F.col("n") / F.coalesce("_c", F.lit(1.0))).otherwise(F.col("n").cast("double"))
    ).drop("_c")


def rolling_sum(df: DataFrame, value: str, out: str = "s7", days: int = 7, by: Sequence[str] = ("series",), order: str = "day") -> DataFrame:
    """Trailing sum over rows of a dense daily panel; shorter at the start."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(-(days - 1), 0)
    return df.withColumn(out, F.sum(value).over(w))


def warning_threshold(
    df: DataFrame, value: str, out: str = "thr", weeks: int = 3, factor: float = 2.0, floor: float = 3.0,
    by: Sequence[str] = ("series",), order: str = "day",
) -> DataFrame:
    """max(factor x mean weekly count of the last ``weeks`` 7-day blocks, floor) on a dense daily panel.

    Days before the start of a series count as zero.
    """
    w = W.partitionBy(*by).orderBy(order).rowsBetween(-(7 * weeks - 1), 0)
    return df.withColumn(out, F.greatest(F.lit(factor / weeks) * F.sum(value).over(w), F.lit(float(floor))))


def delay_profile(hist: DataFrame, origin: Column, probs: Sequence[float] = (0.5, 0.75, 0.9, 0.95), dmax: int = DMAX) -> DataFrame:
    """Delay quantiles weighted by cases, searched delays (first delay with CDF >= .5 / .95), and the mean share
    reported of the last seven days at ``origin``. Works on at most dmax+1 rows after one aggregate."""
    per = hist.groupBy("delay").agg(F.sum("n").alias("n"))
    q = per.agg(
        *[F.expr(f"percentile(delay, {p}D, n)").alias(f"p{round(100 * p)}") for p in probs], F.sum("n").alias("n_cases")
    )
    w = W.orderBy("delay").rowsBetween(W.unboundedPreceding, 0)
    cdf = per.withColumn("_c", F.sum("n").over(w) / F.sum("n").over(W.partitionBy()))
    first = cdf.agg(
        F.min(F.when(F.col("_c") >= 0.5, F.col("delay"))).alias("median"), F.min(F.when(F.col("_c") >= 0.95, F.col("delay"))).alias("p95_first")
    )
    o = hist.sparkSession.range(1).select(origin.alias("origin"))
    c = completeness(hist, o, dmax=dmax).where("k < 7").agg(F.avg("share").alias("v")).scalar()
    return q.withColumns(
        {"median": first.select("median").scalar(), "p95_first": first.select("p95_first").scalar(), "recent7_complete": c}
    )


def peak_by_group(daily: DataFrame, group: Column, min_cases: int = 100) -> DataFrame:
    """Largest 7-day sum and its first date per group with at least ``min_cases`` cases."""
    g = daily.groupBy(group.alias("grp"), "day").agg(F.sum("n").alias("n"))
    s = rolling_sum(g, "n", by=("grp",))
    return (
        s.groupBy("grp")
        .agg(
            F.sum("n").alias("total"),
            F.max("s7").alias("peak7"),
            F.max_by("day", F.struct("s7", -F.datediff("day", F.lit("1970-01-01").cast("date")))).alias("peak_day"),
        )
        .where(F.col("total") >= min_cases)
    )


def recent_summary(snapshot: DataFrame, origin: Column) -> DataFrame:
    """Per series of a daily snapshot (series, day, confirmed, pending): known7, confirmed14, pending14, last case day."""
    age = F.datediff(origin, F.col("day"))
    return snapshot.where(age >= 0).groupBy("series").agg(
        F.sum(F.when(age < 7, F.col("confirmed")).otherwise(0)).alias("known7"),
        F.sum(F.when(age < 14, F.col("confirmed")).otherwise(0)).alias("confirmed14"),
        F.sum(F.when(age < 14, F.col("pending")).otherwise(0)).alias("pending14"),
        F.max(F.when(F.col("confirmed") > 0, F.col("day"))).alias("last_onset"),
    )


def epidemic_years(daily: DataFrame, inside: Column | None = None, min_cases: int = 1000) -> DataFrame:
    """Years whose cases reach ``min_cases``, counted over the series meeting ``inside`` (all series when none does)."""
    d = daily if inside is None else daily.withColumn("_in", inside)
    if inside is not None:
        some = d.agg(F.max("_in").alias("v")).scalar()
        d = d.where(F.col("_in") | ~some)
    return d.groupBy(F.year("day").alias("year")).agg(F.sum("n").alias("cases")).where(F.col("cases") >= min_cases)


def densify_snapshot(snapshot: DataFrame, series: DataFrame, first: Column, last: Column, date_type: str, col: str) -> DataFrame:
    """Sparse snapshot rows -> dense (series, day, value); unknown series and dates outside the range are left out."""
    sub = snapshot.where(F.col("date_type") == date_type).groupBy(
        F.concat("county", F.lit("|"), "town").alias("series"), F.col("date").cast("date").alias("day")
    ).agg(F.sum(col).alias("value"))
    return dense_days(series.select("series").distinct(), first, last).join(sub, ["series", "day"], "left").select(
        "series", "day", F.coalesce("value", F.lit(0)).cast("long").alias("value")
    )


def series_region(df: DataFrame, cities: Sequence[str] = lb.FOCUS_CITIES) -> DataFrame:
    return df.withColumn("region", lb.region_of(F.col("series"), cities))
