"""Sunday weeks: keys, dense indexes, ranges, and joins of dates to weeks.

From 2010 on a week's year is the year of its Wednesday, so key and index are arithmetic on the date and need no join.
A (date, year, week) map, where given, wins and also covers years with another rule (``week_dimension``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPOCH_SUNDAY = "1970-01-04"


def week_start(d: Column) -> Column:
    return F.date_sub(d, F.dayofweek(d) - 1)


def week_index(start: Column) -> Column:
    """Consecutive number of the week starting on Sunday ``start``."""
    return F.floor(F.datediff(start, F.lit(EPOCH_SUNDAY).cast("date")) / 7).cast("int")


def start_of_index(idx: Column) -> Column:
    return F.date_add(F.lit(EPOCH_SUNDAY).cast("date"), idx * 7)


def yw_of_start(start: Column) -> Column:
    mid = F.date_add(start, 3)
    return F.concat(
        F.year(mid).cast("string"),
        F.lpad((F.floor((F.dayofyear(mid) - 1) / 7) + 1).cast("string"), 2, "0"),
    )


def yw_of_index(idx: Column) -> Column:
    return yw_of_start(start_of_index(idx))


def yw_of_date(d: Column) -> Column:
    return yw_of_start(week_start(d))


def start_of_yw(yw: Column) -> Column:
    """Inverse of ``yw_of_start``: the week holding the first Wednesday of the year is week 1."""
    jan1 = F.make_date(F.substring(yw, 1, 4).cast("int"), F.lit(1), F.lit(1))
    to_wed = F.pmod(F.lit(4) - F.dayofweek(jan1), F.lit(7))
    return F.date_add(F.date_add(jan1, to_wed - 3), (F.substring(yw, 5, 2).cast("int") - 1) * 7)


def index_of_yw(yw: Column) -> Column:
    return week_index(start_of_yw(yw))


def weeks_in_year(year: Column) -> Column:
    """52 or 53: the number of Wednesdays in the year."""
    jan1 = F.make_date(year, F.lit(1), F.lit(1))
    dec31 = F.make_date(year, F.lit(12), F.lit(31))
    to_wed = F.pmod(F.lit(4) - F.dayofweek(jan1), F.lit(7))
    return F.floor((F.datediff(dec31, jan1) - to_wed) / 7).cast("int") + 1


def add_week(df: DataFrame, date_col: str) -> DataFrame:
    """Columns yw, week_idx, week_start for a date column."""
    s = week_start(F.col(date_col))
    return df.withColumns({"week_start": s, "yw": yw_of_start(s), "week_idx": week_index(s)})


def week_dimension(date_map: DataFrame) -> DataFrame:
    """(date, year, week) map -> one row per week with its limits, days, weeks in the year and a dense index.

    The only window without partition here runs over weeks of the calendar (about 52 rows a year).
    """
    yw = F.concat(F.col("year").cast("string"), F.lpad(F.col("week").cast("string"), 2, "0"))
    weeks = (
        date_map.withColumn("yw", yw)
        .groupBy("yw")
        .agg(
            F.min("year").alias("year"),
            F.min("week").alias("week"),
            F.min("date").alias("week_start"),
            F.max("date").alias("week_end"),
            F.count("*").alias("n_days"),
        )
    )
    return weeks.withColumn("n_weeks_in_year", F.max("week").over(W.partitionBy("year"))).withColumn(
        "week_idx", F.row_number().over(W.orderBy("week_start")) - 1
    )


def week_range(dim: DataFrame, start: str, end: str) -> DataFrame:
    """Weeks start..end, both included. Unknown weeks and a reversed range raise when the plan runs."""
    a = dim.where(F.col("yw") == start).agg(F.max("week_idx").alias("i")).scalar()
    b = dim.where(F.col("yw") == end).agg(F.max("week_idx").alias("i")).scalar()
    ok = F.assert_true(a.isNotNull() & b.isNotNull() & (a <= b), F.lit(f"week range {start}..{end} is not in the table"))
    return dim.where(ok.isNull() & (F.col("week_idx") >= a) & (F.col("week_idx") <= b))


def next_weeks(df: DataFrame, dim: DataFrame, n: int, yw_col: str = "yw") -> DataFrame:
    """Each row with the n weeks after its week: columns step, next_yw. Weeks past the table are left out."""
    here = dim.select(F.col("yw").alias("_yw"), F.col("week_idx").alias("_i"))
    there = dim.select(F.col("yw").alias("next_yw"), F.col("week_idx").alias("_j"))
    return (
        df.join(here, F.col(yw_col) == F.col("_yw"))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("_j", F.col("_i") + F.col("step"))
        .join(there, "_j")
        .drop("_yw", "_i", "_j")
    )


def shift_week(df: DataFrame, dim: DataFrame, k: int, yw_col: str = "yw", out: str = "shifted_yw") -> DataFrame:
    """The week k steps away; a row whose target is outside the table raises."""
    here = dim.select(F.col("yw").alias("_yw"), (F.col("week_idx") + k).alias("_j"))
    there = dim.select(F.col("yw").alias(out), F.col("week_idx").alias("_j"))
    joined = df.join(here, F.col(yw_col) == F.col("_yw"), "left").join(there, "_j", "left")
    return joined.withColumn(
        out, F.coalesce(F.col(out), F.raise_error(F.concat(F.lit("week outside the table: "), F.col(yw_col))).cast("string"))
    ).drop("_yw", "_j")


def week_of_date(df: DataFrame, date_col: str, dim: DataFrame, missing: str = "error") -> DataFrame:
    """Week holding each date. The interval join is an equi join on the days of each week (seven rows a week)."""
    days = dim.select(
        F.explode(F.sequence("week_start", "week_end")).alias("_day"), F.col("yw").alias("_found")
    )
    j = df.join(days, F.col(date_col) == F.col("_day"), "left")
    yw = F.col("_found")
    if missing == "error":
        yw = F.coalesce(
            yw, F.raise_error(F.concat(F.lit("date outside the week table: "), F.col(date_col).cast("string"))).cast("string")
        )
    return j.withColumn("yw", yw).drop("_day", "_found")


def asof_week(df: DataFrame, date_col: str, dim: DataFrame) -> DataFrame:
    """Last week starting on or before each date, also past the end of the table; null before its first week.

    Every week is spread to the days up to the next week start, so gaps in the table resolve in one equi join.
    """
    nxt = F.lead("week_start").over(W.orderBy("week_start"))
    days = (
        dim.withColumn("_until", F.coalesce(F.date_sub(nxt, 1), F.col("week_end")))
        .select(F.explode(F.sequence("week_start", "_until")).alias("_day"), F.col("yw").alias("_found"))
    )
    last = dim.agg(F.max_by("yw", "week_start").alias("v")).scalar()
    end = dim.agg(F.max("week_start").alias("v")).scalar()
    return (
        df.join(days, F.col(date_col) == F.col("_day"), "left")
        .withColumn("yw", F.when(F.col(date_col) >= end, last).otherwise(F.col("_found")))
        .drop("_day", "_found")
    )


def seasonal_phase(week: Column, n_weeks: Column) -> Column:
    return (week - 0.5) / n_weeks


def harmonics(yw: Column) -> dict[str, Column]:
    """season_sin, season_cos of the phase in the year (52 or 53 weeks)."""
    ph = seasonal_phase(F.substring(yw, 5, 2).cast("int"), weeks_in_year(F.substring(yw, 1, 4).cast("int")))
    a = F.lit(2 * math.pi) * ph
    return {"season_sin": F.sin(a), "season_cos": F.cos(a)}


def double_harmonics(yw: Column, period: float = 52.18) -> dict[str, Column]:
    """Two harmonics of a fixed period, for seasons with two peaks."""
    a = F.lit(2 * math.pi / period) * (F.substring(yw, 5, 2).cast("int") - 1)
    return {"s2_sin1": F.sin(a), "s2_cos1": F.cos(a), "s2_sin2": F.sin(a * 2), "s2_cos2": F.cos(a * 2)}
