"""Known-future covariates by week (holidays, school breaks, season) and past-only covariates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import calendar as cal

# New Year's Day of the lunar calendar.
LUNAR_NEW_YEAR = {
    2016: "2016-02-08", 2017: "2017-01-28", 2018: "2018-02-16", 2019: "2019-02-05", 2020: "2020-01-25",
    2021: "2021-02-12", 2022: "2022-02-01", 2023: "2023-01-22", 2024: "2024-02-10", 2025: "2025-01-29",
    2026: "2026-02-17", 2027: "2027-02-06", 2028: "2028-01-26", 2029: "2029-02-13",
}
# The weekend category of the holiday file and the words that mark the new-year break.
WEEKEND_CATEGORY = "星期六、星期日"
NEW_YEAR_WORDS = "春節|除夕|小年夜"


def _new_year_dates(spark, dates: dict[int, str]) -> DataFrame:
    return spark.createDataFrame([(d,) for d in dates.values()], "d string").select(F.col("d").cast("date").alias("date"))


def weekday_holidays(holidays: DataFrame) -> DataFrame:
    """Public holidays that are not ordinary weekend days."""
    return holidays.where(F.col("isHoliday") & ~(F.coalesce("holidayCategory", F.lit("")) == WEEKEND_CATEGORY))


def extra_closures(closures: DataFrame, holidays: DataFrame) -> DataFrame:
    """Closures on Monday..Friday that are not already holidays."""
    return closures.where(F.dayofweek("date").between(2, 6)).join(
        weekday_holidays(holidays).select("date").distinct(), "date", "left_anti"
    )


def holiday_weeks(
    weeks: DataFrame, holidays: DataFrame, closures: DataFrame, dim: DataFrame | None = None,
    new_year: dict[int, str] | None = None, break_days: float = 5.0,
) -> DataFrame:
    """Per week of ``weeks`` (yw, week_start): holiday_days with closures, cny_week 0/1, closure_days.

    Beyond the holiday file only the listed new-year dates are known; such a week counts ``break_days`` at least.
    ``dim`` resolves dates by the week table; without it the arithmetic rule of the calendar is used.
    """
    new_year = LUNAR_NEW_YEAR if new_year is None else new_year

    def to_week(df: DataFrame) -> DataFrame:
        return cal.asof_week(df, "date", dim) if dim is not None else df.withColumn("yw", cal.yw_of_date(F.col("date")))

    file_max = holidays.agg(F.max("date").alias("v")).scalar()
    marked = holidays.where(
        F.col("isHoliday")
        & F.concat_ws("|", F.coalesce("name", F.lit("")), F.coalesce("holidayCategory", F.lit(""))).rlike(NEW_YEAR_WORDS)
    ).select("date")
    listed = _new_year_dates(holidays.sparkSession, new_year).where(F.col("date") > file_max)
    listed = listed.union(listed.select(F.date_sub("date", 1)))
    parts = (
        to_week(weekday_holidays(holidays).select("date")).select("yw", F.lit(1).alias("hol"), F.lit(0).alias("clo"), F.lit(0).alias("cny"))
        .union(to_week(extra_closures(closures, holidays).select("date")).select("yw", F.lit(0), F.lit(1), F.lit(0)))
        .union(to_week(marked.union(listed)).select("yw", F.lit(0), F.lit(0), F.lit(1)))
    )
    g = parts.groupBy("yw").agg(
        F.sum("hol").alias("hol"), F.sum("clo").alias("closure_days"), F.max("cny").alias("cny_week")
    )
    j = weeks.select("yw", "week_start").distinct().join(g, "yw", "left")
    days = F.coalesce(F.col("hol") + F.col("closure_days"), F.lit(0)).cast("double")
    cny = F.coalesce("cny_week", F.lit(0)).cast("double")
    return j.select(
        "yw",
        "week_start",
        F.when((F.col("week_start") > file_max) & (cny == 1), F.greatest(days, F.lit(break_days))).otherwise(days).alias("holiday_days"),
        cny.alias("cny_week"),
        F.coalesce("closure_days", F.lit(0)).cast("double").alias("closure_days"),
    )


def school_weeks(weeks: DataFrame, new_year: dict[int, str] | None = None) -> DataFrame:
    """summer_break, winter_break and reopen (first two weeks after a break) by the Wednesday of each week.

    Input one row per week (yw, week_start); the window without partition runs over those weeks only.
    """
    new_year = LUNAR_NEW_YEAR if new_year is None else new_year
    wed = F.date_add("week_start", 3)
    y = F.year(wed)
    listed = F.create_map(*[F.lit(v) for k, d in new_year.items() for v in (k, d)])
    lny = F.coalesce(F.try_element_at(listed, y).cast("date"), F.make_date(y, F.lit(2), F.lit(5)))
    winter_end = F.greatest(F.make_date(y, F.lit(2), F.lit(10)), F.date_add(lny, 6))
    w = W.orderBy("week_start")
    d = weeks.select("yw", "week_start").distinct().withColumns(
        {
            "summer_break": wed.between(F.make_date(y, F.lit(7), F.lit(1)), F.make_date(y, F.lit(8), F.lit(29))).cast("int"),
            "winter_break": wed.between(F.make_date(y, F.lit(1), F.lit(21)), winter_end).cast("int"),
        }
    )
    brk = F.greatest("summer_break", "winter_break")
    d = d.withColumn("_brk", brk).withColumn("_end", ((F.lag("_brk", 1, 0).over(w) == 1) & (F.col("_brk") == 0)).cast("int"))
    return d.withColumn("reopen", F.greatest("_end", F.lag("_end", 1, 0).over(w))).drop("_brk", "_end")


def future_covariates(
    weeks: DataFrame, kinds: Sequence[str], holidays: DataFrame | None = None, closures: DataFrame | None = None,
    dim: DataFrame | None = None,
) -> DataFrame:
    """One row per context or future week with a column per chosen kind: season, season2, school, cny, holiday."""
    known = {"season", "season2", "school", "cny", "holiday"}
    if not kinds or not set(kinds) <= known:
        raise ValueError(f"covariate kinds must be some of {sorted(known)}")
    out = weeks.select("yw", "week_start").distinct()
    if "season" in kinds:
        out = out.withColumns(cal.harmonics(F.col("yw")))
    if "season2" in kinds:
        out = out.withColumns(cal.double_harmonics(F.col("yw")))
    if "school" in kinds:
        out = out.join(school_weeks(weeks).drop("week_start"), "yw")
    if {"cny", "holiday"} & set(kinds):
        hw = holiday_weeks(weeks, holidays, closures, dim).drop("week_start")
        keep = [c for k, c in (("cny", "cny_week"), ("holiday", "holiday_days")) if k in kinds]
        out = out.join(hw.select("yw", *keep), "yw")
    return out


def horizon_weeks(panel_weeks: DataFrame, horizon: int) -> DataFrame:
    """Context weeks (yw, week_start) and the ``horizon`` weeks after the last of them."""
    last = panel_weeks.agg(F.max("week_start").alias("v")).scalar()
    spark = panel_weeks.sparkSession
    ahead = spark.range(1, horizon + 1).select(F.date_add(last, F.col("id").cast("int") * 7).alias("week_start"))
    return panel_weeks.select("week_start").distinct().union(ahead).select(
        cal.yw_of_start(F.col("week_start")).alias("yw"), "week_start"
    )


def past_only(df: DataFrame, cols: Sequence[str], lag: int, order: str, partition: Sequence[str] = ()) -> DataFrame:
    """Lag by the reporting delay, fill the head from the first value, then the gaps and the tail from the last one.

    A gap inside the series takes the next known value, as the head does; only weeks without any later value take the
    last known one.
    """
    w = W.partitionBy(*partition).orderBy(order)
    ahead, behind = w.rowsBetween(0, W.unboundedFollowing), w.rowsBetween(W.unboundedPreceding, 0)
    lagged = df.withColumns({c: F.lag(c, lag).over(w) for c in cols})
    return lagged.withColumns(
        {c: F.coalesce(F.first(c, ignorenulls=True).over(ahead), F.last(c, ignorenulls=True).over(behind)) for c in cols}
    )


def horizon_tags(
    forecasts: DataFrame, holidays: DataFrame, closures: DataFrame, start_col: str = "week_start",
    origin_col: str = "origin_start",
) -> DataFrame:
    """Per forecast row: names of the weekday holidays in its week, and of closures in the last three weeks to the origin.

    Dates map to their Sunday week, so both range joins are equi joins on the week.
    """
    hol = (
        weekday_holidays(holidays)
        .select(
            cal.week_start(F.col("date")).alias("_w"),
            "date",
            F.concat(F.coalesce("name", F.lit("")), F.coalesce("holidayCategory", F.lit(""))).alias("_n"),
        )
        .groupBy("_w")
        .agg(
            F.array_join(
                F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("date", "_n"))), lambda x: x["_n"])), ","
            ).alias("holiday_names")
        )
    )
    clo = (
        closures.select(cal.week_start(F.col("date")).alias("_c"), "date", F.col("name").alias("_n"))
        .withColumn("_w", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.date_add(F.col("_c"), k * 7))))
        .groupBy("_w")
        .agg(
            F.array_join(
                F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("date", "_n"))), lambda x: x["_n"])), ","
            ).alias("recent_closures")
        )
    )
    return (
        forecasts.join(hol, F.col(start_col) == F.col("_w"), "left").drop("_w")
        .join(clo, F.col(origin_col) == F.col("_w"), "left").drop("_w")
    )
