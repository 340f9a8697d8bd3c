"""Complete range of each weekly series: partial edges, sparse heads, sudden drops, coverage.

All rules look at a few neighbouring weeks, so one window per series finds them without a loop. After aggregation a
series holds at most one row per week, which bounds every window partition by the calendar.
Input is long: series columns, week_idx, value (null = no rows that week).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import calendar as cal


def _median_over(x: str, w) -> Column:
    return F.expr(f"percentile({x}, 0.5D)").over(w)


def _with_edge_tests(df: DataFrame, by: Sequence[str], value: str, idx: str, ratio: Column, k: int) -> DataFrame:
    """Adds _t (row number from 0), _last_t and _head (passes the head test) on the non-null rows."""
    w = W.partitionBy(*by).orderBy(idx)
    all_rows = W.partitionBy(*by)
    d = df.where(F.col(value).isNotNull()).withColumns(
        {
            "_t": F.row_number().over(w) - 1,
            "_before": _median_over(value, w.rowsBetween(-k, -1)),
            "_after": _median_over(value, w.rowsBetween(1, k)),
            "_ratio": ratio,
        }
    )
    tail_ok = (F.col("_t") <= k) | (F.col(value) >= F.col("_ratio") * F.col("_before"))
    d = d.withColumn("_last_t", F.max(F.when(tail_ok, F.col("_t"))).over(all_rows))
    left = F.col("_last_t") + 1 - F.col("_t")
    head_ok = (left >= 1) & ((left <= k + 1) | (F.col(value) >= F.col("_ratio") * F.col("_after")))
    return d.withColumn("_head", head_ok)


def detect_edges(
    df: DataFrame, by: Sequence[str], value: str = "value", idx: str = "week_idx", ratio: float | Column = 0.6, k: int = 8
) -> DataFrame:
    """First and last complete week per series: trailing, then leading weeks below ratio x median of k neighbours go.

    The tail test of a week reads only earlier weeks, so cutting the tail never changes another week's test; the last
    week kept is the last one that passes. The head test is the mirror on what is left.
    """
    r = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    d = _with_edge_tests(df, by, value, idx, r, k)
    return d.groupBy(*by).agg(
        F.min(idx).alias("raw_first"),
        F.max(idx).alias("raw_last"),
        F.min(F.when(F.col("_head"), F.col(idx))).alias("first_complete"),
        F.max(F.when(F.col("_t") == F.col("_last_t"), F.col(idx))).alias("last_complete"),
    )


def sparse_head(
    df: DataFrame, by: Sequence[str], value: str = "value", idx: str = "week_idx", k: int = 8, ratio: float = 0.3
) -> DataFrame:
    """First week without a gap for k+1 weeks and at least ratio x the median of the next k; else the first observed.

    Needs every week of the range as a row (null = no rows that week).
    """
    w = W.partitionBy(*by).orderBy(idx)
    d = df.withColumns(
        {
            "_n": F.count(value).over(w.rowsBetween(0, k)),
            "_after": _median_over(value, w.rowsBetween(1, k)),
        }
    )
    ok = (F.col("_n") == k + 1) & (F.col(value) >= F.lit(float(ratio)) * F.col("_after"))
    return d.groupBy(*by).agg(
        F.coalesce(F.min(F.when(ok, F.col(idx))), F.min(F.when(F.col(value).isNotNull(), F.col(idx)))).alias("first_complete")
    )


def edges_asof(
    df: DataFrame, by: Sequence[str], asof: Column, value: str = "value", idx: str = "week_idx",
    ratio: float | None = None, k: int = 8,
) -> DataFrame:
    """Raw and complete range as of a date: weeks not yet over never count. ``ratio`` None uses the sparse-head rule only."""
    raw = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(idx).alias("raw_first"), F.max(idx).alias("raw_last"))
    current = cal.week_index(cal.week_start(asof))
    past = df.where(F.col(idx) < current)
    if ratio is not None:
        e = detect_edges(past, by, value, idx, ratio, k).drop("raw_first", "raw_last")
    else:
        began = past.join(raw.select(*by, "raw_first"), list(by)).where(F.col(idx) >= F.col("raw_first"))
        last = past.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max(idx).alias("last_complete"))
        e = sparse_head(began, by, value, idx, k).join(last, list(by))
    return raw.join(e, list(by))


def drop_check(
    df: DataFrame, by: Sequence[str], at: DataFrame, special_days: DataFrame, value: str = "value", idx: str = "week_idx",
    k: int = 4, limit: float = 0.85,
) -> DataFrame:
    """Week ``at`` (series columns, week_idx) against the median of the k observed weeks before it.

    Rows only where the ratio is below ``limit``: action 'kept' when ``special_days`` (week_idx, holiday_days,
    closure_days) explains it, else 'paused'.
    """
    w = W.partitionBy(*by).orderBy(idx)
    d = df.where(F.col(value).isNotNull()).withColumns(
        {"_n": F.row_number().over(w) - 1, "_m": _median_over(value, w.rowsBetween(-k, -1))}
    )
    d = (
        d.join(at.select(*by, F.col(idx)), [*by, idx], "left_semi")
        .where(F.col("_n") >= k)
        .withColumn("drop_ratio", F.col(value) / F.nullif(F.col("_m"), F.lit(0.0)))
        .where(F.col("drop_ratio") < limit)
    )
    s = special_days.select(idx, "holiday_days", "closure_days")
    return d.join(s, idx, "left").select(
        *by,
        idx,
        F.col("drop_ratio"),
        F.when(F.coalesce("holiday_days", F.lit(0.0)) > 0, "kept").otherwise("paused").alias("action"),
        F.coalesce("holiday_days", F.lit(0.0)).alias("holiday_days"),
        F.coalesce("closure_days", F.lit(0.0)).alias("closure_days"),
    )


def coverage(
    denominators: DataFrame, rules: DataFrame, asof: Column, special_days: DataFrame | None = None, k: int = 8
) -> DataFrame:
    """One row per source: raw and complete range, lists of dropped weeks, drop flag.

    ``denominators``: source, week_idx, value. ``rules``: source, ratio, lag (weeks cut from the tail), check (sudden-drop
    check on the newest week). A paused newest week is cut before the lag.
    """
    current = cal.week_index(cal.week_start(asof))
    w, every = W.partitionBy("source").orderBy("week_idx"), W.partitionBy("source")
    past = (
        denominators.where(F.col("value").isNotNull())
        .withColumns({"_raw0": F.min("week_idx").over(every), "_raw1": F.max("week_idx").over(every)})
        .where(F.col("week_idx") < current)
        .join(rules, "source")
    )
    # edges and the sudden-drop ratio of the newest complete week come from the same windows and one aggregate
    d = _with_edge_tests(past, ["source"], "value", "week_idx", F.col("ratio"), k)
    d = d.withColumn("_drop", F.when(F.col("_t") >= 4, F.col("value") / F.nullif(_median_over("value", w.rowsBetween(-4, -1)), F.lit(0.0))))
    newest = F.col("_t") == F.col("_last_t")
    c = d.groupBy("source").agg(
        F.min("_raw0").alias("raw_first"), F.max("_raw1").alias("raw_last"),
        F.min(F.when(F.col("_head"), F.col("week_idx"))).alias("first_complete"),
        F.max(F.when(newest, F.col("week_idx"))).alias("last_complete"),
        F.max("lag").alias("lag"),
        F.max(F.when(newest & F.col("check") & (F.col("_drop") < 0.85), F.col("_drop"))).alias("flag_ratio"),
    )
    if special_days is not None:
        s = special_days.select(F.col("week_idx").alias("last_complete"), "holiday_days")
        c = c.withColumn("flag_week", F.when(F.col("flag_ratio").isNotNull(), F.col("last_complete"))).join(s, "last_complete", "left")
        c = c.withColumn("flag_action", F.when(F.col("flag_week").isNotNull(), F.when(F.coalesce("holiday_days", F.lit(0.0)) > 0, "kept").otherwise("paused")))
    else:
        c = c.withColumns(
            {"flag_week": F.lit(None).cast("int"), "flag_ratio": F.lit(None).cast("double"), "flag_action": F.lit(None).cast("string")}
        )
    last = F.col("last_complete") - F.when(F.col("flag_action") == "paused", 1).otherwise(0) - F.col("lag")
    c = c.withColumn("last_complete", last.cast("int"))

    def weeks(a: Column, b: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.when(a <= b, F.transform(F.sequence(a, b), cal.yw_of_index)).otherwise(none)

    return c.select(
        "source",
        cal.yw_of_index(F.col("raw_first")).alias("raw_first"),
        cal.yw_of_index(F.col("raw_last")).alias("raw_last"),
        cal.yw_of_index(F.col("first_complete")).alias("first_complete"),
        cal.yw_of_index(F.col("last_complete")).alias("last_complete"),
        F.col("first_complete").alias("first_idx"),
        F.col("last_complete").alias("last_idx"),
        weeks(F.col("raw_first"), F.col("first_complete") - 1).alias("dropped_head"),
        weeks(F.col("last_complete") + 1, F.col("raw_last")).alias("dropped_tail"),
        cal.yw_of_index(F.col("flag_week")).alias("flag_week"),
        F.round("flag_ratio", 3).alias("flag_ratio"),
        "flag_action",
    )


def gate(cov: DataFrame, gated: str, by: str) -> DataFrame:
    """A source is complete no further than its denominator: last week = the smaller of the two."""
    limit = cov.where(F.col("source") == by).select(F.col("last_idx").alias("_lim"))
    lim = limit.agg(F.min("_lim").alias("v")).scalar()
    last = F.when(F.col("source") == gated, F.least(F.col("last_idx"), lim)).otherwise(F.col("last_idx"))
    return cov.withColumn("last_idx", last).withColumn("last_complete", cal.yw_of_index(F.col("last_idx")))


def apply_coverage(panel: DataFrame, cov: DataFrame, zero_fill: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Long panel (source, week_idx, value ...): null outside the complete range, missing = 0 inside for case lists.

    A source without a coverage row stays as it is.
    """
    c = cov.select("source", F.col("first_idx").alias("_a"), F.col("last_idx").alias("_b"))
    inside = F.col("week_idx").between(F.col("_a"), F.col("_b"))
    filled = F.when(F.col("source").isin(*zero_fill), F.coalesce(F.col(value), F.lit(0.0))).otherwise(F.col(value)) if zero_fill else F.col(value)
    return (
        panel.join(c, "source", "left")
        .withColumn(value, F.when(F.col("_a").isNull(), F.col(value)).when(inside, filled))
        .drop("_a", "_b")
    )


def qa_report(cov: DataFrame) -> DataFrame:
    """Coverage and flags as text columns."""
    dash = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise("-")
    return cov.select(
        "source",
        F.concat("raw_first", F.lit("-"), "raw_last").alias("raw_range"),
        F.concat("first_complete", F.lit("-"), "last_complete").alias("complete_range"),
        dash(F.col("dropped_head")).alias("dropped_head"),
        dash(F.col("dropped_tail")).alias("dropped_tail"),
        F.coalesce(F.concat_ws(" ", "flag_week", "flag_action"), F.lit("")).alias("flag"),
    )
