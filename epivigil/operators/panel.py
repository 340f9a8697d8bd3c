"""Weekly panels: aligned national columns, grouped long panels on a full grid, derived indicators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb
from . import calendar as cal


@dataclass(frozen=True)
class Measure:
    """One indicator: which source table, which value column, and an optional row condition (SQL text)."""

    indicator: str
    table: str
    value: str
    source: str
    where: str | None = None


def national_long(tables: Mapping[str, DataFrame], measures: Sequence[Measure]) -> DataFrame:
    """(source, indicator, yw, week_idx, value): each measure summed by week, one pass over each source table.

    Sums are combined on the map side, so the shuffle carries weeks x indicators, never source rows.
    """
    outs = None
    for name in dict.fromkeys(m.table for m in measures):
        ms = [m for m in measures if m.table == name]
        # min_count=1: a week is unobserved (null) for a measure only when no row meets its condition
        aggs = [
            F.sum(F.when(F.expr(m.where), F.col(m.value)) if m.where else F.col(m.value)).cast("double").alias(m.indicator)
            for m in ms
        ]
        g = tables[name].where(lb.is_week_key(F.col("yw"))).groupBy("yw").agg(*aggs)
        src = lb.literal_map({m.indicator: m.source for m in ms})
        long = g.unpivot("yw", [m.indicator for m in ms], "indicator", "value").select(
            src[F.col("indicator")].alias("source"), "indicator", "yw", cal.index_of_yw(F.col("yw")).alias("week_idx"), "value"
        )
        outs = long if outs is None else outs.unionByName(long)
    return outs.where(F.col("value").isNotNull())


def bounds(df: DataFrame, col: str) -> tuple[Column, Column]:
    """(smallest, largest) value of a column, from one scalar subquery."""
    b = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("v")).scalar()
    return b["lo"], b["hi"]


def spine(first: Column, last: Column, spark) -> DataFrame:
    """Weeks first..last (indexes) as rows week_idx, yw, week_start."""
    return (
        spark.range(1)
        .select(F.explode(F.sequence(first, last)).alias("week_idx"))
        .select("week_idx", cal.yw_of_index(F.col("week_idx")).alias("yw"), cal.start_of_index(F.col("week_idx")).alias("week_start"))
    )


def wide(long: DataFrame, indicators: Sequence[str]) -> DataFrame:
    """Long -> one row per week of the full range, one column per indicator (listed, so no extra job finds them)."""
    lo, hi = bounds(long, "week_idx")
    w = long.groupBy("week_idx").pivot("indicator", list(indicators)).agg(F.first("value", ignorenulls=True))
    return spine(lo, hi, long.sparkSession).join(w, "week_idx", "left")


def add_ratios(nat: DataFrame, ratios: Mapping[str, tuple[str, str, float]]) -> DataFrame:
    """name -> (numerator, denominator, scale), both SQL text over panel columns; null where the denominator is 0."""
    return nat.withColumns({k: lb.ratio(F.expr(a), F.expr(b), s) for k, (a, b, s) in ratios.items()})


def composite(nat: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    """Sums and differences of columns; null when a part is unobserved."""
    return nat.withColumns({k: F.expr(e) for k, e in exprs.items()})


def primary_indicator(nat: DataFrame, preferred: str, fallback: str, more_than: int = 10) -> DataFrame:
    """Column ``primary``: the preferred indicator when it has more than ``more_than`` observed weeks, else the fallback."""
    n = nat.agg(F.count(preferred).alias("n")).scalar()
    return nat.withColumns(
        {
            "primary": F.when(n > more_than, F.col(preferred)).otherwise(F.col(fallback)),
            "primary_name": F.when(n > more_than, F.lit(preferred)).otherwise(F.lit(fallback)),
        }
    )


def null_before_first_positive(df: DataFrame, col: str, by: Sequence[str] = (), idx: str = "week_idx") -> DataFrame:
    """A new definition starts with its first nonzero week; earlier zeros are no observations."""
    first = df.where(F.col(col) > 0).groupBy(*by).agg(F.min(idx).alias("_first"))
    if by:
        return df.join(first, list(by), "left").withColumn(
            col, F.when(F.col(idx) >= F.col("_first"), F.col(col))
        ).drop("_first")
    return df.withColumn(col, F.when(F.col(idx) >= first.select("_first").scalar(), F.col(col)))


def trim_placeholder_tail(df: DataFrame, filled: Column, order: str = "yw") -> DataFrame:
    """Rows up to the last week meeting ``filled`` (a site reports 0 for weeks not yet filed); none met -> no rows."""
    last = df.where(filled).agg(F.max(order).alias("v")).scalar()
    return df.where(F.col(order) <= last)


def grouped_panel(
    tables: Mapping[str, DataFrame], measures: Sequence[Measure], by: str, cov: DataFrame, keep: DataFrame | None = None
) -> DataFrame:
    """(yw, week_idx, by, indicator, value) on the full grid week x group inside each source's complete range; missing = 0.

    ``keep``: one column of allowed groups, all present groups without it. The grid is spread by ``sequence``.
    """
    sums = None
    for name in dict.fromkeys(m.table for m in measures):
        ms = [m for m in measures if m.table == name]
        aggs = [
            F.sum(F.when(F.expr(m.where), F.col(m.value)) if m.where else F.col(m.value)).cast("double").alias(m.indicator)
            for m in ms
        ]
        g = tables[name].where(lb.is_week_key(F.col("yw"))).groupBy("yw", by).agg(*aggs)
        g = g.unpivot(["yw", by], [m.indicator for m in ms], "indicator", "value").where(F.col("value").isNotNull())
        sums = g if sums is None else sums.unionByName(g)
    if keep is not None:
        sums = lb.keep_groups(sums, by, keep)
        grid_groups = keep.select(F.col(keep.columns[0]).alias(by)).distinct()
    else:
        grid_groups = sums.select(by).distinct()
    spans = cov.select("source", "first_idx", "last_idx").where("first_idx <= last_idx")
    pairs = tables[measures[0].table].sparkSession.createDataFrame(
        [(m.indicator, m.source) for m in measures], "indicator string, source string"
    )
    # indicators and their ranges are a handful of rows; they travel as one array literal column, not as a cross join
    ranges = (
        pairs.join(spans, "source")
        .agg(F.collect_list(F.struct("indicator", "source", "first_idx", "last_idx")).alias("r"))
        .scalar()
    )
    grid = (
        grid_groups.withColumn("_r", F.explode(ranges))
        .select(by, F.col("_r.indicator").alias("indicator"), F.explode(F.sequence("_r.first_idx", "_r.last_idx")).alias("week_idx"))
        .withColumn("yw", cal.yw_of_index(F.col("week_idx")))
    )
    return grid.join(sums, ["yw", by, "indicator"], "left").select(
        "yw", "week_idx", by, "indicator", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def collapse_groups(
    df: DataFrame, group: str, mapping: Mapping[str, str], value: str, prefix: str, targets: Sequence[str], other: str = "other"
) -> DataFrame:
    """Groups mapped to a few and pivoted wide: one row per week, columns prefix+target."""
    g = F.coalesce(F.try_element_at(lb.literal_map(mapping), F.col(group)), F.lit(other))
    p = df.withColumn("_g", g).groupBy("yw").pivot("_g", list(targets)).agg(F.sum(value))
    return p.select("yw", *[F.col(f"`{t}`").alias(f"{prefix}{t}") for t in targets])


def pivot_kind(df: DataFrame, keys: Sequence[str], kind: str, value: str, kinds: Mapping[str, str]) -> DataFrame:
    """Wide by kind; the first observed value of a cell counts. ``kinds``: kind -> column name."""
    p = df.groupBy(*keys).pivot(kind, list(kinds)).agg(F.first(value, ignorenulls=True))
    return p.select(*keys, *[F.col(f"`{k}`").alias(v) for k, v in kinds.items()])


def yearly_summary(nat: DataFrame, totals: Sequence[str], rates: Sequence[str]) -> DataFrame:
    """Per year: sums (null when nothing was observed) and mean rates to two digits."""
    return (
        nat.groupBy(F.substring("yw", 1, 4).alias("year"))
        .agg(*[F.sum(c).alias(c) for c in totals], *[F.round(F.avg(c), 2).alias(c) for c in rates])
    )


def reconcile(nat: DataFrame, official: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Official figures (yw, official) against panel columns: percent difference to one digit per week."""
    j = official.join(nat.select("yw", *columns), "yw").where(F.col(columns[0]).isNotNull())
    return j.withColumns(
        {f"diff_{c}_pct": F.round(F.lit(100.0) * (F.col(c) - F.col("official")) / F.col("official"), 1) for c in columns}
    )


def reconcile_summary(rows: DataFrame, column: str) -> DataFrame:
    d = f"diff_{column}_pct"
    return rows.agg(
        F.count(d).alias("n"), F.round(F.avg(d), 1).alias("mean_diff_pct"), F.min(d).alias("min_diff_pct"), F.max(d).alias("max_diff_pct")
    )


def truncate_to_common(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Series of one set cut to the weeks all of them have: latest first week, earliest last week."""
    obs = long.where(F.col("value").isNotNull())
    ends = obs.groupBy(*by, "indicator").agg(F.min("week_idx").alias("_a"), F.max("week_idx").alias("_b"))
    common = ends.groupBy(*by).agg(F.max("_a").alias("_lo"), F.min("_b").alias("_hi"))
    if by:
        return obs.join(common, list(by)).where(F.col("week_idx").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    lo, hi = common.select("_lo").scalar(), common.select("_hi").scalar()
    return obs.where(F.col("week_idx").between(lo, hi))
