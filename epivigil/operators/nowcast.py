"""Counts a system would have seen at an origin: final, as known, completeness-adjusted, Gamma-Poisson nowcast.

Every mode answers rows (origin, series, onset, k, n) for the last ``back`` onset days; zero rows are included where a
mode can turn a zero into something else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import linelist as ll

_MODE = re.compile(r"^(?:(final|asof|asof_adj)|asof_nc(r?)(\d+(?:[.]\d+)?)(x2)?)$")


@dataclass(frozen=True)
class Mode:
    """Parsed context mode."""

    kind: str
    beta: float = 7.0
    passes: int = 1
    report_triggered: bool = False


def parse_mode(text: str) -> Mode:
    """final | asof | asof_adj | asof_nc<beta>[x2] | asof_ncr<beta>[x2]."""
    m = _MODE.match(text)
    if not m:
        raise ValueError(f"unknown mode {text}")
    if m.group(1):
        return Mode(m.group(1))
    return Mode("nowcast", float(m.group(3)), 2 if m.group(4) else 1, bool(m.group(2)))


def dense_known(hist: DataFrame, origins: DataFrame, back: int, start=None) -> DataFrame:
    """Known counts with zeros: every series and origin on its last ``back`` onset days (none before ``start``)."""
    grid = _series_by_origin(hist, origins)
    grid = grid.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(back - 1)))).withColumn("onset", F.date_sub("origin", F.col("k")))
    if start is not None:
        grid = grid.where(F.col("onset") >= start)
    known = ll.known_counts(hist, origins, back).drop("k")
    return grid.join(known, ["origin", "series", "onset"], "left").select(
        "origin", "series", "onset", "k", F.coalesce("n", F.lit(0)).alias("n")
    )


def _series_by_origin(hist: DataFrame, origins: DataFrame) -> DataFrame:
    """Every series at every origin: the origins (days of a calendar) travel as one array and are exploded."""
    arr = origins.agg(F.array_sort(F.collect_set("origin")).alias("v")).scalar()
    return hist.select("series").distinct().withColumn("origin", F.explode(arr))


def gamma_poisson(
    known: DataFrame, comp: DataFrame, beta: float = 7.0, prior_lags: tuple[int, int] = (8, 35), floor: float = 0.0,
    passes: int = 1, report_triggered: bool = False, dmax: int = ll.DMAX,
) -> DataFrame:
    """E[N | r] = r + (a + r)(1 - c_k) / (beta + c_k) with a = beta x level.

    ``known`` must hold every onset day 0..max(prior_lags) back (zeros included). The level is the mean of r/c over lags
    prior_lags; a second pass takes it from the first result at lags 2..prior_lags[1]-1. With ``report_triggered`` days
    with nothing reported stay 0.
    """
    c = comp.select("origin", F.col("k").alias("_k"), F.col("share").alias("_c"))
    d = known.withColumn("_k", F.least("k", F.lit(dmax))).join(c, ["origin", "_k"], "left").withColumn("_c", F.coalesce("_c", F.lit(1.0)))
    d = d.withColumn("_r", F.col("n").cast("double")).withColumn("_out", F.col("_r"))
    # an (origin, series) partition holds the few onset days of the window
    w = W.partitionBy("origin", "series")
    for p in range(passes):
        src, lo, hi = (F.col("_r") / F.col("_c"), *prior_lags) if p == 0 else (F.col("_out"), 2, prior_lags[1] - 1)
        level = F.coalesce(F.avg(F.when(F.col("k").between(lo, hi), src)).over(w), F.lit(0.0))
        d = d.withColumn("_lam", F.greatest(level, F.lit(floor)))
        add = (F.lit(beta) * F.col("_lam") + F.col("_r")) * (1 - F.col("_c")) / (F.lit(beta) + F.col("_c"))
        if report_triggered:
            add = F.when(F.col("_r") >= 1, add).otherwise(0.0)
        d = d.withColumn("_out", F.when(F.col("k") <= dmax, F.col("_r") + add).otherwise(F.col("_r")))
    return d.select("origin", "series", "onset", "k", F.col("_out").alias("n"))


def context_counts(hist: DataFrame, origins: DataFrame, mode: str, back: int, dmax: int = ll.DMAX, start=None) -> DataFrame:
    """The plan for one context mode: (origin, series, onset, k, n) on the last ``back`` onset days."""
    m = parse_mode(mode)
    if m.kind == "final":
        as_final = hist.groupBy("series", "onset").agg(F.sum("n").alias("n")).withColumn("delay", F.lit(0))
        return dense_known(as_final, origins, back, start).withColumn("n", F.col("n").cast("double"))
    if m.kind == "asof":
        return dense_known(hist, origins, back, start).withColumn("n", F.col("n").cast("double"))
    comp = ll.completeness(hist, origins, dmax=dmax)
    if m.kind == "asof_adj":
        return ll.adjusted_counts(dense_known(hist, origins, back, start), comp, dmax)
    known = dense_known(hist, origins, max(back, 36), start)
    out = gamma_poisson(known, comp, m.beta, passes=m.passes, report_triggered=m.report_triggered, dmax=dmax)
    return out.where(F.col("k") < back)


def window_sums(context: DataFrame, length: int, out: str) -> DataFrame:
    """Sum of the last ``length`` onset days per (origin, series)."""
    return context.where(F.col("k") < length).groupBy("origin", "series").agg(F.sum("n").alias(out))


def context_thresholds(context: DataFrame, weeks: int = 3, factor: float = 2.0, floor: float = 3.0) -> DataFrame:
    """(origin, series, s7, thr) from the counts seen at the origin."""
    return context.where(F.col("k") < 7 * weeks).groupBy("origin", "series").agg(
        F.sum(F.when(F.col("k") < 7, F.col("n")).otherwise(0.0)).alias("s7"),
        F.greatest(F.lit(factor / weeks) * F.sum("n"), F.lit(float(floor))).alias("thr"),
    )
