"""Epidemic periods, threshold lookup, horizon outlook and situation metrics.

Series are weekly, at most one row per week of the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import quantiles as qx


def yearly_thresholds(weeks: DataFrame, table: DataFrame, year: Column, carry: bool = True, out: str = "thr") -> DataFrame:
    """Threshold of the week's year; a year not in the table takes the latest year's (also null where that is null)."""
    t = table.select(F.col("year").cast("int").alias("_y"), F.col("threshold").cast("double").alias("_t"), F.lit(True).alias("_has"))
    j = weeks.withColumn("_y", year.cast("int")).join(t, "_y", "left")
    if not carry:
        return j.withColumn(out, F.col("_t")).drop("_y", "_t", "_has")
    latest = t.agg(F.max_by("_t", "_y").alias("v")).scalar()
    return j.withColumn(out, F.when(F.col("_has"), F.col("_t")).otherwise(latest)).drop("_y", "_t", "_has")


def fixed_threshold_flags(df: DataFrame, by: Sequence[str], value: str, thr: str, order: str, leave_after: int = 2) -> DataFrame:
    """in_period, entered, exited: in at value >= thr, out with the ``leave_after``-th week below in a row.

    Equivalent without state: in the period when any of the last ``leave_after`` observed weeks is at the threshold.
    """
    w = W.partitionBy(*by).orderBy(order)
    d = df.where(F.col(value).isNotNull())
    inside = F.max(F.col(value) >= F.col(thr)).over(w.rowsBetween(-(leave_after - 1), 0))
    d = d.withColumn("in_period", F.coalesce(inside, F.lit(False)))
    before = F.lag("in_period", 1, False).over(w)
    return d.withColumns({"entered": F.col("in_period") & ~before, "exited": ~F.col("in_period") & before})


WAVE_SCHEMA = "level double, trough double, peak double, rises int, falls int, in_period boolean, entered boolean, exited boolean"


class Wave:
    """Trough/peak rule as explicit state, shared by the batch and the streaming form.

    In after ``rise`` rises in a row at ``up`` x the trough or more; out after ``fall`` falls in a row below ``down`` x
    the peak. A new peak starts at entry, a new trough at exit.
    """

    def __init__(self, rise: int = 3, up: float = 2.0, fall: int = 2, down: float = 0.5):
        self.rise, self.up, self.fall, self.down = rise, up, fall, down
        self.start()

    def start(self):
        self.inside, self.low, self.high, self.runs, self.prev = False, None, None, [0, 0], None

    def state(self) -> tuple:
        return (self.inside, self.low, self.high, self.runs[0], self.runs[1], self.prev)

    def restore(self, s: tuple):
        self.inside, self.low, self.high, self.prev = bool(s[0]), s[1], s[2], s[5]
        self.runs = [int(s[3]), int(s[4])]

    def step(self, v: float) -> tuple:
        if self.prev is None:
            self.low = self.high = v
        else:
            up, down = v > self.prev, v < self.prev
            self.runs = [self.runs[0] + 1 if up else 0, self.runs[1] + 1 if down else 0]
        self.prev = v
        was = self.inside
        if was:
            self.high = max(self.high, v)
            if self.runs[1] >= self.fall and v < self.down * self.high:
                self.inside, self.low = False, v
        else:
            self.low = min(self.low, v)
            if self.runs[0] >= self.rise and v >= self.up * self.low:
                self.inside, self.high = True, v
        level = self.down * self.high if self.inside else self.up * self.low
        return (level, self.low, self.high, *self.runs, self.inside, self.inside and not was, was and not self.inside)


def wave_flags(df: DataFrame, by: Sequence[str], value: str, order: str, **rule) -> DataFrame:
    """Trough/peak flags per series. Each step depends on the last, so a series (its weeks) is one group."""
    key_types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {key_types[c]}" for c in [*by, order]) + f", `{value}` double, " + WAVE_SCHEMA
    names = [c.split()[0] for c in WAVE_SCHEMA.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        wave = Wave(**rule)
        flags = pd.DataFrame([wave.step(float(v)) for v in pdf[value]], columns=names, index=pdf.index)
        return pd.concat([pdf[[*by, order, value]], flags], axis=1)

    d = df.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias(value))
    return d.groupBy(*by).applyInPandas(run, schema)


def periods(flags: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """(by, entry, last in-period week or null while open): islands numbered by the running count of entries."""
    w = W.partitionBy(*by).orderBy(order)
    d = flags.withColumns({"_no": F.sum(F.col("entered").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)), "_prev": F.lag(order).over(w)})
    return d.where(F.col("_no") > 0).groupBy(*by, "_no").agg(
        F.min(F.when(F.col("entered"), F.col(order))).alias("entry"),
        F.min(F.when(F.col("exited"), F.col("_prev"))).alias("last_in_period"),
    ).drop("_no")


def outlook(forecasts: DataFrame, by: Sequence[str], thr: str, last_observed: str, week: str, cap: float = 0.05, ties: str = "first") -> DataFrame:
    """One row per forecast path: event, p, p_indep, by_h, first_week. A path is its few horizons, collected in order."""
    p = qx.prob_ge(qx.qcols(), F.col(thr), cap, ties)
    g = forecasts.withColumn("_p", p).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("h", F.col("_p").alias("p"), F.col(week).alias("w")))).alias("_path"),
        F.first(thr).alias("threshold"),
        F.first(last_observed).alias("last_observed"),
    )
    above = F.col("last_observed") >= F.col("threshold")
    ps = F.col("_path.p")
    pr = qx.path_probability(ps, above)
    hit = F.filter("_path", lambda x: F.when(above, x["p"] < 0.5).otherwise(x["p"] >= 0.5))
    return g.select(
        *by, "threshold", above.alias("above_now"), pr["event"].alias("event"), F.round(pr["p"], 3).alias("p"),
        F.round(pr["p_indep"], 3).alias("p_indep"), F.transform(ps, lambda x: F.round(x, 3)).alias("by_h"),
        F.try_element_at(hit, F.lit(1))["w"].alias("first_week"),
    )


def streak(df: DataFrame, by: Sequence[str], order: str, condition: Column, out: str = "streak") -> DataFrame:
    """Number of last rows in a row meeting the condition: (by, out)."""
    w = W.partitionBy(*by).orderBy(order)
    d = df.withColumns({"_rn": F.row_number().over(w), "_ok": F.coalesce(condition, F.lit(False))})
    return d.groupBy(*by).agg((F.max("_rn") - F.coalesce(F.max(F.when(~F.col("_ok"), F.col("_rn"))), F.lit(0))).alias(out))


def situation(df: DataFrame, by: Sequence[str], value: str, idx: str = "week_idx", yw: str = "yw", years_back: int = 3,
              since: str | None = None) -> DataFrame:
    """The newest observed week of each series in context: (by, yw, value, wow_pct, w3_pct, rising, falling, same_week_mean,
    pct_rank, last4, prev4, change4_pct)."""
    w = W.partitionBy(*by).orderBy(idx)
    obs = df.where(F.col(value).isNotNull())
    d = obs.withColumns(
        {
            "_n": F.row_number().over(w),
            "_last": F.max(idx).over(W.partitionBy(*by)),
            "_p1": F.lag(value, 1).over(w),
            "_p3": F.lag(value, 3).over(w),
            "_cur": F.last(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
            "_cyw": F.last(yw).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
            "_a4": F.avg(value).over(w.rowsBetween(-3, 0)),
            "_b4": F.avg(value).over(w.rowsBetween(-7, -4)),
        }
    )
    d = d.withColumns({"_up": F.col(value) > F.col("_p1"), "_down": F.col(value) < F.col("_p1")})
    year, cyear = F.substring(yw, 1, 4).cast("int"), F.substring("_cyw", 1, 4).cast("int")
    same = (F.substring(yw, 5, 2) == F.substring("_cyw", 5, 2)) & year.between(cyear - years_back, cyear - 1)
    hist = F.lit(True) if since is None else F.col(yw) >= since
    newest = F.col(idx) == F.col("_last")

    def at(c: str) -> Column:
        return F.max(F.when(newest, F.col(c)))

    def run(c: str) -> Column:
        return F.max("_n") - F.coalesce(F.max(F.when(~F.coalesce(F.col(c), F.lit(False)), F.col("_n"))), F.lit(0))

    pct = lambda a, b: F.lit(100.0) * (a / F.nullif(b, F.lit(0.0)) - 1)
    v, p1, p3, a4, b4 = at(value), at("_p1"), at("_p3"), at("_a4"), at("_b4")
    return d.groupBy(*by).agg(
        F.max("_cyw").alias("yw"), v.alias("value"), pct(v, p1).alias("wow_pct"), pct(v, p3).alias("w3_pct"),
        run("_up").alias("rising"), run("_down").alias("falling"),
        F.avg(F.when(same, F.col(value))).alias("same_week_mean"),
        (100 * F.avg(F.when(hist, (F.col(value) < F.col("_cur")).cast("int")))).alias("pct_rank"),
        a4.alias("last4"), b4.alias("prev4"), F.when(b4 > 0, pct(a4, b4)).otherwise(0.0).alias("change4_pct"),
    )


def trend_source(sit_count: DataFrame, sit_rate: DataFrame, special: DataFrame, by: Sequence[str]) -> DataFrame:
    """Week-over-week change of the count, or of the rate when the newest week or the one before has holidays.

    ``special``: yw, holiday_days, previous_days.
    """
    r = sit_rate.select(*by, F.col("wow_pct").alias("_r"))
    s = special.select("yw", "holiday_days", "previous_days")
    use_rate = (F.coalesce("holiday_days", F.lit(0.0)) > 0) | (F.coalesce("previous_days", F.lit(0.0)) > 0)
    return sit_count.join(r, list(by)).join(s, "yw", "left").withColumns(
        {"trend_from": F.when(use_rate, "rate").otherwise("count"), "trend_pct": F.when(use_rate, F.col("_r")).otherwise(F.col("wow_pct"))}
    ).drop("_r", "holiday_days", "previous_days")


def interval_width(forecasts: DataFrame) -> DataFrame:
    """Width of the 80 % interval in percent of the median."""
    return forecasts.withColumn("width_pct", F.lit(100.0) * (F.col("q90") - F.col("q10")) / F.nullif(F.col("median"), F.lit(0.0)))


def composition(df: DataFrame, group: str, value: str, selected: Sequence[str], yw: str = "yw", idx: str = "week_idx",
                by: Sequence[str] = (), weeks: int = 4) -> DataFrame:
    """Newest week: share of each group, change against ``weeks`` before (that value at least 1), share of ``selected``."""
    w = W.partitionBy(*by, group).orderBy(idx)
    d = df.withColumn("_before", F.lag(value, weeks).over(w))
    last = d.groupBy(*by).agg(F.max(idx).alias(idx))
    if by:
        d = d.join(last, [*by, idx])
    else:
        d = d.where(F.col(idx) == last.select(idx).scalar())
    tot = F.sum(value).over(W.partitionBy(*by, yw))
    sel = F.sum(F.when(F.col(group).isin(*selected), F.col(value)).otherwise(0)).over(W.partitionBy(*by, yw))
    return d.select(
        *by, yw, group, value,
        (F.lit(100.0) * F.col(value) / F.nullif(tot, F.lit(0.0))).alias("share_pct"),
        (F.lit(100.0) * (F.col(value) / F.greatest(F.coalesce("_before", F.lit(1.0)), F.lit(1.0)) - 1)).alias("change_pct"),
        (F.lit(100.0) * sel / F.nullif(tot, F.lit(0.0))).alias("selected_pct"),
    )


def latest_payload(history: DataFrame, forecasts: DataFrame, by: Sequence[str], value: str, n: int = 130, idx: str = "week_idx",
                   yw: str = "yw", digits: int = 3) -> DataFrame:
    """Per series one JSON text: the last n observations and the forecast rows with the realised value where known."""
    w = W.partitionBy(*by).orderBy(F.desc(idx))
    obs = history.where(F.col(value).isNotNull())
    h = obs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    hist = h.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(yw).alias("yw"), F.round(value, digits).alias("y")))).alias("history"),
        F.max(idx).alias("_last"), F.max_by(value, idx).alias("last_observed"),
    )
    actual = obs.select(*by, F.col(yw).alias("target_yw"), F.round(value, digits).alias("observed"))
    f = forecasts.join(actual, [*by, "target_yw"], "left").groupBy(*by).agg(
        F.array_sort(
            F.collect_list(F.struct("h", F.col("target_yw").alias("yw"), *[F.round(c, digits).alias(c) for c in ("median", *qx.QCOLS)], "observed"))
        ).alias("forecast")
    )
    return hist.join(f, list(by), "left").select(
        *by, "last_observed", F.size("history").alias("n_history"),
        F.to_json(F.struct("history", "forecast")).alias("payload"),
    )
