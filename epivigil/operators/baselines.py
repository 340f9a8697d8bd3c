"""Rolling-origin baselines with empirical-error deciles.

Every row of a series is an origin (its last observed step). The errors an origin may use are a frame of rows before
it, so one sort per series serves all origins, horizons and models; no origin is joined to its history. Points and errors
are window expressions. The deciles of the moving frame come from one sorted list per series that gains and loses a value
per step (Arrow batches); the built-in percentile would count and sort the whole frame again for every row. A partition
holds one series, at most one row per step of its calendar. Missing steps are the caller's error (``require_complete``).
"""

from __future__ import annotations

from collections.abc import Sequence
from bisect import bisect_left, insort
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import LEVELS, QCOLS
from ..session import spread

_ARR = "array(" + ",".join(f"{x}D" for x in LEVELS) + ")"


def require_complete(df: DataFrame, by: Sequence[str], idx: str, value: str) -> DataFrame:
    """The same rows; the plan raises, naming the series, when steps are missing or null between its first and last."""
    w = W.partitionBy(*by)
    gaps = F.max(idx).over(w) - F.min(idx).over(w) + 1 - F.count(value).over(w)
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in by]) if by else F.lit("series")
    d = df.withColumn("_gaps", gaps)
    ok = F.when(F.col("_gaps") == 0, True).otherwise(
        F.raise_error(F.concat(F.lit("missing steps in "), name, F.lit(": "), F.col("_gaps").cast("string"))).cast("boolean")
    )
    return d.where(ok).drop("_gaps")


def _start(window: int | None, lead_rows: int) -> int | None:
    """Frame start for an expanding or a sliding context whose first ``lead_rows`` rows carry no error."""
    return None if window is None else -(window - 1 - lead_rows)


def deciles(point: Column, err: Column, positive: bool = True, center: bool = True) -> Column:
    """Point + error deciles, shifted so that the median error is 0, not below 0.

    Nine decimals are kept, as doubles of any size: an actual that equals a bound then compares equal whatever the order of the
    additions.
    """
    mid = err[4] if center else F.lit(0.0)
    q = F.transform(err, lambda e: F.round(point + e - mid, 9))
    return F.transform(q, lambda x: F.greatest(x, F.lit(0.0))) if positive else q


def error_deciles(df: DataFrame, by: Sequence[str], err: str = "err", out: str = "eq") -> DataFrame:
    """Linear-interpolated deciles of each group's errors. A group is one context, so its size is bounded by it."""
    return df.groupBy(*by).agg(F.expr(f"percentile({err}, {_ARR})").alias(out))


def frame_deciles(x: np.ndarray, first: int | None, last: int, want: np.ndarray) -> list:
    """Deciles of x[r+first .. r+last] (from the start when ``first`` is None) for every wanted row r; NaN is left out."""
    out, held, added, dropped = [None] * len(x), [], 0, 0
    for r in range(len(x)):
        while added <= min(r + last, len(x) - 1):
            if x[added] == x[added]:
                insort(held, x[added])
            added += 1
        if first is not None:
            while dropped < min(r + first, added):
                if x[dropped] == x[dropped]:
                    del held[bisect_left(held, x[dropped])]
                dropped += 1
        if want[r] and held:
            top = len(held) - 1
            row = []
            for level in LEVELS:
                pos = top * level
                i = int(pos)
                a = held[i]
                row.append(a + (held[i + 1] - a) * (pos - i) if i < top else a)
            out[r] = row
    return out


def _frame_columns(df: DataFrame, by: Sequence[str], idx: str, frames: dict[str, tuple[str, int | None, int]], want: str) -> DataFrame:
    """Adds one array<double> column per entry name -> (error column, first, last)."""
    schema = T.StructType(list(df.schema.fields))
    for name in frames:
        schema = schema.add(name, T.ArrayType(T.DoubleType()))
    used = {c for c, _, _ in frames.values()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        flags = pdf[want].fillna(False).to_numpy(dtype=bool)
        values = {c: pdf[c].to_numpy(dtype=float) for c in used}
        for name, (col, first, last) in frames.items():
            pdf[name] = pd.Series(frame_deciles(values[col], first, last, flags), index=pdf.index, dtype=object)
        return pdf[flags]

    return df.groupBy(*by).applyInPandas(run, schema)


def ma_weights(window: int, horizon: int) -> list[list[float]]:
    """Weight of each of the last ``window`` values (oldest first) in the h-step recursive mean, h = 1..horizon."""
    rows = [[1.0 if i == j else 0.0 for j in range(window)] for i in range(window)]
    for _ in range(horizon):
        tail = rows[-window:]
        rows.append([sum(r[j] for r in tail) / window for j in range(window)])
    return rows[window:]


def forecasts(
    df: DataFrame, by: Sequence[str], idx: str, value: str, models: Sequence[str] = ("naive", "snaive", "ma3"),
    horizon: int = 4, hs: Sequence[int] | None = None, season: int = 52, window: int | None = None, warmup: int = 104,
    positive: bool = True, keep: Column | None = None, with_truth: bool = True,
) -> DataFrame:
    """Long forecasts (by, model, origin idx, h, y, y_origin, mase_scale, context_len, median, q10..q90).

    Origins are the rows with at least ``warmup`` observed steps (and the model's own minimum) and, when truth is
    wanted, ``horizon`` steps after them. ``window`` None = expanding context, else the number of steps kept.
    ``keep`` restricts the origins (a condition on the input columns). ``hs`` picks horizons.
    """
    hs = list(hs) if hs else list(range(1, horizon + 1))
    w = W.partitionBy(*by).orderBy(idx)
    x = F.col(value).cast("double")
    d = spread(df, by).withColumn("_x", x).withColumns({"_n": F.row_number().over(w), "_future": F.lead("_x", horizon).over(w)})
    d = d.withColumn("_len", F.col("_n") if window is None else F.least(F.col("_n"), F.lit(window)))
    cols: dict[str, Column] = {f"_y{h}": F.lead("_x", h).over(w) for h in hs}
    if "snaive" in models or with_truth:
        cols["_es"] = F.col("_x") - F.lag("_x", season).over(w)
    ma = next((int(m[2:]) for m in models if m.startswith("ma")), None)
    if ma:
        for j in range(1, ma):
            cols[f"_l{j}"] = F.lag("_x", j).over(w)
    d = d.withColumns(cols)
    d = d.withColumn("_scale", F.avg(F.abs(F.col("_es"))).over(w.rowsBetween(W.unboundedPreceding, 0)) if "_es" in cols else F.lit(None).cast("double"))
    point: dict[tuple[str, int], Column] = {}
    err: dict[str, Column] = {}
    for m in models:
        if m == "naive":
            for h in hs:
                err[f"_e_naive_{h}"] = F.col(f"_y{h}") - F.col("_x")
                point[m, h] = F.col("_x")
        elif m == "snaive":
            for h in hs:
                back = season - h if h <= season else 2 * season - h
                point[m, h] = F.lag("_x", back).over(w) if back else F.col("_x")
        elif m.startswith("ma"):
            weights = ma_weights(ma, max(hs))
            lags = [F.col(f"_l{j}") for j in range(ma - 1, 0, -1)] + [F.col("_x")]
            for h in hs:
                point[m, h] = reduce(add, [F.lit(a) * c for a, c in zip(weights[h - 1], lags)])
                err[f"_e_{m}_{h}"] = F.col(f"_y{h}") - point[m, h]
        else:
            raise ValueError(f"unknown baseline {m}")
    d = d.withColumns({**err, **{f"_p_{m}_{h}": c for (m, h), c in point.items()}})
    frames: dict[str, tuple[str, int | None, int]] = {}
    for m in models:
        if m == "snaive":
            frames["_q_snaive"] = ("_es", _start(window, season), 0)
            continue
        skip = 0 if m == "naive" else ma - 1
        for h in hs:
            frames[f"_q_{m}_{h}"] = (f"_e_{m}_{h}", _start(window, skip), -horizon)
    need = {"naive": horizon + 1, "snaive": season + 8}
    ok = F.col("_n") >= warmup
    if with_truth:
        ok = ok & F.col("_future").isNotNull()
    if keep is not None:
        ok = ok & keep
    d = d.withColumn("_ok", ok).select(
        *by, idx, "_x", "_scale", "_len", "_ok", *[f"_y{h}" for h in hs], *[f"_p_{m}_{h}" for m, h in point], *sorted({c for c, _, _ in frames.values()})
    )
    d = _frame_columns(d, by, idx, frames, "_ok")
    rows = []
    for m in models:
        least = need.get(m, (ma or 0) + horizon + 8)
        for h in hs:
            eq = F.col("_q_snaive") if m == "snaive" else F.col(f"_q_{m}_{h}")
            rows.append(
                F.when(
                    F.col("_len") >= least,
                    F.struct(
                        F.lit(m).alias("model"), F.lit(h).alias("h"), F.col(f"_y{h}").alias("y"),
                        deciles(F.col(f"_p_{m}_{h}"), eq, positive).alias("q"),
                    ),
                )
            )
    return (
        d.withColumn("_r", F.explode(F.array(*rows)))
        .where(F.col("_r").isNotNull())
        .select(
            *by,
            F.col("_r.model").alias("model"),
            F.col(idx).alias("origin"),
            F.col("_r.h").alias("h"),
            F.col("_r.y").alias("y"),
            F.col("_x").alias("y_origin"),
            F.col("_scale").alias("mase_scale"),
            F.col("_len").alias("context_len"),
            F.col("_r.q")[4].alias("median"),
            *[F.col("_r.q")[i].alias(c) for i, c in enumerate(QCOLS)],
        )
    )


def live_forecasts(df: DataFrame, by: Sequence[str], idx: str, value: str, **kw) -> DataFrame:
    """Forecasts from the last observed step of each series only."""
    obs = df.where(F.col(value).isNotNull())
    last = obs.withColumn("_last", F.max(idx).over(W.partitionBy(*by)) == F.col(idx))
    return forecasts(last, by, idx, value, keep=F.col("_last"), with_truth=False, **{"warmup": 0, **kw})


def mase_scale(df: DataFrame, by: Sequence[str], idx: str, value: str, season: int = 52) -> DataFrame:
    """Running mean |x - x[season back]| up to and including each row; null for the first ``season`` rows."""
    w = W.partitionBy(*by).orderBy(idx)
    d = df.withColumn("_d", F.abs(F.col(value) - F.lag(value, season).over(w)))
    return d.withColumn("mase_scale", F.avg("_d").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_d")
