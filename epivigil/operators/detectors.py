"""Control charts and first crossings on dense daily series (at most one row per day and series)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import spread


def _baseline(df: DataFrame, by: Sequence[str], value: str, order: str, baseline: int, min_sd: float, gap: int) -> DataFrame:
    """Mean and population sd of ``baseline`` days ending ``gap`` days earlier; null until that many days exist."""
    w = W.partitionBy(*by).orderBy(order)
    f = w.rowsBetween(-(baseline + gap), -(gap + 1))
    x = F.col(value).cast("double")
    return df.withColumns({"_x": x, "_t": F.row_number().over(w) - 1, "_mu": F.avg(x).over(f), "_sd": F.stddev_pop(x).over(f)}).withColumn(
        "_ready", F.col("_t") >= baseline + gap
    ).withColumn("_sd", F.greatest("_sd", F.lit(float(min_sd))))


def ewma(df: DataFrame, by: Sequence[str], value: str, order: str, lam: float = 0.3, k: float = 3.0, baseline: int = 56,
         min_sd: float = 0.5, gap: int = 7) -> DataFrame:
    """Columns z and alarm: z > mean + k sd of the baseline.

    The smoothed value forgets: a term older than ``reach`` days weighs under 1e-18, below double precision. So a
    fold over the last ``reach`` days equals the recursion from the start.
    """
    reach = math.ceil(math.log(1e-18) / math.log(1 - lam)) if 0 < lam < 1 else 1
    w = W.partitionBy(*by).orderBy(order)
    d = _baseline(spread(df, list(by)), by, value, order, baseline, min_sd, gap)
    d = d.withColumn("_recent", F.collect_list("_x").over(w.rowsBetween(-reach, 0)))
    z = F.aggregate(F.slice("_recent", 2, reach), F.col("_recent")[0], lambda a, x: F.lit(lam) * x + F.lit(1 - lam) * a)
    d = d.withColumn("z", z)
    return d.withColumn("alarm", F.col("_ready") & (F.col("z") > F.col("_mu") + F.lit(float(k)) * F.col("_sd"))).drop(
        "_recent", "_x", "_t", "_mu", "_sd", "_ready"
    )


def cusum(df: DataFrame, by: Sequence[str], value: str, order: str, k: float = 0.5, h: float = 4.0, baseline: int = 56,
          min_sd: float = 0.5, gap: int = 7) -> DataFrame:
    """Columns s and alarm: one-sided CUSUM of standardised counts, back to 0 after an alarm.

    Baselines are window expressions; only the sum with reset runs per series (its days) in a grouped map.
    """
    d = _baseline(spread(df, list(by)), by, value, order, baseline, min_sd, gap)
    d = d.withColumn("_z", F.when(F.col("_ready"), (F.col("_x") - F.col("_mu")) / F.col("_sd") - F.lit(float(k))))
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*by, order, value]) + ", s double, alarm boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        s, out = 0.0, []
        for z in pdf["_z"].to_numpy(dtype=float):
            s = 0.0 if s > h else s
            s = s if np.isnan(z) else max(0.0, s + z)
            out.append(s)
        pdf["s"] = out
        pdf["alarm"] = pdf["s"] > h
        return pdf[[*by, order, value, "s", "alarm"]]

    return d.select(*by, order, value, "_z").groupBy(*by).applyInPandas(run, schema)


def episodes(df: DataFrame, by: Sequence[str] = ("series",), value: str = "s7", thr: str = "thr", order: str = "day", gap: int = 14) -> DataFrame:
    """Rows where the value reaches the threshold with no such day in the ``gap`` days before."""
    w = W.partitionBy(*by).orderBy(order)
    day = F.datediff(order, F.lit("1970-01-01").cast("date"))
    d = df.withColumn("_up", F.col(value) >= F.col(thr))
    before = F.last(F.when(F.col("_up"), day), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("_before", before)
    return d.where(F.col("_up") & (F.col("_before").isNull() | (day - F.col("_before") > gap))).drop("_up", "_before")
