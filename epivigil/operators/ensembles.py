"""Combining forecasts: quantile mean, probability mean, co-directional sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import QCOLS


def quantile_mean(df: DataFrame, members: Sequence[str], keys: Sequence[str], name: str | None = None, qcols: Sequence[str] = QCOLS) -> DataFrame:
    """Mean per quantile over the members; only keys every member has."""
    g = df.where(F.col("model").isin(*members)).groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in qcols], F.countDistinct("model").alias("_n")
    )
    return g.where(F.col("_n") == len(set(members))).drop("_n").withColumn("model", F.lit(name or "ens_" + "_".join(members)))


def probability_mean(df: DataFrame, base: str, other: str, keys: Sequence[str] = ("mode", "series", "origin"), name: str | None = None) -> DataFrame:
    """Rows of ``base`` with prob = mean of both models; null where the other model has no row."""
    o = df.where(F.col("model") == other).select(*keys, F.col("prob").alias("_p"))
    b = df.where(F.col("model") == base).join(o, list(keys), "left")
    return b.withColumn("prob", (F.col("prob") + F.col("_p")) / 2).withColumn("model", F.lit(name or f"ensp_{base}_{other}")).drop("_p")


def add_sum(df: DataFrame, a: str, b: str, out: str, mode: str, keys: Sequence[str] = ("origin_yw", "target_yw", "h"), qcols: Sequence[str] = QCOLS) -> DataFrame:
    """Appends target ``out`` = a + b where origin and target week agree: medians add, quantiles add level by level."""
    nums = ["median", *qcols]
    right = df.where((F.col("target") == b) & (F.col("mode") == mode)).select(*keys, *[F.col(c).alias(f"_{c}") for c in nums])
    s = (
        df.where((F.col("target") == a) & (F.col("mode") == mode)).join(right, list(keys))
        .withColumns({c: F.col(c) + F.col(f"_{c}") for c in nums})
        .withColumns({"target": F.lit(out), "mode": F.lit(f"{mode}_sum")})
        .drop(*[f"_{c}" for c in nums])
    )
    return df.unionByName(s, allowMissingColumns=True)
