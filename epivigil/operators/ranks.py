"""Running totals, exact quantiles, AUC and nearest knots over groups of any size.

One group may hold most of the rows, so no step sorts a whole group in one task. Equal values are counted first
(combined on the map side). The distinct values are cut into buckets at approximate quantiles; totals of the buckets
are few, and only the values inside one bucket are ordered together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 64


def add_bucket(df: DataFrame, by: Sequence[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """Column _b: position of ``value`` among approximate quantiles of its group; order is kept, ties stay together."""
    steps = ",".join(str(i / buckets) for i in range(1, buckets))
    cuts = F.expr(f"array_distinct(percentile_approx({value}, array({steps})))").alias("_cuts")
    if not by:
        j = df.withColumn("_cuts", df.agg(cuts).scalar())
    else:
        j = df.join(df.groupBy(*by).agg(cuts), list(by))
    return j.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def running_before(df: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Per distinct value: for each column of ``sums`` its total over all smaller values (suffix _before) and its group
    total (suffix _all). Input: one row per (by, value)."""
    b = add_bucket(df, by, value, buckets)
    totals = b.groupBy(*by, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    wb = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    wa = W.partitionBy(*by)
    totals = totals.withColumns(
        {
            **{f"_o_{s}": F.coalesce(F.sum(f"_t_{s}").over(wb), F.lit(0)) for s in sums},
            **{f"{s}_all": F.sum(f"_t_{s}").over(wa) for s in sums},
        }
    ).drop(*[f"_t_{s}" for s in sums])
    wi = W.partitionBy(*by, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    inner = b.withColumns({f"_i_{s}": F.coalesce(F.sum(s).over(wi), F.lit(0)) for s in sums})
    # totals hold one row per bucket
    return (
        inner.join(totals, [*by, "_b"])
        .withColumns({f"{s}_before": F.col(f"_i_{s}") + F.col(f"_o_{s}") for s in sums})
        .drop("_b", *[f"_i_{s}" for s in sums], *[f"_o_{s}" for s in sums])
    )


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None) -> DataFrame:
    """(by, prob, quantile): linear interpolation between order statistics, for groups too big for one buffer."""
    n = F.count("*") if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(n.cast("long").alias("_n"))
    r = running_before(counts.where("_n > 0"), by, "_v", ["_n"])
    p = r.withColumn("prob", F.explode(F.array(*[F.lit(float(x)) for x in probs])))
    pos = (F.col("_n_all") - 1) * F.col("prob")
    lo, hi = F.floor(pos), F.ceil(pos)
    holds = lambda k: (F.col("_n_before") <= k) & (k < F.col("_n_before") + F.col("_n"))
    near = p.where(holds(lo) | holds(hi))
    g = near.groupBy(*by, "prob").agg(
        F.max(F.when(holds(lo), F.col("_v"))).alias("a"), F.max(F.when(holds(hi), F.col("_v"))).alias("b"), F.max(pos - lo).alias("f")
    )
    return g.select(*by, "prob", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("quantile"))


def auc(df: DataFrame, by: Sequence[str], event: str = "event", score: str = "prob") -> DataFrame:
    """ROC AUC with average ranks for ties, null when a class is missing: (by, auc, n, n_event)."""
    c = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("_s")).agg(
        F.count_if(F.col(event)).alias("pos"), F.count_if(~F.col(event)).alias("neg")
    )
    r = running_before(c, by, "_s", ["pos", "neg"])
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.max("pos_all").cast("double") * F.max("neg_all")
    return r.groupBy(*by).agg(
        (won / F.nullif(pairs, F.lit(0.0))).alias("auc"),
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum("pos").alias("n_event"),
    )


def knots_around(points: DataFrame, knots: DataFrame, by: Sequence[str], x: str, buckets: int = BUCKETS) -> DataFrame:
    """Each distinct point with the knot at or below it and the knot at or above it (structs lo, hi of x, y).

    Knots and points are ordered together inside buckets; what a bucket lacks comes from its neighbours through the
    bucket table.
    """
    k = knots.select(*by, F.col("x").cast("double").alias(x), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("_k"))
    p = points.select(*by, F.col(x).cast("double").alias(x)).distinct().withColumn("_k", F.lit(None).cast("struct<x:double,y:double>"))
    b = add_bucket(p.unionByName(k), by, x, buckets)
    ends = b.groupBy(*by, "_b").agg(F.max("_k").alias("_max"), F.min("_k").alias("_min"))
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*by).orderBy("_b").rowsBetween(1, W.unboundedFollowing)
    ends = ends.withColumns(
        {"_below": F.last("_max", ignorenulls=True).over(before), "_above": F.first("_min", ignorenulls=True).over(after)}
    ).drop("_max", "_min")
    w = W.partitionBy(*by, "_b").orderBy(x)
    inner = b.withColumns(
        {
            "_lo": F.max("_k").over(w.rangeBetween(W.unboundedPreceding, 0)),
            "_hi": F.min("_k").over(w.rangeBetween(0, W.unboundedFollowing)),
        }
    ).where(F.col("_k").isNull())
    return inner.join(ends, [*by, "_b"]).select(
        *by, x, F.coalesce("_lo", "_below").alias("lo"), F.coalesce("_hi", "_above").alias("hi")
    )


def interpolate(x: Column, lo: Column, hi: Column) -> Column:
    """Value at x on the segment between two knots; flat beyond the ends."""
    w = hi["x"] - lo["x"]
    return (
        F.when(lo.isNull(), hi["y"]).when(hi.isNull(), lo["y"]).when(w > 0, lo["y"] + (hi["y"] - lo["y"]) * (x - lo["x"]) / w)
        .otherwise(lo["y"])
    )
