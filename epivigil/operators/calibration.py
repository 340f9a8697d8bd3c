"""Recalibration of probabilities (isotonic, Platt, leave one year out) and probability scores.

Rows are first counted per distinct probability (n, events); everything after works on those counts. Equal scores are
therefore pooled before the isotonic fit, where a fit on raw rows would depend on the order of ties.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from . import ranks


def counts_by_score(df: DataFrame, by: Sequence[str], prob: str = "prob", event: str = "event") -> DataFrame:
    return df.where(F.col(prob).isNotNull()).groupBy(*by, F.col(prob).cast("double").alias("p")).agg(
        F.count("*").cast("double").alias("n"), F.count_if(F.col(event)).cast("double").alias("pos")
    )


def leave_one_out(counts: DataFrame, year: str = "year") -> DataFrame:
    """(fold, p, n, pos) with the counts of all years but the fold. Years are few and travel as one array."""
    years = counts.select(year).distinct().agg(F.array_sort(F.collect_list(year)).alias("v")).scalar()
    d = counts.withColumn("fold", F.explode(years)).where(F.col("fold") != F.col(year))
    return d.groupBy("fold", "p").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def _pool(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pool adjacent violators over blocks (sx, n, sy) sorted by their mean x."""
    pdf = pdf.iloc[np.argsort((pdf["sx"] / pdf["n"]).to_numpy(), kind="stable")]
    stack: list[list[float]] = []
    for sx, n, sy in zip(pdf["sx"], pdf["n"], pdf["sy"]):
        cur = [sx, n, sy]
        while stack and stack[-1][2] * cur[1] > cur[2] * stack[-1][1]:
            top = stack.pop()
            cur = [a + b for a, b in zip(top, cur)]
        stack.append(cur)
    out = pd.DataFrame(stack, columns=["sx", "n", "sy"])
    for c in pdf.columns:
        if c not in out:
            out[c] = pdf[c].iloc[0]
    return out[list(pdf.columns)]


MOST = 50_000  # blocks that are pooled in one task
CUTS = 63
GRAIN = 1 << 20


def _apart(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``blocks`` with _s, a part of their group that can be pooled by itself.

    For a threshold t, the fit is below t up to the place where the running sum of (events - t * rows) is smallest, and not below it
    behind: no block of the fit crosses that place. Each part lies between the places of two neighbouring thresholds, which are
    quantiles of the blocks' own means. Thresholds are multiples of 2^-20, so the sums are whole numbers and compare exactly.
    """
    steps = ",".join(str(i / (CUTS + 1)) for i in range(1, CUTS + 1))
    grains = F.expr(f"array_distinct(transform(percentile_approx(sy / n, array({steps})), t -> bigint(ceil(t * {GRAIN}))))")
    b = ranks.add_bucket(blocks.withColumn("_x", F.col("sx") / F.col("n")), keys, "_x")
    inner = W.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumns({"_n": F.sum(F.col("n").cast("long")).over(inner), "_p": F.sum(F.col("sy").cast("long")).over(inner)})
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = b.groupBy(*keys, "_b").agg(F.max("_n").alias("_n"), F.max("_p").alias("_p"))
    offsets = offsets.select(*keys, "_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_o{c}") for c in ("_n", "_p")])
    b = b.join(offsets, [*keys, "_b"]).withColumns({"_n": F.col("_n") + F.col("_o_n"), "_p": F.col("_p") + F.col("_o_p")}).drop("_b", "_o_n", "_o_p")
    at = b.join(blocks.groupBy(*keys).agg(grains.alias("_t")), list(keys)).withColumn("_t", F.explode("_t"))
    value = F.col("_p") * GRAIN - F.col("_t") * F.col("_n")
    low = at.groupBy(*keys, "_t").agg(F.min(F.struct(value.alias("v"), F.col("_x").alias("x"))).alias("_l"))
    places = low.where("_l.v < 0").groupBy(*keys).agg(F.array_sort(F.collect_set("_l.x")).alias("_places"))
    s = F.coalesce(F.size(F.filter("_places", lambda x: x < F.col("_x"))), F.lit(0))
    return b.join(places, list(keys), "left").withColumn("_s", s).drop("_places", "_x", "_n", "_p")


def isotonic_fit(counts: DataFrame, by: Sequence[str], buckets: int = ranks.BUCKETS, most: int = MOST) -> DataFrame:
    """Knots (by, x, y, n) of the non-decreasing fit; x and y are means of a pooled block.

    Pooling may be done in any order, so each score bucket is pooled by itself in parallel. Groups of which more than ``most`` blocks
    survive (scores that are in order already) are parted where no block of the fit can cross, until no part holds more or a round
    parts nothing further; the parts are pooled in parallel.
    """
    keys = list(by) or ["_one"]
    c = counts if by else counts.withColumn("_one", F.lit(0))
    b = ranks.add_bucket(c, keys, "p", buckets).select(
        *keys, "_b", (F.col("p") * F.col("n")).alias("sx"), "n", F.col("pos").alias("sy")
    )
    part = written(b.groupBy(*keys, "_b").applyInPandas(_pool, b.schema).drop("_b"), "pooled-buckets")
    largest = lambda d, k: d.groupBy(*k).count().agg(F.max("count")).first()[0] or 0
    groups, size = list(keys), largest(part, keys)
    while size > most:
        part = written(_apart(part, groups).withColumnRenamed("_s", f"_s{len(groups)}"), "parted-blocks")
        groups.append(f"_s{len(groups)}")
        size, was = largest(part, groups), size
        if size == was:
            break
    blocks = part.groupBy(*groups).applyInPandas(_pool, part.schema)
    return blocks.select(*by, (F.col("sx") / F.col("n")).alias("x"), (F.col("sy") / F.col("n")).alias("y"), "n")


def isotonic_predict(points: DataFrame, knots: DataFrame, by: Sequence[str], prob: str, out: str = "calibrated") -> DataFrame:
    """(by, prob, out) for the distinct points: linear between knots, flat outside, within [0, 1]."""
    k = ranks.knots_around(points, knots, by, prob)
    v = ranks.interpolate(F.col(prob), F.col("lo"), F.col("hi"))
    return k.select(*by, prob, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)).alias(out))


def _logit(p: Column) -> Column:
    c = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), p))
    return F.log(c / (1 - c))


def platt_fit(counts: DataFrame, by: str, iterations: int = 50, ridge: float = 1e-6, tol: float = 1e-8) -> dict:
    """fold -> (a, b) of sigmoid(a logit(p) + b). Newton steps on five sums per fold; only those sums reach the driver.

    Folds are the years of a study, so an iteration returns a handful of rows.
    """
    d = counts.withColumn("_z", _logit(F.col("p"))).persist()
    try:
        par = {r[0]: (1.0, 0.0) for r in d.select(by).distinct().collect()}
        open_ = set(par)
        for _ in range(iterations):
            if not open_:
                break
            a = F.create_map(*[F.lit(v) for k in par for v in (k, par[k][0])])[F.col(by)]
            b = F.create_map(*[F.lit(v) for k in par for v in (k, par[k][1])])[F.col(by)]
            q = 1 / (1 + F.exp(-(a * F.col("_z") + b)))
            w = (q * (1 - q) + 1e-9) * F.col("n")
            r, z = q * F.col("n") - F.col("pos"), F.col("_z")
            sums = d.where(F.col(by).isin(list(open_))).groupBy(by).agg(
                F.sum(r * z).alias("g0"), F.sum(r).alias("g1"), F.sum(w * z * z).alias("h00"), F.sum(w * z).alias("h01"), F.sum(w).alias("h11")
            )
            for s in sums.collect():
                h00, h11, h01 = s["h00"] + ridge, s["h11"] + ridge, s["h01"]
                det = h00 * h11 - h01 * h01
                da, db = (h11 * s["g0"] - h01 * s["g1"]) / det, (h00 * s["g1"] - h01 * s["g0"]) / det
                old = par[s[by]]
                par[s[by]] = (old[0] - da, old[1] - db)
                if max(abs(da), abs(db)) < tol:
                    open_.discard(s[by])
        return par
    finally:
        d.unpersist()


def platt_predict(prob: Column, key: Column, params: dict) -> Column:
    a = F.create_map(*[F.lit(v) for k in params for v in (k, params[k][0])])[key]
    b = F.create_map(*[F.lit(v) for k in params for v in (k, params[k][1])])[key]
    return 1 / (1 + F.exp(-(a * _logit(prob) + b)))


def loyo(df: DataFrame, prob: str = "prob", event: str = "event", year: str = "year", method: str = "isotonic", out: str = "prob_cal") -> DataFrame:
    """Rows with a probability calibrated on all other years; null when there is no other year."""
    counts = counts_by_score(df, [year], prob, event)
    train = leave_one_out(counts, year)
    if method == "platt":
        params = platt_fit(train, "fold")
        if not params:
            return df.withColumn(out, F.lit(None).cast("double"))
        known = F.col(year).isin(list(params))
        return df.withColumn(out, F.when(known, platt_predict(F.col(prob), F.col(year), params)))
    if method != "isotonic":
        raise ValueError("method must be 'isotonic' or 'platt'")
    # the knots are read several times below; they are stored once instead of being fitted again
    knots = written(isotonic_fit(train, ["fold"]), "knots")
    points = counts.select(F.col(year).alias("fold"), F.col("p"))
    m = isotonic_predict(points, knots, ["fold"], "p", out)
    return df.join(m.select(F.col("fold").alias(year), F.col("p").alias(prob), out), [year, prob], "left")


def calibration_map(knots: DataFrame, step: float = 0.01) -> DataFrame:
    """The deployable map on a grid of raw probabilities 0..1."""
    n = round(1 / step)
    knots = written(knots, "knots")
    grid = knots.sparkSession.range(n + 1).select(F.round(F.col("id") * step, 6).alias("raw"))
    return isotonic_predict(grid, knots, [], "raw")


def edges(bins: int = 10) -> list[float]:
    return [i * (1 / bins) for i in range(bins)]


def bin_of(p: Column, bins: int = 10) -> Column:
    """Number of the bin [edge, next edge) holding p; 1 belongs to the last."""
    e = F.array(*[F.lit(x) for x in edges(bins)])
    return F.greatest(F.lit(0), F.size(F.filter(e, lambda x: x <= p)) - 1)


def probability_scores(df: DataFrame, by: Sequence[str], prob: str = "prob", event: str = "event", bins: int = 10, eps: float = 1e-3) -> DataFrame:
    """n, event_rate, brier, logloss, ece per group; one shuffle, by group and bin."""
    p, y = F.col(prob), F.col(event).cast("double")
    c = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    g = df.where(p.isNotNull()).groupBy(*by, bin_of(p, bins).alias("_b")).agg(
        F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum((p - y) * (p - y)).alias("sb"),
        F.sum(-(y * F.log(c) + (1 - y) * F.log(1 - c))).alias("sl"),
    )
    n = F.sum("n")
    return g.groupBy(*by).agg(
        n.alias("n"), (F.sum("sy") / n).alias("event_rate"), (F.sum("sb") / n).alias("brier"), (F.sum("sl") / n).alias("logloss"),
        (F.sum(F.abs(F.col("sp") - F.col("sy"))) / n).alias("ece"),
    )


def reliability(df: DataFrame, prob: str = "prob", event: str = "event", bins: int = 10) -> DataFrame:
    """Per bin n, mean predicted, observed; empty bins stay with n = 0 and nulls."""
    g = df.where(F.col(prob).isNotNull()).groupBy(bin_of(F.col(prob), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(prob).alias("mean_pred"), F.avg(F.col(event).cast("double")).alias("observed")
    )
    s = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return s.join(g, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


