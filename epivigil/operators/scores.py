"""Truth, scores, summaries, leaderboards and the forecast log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import quantiles as qx
from . import ranks

LOG_KEY = ("mode", "target", "origin_yw", "target_yw")


def attach_truth(forecasts: DataFrame, panel: DataFrame, by: Sequence[str], idx: str = "week_idx", value: str = "value",
                 origin: str = "origin") -> DataFrame:
    """y at origin+h and y_origin at the origin, from two equi joins with the panel."""
    p = panel.select(*by, F.col(idx).alias("_i"), F.col(value).cast("double").alias("_v"))
    f = forecasts.withColumn("_t", F.col(origin) + F.col("h"))
    a = f.join(p.withColumnsRenamed({"_i": "_t", "_v": "y"}), [*by, "_t"], "left").drop("_t")
    return a.join(p.withColumnsRenamed({"_i": origin, "_v": "y_origin"}), [*by, origin], "left")


def add_scores(df: DataFrame) -> DataFrame:
    """abs_err, wis, cov80, cov60, dir_hit, dir_hit3, hit_tol10 as expressions in the same stage."""
    q, y, m, y0 = qx.qcols(), F.col("y"), F.col("median"), F.col("y_origin")
    return df.withColumns(
        {
            "abs_err": qx.abs_err(y, m),
            "wis": qx.wis(y, q),
            "cov80": qx.covered(y, q, 80),
            "cov60": qx.covered(y, q, 60),
            "dir_hit": qx.direction_hit(y0, y, m),
            "dir_hit3": qx.direction3_hit(y0, y, m),
            "hit_tol10": qx.tolerance_hit(y, m),
        }
    )


def default_thresholds(df: DataFrame, given: Mapping[str, float] | None = None, pct: float = 0.75, target: str = "target") -> DataFrame:
    """(target, thr): the given value, else the pct quantile of the distinct (origin, h) actuals of the target."""
    given = dict(given or {})
    rest = df.where(~F.col(target).isin(*given)) if given else df
    # truth does not depend on the model: one y per (target, origin, h)
    one = rest.groupBy(target, "origin", "h").agg(F.first("y").alias("y"))
    q = ranks.exact_quantiles(one, [target], "y", [pct]).select(target, F.col("quantile").alias("thr"))
    if given:
        q = q.unionByName(df.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{target} string, thr double"))
    return q


def usual_threshold(table: DataFrame) -> DataFrame:
    """Most frequent yearly threshold (the largest of equally frequent ones) as one row ``thr``."""
    return table.where(F.col("threshold").isNotNull()).groupBy("threshold").count().agg(
        F.max_by("threshold", F.struct("count", "threshold")).alias("thr")
    )


def summarize(
    results: DataFrame, thresholds: DataFrame, segments: Mapping[str, tuple[int, int]] = lb.SEGMENTS, reference: str = "snaive",
    by: Sequence[str] = ("config", "target"), horizon: str = "h",
) -> DataFrame:
    """Per (config, target, segment, h) with segment 'all' included: errors, coverage, hits, threshold rates, n, relative WIS.

    Rows are combined once by (config, target, segment of the target year, h); 'all' is the sum of those partial sums,
    so the big table is read and shuffled once.
    """
    d = results.join(thresholds, "target").withColumn("segment", lb.segment_of(F.col("target_year"), segments))
    event, alarm = F.col("y") >= F.col("thr"), F.col("median") >= F.col("thr")
    sums: dict[str, Column] = {
        "wis": F.sum("wis"), "abs": F.sum("abs_err"), "absy": F.sum(F.abs("y")),
        "ape": F.sum(qx.ape(F.col("y"), F.col("median"))), "ape_n": F.count(qx.ape(F.col("y"), F.col("median"))),
        "ase": F.sum(F.col("abs_err") / F.nullif(F.col("mase_scale"), F.lit(0.0))),
        "ase_n": F.count(F.col("abs_err") / F.nullif(F.col("mase_scale"), F.lit(0.0))),
        **{c: F.count_if(F.col(c)) for c in ("cov80", "cov60", "dir_hit", "dir_hit3", "hit_tol10")},
        **qx.confusion(event, alarm), "n": F.count("*"), "thr": F.first("thr"),
    }
    part = d.groupBy(*by, "segment", horizon).agg(*[c.alias(f"_{k}") for k, c in sums.items()])
    both = part.withColumn("segment", F.explode(F.array(F.lit("all"), F.col("segment")))).where(
        F.col("segment").isin("all", *segments)
    )
    t = both.groupBy(*by, "segment", horizon).agg(
        *[(F.first("_thr") if k == "thr" else F.sum(f"_{k}")).alias(k) for k in sums]
    )

    def mean(a: str, n: str = "n") -> Column:
        return F.col(a).cast("double") / F.nullif(F.col(n).cast("double"), F.lit(0.0))

    rates = qx.confusion_rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    out = t.select(
        *by, "segment", horizon,
        mean("wis").alias("wis"), mean("abs").alias("mae"), mean("ape", "ape_n").alias("mape"), mean("abs", "absy").alias("wape"),
        mean("ase", "ase_n").alias("mase"), *[mean(c).alias(c) for c in ("cov80", "cov60", "dir_hit", "dir_hit3", "hit_tol10")],
        "thr", *[c.alias(k) for k, c in rates.items()], "n",
    )
    return relative_to(out, reference, by=("target", "segment", horizon))


def relative_to(summary: DataFrame, reference: str, by: Sequence[str] = ("target", "segment", "h"), score: str = "wis",
                config: str = "config") -> DataFrame:
    """Score ratio to the reference configuration with the same keys; null where it is absent."""
    r = summary.where(F.col(config) == reference).select(*by, F.col(score).alias("_ref"))
    return summary.join(r, list(by), "left").withColumn(
        f"rel_{score}_vs_{reference}", F.col(score) / F.nullif(F.col("_ref"), F.lit(0.0))
    ).drop("_ref")


def percent_improvement(summary: DataFrame, a: str, b: str, by: Sequence[str] = ("target", "segment", "h")) -> DataFrame:
    """100 (1 - a/b) per key, whole percent."""
    x = summary.where(F.col("config") == a).select(*by, F.col("wis").alias("_a"))
    y = summary.where(F.col("config") == b).select(*by, F.col("wis").alias("_b"))
    return x.join(y, list(by)).select(*by, F.bround(F.lit(100.0) * (1 - F.col("_a") / F.col("_b"))).cast("int").alias("pct"))


def leaderboard(summary: DataFrame, segment: str, hs: Sequence[int] = (1, 2, 3, 4), target: str | None = None) -> DataFrame:
    """Mean over horizons per configuration, best WIS first, and its ratio to the last-value and seasonal rows."""
    s = summary.where((F.col("segment") == segment) & F.col("h").isin(*hs))
    if target is not None:
        s = s.where(F.col("target") == target)
    g = s.groupBy("config").agg(
        *[F.avg(c).alias(c) for c in ("wis", "mae", "mape", "mase", "cov80", "cov60")], F.avg("rel_wis_vs_snaive").alias("rel_wis")
    )
    for ref in ("naive", "snaive"):
        v = g.where(F.col("config") == ref).agg(F.max("wis").alias("v")).scalar()
        g = g.withColumn(f"rel_{ref}", F.col("wis") / v)
    return g.orderBy("wis", "config")


def best_config(summary: DataFrame, segment: str, target: str | None = None) -> Column:
    """Scalar: the configuration with the lowest mean WIS in a segment."""
    s = summary.where(F.col("segment") == segment)
    if target is not None:
        s = s.where(F.col("target") == target)
    return s.groupBy("config").agg(F.avg("wis").alias("w")).agg(F.min_by("config", F.struct("w", "config")).alias("v")).scalar()


def pivot_scores(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, score: str = "wis", prefix: str = "h") -> DataFrame:
    """Mean score by rows x column (horizon or year); the values are listed, so no extra job finds them."""
    p = df.groupBy(*rows).pivot(column, list(values)).agg(F.avg(score))
    return p.select(*rows, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def group_scores(results: DataFrame, group: str, reference: str = "naive",
                 segments: Mapping[str, tuple[int, int]] = lb.SEGMENTS) -> DataFrame:
    """Per (config, segment, h) with 'all': WIS summed over groups, mean, coverage, hits, n, ratio of sums to the reference."""
    d = results.withColumn("segment", lb.segment_of(F.col("target_year"), segments))
    part = d.groupBy("config", "segment", "h").agg(
        F.sum("wis").alias("wis_sum"), F.sum("abs_err").alias("_ae"), F.count("*").alias("n"),
        *[F.count_if(F.col(c)).alias(f"_{c}") for c in ("cov80", "dir_hit", "dir_hit3", "hit_tol10")],
    )
    t = part.withColumn("segment", F.explode(F.array(F.lit("all"), F.col("segment")))).groupBy("config", "segment", "h").agg(
        *[F.sum(c).alias(c) for c in ("wis_sum", "_ae", "n", "_cov80", "_dir_hit", "_dir_hit3", "_hit_tol10")]
    )
    t = t.select(
        "config", "segment", "h", "wis_sum", (F.col("wis_sum") / F.col("n")).alias("wis"), (F.col("_ae") / F.col("n")).alias("mae"),
        *[(F.col(f"_{c}") / F.col("n")).alias(c) for c in ("cov80", "dir_hit", "dir_hit3", "hit_tol10")], "n",
    )
    return relative_to(t, reference, by=("segment", "h"), score="wis_sum")


def per_group_relative(results: DataFrame, group: str, reference: str = "naive") -> DataFrame:
    """Mean WIS per (config, group) and its ratio to the reference in the same group."""
    g = results.groupBy("config", group).agg(F.avg("wis").alias("wis"))
    return relative_to(g, reference, by=(group,))


def bias_table(results: DataFrame, by: Sequence[str] = ("config", "segment", "h")) -> DataFrame:
    """Mean signed bias and absolute percent error; null parts at y = 0 are left out."""
    b = F.lit(100.0) * (F.col("median") - F.col("y")) / F.nullif(F.col("y"), F.lit(0.0))
    return results.groupBy(*by).agg(F.avg(b).alias("bias_pct"), F.avg(F.abs(b)).alias("mape"), F.count("*").alias("n"))


def high_activity(results: DataFrame, best: Column, pct: float = 0.75) -> DataFrame:
    """Rows whose actual reaches the pct quantile of the best configuration's actuals."""
    q = ranks.exact_quantiles(results.where(F.col("config") == best), [], "y", [pct]).agg(F.max("quantile").alias("v")).scalar()
    return results.where(F.col("y") >= q)


def best_series(results: DataFrame, best: Column, reference: str = "naive", keys: Sequence[str] = ("target", "origin", "h")) -> DataFrame:
    """The best configuration's forecast against the actual, with the reference median of the same target step."""
    r = results.where(F.col("config") == reference).select(*keys, F.col("median").alias("naive"))
    return results.where(F.col("config") == best).join(r, list(keys), "left")


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def merge_log(old: DataFrame, *new: DataFrame, keys: Sequence[str] = LOG_KEY) -> DataFrame:
    """Old and new log rows; the newest ``run_at`` of a key wins, later frames win ties."""
    allf = old.withColumn("_s", F.lit(0))
    for i, n in enumerate(new, 1):
        allf = allf.unionByName(n.withColumn("_s", F.lit(i)), allowMissingColumns=True)
    return dedupe(allf, keys, [F.desc("run_at"), F.desc("_s")]).drop("_s")


def replace_origin(old: DataFrame, new: DataFrame, defaults: Mapping[str, str], key: str = "origin") -> DataFrame:
    """Old rows of the new origins go; columns the old table lacks take a default (SQL text over the old columns)."""
    add = {c: F.expr(e) for c, e in defaults.items() if c not in old.columns}
    kept = old.join(new.select(key).distinct(), key, "left_anti").withColumns(add) if add else old.join(
        new.select(key).distinct(), key, "left_anti"
    )
    return kept.unionByName(new, allowMissingColumns=True)


def evaluate_log(log: DataFrame, panel: DataFrame, targets: Sequence[str], since: str | None = None) -> DataFrame:
    """Logged forecasts against the wide panel's column of the same name; weeks without a value yet are left out."""
    have = [t for t in targets if t in panel.columns]
    long = panel.select("yw", *[F.col(t).cast("double").alias(t) for t in have]).unpivot("yw", have, "target", "actual")
    d = log if since is None else log.where(F.col("origin_yw") >= since)
    j = d.join(long.withColumnRenamed("yw", "target_yw"), ["target", "target_yw"]).where(F.col("actual").isNotNull())
    q, y, m = qx.qcols(), F.col("actual"), F.col("median")
    return j.withColumns(
        {
            "abs_err": qx.abs_err(y, m), "ape": qx.ape(y, m, 1.0), "in60": qx.covered(y, q, 60), "in80": qx.covered(y, q, 80),
            "wis": qx.wis(y, q),
        }
    )


def evaluation_summary(ev: DataFrame) -> DataFrame:
    return ev.groupBy("mode", "target", "h").agg(
        F.count("*").alias("n"), F.avg("abs_err").alias("mae"), (F.avg("ape") * 100).alias("mape"),
        F.avg(F.col("in60").cast("int")).alias("cov60"), F.avg(F.col("in80").cast("int")).alias("cov80"), F.avg("wis").alias("wis"),
    )
