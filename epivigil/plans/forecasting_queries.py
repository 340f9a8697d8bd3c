"""Forecast generation."""

import numpy as np
from pyspark.sql import functions as F

from ..functions import quantiles as qx
from ..operators import baselines as bl
from ..operators import calendar as cal
from ..operators import covariates as cov
from ..operators import ensembles as en
from ..operators import forecaster as fc
from ..operators import linelist as ll
from ..operators import nowcast as nc
from ..operators import panel as pn
from ..session import spread
from .registry import R, big, chain, query, rnd, rounded, text
from .testbed import (C_CPANEL, C_EW, C_NAT, C_SCORED, C_VISITS, any_rows, backtest_cte, county_panel, daily, early_warning, histogram, daily_origins,
                      national, results, visits, yw_idx_sql)
from .weeks_queries import closures, holidays

QS = ", ".join(f"{R(c, 5)} AS {c}" for c in qx.QCOLS)


def _out(df, *keys):
    return df.select(*keys, "model", big("h").alias("h"), rnd("y", 5).alias("y"), rnd("mase_scale", 5).alias("mase_scale"), *[rnd(c, 5).alias(c) for c in qx.QCOLS])


def _sql_out(keys, src="bt"):
    return f"SELECT {keys}, model, CAST(h AS BIGINT) AS h, {R('y', 5)} AS y, {R('mase_scale', 5)} AS mase_scale, {QS} FROM {src}"


@query("f1_contexts", chain(C_CPANEL, """r AS (SELECT county, week_idx, row_number() OVER w AS n, COUNT(*) OVER (PARTITION BY county) AS total_n, SUM(total) OVER (PARTITION BY county ORDER BY week_idx ROWS 155 PRECEDING) AS s FROM cpanel WINDOW w AS (PARTITION BY county ORDER BY week_idx))""",
 "SELECT county, CAST(week_idx AS BIGINT) AS origin, CAST(LEAST(n, 156) AS BIGINT) AS len, CAST(s AS DOUBLE) AS total FROM r WHERE n >= 104 AND total_n - n >= 4"))
def f1(spark, sf):
    c = fc.contexts(bl.require_complete(county_panel(spark, sf), ["county"], "week_idx", "total"), ["county"], "week_idx", "total", 104, 4, 156)
    return c.select("county", big("origin").alias("origin"), F.size("context").cast("long").alias("len"), F.aggregate("context", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("f2_error_deciles", chain(C_CPANEL, "e AS (SELECT county, total - LAG(total) OVER (PARTITION BY county ORDER BY week_idx) AS e, AVG(total) OVER (PARTITION BY county) AS p FROM cpanel)",
 "g AS (SELECT county, MIN(p) AS p, quantile_cont(e, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM e GROUP BY 1)", "SELECT county, " + ", ".join(f"{R(f'GREATEST(0.0, p + q[{i + 1}] - q[5])', 5)} AS {c}" for i, c in enumerate(qx.QCOLS)) + " FROM g"))
def f2(spark, sf):
    from pyspark.sql import Window as W

    p = county_panel(spark, sf)
    e = p.withColumn("err", (F.col("total") - F.lag("total").over(W.partitionBy("county").orderBy("week_idx"))).cast("double"))
    q = bl.error_deciles(e, ["county"]).join(p.groupBy("county").agg(F.avg("total").alias("p")), "county")
    arr = bl.deciles(F.col("p"), F.col("eq"))
    return rounded(q.select("county", *qx.spread(arr)), *qx.QCOLS, digits=5)


@query("f3_seasonal_naive", chain(C_NAT, "s AS (SELECT 'all' AS g, week_idx, total FROM nat)", backtest_cte("s", "g", "total", models=("snaive",)), _sql_out("CAST(origin AS BIGINT) AS origin")))
def f3(spark, sf):
    n = national(spark, sf).withColumn("g", F.lit("all"))
    f = bl.forecasts(n, ["g"], "week_idx", "total", ["snaive"])
    return _out(f, big("origin").alias("origin"))


@query("f4_last_value", chain(C_NAT, "s AS (SELECT 'all' AS g, week_idx, total FROM nat)", backtest_cte("s", "g", "total", models=("naive",)), _sql_out("CAST(origin AS BIGINT) AS origin")))
def f4(spark, sf):
    n = national(spark, sf).withColumn("g", F.lit("all"))
    return _out(bl.forecasts(n, ["g"], "week_idx", "total", ["naive"]), big("origin").alias("origin"))


@query("f5_moving_average", chain(C_NAT, "s AS (SELECT 'all' AS g, week_idx, total FROM nat)", backtest_cte("s", "g", "total", models=("ma3",), window=156), _sql_out("CAST(origin AS BIGINT) AS origin")))
def f5(spark, sf):
    n = national(spark, sf).withColumn("g", F.lit("all"))
    return _out(bl.forecasts(n, ["g"], "week_idx", "total", ["ma3"], window=156), big("origin").alias("origin"))


@query("f6_user_forecaster", chain(C_CPANEL, backtest_cte("cpanel", "county", "total", models=("naive",), window=156), f"SELECT county, CAST(origin AS BIGINT) AS origin, CAST(h AS BIGINT) AS h, {R('y', 5)} AS y, {QS} FROM bt"))
def f6(spark, sf):
    """The hook with the last-value callable gives what the window plan gives."""
    ctx = fc.contexts(spread(county_panel(spark, sf), ["county"]), ["county"], "week_idx", "total", 104, 4, 156)
    f = fc.run_forecaster(ctx, fc.last_value_forecaster, ["county"], 4)
    return f.select("county", big("origin").alias("origin"), big("h").alias("h"), rnd("y", 5).alias("y"), *[rnd(c, 5).alias(c) for c in qx.QCOLS])


@query("f6b_daily_asof_forecasts")
def f6b(spark, sf):
    """Daily contexts as known at each origin: final 7-day sums with the last days replaced by what was known."""
    h, o, back = histogram(spark, sf), daily_origins(spark, sf), 46
    d = daily(spark, sf)
    from pyspark.sql import Window as W

    w = W.partitionBy("series").orderBy("day")
    final = d.withColumn("old", F.collect_list(F.col("s7").cast("double")).over(w.rowsBetween(-363, -40))).join(o, d.day == o.origin).select("series", "origin", "old")
    known = nc.context_counts(h, o, "asof", back, 40)
    wk = W.partitionBy("origin", "series").orderBy(F.desc("k")).rowsBetween(-6, 0)
    tail = known.withColumn("s7", F.sum("n").over(wk)).where("k < 40").groupBy("origin", "series").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("t"), "s7"))), lambda x: x["s7"]).alias("new")
    )
    ctx = final.join(tail, ["origin", "series"]).select(
        "series", "origin", F.concat("old", "new").alias("context"), F.array().cast("array<double>").alias("truth")
    )
    f = fc.run_forecaster(ctx, fc.last_value_forecaster, ["series"], 14, hs=(7, 14))
    return f.select("series", text("origin").alias("origin"), "h", *[rnd(c, 4).alias(c) for c in qx.QCOLS])


@query("f7_joint_contexts", chain(C_VISITS, "g0 AS (SELECT week_idx, visit_type, SUM(total) AS v FROM visits WHERE visit_type IN ('BUILDING', 'MACHINERY') AND NOT (visit_type = 'BUILDING' AND yw < '199520') AND NOT (visit_type = 'MACHINERY' AND yw > '200110') GROUP BY 1, 2)",
 "gg AS (SELECT visit_type, unnest(range(MIN(week_idx), MAX(week_idx) + 1)) AS week_idx FROM g0 GROUP BY 1), g AS (SELECT gg.visit_type, gg.week_idx, COALESCE(v, 0) AS v FROM gg LEFT JOIN g0 ON g0.visit_type = gg.visit_type AND g0.week_idx = gg.week_idx)",
 "e AS (SELECT MAX(a) AS lo, MIN(b) AS hi FROM (SELECT visit_type, MIN(week_idx) AS a, MAX(week_idx) AS b FROM g GROUP BY 1))", "c AS (SELECT g.* FROM g, e WHERE week_idx BETWEEN lo AND hi)",
 """r AS (SELECT visit_type, week_idx, row_number() OVER w AS n, COUNT(*) OVER (PARTITION BY visit_type) AS m, SUM(v) OVER (PARTITION BY visit_type ORDER BY week_idx ROWS UNBOUNDED PRECEDING) AS s FROM c WINDOW w AS (PARTITION BY visit_type ORDER BY week_idx))""",
 """SELECT CAST(week_idx AS BIGINT) AS origin, MIN(n) AS len, CAST(SUM(CASE WHEN visit_type = 'BUILDING' THEN s END) AS DOUBLE) AS a, CAST(SUM(CASE WHEN visit_type = 'MACHINERY' THEN s END) AS DOUBLE) AS b FROM r WHERE n >= 104 AND m - n >= 4 GROUP BY 1 HAVING COUNT(*) = 2"""))
def f7(spark, sf):
    v = visits(spark, sf).where(F.col("visit_type").isin("BUILDING", "MACHINERY"))
    v = v.where(~((F.col("visit_type") == "BUILDING") & (F.col("yw") < "199520")) & ~((F.col("visit_type") == "MACHINERY") & (F.col("yw") > "200110")))
    g = v.groupBy("week_idx", F.col("visit_type").alias("indicator")).agg(F.sum("total").cast("double").alias("value"))
    ends = g.groupBy("indicator").agg(F.min("week_idx").alias("a"), F.max("week_idx").alias("b"))
    grid = ends.select("indicator", F.explode(F.sequence("a", "b")).alias("week_idx"))
    g = grid.join(g, ["indicator", "week_idx"], "left").na.fill(0.0, ["value"])
    c = fc.joint_contexts(pn.truncate_to_common(g), "indicator", [], "week_idx", "value", ["BUILDING", "MACHINERY"], warmup=104, horizon=4)
    tot = lambda i: F.aggregate(F.col("context")[i], F.lit(0.0), lambda a, x: a + x)
    return c.select(big("origin").alias("origin"), F.size(F.col("context")[0]).cast("long").alias("len"), tot(0).alias("a"), tot(1).alias("b"))


@query("f8_group_forecasts", chain(C_CPANEL, backtest_cte("cpanel", "county", "total"), f"SELECT county, model, CAST(h AS BIGINT) AS h, COUNT(*) AS n, {R('AVG(q10)', 4)} AS q10, {R('AVG(q50)', 4)} AS q50, {R('AVG(q90)', 4)} AS q90 FROM bt GROUP BY 1, 2, 3"))
def f8(spark, sf):
    f = bl.forecasts(county_panel(spark, sf), ["county"], "week_idx", "total")
    return f.groupBy("county", "model", big("h").alias("h")).agg(F.count("*").alias("n"), *[rnd(F.avg(c), 4).alias(c) for c in ("q10", "q50", "q90")])


def live(spark, sf):
    p = county_panel(spark, sf)
    f = bl.live_forecasts(p, ["county"], "week_idx", "total", models=["naive", "ma3"])
    start = cal.start_of_index(F.col("origin") + F.col("h"))
    return f.withColumns(
        {"origin_yw": cal.yw_of_index(F.col("origin")), "week_start": start, "target_yw": cal.yw_of_start(start), "origin_start": cal.start_of_index(F.col("origin"))}
    )


def _live_cte():
    full = backtest_cte("cpanel", "county", "total", "lv", models=("naive", "ma3"), warmup=0)
    full = full.replace("fut IS NOT NULL", f"{'week_idx'} = (SELECT MAX(week_idx) FROM cpanel)")
    return full


@query("f9_live_forecasts", chain(C_CPANEL, _live_cte(), f"SELECT county, model, {yw_idx_sql('origin')} AS origin_yw, {yw_idx_sql('origin + h')} AS target_yw, CAST(DATE '1970-01-04' + CAST(7 * (origin + h) AS INTEGER) AS VARCHAR) AS week_start, CAST(h AS BIGINT) AS h, {QS} FROM lv"))
def f9(spark, sf):
    return live(spark, sf).select("county", "model", "origin_yw", "target_yw", text("week_start").alias("week_start"), big("h").alias("h"), *[rnd(c, 5).alias(c) for c in qx.QCOLS])


@query("f10_quantile_mean", chain(C_SCORED, "SELECT county, CAST(origin AS BIGINT) AS origin, CAST(h AS BIGINT) AS h, 'ens_naive_ma3' AS model, " + ", ".join(f"{R(f'AVG({c})', 5)} AS {c}" for c in qx.QCOLS) + " FROM bt WHERE model IN ('naive', 'ma3') GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT model) = 2"))
def f10(spark, sf):
    e = en.quantile_mean(results(spark, sf), ["naive", "ma3"], ["county", "origin", "h"])
    return e.select("county", big("origin").alias("origin"), big("h").alias("h"), "model", *[rnd(c, 5).alias(c) for c in qx.QCOLS])


@query("f11_probability_mean", chain(C_EW.replace(" anyr AS (", " anyr AS MATERIALIZED ("), f"""SELECT a.series, CAST(a.origin AS VARCHAR) AS origin, 'ensp_naive_snaive' AS model, {R('(a.prob + b.prob) / 2', 5)} AS prob FROM anyr a LEFT JOIN (SELECT * FROM anyr WHERE model = 'snaive' AND series NOT LIKE 'ASIA%') b ON b.mode = a.mode AND b.series = a.series AND b.origin = a.origin WHERE a.model = 'naive'"""))
def f11(spark, sf):
    a = any_rows(spark, sf).where("not (model = 'snaive' and series like 'ASIA%')")
    return en.probability_mean(a, "naive", "snaive").select("series", text("origin").alias("origin"), "model", rnd("prob", 5).alias("prob"))


def log_rows(spark, sf):
    """Live forecasts of cases and totals as log rows (mode, target, ...)."""
    out = None
    n = national(spark, sf).where("total is not null").withColumn("g", F.lit("all"))
    for t in ("cases", "total"):
        f = bl.live_forecasts(n, ["g"], "week_idx", t, models=["naive", "ma3"])
        f = f.select(
            F.when(F.col("model") == "naive", "joint").otherwise("uni").alias("mode"), F.lit(t).alias("target"), cal.yw_of_index(F.col("origin")).alias("origin_yw"),
            cal.yw_of_index(F.col("origin") + F.col("h")).alias("target_yw"), big("h").alias("h"), "median", *qx.QCOLS,
        )
        out = f if out is None else out.unionByName(f)
    return out


def _one(t):
    c = backtest_cte(f"s_{t}", "g", t, f"b_{t}", models=("naive", "ma3"), warmup=0).replace("fut IS NOT NULL", f"week_idx = (SELECT MAX(week_idx) FROM s_{t})")
    return f"s_{t} AS (SELECT 'all' AS g, week_idx, {t} FROM nat WHERE total IS NOT NULL),\n" + c


C_LOGROWS = C_NAT + ",\n" + _one("cases") + ",\n" + _one("total") + f""",
 logrows AS (SELECT CASE model WHEN 'naive' THEN 'joint' ELSE 'uni' END AS mode, target, {yw_idx_sql('origin')} AS origin_yw, {yw_idx_sql('origin + h')} AS target_yw, h, median, {', '.join(qx.QCOLS)}
  FROM (SELECT 'cases' AS target, * FROM b_cases UNION ALL SELECT 'total', * FROM b_total))"""


@query("f12_add_sum", chain(C_LOGROWS, "u AS (SELECT mode, target, origin_yw, target_yw, h, " + ", ".join(qx.QCOLS) + " FROM logrows UNION ALL SELECT 'joint_sum', 'both', a.origin_yw, a.target_yw, a.h, " + ", ".join(f"a.{c} + b.{c}" for c in qx.QCOLS) + " FROM logrows a JOIN logrows b ON a.origin_yw = b.origin_yw AND a.target_yw = b.target_yw AND a.h = b.h WHERE a.mode = 'joint' AND b.mode = 'joint' AND a.target = 'cases' AND b.target = 'total')",
 f"SELECT mode, target, origin_yw, target_yw, CAST(h AS BIGINT) AS h, {QS} FROM u"))
def f12(spark, sf):
    s = en.add_sum(log_rows(spark, sf), "cases", "total", "both", "joint")
    return s.select("mode", "target", "origin_yw", "target_yw", "h", *[rnd(c, 5).alias(c) for c in qx.QCOLS])


def covariate_forecaster(cs, horizon, extras):
    """Last value with its empirical h-step changes, of which a linear fit on the changes of the covariates explains a part."""
    if not extras:
        return fc.last_value_forecaster(cs, horizon, extras)
    levels = np.arange(1, 10) / 10
    out = []
    for k, c in enumerate(cs):
        x = np.stack([np.asarray(v[k], dtype=float)[-(len(c) + horizon) :] for v in extras.values()])
        n, rows = len(c) - horizon, []
        for h in range(1, horizon + 1):
            moved, changes = c[h : h + n] - c[:n], x[:, h : h + n] - x[:, :n]
            weights = np.linalg.lstsq(changes.T, moved, rcond=None)[0]
            q = np.quantile(moved - weights @ changes, levels)
            rows.append(c[-1] + weights @ (x[:, len(c) - 1 + h] - x[:, len(c) - 1]) + q - q[4])
        out.append(np.maximum(np.stack(rows), 0.0))
    return np.stack(out)


@query("f13_config_suite")
def f13(spark, sf):
    """Every configuration of the four suites run over the national panel; mean WIS per configuration."""
    n = national(spark, sf).withColumn("g", F.lit("all")).na.fill(0, ["total"])

    def fn(panel, kinds):
        c = cov.future_covariates(panel, kinds, holidays(spark, sf), closures(spark, sf))
        return c.withColumn("week_idx", cal.index_of_yw(F.col("yw")))

    out = None
    for c in [c for name in ("baselines", "windows", "covariates", "transforms") for c in fc.suite(name, "total")]:
        r = fc.run_config(c, n, ["g"], forecaster=covariate_forecaster, covariate_fn=fn).withColumn("wis", qx.wis(F.col("y"), qx.qcols()))
        out = r if out is None else out.unionByName(r, allowMissingColumns=True)
    return out.groupBy("config", "h").agg(F.count("*").alias("n"), rnd(F.avg("wis"), 4).alias("wis"))


def shifted_forecaster(cs, horizon, extras):
    """Last value plus the covariate of the target week: shows that covariates reach the callable."""
    out = []
    for c, hol in zip(cs, extras["cov_holiday_days"]):
        ahead = np.asarray(hol, dtype=float)[-horizon:]
        out.append(np.repeat((c[-1] + ahead)[:, None], 9, axis=1))
    return np.stack(out)


@query("m1_panel_and_covariates", chain(C_NAT, "nat2 AS (SELECT week_idx, DATE '1970-01-04' + CAST(7 * week_idx AS INTEGER) AS ws FROM nat)",
 __import__("epivigil.plans.weeks_queries", fromlist=["C_HOL"]).C_HOL,
 """r AS (SELECT week_idx, COALESCE(total, 0) AS x, row_number() OVER (ORDER BY week_idx) AS n, COUNT(*) OVER () AS m FROM nat), hs AS (SELECT unnest([1, 2, 3, 4]) AS h)""",
 """SELECT CAST(r.week_idx AS BIGINT) AS origin, CAST(h AS BIGINT) AS h, CAST(y.x AS DOUBLE) AS y, CAST(r.x + w.holiday_days AS DOUBLE) AS median FROM r CROSS JOIN hs JOIN r y ON y.week_idx = r.week_idx + h JOIN hwk w ON w.week_idx = r.week_idx + h WHERE r.n >= 104 AND r.m - r.n >= 4"""))
def m1(spark, sf):
    n = national(spark, sf).withColumn("g", F.lit("all")).na.fill(0, ["total"])

    def fn(panel, kinds):
        c = cov.future_covariates(panel, kinds, holidays(spark, sf), closures(spark, sf))
        return c.withColumn("week_idx", cal.index_of_yw(F.col("yw")))

    cfg = fc.Config("user", model="user", target="total", covariates=("holiday",))
    r = fc.run_config(cfg, n, ["g"], forecaster=shifted_forecaster, covariate_fn=fn)
    return r.select(big("origin").alias("origin"), big("h").alias("h"), "y", "median")


@query("m3_interval_deciles", """WITH a AS (SELECT o_orderkey, list_sort(list_transform([o_totalprice / 1000 - 80, o_totalprice / 1000 - 60, o_totalprice / 1000 - 40, o_totalprice / 1000 + 5, o_totalprice / 1000, o_totalprice / 1000 + 20, o_totalprice / 1000 + 40, o_totalprice / 1000 + 30, o_totalprice / 1000 + 80], lambda x: GREATEST(x, 0.0))) AS q FROM orders)
 SELECT o_orderkey, """ + ", ".join(f"{R(f'q[{i + 1}]', 5)} AS {c}" for i, c in enumerate(qx.QCOLS)) + " FROM a")
def m3(spark, sf):
    from .testbed import table

    m = F.col("o_totalprice") / 1000
    lo, hi = {80: m - 80, 60: m - 60, 40: m - 40, 20: m + 5}, {20: m + 20, 40: m + 40, 60: m + 30, 80: m + 80}
    q = qx.deciles_from_intervals(m, lo, hi)
    return rounded(table(spark, sf, "orders").select("o_orderkey", *qx.spread(q)), *qx.QCOLS, digits=5)
