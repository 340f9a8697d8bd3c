"""Scores, summaries, leaderboards, forecast log."""

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import quantiles as qx
from ..operators import baselines as bl
from ..operators import calendar as cal
from ..operators import scores as sc
from .forecasting_queries import C_LOGROWS, log_rows
from .registry import R, big, chain, query, rnd, rounded, text
from .testbed import C_CPANEL, C_NAT, C_SCORED, SEGS, county_panel, national, results, stored, table, yw_idx_sql

KEY = ["county", "model", "origin", "h"]


def _key(df, *cols):
    return df.select("county", "model", big("origin").alias("origin"), big("h").alias("h"), *cols)


_K = "county, model, CAST(origin AS BIGINT) AS origin, CAST(h AS BIGINT) AS h"


@query("g1_attach_truth", chain(C_SCORED, f"SELECT {_K}, CAST(y AS DOUBLE) AS y, CAST(y_origin AS DOUBLE) AS y_origin FROM bt"))
def g1(spark, sf):
    f = results(spark, sf).drop("y", "y_origin")
    return _key(sc.attach_truth(f, county_panel(spark, sf), ["county"], value="cases"), "y", "y_origin")


@query("g2_wis", chain(C_SCORED, f"SELECT {_K}, {R('wis', 5)} AS wis FROM scored"))
def g2(spark, sf):
    return _key(results(spark, sf).withColumn("wis", qx.wis(F.col("y"), qx.qcols())), rnd("wis", 5).alias("wis"))


@query("g3_coverage", chain(C_SCORED, """SELECT model, CAST(h AS BIGINT) AS h, COUNT(*) FILTER (y >= q10 AND y <= q90) AS c80, COUNT(*) FILTER (y >= q20 AND y <= q80) AS c60,
 COUNT(*) FILTER (y >= q30 AND y <= q70) AS c40, COUNT(*) FILTER (y >= q40 AND y <= q60) AS c20 FROM bt GROUP BY 1, 2"""))
def g3(spark, sf):
    y, q = F.col("y"), qx.qcols()
    return results(spark, sf).groupBy("model", big("h").alias("h")).agg(*[F.count_if(qx.covered(y, q, c)).alias(f"c{c}") for c in (80, 60, 40, 20)])


@query("g4_errors", chain(C_SCORED, f"SELECT {_K}, {R('ABS(y - q50)', 5)} AS abs_err, {R('100.0 * ABS(y - q50) / NULLIF(ABS(y), 0)', 5)} AS ape FROM bt"))
def g4(spark, sf):
    y, m = F.col("y"), F.col("median")
    return _key(results(spark, sf), rnd(qx.abs_err(y, m), 5).alias("abs_err"), rnd(qx.ape(y, m), 5).alias("ape"))


@query("g5_mase_scale", chain(C_CPANEL, "d AS (SELECT county, week_idx, ABS(cases - LAG(cases, 52) OVER (PARTITION BY county ORDER BY week_idx)) AS d FROM cpanel)",
 f"SELECT county, CAST(week_idx AS BIGINT) AS week_idx, {R('AVG(d) OVER (PARTITION BY county ORDER BY week_idx ROWS UNBOUNDED PRECEDING)')} AS mase_scale FROM d"))
def g5(spark, sf):
    m = bl.mase_scale(county_panel(spark, sf), ["county"], "week_idx", "cases")
    return m.select("county", big("week_idx").alias("week_idx"), rnd("mase_scale").alias("mase_scale"))


@query("g6_hits", chain(C_SCORED, "SELECT model, CAST(h AS BIGINT) AS h, COUNT(*) FILTER (dir_hit) AS dir_hit, COUNT(*) FILTER (dir_hit3) AS dir_hit3, COUNT(*) FILTER (hit_tol10) AS hit_tol10 FROM scored GROUP BY 1, 2"))
def g6(spark, sf):
    r = sc.add_scores(results(spark, sf).drop("dir_hit", "dir_hit3", "hit_tol10"))
    return r.groupBy("model", big("h").alias("h")).agg(*[F.count_if(F.col(c)).alias(c) for c in ("dir_hit", "dir_hit3", "hit_tol10")])


@query("g7_threshold_confusion", chain(C_SCORED, f"""c AS (SELECT model, COUNT(*) FILTER (y >= 2 AND q50 >= 2) AS tp, COUNT(*) FILTER (y < 2 AND q50 >= 2) AS fp, COUNT(*) FILTER (y >= 2 AND q50 < 2) AS fn, COUNT(*) FILTER (y < 2 AND q50 < 2) AS tn FROM bt GROUP BY 1)""",
 f"SELECT *, {R('tp / NULLIF(CAST(tp + fn AS DOUBLE), 0)')} AS thr_hit_rate, {R('fp / NULLIF(CAST(fp + tn AS DOUBLE), 0)')} AS thr_false_alarm, {R('(tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE)')} AS thr_accuracy FROM c"))
def g7(spark, sf):
    g = results(spark, sf).groupBy("model").agg(*[c.alias(k) for k, c in qx.confusion(F.col("y") >= 2, F.col("median") >= 2).items()])
    return g.select("*", *[rnd(c).alias(k) for k, c in qx.confusion_rates(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]).items()])


C_THR = "one AS (SELECT DISTINCT county, origin, h, y FROM bt), thr AS (SELECT quantile_cont(y, 0.75) AS thr FROM one)"


@query("g8_default_threshold", chain(C_SCORED, "one AS (SELECT DISTINCT county, origin, h, y FROM bt)", f"SELECT county AS target, {R('quantile_cont(y, 0.75)')} AS thr FROM one WHERE county <> 'NATION_3' GROUP BY 1 UNION ALL SELECT 'NATION_3', 7.5"))
def g8(spark, sf):
    r = results(spark, sf).withColumn("target", F.col("county"))
    return rounded(sc.default_thresholds(r, {"NATION_3": 7.5}), "thr")


@query("g8b_usual_threshold", "WITH y AS (SELECT year(o_orderdate) AS year, CAST(floor(COUNT(*) / 100) AS DOUBLE) AS threshold FROM orders GROUP BY 1), c AS (SELECT threshold, COUNT(*) AS n FROM y GROUP BY 1) SELECT threshold AS thr FROM c ORDER BY n DESC, threshold DESC LIMIT 1")
def g8b(spark, sf):
    y = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.floor(F.count("*") / 100).cast("double").alias("threshold"))
    return sc.usual_threshold(y)


def summary(spark, sf):
    def make():
        r = results(spark, sf)
        thr = sc.default_thresholds(r.withColumn("origin", F.concat_ws("|", "county", "origin")))
        return sc.summarize(r, thr, SEGS)

    return stored(spark, sf, "summary", make)


C_SUM = C_THR + """,
 sx AS (SELECT r.*, t.thr, s.seg FROM results r, thr t, (SELECT unnest(['all', 'early', 'mid']) AS seg) s WHERE s.seg = 'all' OR s.seg = r.segment),
 sm0 AS (SELECT config, target, seg AS segment, h, AVG(wis) AS wis, AVG(abs_err) AS mae, AVG(100.0 * abs_err / NULLIF(ABS(y), 0)) AS mape, SUM(abs_err) / NULLIF(SUM(ABS(y)), 0) AS wape, AVG(abs_err / NULLIF(mase_scale, 0)) AS mase,
  AVG(CAST(cov80 AS INTEGER)) AS cov80, AVG(CAST(cov60 AS INTEGER)) AS cov60, AVG(CAST(dir_hit AS INTEGER)) AS dir_hit, AVG(CAST(dir_hit3 AS INTEGER)) AS dir_hit3, AVG(CAST(hit_tol10 AS INTEGER)) AS hit_tol10, MIN(thr) AS thr,
  COUNT(*) FILTER (y >= thr AND q50 >= thr) AS tp, COUNT(*) FILTER (y < thr AND q50 >= thr) AS fp, COUNT(*) FILTER (y >= thr AND q50 < thr) AS fn, COUNT(*) FILTER (y < thr AND q50 < thr) AS tn, COUNT(*) AS n FROM sx GROUP BY 1, 2, 3, 4),
 summ AS (SELECT a.*, tp / NULLIF(CAST(tp + fn AS DOUBLE), 0) AS thr_hit_rate, fp / NULLIF(CAST(fp + tn AS DOUBLE), 0) AS thr_false_alarm, (tp + tn) / CAST(a.n AS DOUBLE) AS thr_accuracy, a.wis / b.rw AS rel
  FROM sm0 a LEFT JOIN (SELECT target, segment, h, wis AS rw FROM sm0 WHERE config = 'snaive') b ON b.target = a.target AND b.segment = a.segment AND b.h = a.h)"""
_M = ["wis", "mae", "mape", "wape", "mase", "cov80", "cov60", "dir_hit", "dir_hit3", "hit_tol10", "thr", "thr_hit_rate", "thr_false_alarm", "thr_accuracy"]


@query("g9_summary", chain(C_SCORED, C_SUM, f"SELECT config, target, segment, CAST(h AS BIGINT) AS h, {', '.join(f'{R(c, 5)} AS {c}' for c in _M)}, n, {R('rel', 5)} AS rel_wis_vs_snaive FROM summ"))
def g9(spark, sf):
    return rounded(summary(spark, sf), *_M, "rel_wis_vs_snaive", digits=5).withColumn("h", big("h"))


@query("g10_relative_score", chain(C_SCORED, C_SUM, """SELECT a.target, a.segment, CAST(a.h AS BIGINT) AS h, CAST(round_even(100.0 * (1 - a.wis / b.wis), 0) AS BIGINT) AS pct, """ + R("a.wis / b.wis", 5) + """ AS rel FROM summ a JOIN summ b ON b.target = a.target AND b.segment = a.segment AND b.h = a.h WHERE a.config = 'ma3' AND b.config = 'naive'"""))
def g10(spark, sf):
    s = summary(spark, sf)
    i = sc.percent_improvement(s, "ma3", "naive")
    r = sc.relative_to(s, "naive").where("config = 'ma3'").select("target", "segment", "h", rnd("rel_wis_vs_naive", 5).alias("rel"))
    return i.join(r, ["target", "segment", "h"]).withColumns({"h": big("h"), "pct": big("pct")})


C_LB = "lb AS (SELECT config, AVG(wis) AS wis, AVG(mae) AS mae, AVG(mape) AS mape, AVG(mase) AS mase, AVG(cov80) AS cov80, AVG(cov60) AS cov60, AVG(rel) AS rel_wis FROM summ WHERE segment = 'mid' AND h IN (1, 2, 3, 4) GROUP BY 1)"


@query("g11_leaderboard", chain(C_SCORED, C_SUM, C_LB, f"SELECT config, {', '.join(f'{R(c, 5)} AS {c}' for c in ('wis', 'mae', 'mape', 'mase', 'cov80', 'cov60', 'rel_wis'))}, "
 f"""{R("wis / (SELECT wis FROM lb WHERE config = 'naive')", 5)} AS rel_naive, {R("wis / (SELECT wis FROM lb WHERE config = 'snaive')", 5)} AS rel_snaive FROM lb"""))
def g11(spark, sf):
    b = sc.leaderboard(summary(spark, sf), "mid", target="cases")
    return rounded(b, *[c for c in b.columns if c != "config"], digits=5)


@query("g12_score_pivots", chain(C_SCORED, f"""SELECT config, {', '.join(R(f'AVG(CASE WHEN h = {h} THEN wis END)', 5) + f' AS h{h}' for h in (1, 2, 3, 4))}, {', '.join(R(f'AVG(CASE WHEN target_year = {y} AND h = 1 THEN wis END)', 5) + f' AS y{y}' for y in (1998, 1999, 2000))} FROM results GROUP BY 1"""))
def g12(spark, sf):
    r = results(spark, sf)
    a = sc.pivot_scores(r, ["config"], "h", [1, 2, 3, 4])
    b = sc.pivot_scores(r.where("h = 1"), ["config"], "target_year", [1998, 1999, 2000], prefix="y")
    j = a.join(b, "config")
    return rounded(j, *[c for c in j.columns if c != "config"], digits=5)


@query("g13_group_scores", chain(C_SCORED, """gx AS (SELECT config, s.seg AS segment, h, SUM(wis) AS wis_sum, AVG(wis) AS wis, AVG(abs_err) AS mae, AVG(CAST(cov80 AS INTEGER)) AS cov80, AVG(CAST(dir_hit AS INTEGER)) AS dir_hit, COUNT(*) AS n FROM results r, (SELECT unnest(['all', 'early', 'mid', 'other']) AS seg) s WHERE s.seg = 'all' OR s.seg = r.segment GROUP BY 1, 2, 3)""",
 f"""SELECT a.config, a.segment, CAST(a.h AS BIGINT) AS h, {R('a.wis_sum', 3)} AS wis_sum, {R('a.wis', 5)} AS wis, {R('a.mae', 5)} AS mae, {R('a.cov80')} AS cov80, {R('a.dir_hit')} AS dir_hit, a.n, {R('a.wis_sum / b.wis_sum', 5)} AS rel
 FROM gx a LEFT JOIN gx b ON b.config = 'naive' AND b.segment = a.segment AND b.h = a.h"""))
def g13(spark, sf):
    g = sc.group_scores(results(spark, sf), "county", segments=SEGS)
    return g.select("config", "segment", big("h").alias("h"), rnd("wis_sum", 3).alias("wis_sum"), rnd("wis", 5).alias("wis"), rnd("mae", 5).alias("mae"), rnd("cov80").alias("cov80"),
                    rnd("dir_hit").alias("dir_hit"), "n", rnd("rel_wis_sum_vs_naive", 5).alias("rel"))


@query("g13b_per_group_relative", chain(C_SCORED, "g AS (SELECT config, county, AVG(wis) AS wis FROM results WHERE segment = 'mid' GROUP BY 1, 2)", f"SELECT a.config, a.county, {R('a.wis', 5)} AS wis, {R('a.wis / NULLIF(b.wis, 0)', 5)} AS rel FROM g a LEFT JOIN g b ON b.config = 'naive' AND b.county = a.county"))
def g13b(spark, sf):
    r = results(spark, sf).where(lb.segment_of(F.col("target_year"), SEGS) == "mid")
    return sc.per_group_relative(r, "county").select("config", "county", rnd("wis", 5).alias("wis"), rnd("rel_wis_vs_naive", 5).alias("rel"))


C_BEST = C_LB + ", best AS (SELECT config FROM lb ORDER BY wis, config LIMIT 1)"


@query("g14_bias_high_activity", chain(C_SCORED, C_SUM, C_BEST, "q AS (SELECT quantile_cont(y, 0.75) AS q FROM results WHERE config = (SELECT config FROM best))",
 f"SELECT config, CAST(h AS BIGINT) AS h, {R('AVG(100.0 * (q50 - y) / NULLIF(y, 0))', 4)} AS bias_pct, {R('AVG(ABS(100.0 * (q50 - y) / NULLIF(y, 0)))', 4)} AS mape, COUNT(*) AS n FROM results, q WHERE y >= q GROUP BY 1, 2"))
def g14(spark, sf):
    r = results(spark, sf)
    hi = sc.high_activity(r, sc.best_config(summary(spark, sf), "mid"))
    return rounded(sc.bias_table(hi, ("config", "h")), "bias_pct", "mape", digits=4).withColumn("h", big("h"))


@query("g15_best_series", chain(C_SCORED, C_SUM, C_BEST, f"""SELECT b.county, b.target_yw, CAST(b.h AS BIGINT) AS h, CAST(b.y AS DOUBLE) AS y, {R('b.q50', 5)} AS median, {R('b.q10', 5)} AS q10, {R('b.q90', 5)} AS q90, {R('n.q50', 5)} AS naive
 FROM results b LEFT JOIN results n ON n.config = 'naive' AND n.county = b.county AND n.origin = b.origin AND n.h = b.h WHERE b.config = (SELECT config FROM best)"""))
def g15(spark, sf):
    s = sc.best_series(results(spark, sf), sc.best_config(summary(spark, sf), "mid"), keys=("county", "origin", "h"))
    return s.select("county", "target_yw", big("h").alias("h"), "y", *[rnd(c, 5).alias(c) for c in ("median", "q10", "q90", "naive")])


def logs(spark, sf):
    """A log of two runs with one overlapping origin: the stored naive and MA forecasts of the national total."""

    def make():
        n = national(spark, sf).where("total is not null").withColumn("g", F.lit("all"))
        f = bl.forecasts(n, ["g"], "week_idx", "total", ["naive", "ma3"])
        cut = f.agg(F.max("origin")).scalar()
        d = f.select(
            "origin", F.col("model").alias("mode"), F.lit("total").alias("target"), cal.yw_of_index(F.col("origin")).alias("origin_yw"),
            cal.yw_of_index(F.col("origin") + F.col("h")).alias("target_yw"), "h", "median", *qx.QCOLS,
        )
        a = d.where(F.col("origin") <= cut - 20).withColumn("run_at", F.lit("2001-01-01T08:00"))
        b = d.where(F.col("origin") >= cut - 20).withColumn("run_at", F.lit("2001-02-01T08:00")).withColumn("median", F.col("median") + 1)
        return a.unionByName(b).drop("origin")

    return stored(spark, sf, "logs", make)


from .testbed import backtest_cte  # noqa: E402

C_LOG = C_NAT + ",\n ns AS (SELECT 'all' AS g, week_idx, total FROM nat WHERE total IS NOT NULL),\n" + backtest_cte("ns", "g", "total", "nb", models=("naive", "ma3")) + f""",
 nl AS (SELECT model AS mode, origin, {yw_idx_sql('origin')} AS origin_yw, {yw_idx_sql('origin + h')} AS target_yw, h, median, {', '.join(qx.QCOLS)}, MAX(origin) OVER () AS cut FROM nb),
 lg AS (SELECT '2001-01-01T08:00' AS run_at, mode, origin_yw, target_yw, h, median, {', '.join(qx.QCOLS)} FROM nl WHERE origin <= cut - 20 UNION ALL SELECT '2001-02-01T08:00', mode, origin_yw, target_yw, h, median + 1, {', '.join(qx.QCOLS)} FROM nl WHERE origin >= cut - 20),
 lm AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY mode, origin_yw, target_yw ORDER BY run_at DESC) = 1)"""


def merged(spark, sf):
    l = logs(spark, sf)
    first = l.where("run_at < '2001-02'")
    return sc.merge_log(first, l.where("run_at >= '2001-02'"))


@query("g16_merge_log", chain(C_LOG, f"SELECT run_at, mode, origin_yw, target_yw, CAST(h AS BIGINT) AS h, {R('median', 5)} AS median FROM lm"))
def g16(spark, sf):
    return merged(spark, sf).select("run_at", "mode", "origin_yw", "target_yw", big("h").alias("h"), rnd("median", 5).alias("median"))


@query("g17_replace_origin", chain(C_LOG, """c AS (SELECT MAX(origin_yw) AS m FROM lg)""", f"""SELECT mode, origin_yw, CAST(h AS BIGINT) AS h, 'old' AS method, {R('median', 5)} AS median FROM lg, c WHERE run_at < '2001-02' AND origin_yw NOT IN (SELECT origin_yw FROM lg WHERE run_at >= '2001-02')
 UNION ALL SELECT mode, origin_yw, CAST(h AS BIGINT), 'new', {R('median', 5)} FROM lg WHERE run_at >= '2001-02'"""))
def g17(spark, sf):
    l = logs(spark, sf)
    new = l.where("run_at >= '2001-02'").withColumn("method", F.lit("new"))
    out = sc.replace_origin(l.where("run_at < '2001-02'"), new, {"method": "'old'"}, "origin_yw")
    return out.select("mode", "origin_yw", big("h").alias("h"), "method", rnd("median", 5).alias("median"))


C_EV = C_LOG + f""",
 act AS (SELECT {yw_idx_sql('week_idx')} AS yw, CAST(total AS DOUBLE) AS actual FROM nat WHERE total IS NOT NULL AND week_idx <= (SELECT MAX(week_idx) - 2 FROM nat)),
 ev AS (SELECT lm.*, actual, ABS(actual - median) AS abs_err, ABS(actual - median) / NULLIF(ABS(actual), 0) AS ape, actual >= q20 AND actual <= q80 AS in60, actual >= q10 AND actual <= q90 AS in80 FROM lm JOIN act ON act.yw = lm.target_yw WHERE origin_yw >= '199901')"""


def evaluated(spark, sf):
    n = national(spark, sf)
    panel = n.where(F.col("week_idx") <= n.agg(F.max("week_idx")).scalar() - 2)
    return sc.evaluate_log(merged(spark, sf), panel, ["total", "not_there"], "199901")


@query("g18_evaluate_log", chain(C_EV, f"SELECT mode, origin_yw, target_yw, CAST(h AS BIGINT) AS h, actual, {R('abs_err', 5)} AS abs_err, {R('ape', 5)} AS ape, in60, in80 FROM ev"))
def g18(spark, sf):
    return evaluated(spark, sf).select("mode", "origin_yw", "target_yw", big("h").alias("h"), "actual", rnd("abs_err", 5).alias("abs_err"), rnd("ape", 5).alias("ape"), "in60", "in80")


@query("g19_evaluation_summary", chain(C_EV, f"SELECT mode, 'total' AS target, CAST(h AS BIGINT) AS h, COUNT(*) AS n, {R('AVG(abs_err)', 5)} AS mae, {R('AVG(ape) * 100', 5)} AS mape, {R('AVG(CAST(in60 AS INTEGER))')} AS cov60, {R('AVG(CAST(in80 AS INTEGER))')} AS cov80 FROM ev GROUP BY 1, 3"))
def g19(spark, sf):
    s = sc.evaluation_summary(evaluated(spark, sf)).drop("wis")
    return rounded(s, "mae", "mape", digits=5).withColumns({"h": big("h"), "cov60": rnd("cov60"), "cov80": rnd("cov80")})
