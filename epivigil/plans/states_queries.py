"""Probabilities, epidemic periods, situation."""

from pyspark.sql import functions as F

from ..functions import quantiles as qx
from ..operators import alerts as al
from ..operators import calendar as cal
from ..operators import covariates as cov
from ..operators import period as pd
from .cases_queries import recent_snapshot
from .forecasting_queries import _live_cte, live
from .registry import R, big, chain, query, rnd, rounded, text
from .sources_queries import C_SNAP
from .testbed import (C_CPANEL, C_EW, C_SCORED, C_VISITS, any_rows, county_panel, early_warning, prob_sql, results, table, visits, yw_idx_sql, yw_sql)
from .weeks_queries import C_HOL, closures, holidays

_K = "county, model, CAST(origin AS BIGINT) AS origin, CAST(h AS BIGINT) AS h"


def _key(df, *cols):
    return df.select("county", "model", big("origin").alias("origin"), big("h").alias("h"), *cols)


@query("h1_prob_capped", chain(C_SCORED, f"SELECT {_K}, {R(prob_sql('3', 0.05, 'first'), 5)} AS p FROM bt"))
def h1(spark, sf):
    return _key(results(spark, sf), rnd(qx.prob_ge(qx.qcols(), F.lit(3.0)), 5).alias("p"))


@query("h2_prob_last_tie", chain(C_SCORED, f"SELECT {_K}, {R(prob_sql('3', 0.02, 'last'), 5)} AS p FROM bt"))
def h2(spark, sf):
    return _key(results(spark, sf), rnd(qx.prob_ge(qx.qcols(), F.lit(3.0), 0.02, "last"), 5).alias("p"))


C_PATH = f"""pp AS (SELECT county, model, origin, h, {prob_sql('3', 0.05, 'first')} AS p, y_origin >= 3 AS above, {yw_idx_sql('origin + h')} AS w FROM bt)"""


@query("h3_outlook", chain(C_SCORED, C_PATH, f"""SELECT county, model, CAST(origin AS BIGINT) AS origin, above AS above_now, CASE WHEN above THEN 'drop' ELSE 'exceed' END AS event, {R('CASE WHEN above THEN 1 - MIN(p) ELSE MAX(p) END', 3)} AS p,
 {R('CASE WHEN above THEN 1 - product(p) ELSE 1 - product(1 - p) END', 3)} AS p_indep, CASE WHEN above THEN MIN(CASE WHEN ROUND(p, 9) < 0.5 THEN w END) ELSE MIN(CASE WHEN ROUND(p, 9) >= 0.5 THEN w END) END AS first_week FROM pp GROUP BY county, model, origin, above"""))
def h3(spark, sf):
    r = results(spark, sf).withColumn("thr", F.lit(3.0))
    o = pd.outlook(r, ["county", "model", "origin"], "thr", "y_origin", "target_yw")
    return o.select("county", "model", big("origin").alias("origin"), "above_now", "event", rnd("p", 3).alias("p"), rnd("p_indep", 3).alias("p_indep"), "first_week")


@query("h4_any_crossing", chain(C_EW, f"SELECT model, series, CAST(origin AS VARCHAR) AS origin, {R('prob', 7)} AS prob, event, CAST(y AS DOUBLE) AS y FROM anyr"))
def h4(spark, sf):
    a = al.any_crossing(early_warning(spark, sf))
    return a.select("model", "series", text("origin").alias("origin"), rnd("prob", 7).alias("prob"), "event", "y")


def yearly_table(spark, sf):
    """A threshold per year: weekly mean of the county totals of the year, plus 1; 1999 is missing, 1997 has no number."""
    v = visits(spark, sf).groupBy(F.substring("yw", 1, 4).cast("int").alias("year")).agg(F.count("*").alias("n"))
    return v.where("year <> 1999").select("year", F.when(F.col("year") != 1997, F.floor(F.col("n") / 52 / 25) + 2).cast("double").alias("threshold"))


C_THRY = C_CPANEL + f""",
 ty AS (SELECT CAST(substr(yw, 1, 4) AS INTEGER) AS year, CASE WHEN CAST(substr(yw, 1, 4) AS INTEGER) <> 1997 THEN CAST(floor(COUNT(*) / 52.0 / 25) + 2 AS DOUBLE) END AS threshold FROM visits WHERE CAST(substr(yw, 1, 4) AS INTEGER) <> 1999 GROUP BY 1),
 th AS (SELECT county, week_idx, {yw_idx_sql('week_idx')} AS yw, total, CASE WHEN ty.year IS NOT NULL THEN threshold ELSE (SELECT arg_max(threshold, year) FROM ty) END AS thr
  FROM cpanel LEFT JOIN ty ON ty.year = CAST(substr({yw_idx_sql('week_idx')}, 1, 4) AS INTEGER))"""


def with_thresholds(spark, sf):
    p = county_panel(spark, sf).withColumn("yw", cal.yw_of_index(F.col("week_idx")))
    return pd.yearly_thresholds(p, yearly_table(spark, sf), F.substring("yw", 1, 4))


C_FLAGS = C_THRY + """,
 f0 AS (SELECT county, week_idx, yw, total, COALESCE(MAX(total >= thr) OVER (PARTITION BY county ORDER BY week_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), false) AS inp FROM th),
 fl AS (SELECT *, inp AND NOT COALESCE(LAG(inp) OVER w, false) AS entered, NOT inp AND COALESCE(LAG(inp) OVER w, false) AS exited FROM f0 WINDOW w AS (PARTITION BY county ORDER BY week_idx))"""


@query("h5_period_fixed", chain(C_FLAGS, "SELECT county, yw, inp AS in_period, entered, exited FROM fl"))
def h5(spark, sf):
    f = pd.fixed_threshold_flags(with_thresholds(spark, sf), ["county"], "total", "thr", "week_idx")
    return f.select("county", "yw", "in_period", "entered", "exited")


@query("h6_yearly_threshold", chain(C_THRY, "SELECT DISTINCT yw, thr FROM th"))
def h6(spark, sf):
    return with_thresholds(spark, sf).select("yw", "thr").distinct()


C_WAVE = C_CPANEL + """,
 ws AS (SELECT county, week_idx, CAST(total AS DOUBLE) AS v, row_number() OVER (PARTITION BY county ORDER BY week_idx) AS n FROM cpanel),
 wave AS (
  SELECT county, week_idx, n, v, v AS trough, v AS peak, 0 AS rises, 0 AS falls, (0 >= 3 AND v >= 2 * v) AS inp, false AS entered, false AS exited FROM ws WHERE n = 1
  UNION ALL
  SELECT county, week_idx, n, v, CASE WHEN was THEN CASE WHEN ext THEN v ELSE trough END ELSE LEAST(trough, v) END, CASE WHEN was THEN GREATEST(peak, v) WHEN ent THEN v ELSE peak END, r, f, CASE WHEN was THEN NOT ext ELSE ent END, NOT was AND ent, was AND ext FROM (
   SELECT *, NOT was AND r >= 3 AND v >= 2 * LEAST(trough, v) AS ent, was AND f >= 2 AND v < 0.5 * GREATEST(peak, v) AS ext FROM (
    SELECT s.county, s.week_idx, s.n, s.v, w.trough, w.peak, w.inp AS was, CASE WHEN s.v > w.v THEN w.rises + 1 ELSE 0 END AS r, CASE WHEN s.v < w.v THEN w.falls + 1 ELSE 0 END AS f
    FROM wave w JOIN ws s ON s.county = w.county AND s.n = w.n + 1)))"""


@query("h7_period_wave", chain(C_WAVE, f"SELECT county, {yw_idx_sql('week_idx')} AS yw, CASE WHEN inp THEN 0.5 * peak ELSE 2 * trough END AS level, trough, peak, CAST(rises AS BIGINT) AS rises, CAST(falls AS BIGINT) AS falls, inp AS in_period, entered, exited FROM wave", recursive=True))
def h7(spark, sf):
    f = pd.wave_flags(county_panel(spark, sf), ["county"], "total", "week_idx")
    return f.select("county", cal.yw_of_index(F.col("week_idx")).alias("yw"), "level", "trough", "peak", big("rises").alias("rises"), big("falls").alias("falls"), "in_period", "entered", "exited")


@query("h8_periods", chain(C_FLAGS, """i AS (SELECT *, SUM(CAST(entered AS INTEGER)) OVER w AS no, LAG(yw) OVER w AS prev FROM fl WINDOW w AS (PARTITION BY county ORDER BY week_idx))""",
 "SELECT county, MIN(CASE WHEN entered THEN yw END) AS entry, MIN(CASE WHEN exited THEN prev END) AS last_in_period FROM i WHERE no > 0 GROUP BY county, no"))
def h8(spark, sf):
    f = pd.fixed_threshold_flags(with_thresholds(spark, sf), ["county"], "total", "thr", "week_idx")
    return pd.periods(f, ["county"], "yw")


_LN = [f"LN(GREATEST(m{i}, GREATEST(m0, m1, m2, m3, m4) * 1e-3, 1e-9))" for i in range(5)]
C_SHAPE = f"""mp AS (SELECT county, model, origin, MIN(y_origin) AS m0, {', '.join(f'MIN(CASE WHEN h = {h} THEN q50 END) AS m{h}' for h in (1, 2, 3, 4))} FROM bt GROUP BY 1, 2, 3),
 sl AS (SELECT *, 100.0 * (EXP((-2 * {_LN[0]} - {_LN[1]} + {_LN[3]} + 2 * {_LN[4]}) / 10) - 1) AS slope, list_position([m1, m2, m3, m4], GREATEST(m1, m2, m3, m4)) - 1 AS it, list_position([m1, m2, m3, m4], LEAST(m1, m2, m3, m4)) - 1 AS il FROM mp)"""


@query("h9_path_shape", chain(C_SCORED, C_SHAPE, f"""SELECT county, model, CAST(origin AS BIGINT) AS origin, {R('slope', 4)} AS slope_pct, CASE WHEN it > 0 AND it < 3 AND GREATEST(m1, m2, m3, m4) >= GREATEST(m0, m4) * 1.05 THEN 'peak'
 WHEN il > 0 AND il < 3 AND LEAST(m1, m2, m3, m4) <= LEAST(m0, m4) * 0.95 THEN 'trough' WHEN slope >= 5 THEN 'up' WHEN slope >= 2 THEN 'slow_up' WHEN slope > -2 THEN 'flat' WHEN slope > -5 THEN 'slow_down' ELSE 'down' END AS kind FROM sl"""))
def h9(spark, sf):
    r = results(spark, sf)
    p = r.groupBy("county", "model", "origin").agg(F.first("y_origin").alias("m0"), *[F.max(F.when(F.col("h") == h, F.col("median"))).alias(f"m{h}") for h in (1, 2, 3, 4)])
    m = [F.col(f"m{h}") for h in (1, 2, 3, 4)]
    return p.select("county", "model", big("origin").alias("origin"), rnd(qx.slope_pct(F.col("m0"), m), 4).alias("slope_pct"), qx.path_shape(F.col("m0"), m).alias("kind"))


@query("h10_streak", chain(C_CPANEL, "r AS (SELECT county, total >= 1 AS ok, row_number() OVER (PARTITION BY county ORDER BY week_idx) AS n FROM cpanel)", "SELECT county, MAX(n) - COALESCE(MAX(CASE WHEN NOT ok THEN n END), 0) AS streak FROM r GROUP BY 1"))
def h10(spark, sf):
    return pd.streak(county_panel(spark, sf), ["county"], "week_idx", F.col("total") >= 1).withColumn("streak", big("streak"))


C_SIT = C_CPANEL + f""",
 s0 AS (SELECT county, week_idx, {yw_idx_sql('week_idx')} AS yw, CAST(total AS DOUBLE) AS v, row_number() OVER w AS n, COUNT(*) OVER (PARTITION BY county) AS m, LAG(total) OVER w AS p1, LAG(total, 3) OVER w AS p3, LAST_VALUE(total) OVER u AS cur, LAST_VALUE({yw_idx_sql('week_idx')}) OVER u AS cyw,
  AVG(total) OVER (PARTITION BY county ORDER BY week_idx ROWS 3 PRECEDING) AS a4, AVG(total) OVER (PARTITION BY county ORDER BY week_idx ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING) AS b4
  FROM cpanel WINDOW w AS (PARTITION BY county ORDER BY week_idx), u AS (PARTITION BY county ORDER BY week_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 s1 AS (SELECT county, MIN(cyw) AS yw, MAX(CASE WHEN n = m THEN v END) AS value, MAX(CASE WHEN n = m THEN p1 END) AS p1, MAX(CASE WHEN n = m THEN p3 END) AS p3, MAX(n) - COALESCE(MAX(CASE WHEN NOT COALESCE(v > p1, false) THEN n END), 0) AS rising,
  MAX(n) - COALESCE(MAX(CASE WHEN NOT COALESCE(v < p1, false) THEN n END), 0) AS falling, AVG(CASE WHEN substr(yw, 5, 2) = substr(cyw, 5, 2) AND CAST(substr(yw, 1, 4) AS INTEGER) BETWEEN CAST(substr(cyw, 1, 4) AS INTEGER) - 3 AND CAST(substr(cyw, 1, 4) AS INTEGER) - 1 THEN v END) AS same,
  100 * AVG(CASE WHEN v < cur THEN 1 ELSE 0 END) AS pr, MAX(CASE WHEN n = m THEN a4 END) AS a4, MAX(CASE WHEN n = m THEN b4 END) AS b4 FROM s0 GROUP BY county)"""


@query("h11_situation", chain(C_SIT, f"""SELECT county, yw, value, {R('100.0 * (value / NULLIF(CAST(p1 AS DOUBLE), 0) - 1)', 5)} AS wow_pct, {R('100.0 * (value / NULLIF(CAST(p3 AS DOUBLE), 0) - 1)', 5)} AS w3_pct, rising, falling, {R('same', 5)} AS same_week_mean, {R('pr', 5)} AS pct_rank,
 {R('a4', 5)} AS last4, {R('b4', 5)} AS prev4, {R('CASE WHEN b4 > 0 THEN 100.0 * (a4 / b4 - 1) ELSE 0 END', 5)} AS change4_pct FROM s1"""))
def h11(spark, sf):
    p = county_panel(spark, sf).select("county", "week_idx", F.col("total").cast("double").alias("v"), cal.yw_of_index(F.col("week_idx")).alias("yw"))
    s = pd.situation(p, ["county"], "v")
    return rounded(s, "wow_pct", "w3_pct", "same_week_mean", "pct_rank", "last4", "prev4", "change4_pct", digits=5).withColumns({"rising": big("rising"), "falling": big("falling")})


@query("h11b_trend_source", chain(C_SIT, "nat AS (SELECT DISTINCT week_idx FROM cpanel)", C_HOL, f"hp AS (SELECT {yw_idx_sql('week_idx')} AS yw, holiday_days + COALESCE(LAG(holiday_days) OVER (ORDER BY week_idx), 0) AS d FROM hwk)",
 "SELECT s1.county, CASE WHEN d > 0 THEN 'rate' ELSE 'count' END AS trend_from FROM s1 LEFT JOIN hp ON hp.yw = s1.yw"))
def h11b(spark, sf):
    from pyspark.sql import Window as W

    from .weeks_queries import holiday_table

    p = county_panel(spark, sf).select("county", "week_idx", F.col("total").cast("double").alias("v"), (F.col("cases") / F.nullif(F.col("total"), F.lit(0))).alias("r"), cal.yw_of_index(F.col("week_idx")).alias("yw"))
    h = holiday_table(spark, sf).select("yw", "holiday_days", F.coalesce(F.lag("holiday_days").over(W.orderBy("week_start")), F.lit(0.0)).alias("previous_days"))
    t = pd.trend_source(pd.situation(p, ["county"], "v"), pd.situation(p, ["county"], "r"), h, ["county"])
    return t.select("county", "trend_from")


@query("h12_latest_payload", chain(C_CPANEL, _live_cte(), f"""l AS (SELECT county, COUNT(*) FILTER (rn <= 130) AS n_history, CAST(MAX(CASE WHEN rn = 1 THEN total END) AS DOUBLE) AS last_observed, CAST(SUM(CASE WHEN rn <= 130 THEN total END) AS DOUBLE) AS hist_sum FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY week_idx DESC) AS rn FROM cpanel) GROUP BY 1),
 f AS (SELECT county, {R('SUM(ROUND(q50, 3))', 3)} AS fsum, COUNT(*) AS nf FROM lv WHERE model = 'naive' GROUP BY 1)""", "SELECT l.county, n_history, last_observed, hist_sum, fsum, nf FROM l JOIN f ON f.county = l.county"))
def h12(spark, sf):
    p = county_panel(spark, sf).select("county", "week_idx", F.col("total").cast("double").alias("v"), cal.yw_of_index(F.col("week_idx")).alias("yw"))
    j = pd.latest_payload(p, live(spark, sf).where("model = 'naive'"), ["county"], "v")
    parsed = F.from_json("payload", "struct<history:array<struct<yw:string,y:double>>,forecast:array<struct<h:int,median:double>>>")
    tot = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    j = j.withColumn("_p", parsed)
    return j.select("county", big("n_history").alias("n_history"), "last_observed", tot(F.col("_p.history.y")).alias("hist_sum"), rnd(tot(F.col("_p.forecast.median")), 3).alias("fsum"), F.size("_p.forecast").cast("long").alias("nf"))


C_TIER = C_EW + """,
 lastd AS (SELECT MAX(origin) AS d FROM anyr), sn AS (SELECT county || '|' || township AS series, onset AS date, COUNT(*) FILTER (NOT imported AND delay < 20) AS confirmed, COUNT(*) FILTER (NOT imported AND delay >= 20) AS pending FROM ll GROUP BY 1, 2),
 rs AS (SELECT series, SUM(CASE WHEN d - date < 7 THEN confirmed ELSE 0 END) AS known7, SUM(CASE WHEN d - date < 14 THEN confirmed ELSE 0 END) AS confirmed14, SUM(CASE WHEN d - date < 14 THEN pending ELSE 0 END) AS pending14 FROM sn, lastd WHERE date <= d GROUP BY 1),
 tr AS (SELECT a.series, prob, thr, known7, confirmed14, pending14, CASE WHEN prob >= 0.4 THEN 'alert' WHEN prob >= 0.3 THEN 'watch' ELSE '' END AS tier, known7 >= thr AS rule_now FROM anyr a JOIN rs ON rs.series = a.series, lastd WHERE a.origin = d AND model = 'naive')"""


def live_tiers(spark, sf):
    from ..operators import linelist as ll

    a = any_rows(spark, sf).where("model = 'naive'")
    last = a.agg(F.max("origin")).scalar()
    s = ll.recent_summary(recent_snapshot(spark, sf), last)
    return al.tiers(a.where(F.col("origin") == last).join(s, "series"), prob="prob")


@query("h13_tiers", chain(C_TIER, f"SELECT series, {R('prob', 4)} AS prob, tier, rule_now, CAST(known7 AS BIGINT) AS known7 FROM tr"))
def h13(spark, sf):
    return live_tiers(spark, sf).select("series", rnd("prob", 4).alias("prob"), "tier", "rule_now", "known7")


@query("h13b_county_rollup", chain(C_TIER, "SELECT split_part(series, '|', 1) AS county, CAST(SUM(confirmed14) AS BIGINT) AS confirmed14, CAST(SUM(pending14) AS BIGINT) AS pending14, CAST(SUM(known7) AS BIGINT) AS known7, COUNT(*) FILTER (tier = 'watch') AS n_watch, COUNT(*) FILTER (tier = 'alert') AS n_alert FROM tr GROUP BY 1"))
def h13b(spark, sf):
    return al.county_rollup(live_tiers(spark, sf))


@query("h14_composition", chain(C_VISITS, "g AS (SELECT age, week_idx, yw, SUM(total) AS n FROM visits GROUP BY 1, 2, 3), l AS (SELECT *, LAG(n, 4) OVER (PARTITION BY age ORDER BY week_idx) AS b FROM g), z AS (SELECT * FROM l WHERE week_idx = (SELECT MAX(week_idx) FROM g))",
 f"SELECT yw, age, CAST(n AS BIGINT) AS n, {R('100.0 * n / SUM(n) OVER ()', 5)} AS share_pct, {R('100.0 * (n / GREATEST(COALESCE(b, 1), 1) - 1)', 5)} AS change_pct, {R(chr(49) + '00.0 * SUM(CASE WHEN age IN (' + chr(39) + '1-URGENT' + chr(39) + ', ' + chr(39) + '2-HIGH' + chr(39) + ') THEN n ELSE 0 END) OVER () / SUM(n) OVER ()', 5)} AS selected_pct FROM z"))
def h14(spark, sf):
    g = visits(spark, sf).groupBy("age", "week_idx", "yw").agg(F.sum("total").alias("n"))
    c = pd.composition(g, "age", "n", ["1-URGENT", "2-HIGH"])
    return rounded(c, "share_pct", "change_pct", "selected_pct", digits=5)


@query("h15_calendar_tags", chain(C_CPANEL, "nat AS (SELECT DISTINCT week_idx FROM cpanel)", C_HOL, _live_cte(), """lw AS (SELECT DISTINCT county, h, DATE '1970-01-04' + CAST(7 * (origin + h) AS INTEGER) AS ws, DATE '1970-01-04' + CAST(7 * origin AS INTEGER) AS os FROM lv)""",
 f"""SELECT county, CAST(h AS BIGINT) AS h, CAST(ws AS VARCHAR) AS week_start, (SELECT string_agg(DISTINCT name || 'public', ',' ORDER BY name || 'public') FROM hol WHERE pub AND date BETWEEN ws AND ws + 6) AS holiday_names,
 (SELECT string_agg(DISTINCT name, ',') FROM clo WHERE date BETWEEN os - 14 AND os + 6) AS recent_closures FROM lw"""))
def h15(spark, sf):
    f = live(spark, sf).where("model = 'naive'")
    t = cov.horizon_tags(f, holidays(spark, sf), closures(spark, sf))
    return t.select("county", big("h").alias("h"), text("week_start").alias("week_start"), "holiday_names", "recent_closures")
