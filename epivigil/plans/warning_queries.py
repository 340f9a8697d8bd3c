"""Detectors and alert evaluation."""

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..operators import alerts as al
from ..operators import detectors as dt
from ..operators import linelist as ll
from ..operators import nowcast as nc
from ..operators import ranks
from .registry import R, big, chain, query, rnd, rounded, text
from .testbed import C_DAILY, C_EP, C_EW, C_ORIGINS, CITIES, GRID, any_rows, daily, early_warning, episodes, histogram, daily_origins, stored, weeks

_DB = """db AS (SELECT series, day, n, row_number() OVER w - 1 AS t, AVG(n) OVER f AS mu, GREATEST(stddev_pop(n) OVER f, 0.5) AS sd FROM daily
  WINDOW w AS (PARTITION BY series ORDER BY day), f AS (PARTITION BY series ORDER BY day ROWS BETWEEN 63 PRECEDING AND 8 PRECEDING))"""
C_DET = C_DAILY + ",\n" + _DB
_EZ = """ez AS (SELECT series, day, t, CAST(n AS DOUBLE) AS z, false AS alarm FROM db WHERE t = 0 UNION ALL
  SELECT b.series, b.day, b.t, 0.3 * b.n + 0.7 * e.z, b.t >= 63 AND 0.3 * b.n + 0.7 * e.z > b.mu + 3 * b.sd FROM ez e JOIN db b ON b.series = e.series AND b.t = e.t + 1)"""
_CZ = """cz AS (SELECT series, day, t, CAST(0 AS DOUBLE) AS s, false AS alarm FROM db WHERE t = 0 UNION ALL
  SELECT series, day, t, s, s > 4 FROM (SELECT b.series, b.day, b.t, CASE WHEN b.t >= 63 THEN GREATEST(0, (CASE WHEN c.alarm THEN 0 ELSE c.s END) + (b.n - b.mu) / b.sd - 0.5) ELSE 0 END AS s FROM cz c JOIN db b ON b.series = c.series AND b.t = c.t + 1))"""

C_EWMA, C_CUSUM = C_DET + ",\n" + _EZ, C_DET + ",\n" + _CZ


def ewma(spark, sf):
    return stored(spark, sf, "ewma", lambda: dt.ewma(daily(spark, sf).select("series", "day", "n"), ["series"], "n", "day"))


def cusum(spark, sf):
    return stored(spark, sf, "cusum", lambda: dt.cusum(daily(spark, sf).select("series", "day", "n"), ["series"], "n", "day"))


@query("i1_ewma", chain(C_EWMA, f"SELECT series, CAST(day AS VARCHAR) AS day, {R('z', 5)} AS z, alarm FROM ez", recursive=True))
def i1(spark, sf):
    return ewma(spark, sf).select("series", text("day").alias("day"), rnd("z", 5).alias("z"), "alarm")


@query("i2_cusum", chain(C_CUSUM, f"SELECT series, CAST(day AS VARCHAR) AS day, {R('s', 5)} AS s, alarm FROM cz", recursive=True))
def i2(spark, sf):
    return cusum(spark, sf).select("series", text("day").alias("day"), rnd("s", 5).alias("s"), "alarm")


@query("i3_episodes", chain(C_DAILY, C_EP, f"SELECT series, CAST(day AS VARCHAR) AS day, s7, {R('thr')} AS thr FROM ep"))
def i3(spark, sf):
    return episodes(spark, sf).select("series", text("day").alias("day"), "s7", rnd("thr").alias("thr"))


@query("i4_site_weeks", chain(C_EW, f"SELECT model, series, CAST(week AS VARCHAR) AS week, {R('prob', 5)} AS prob, event, {R('thr_max', 5)} AS thr_max, region, etype FROM wks"))
def i4(spark, sf):
    return weeks(spark, sf).select("model", "series", text("week").alias("week"), rnd("prob", 5).alias("prob"), "event", rnd("thr_max", 5).alias("thr_max"), "region", "etype")


_RATE = [("sensitivity", "tp / NULLIF(CAST(tp + fn AS DOUBLE), 0)"), ("false_alarm_per100", "100.0 * fp / NULLIF(fp + tn, 0)"), ("ppv", "tp / NULLIF(CAST(tp + fp AS DOUBLE), 0)")]
_RS = ", ".join(f"{R(e)} AS {k}" for k, e in _RATE)


def _conf(p):
    return f"COUNT(*) FILTER (prob >= {p} AND event) AS tp, COUNT(*) FILTER (prob >= {p} AND NOT event) AS fp, COUNT(*) FILTER (prob < {p} AND event) AS fn, COUNT(*) FILTER (prob < {p} AND NOT event) AS tn"


@query("i5_alert_metrics", chain(C_EW, f"c AS (SELECT model, {_conf(0.3)} FROM wks GROUP BY 1)", f"SELECT model, tp, fp, fn, tn, tp + fp AS alerts, {_RS} FROM c"))
def i5(spark, sf):
    m = al.metrics(weeks(spark, sf), ["model"], F.col("prob") >= 0.3, F.col("event"))
    return rounded(m, "sensitivity", "false_alarm_per100", "ppv")


_GRID = "(SELECT unnest([" + ", ".join(str(p) for p in GRID) + "]) AS p_star)"
C_SWEEP = f"""swc AS (SELECT model, p_star, COUNT(*) FILTER (prob >= p_star AND event) AS tp, COUNT(*) FILTER (prob >= p_star AND NOT event) AS fp, COUNT(*) FILTER (prob < p_star AND event) AS fn, COUNT(*) FILTER (prob < p_star AND NOT event) AS tn FROM wks CROSS JOIN {_GRID} GROUP BY 1, 2),
 sw AS (SELECT model, CAST(p_star AS DOUBLE) AS p_star, tp, fp, fn, tn, tp + fp AS alerts, tp / NULLIF(CAST(tp + fn AS DOUBLE), 0) AS sensitivity, 100.0 * fp / NULLIF(fp + tn, 0) AS false_alarm_per100, tp / NULLIF(CAST(tp + fp AS DOUBLE), 0) AS ppv, tp + fp + fn + tn AS n_weeks, tp + fn AS event_weeks FROM swc)"""


def sweep(spark, sf):
    return stored(spark, sf, "sweep", lambda: al.sweep(weeks(spark, sf), ["model"], GRID))


@query("i6_sweep", chain(C_EW, C_SWEEP, f"SELECT model, p_star, tp, fp, fn, tn, {R('alerts / CAST(n_weeks AS DOUBLE)')} AS alert_rate, {R('sensitivity')} AS sensitivity, {R('false_alarm_per100')} AS false_alarm_per100, {R('ppv')} AS ppv FROM sw"))
def i6(spark, sf):
    s = sweep(spark, sf).select("model", "p_star", "tp", "fp", "fn", "tn", "alert_rate", "sensitivity", "false_alarm_per100", "ppv")
    return rounded(s, "alert_rate", "sensitivity", "false_alarm_per100", "ppv")


def _auc_cte(src, by, name, score="prob"):
    return f"""{name}_r AS (SELECT {by}, event, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (COUNT(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS r FROM {src}),
 {name} AS (SELECT {by}, (SUM(CASE WHEN event THEN r END) - COUNT(*) FILTER (event) * (COUNT(*) FILTER (event) + 1) / 2.0) / NULLIF(CAST(COUNT(*) FILTER (event) AS DOUBLE) * COUNT(*) FILTER (NOT event), 0) AS auc, COUNT(*) AS n, COUNT(*) FILTER (event) AS n_event FROM {name}_r GROUP BY {by})"""


@query("i7_auc", chain(C_EW, "wr AS (SELECT model, event, ROUND(prob, 9) AS prob FROM wks)", _auc_cte("wr", "model", "au"), f"SELECT model, {R('auc')} AS auc, n, n_event FROM au"))
def i7(spark, sf):
    w = weeks(spark, sf).withColumn("prob", F.round("prob", 9))
    return rounded(ranks.auc(w, ["model"]), "auc")


@query("i8_strata", chain(C_EW, "wr AS (SELECT model, region, etype, event, ROUND(prob, 9) AS prob FROM wks)", _auc_cte("wr", "model, region, etype", "au"), f"c AS (SELECT model, region, etype, {_conf(0.3)} FROM wks GROUP BY 1, 2, 3)",
 f"SELECT c.model, c.region, c.etype, tp, fp, fn, tn, {_RS}, {R('auc')} AS auc FROM c JOIN au ON au.model = c.model AND au.region = c.region AND au.etype = c.etype"))
def i8(spark, sf):
    by = ["model", "region", "etype"]
    w = weeks(spark, sf).withColumn("prob", F.round("prob", 9))
    m = al.metrics(weeks(spark, sf), by, F.col("prob") >= 0.3, F.col("event")).drop("alerts")
    return rounded(m.join(ranks.auc(w, by).select(*by, "auc"), by), "sensitivity", "false_alarm_per100", "ppv", "auc")


C_LEADS = f"""kinds AS (SELECT DISTINCT mode, model FROM anyr),
 lj AS (SELECT k.mode, k.model, e.series, e.day, a.prob, e.day - a.origin AS k FROM ep e CROSS JOIN kinds k LEFT JOIN anyr a ON a.mode = k.mode AND a.model = k.model AND a.series = e.series AND a.origin >= e.day - 14 AND a.origin < e.day),
 leads AS (SELECT mode, model, series, day, CAST(p_star AS DOUBLE) AS p_star, MAX(CASE WHEN prob >= p_star THEN k END) AS lead FROM lj CROSS JOIN {_GRID} GROUP BY ALL)"""


def leads(spark, sf):
    return stored(spark, sf, "leads", lambda: al.model_leads(episodes(spark, sf), any_rows(spark, sf), GRID))


@query("i9_lead_times", chain(C_EW, C_EP, C_LEADS, "SELECT model, series, CAST(day AS VARCHAR) AS day, p_star, CAST(lead AS BIGINT) AS lead FROM leads"))
def i9(spark, sf):
    return leads(spark, sf).select("model", "series", text("day").alias("day"), "p_star", big("lead").alias("lead"))


C_DLEAD = """dl AS (SELECT 'cusum' AS method, e.series, e.day, MAX(e.day - c.day) AS lead FROM ep e LEFT JOIN cz c ON c.series = e.series AND c.alarm AND c.day BETWEEN e.day - 14 AND e.day GROUP BY 2, 3
  UNION ALL SELECT 'ewma', e.series, e.day, MAX(e.day - c.day) FROM ep e LEFT JOIN ez c ON c.series = e.series AND c.alarm AND c.day BETWEEN e.day - 14 AND e.day GROUP BY 2, 3)"""
C_BOTH = C_DET + ",\n" + _EZ + ",\n" + _CZ


def alarms(spark, sf):
    a = ewma(spark, sf).select(F.lit("ewma").alias("method"), "series", "day", "alarm")
    return a.unionByName(cusum(spark, sf).select(F.lit("cusum").alias("method"), "series", "day", "alarm"))


def detector_leads(spark, sf):
    return stored(spark, sf, "detector_leads", lambda: al.flag_leads(episodes(spark, sf), alarms(spark, sf), "day", "alarm", 14, 0, ["method"]))


@query("i10_detector_leads", chain(C_BOTH, C_EP, C_DLEAD, "SELECT method, series, CAST(day AS VARCHAR) AS day, CAST(lead AS BIGINT) AS lead FROM dl", recursive=True))
def i10(spark, sf):
    return detector_leads(spark, sf).select("method", "series", text("day").alias("day"), big("lead").alias("lead"))


_LS = f"COUNT(*) AS n, {R('AVG(CASE WHEN lead IS NOT NULL THEN 1 ELSE 0 END)')} AS detected, CAST(quantile_cont(lead, 0.5) AS DOUBLE) AS lead_median, {R('AVG(CASE WHEN lead >= 3 THEN 1 ELSE 0 END)')} AS ge3, {R('AVG(CASE WHEN lead IS NOT NULL THEN CASE WHEN lead >= 3 THEN 1 ELSE 0 END END)')} AS ge3_of_detected"


@query("i11_lead_summary", chain(C_EW, C_EP, C_LEADS, f"SELECT model, p_star, {_LS} FROM leads GROUP BY 1, 2"))
def i11(spark, sf):
    return rounded(al.lead_summary(leads(spark, sf), ["model", "p_star"]), "detected", "ge3", "ge3_of_detected")


C_FA = """als AS (SELECT 'cusum' AS method, series, day, alarm FROM cz UNION ALL SELECT 'ewma', series, day, alarm FROM ez),
 fw AS (SELECT method, series, date_trunc('week', day) AS week, MAX(alarm) AS alarm FROM als a WHERE month(day) >= 6 AND NOT EXISTS (SELECT 1 FROM ep e WHERE e.series = a.series AND a.day BETWEEN e.day - 14 AND e.day + 14) GROUP BY 1, 2, 3),
 fa AS (SELECT method, COUNT(*) AS n_weeks, COUNT(*) FILTER (alarm) AS false_weeks, 100.0 * COUNT(*) FILTER (alarm) / COUNT(*) AS false_per100 FROM fw GROUP BY 1)"""


def false_alarms(spark, sf):
    return stored(spark, sf, "false_alarms", lambda: al.detector_false_alarms(alarms(spark, sf), episodes(spark, sf), season=F.month("day") >= 6))


@query("i12_detector_false_alarms", chain(C_BOTH, C_EP, C_FA, f"SELECT method, n_weeks, false_weeks, {R('false_per100')} AS false_per100 FROM fa", recursive=True))
def i12(spark, sf):
    return rounded(false_alarms(spark, sf), "false_per100")


_EWALL = C_EW + ",\n" + _DB + ",\n" + _EZ + ",\n" + _CZ


@query("i13_matched_points", chain(_EWALL, C_EP, C_FA, C_SWEEP, f"""SELECT * EXCLUDE (rn) FROM (SELECT s.model, f.method, {R('f.false_per100')} AS false_per100, s.p_star, {R('s.sensitivity')} AS sensitivity, {R('s.false_alarm_per100')} AS false_alarm_per100, {R('s.ppv')} AS ppv,
 row_number() OVER (PARTITION BY s.model, f.method ORDER BY COALESCE(s.sensitivity, -1) DESC, s.p_star) AS rn FROM sw s JOIN fa f ON s.false_alarm_per100 <= f.false_per100) WHERE rn = 1""", recursive=True))
def i13(spark, sf):
    m = al.matched_points(sweep(spark, sf), false_alarms(spark, sf), ["model"])
    return rounded(m, "false_per100", "sensitivity", "false_alarm_per100", "ppv")


BUDGETS = [0.05, 2.0, 10.0, 30.0]


@query("i14_equal_budget", chain(C_EW, C_EP, C_LEADS, "wkr AS (SELECT * REPLACE (ROUND(prob, 9) AS prob) FROM wks)", C_SWEEP.replace("FROM wks", "FROM wkr"), "wr AS (SELECT model, event, ROUND(prob, 9) AS prob FROM wks)", _auc_cte("wr", "model", "au"), f"bu AS (SELECT unnest({BUDGETS}) AS budget)",
 "pick AS (SELECT * FROM (SELECT s.*, b.budget, row_number() OVER (PARTITION BY s.model, b.budget ORDER BY COALESCE(s.sensitivity, -1) DESC, s.p_star) AS rn FROM sw s JOIN bu b ON s.false_alarm_per100 <= b.budget) WHERE rn = 1)",
 "lsum AS (SELECT model, p_star, AVG(CASE WHEN lead IS NOT NULL THEN 1 ELSE 0 END) AS detected, quantile_cont(lead, 0.5) AS lead_median FROM leads GROUP BY 1, 2)",
 f"""SELECT m.model, CAST(b.budget AS DOUBLE) AS budget, {R('au.auc')} AS auc, p.p_star, {R('COALESCE(p.sensitivity, CASE WHEN p.model IS NULL THEN 0 END)')} AS sensitivity, {R('COALESCE(p.false_alarm_per100, CASE WHEN p.model IS NULL THEN 0 END)')} AS false_alarm_per100, {R('CASE WHEN p.model IS NULL THEN 0 ELSE l.detected END')} AS detected, CAST(l.lead_median AS DOUBLE) AS lead_median
 FROM (SELECT DISTINCT model FROM sw) m CROSS JOIN bu b LEFT JOIN pick p ON p.model = m.model AND p.budget = b.budget LEFT JOIN lsum l ON l.model = m.model AND l.p_star = p.p_star JOIN au ON au.model = m.model"""))
def i14(spark, sf):
    w = weeks(spark, sf).withColumn("prob", F.round("prob", 9))
    e = al.equal_budget(w, leads(spark, sf), ["model"], BUDGETS, GRID)
    return rounded(e.select("model", "budget", "auc", "p_star", "sensitivity", "false_alarm_per100", "detected", "lead_median"), "auc", "sensitivity", "false_alarm_per100", "detected")


@query("i15_stratified_wis", chain(C_EW, f"""SELECT model, CASE WHEN split_part(series, '|', 1) IN ('AFRICA', 'AMERICA') THEN 'focus' ELSE 'other' END AS region, CASE WHEN thr_final <= 3 THEN 'first_cluster' ELSE 'accelerating' END AS etype, {R('AVG(wis)', 5)} AS wis, {R('AVG(CAST(cov80 AS INTEGER))', 5)} AS cov80, COUNT(*) AS n FROM ew WHERE h = 7 GROUP BY 1, 2, 3"""))
def i15(spark, sf):
    e = al.add_strata(early_warning(spark, sf), CITIES, thr="thr_final")
    return rounded(al.stratified_wis(e, ["model", "region", "etype"]), "wis", "cov80", digits=5)


PAIRS = [(w, a) for w in (0.2, 0.3, 0.4) for a in (0.4, 0.5, 0.6) if a > w]
_TIER_COLS = ["watch_flags_per_site_week", "alert_orders_per_site_week", "watch_only_per_site_week", "alert_orders_week", "false_orders_week", "watch_sensitivity", "alert_sensitivity", "alert_ppv", "alert_false_per100",
              "watch_false_per100", "events_detected_watch", "events_detected_alert", "lead_median_watch", "lead_median_alert", "watch_earlier_than_alert", "days_watch_to_alert_mean", "days_watch_to_alert_median_if_earlier", "watch_only_events_detected"]
C_TWO = f"""pr AS (SELECT w, a FROM (VALUES {', '.join(f'({w}::DOUBLE, {a}::DOUBLE)' for w, a in PAIRS)}) v(w, a)),
 wl AS (SELECT w, a, AVG(CASE WHEN prob >= w THEN 1 ELSE 0 END) AS watch_flags_per_site_week, AVG(CASE WHEN prob >= a THEN 1 ELSE 0 END) AS alert_orders_per_site_week, AVG(CASE WHEN prob >= w AND prob < a THEN 1 ELSE 0 END) AS watch_only_per_site_week, 20 * AVG(CASE WHEN prob >= a THEN 1 ELSE 0 END) AS alert_orders_week,
  20 * AVG(CASE WHEN prob >= a AND NOT event THEN 1 ELSE 0 END) AS false_orders_week, COUNT(*) FILTER (prob >= w AND event) / CAST(GREATEST(COUNT(*) FILTER (event), 1) AS DOUBLE) AS watch_sensitivity, COUNT(*) FILTER (prob >= a AND event) / CAST(GREATEST(COUNT(*) FILTER (event), 1) AS DOUBLE) AS alert_sensitivity,
  COUNT(*) FILTER (prob >= a AND event) / CAST(GREATEST(COUNT(*) FILTER (prob >= a), 1) AS DOUBLE) AS alert_ppv, 100.0 * COUNT(*) FILTER (prob >= a AND NOT event) / GREATEST(COUNT(*) FILTER (NOT event), 1) AS alert_false_per100, 100.0 * COUNT(*) FILTER (prob >= w AND NOT event) / GREATEST(COUNT(*) FILTER (NOT event), 1) AS watch_false_per100
  FROM wks CROSS JOIN pr WHERE model = 'naive' GROUP BY 1, 2),
 l2 AS (SELECT pr.w, pr.a, x.lead AS lw, y.lead AS la FROM pr JOIN leads x ON x.p_star = pr.w AND x.model = 'naive' JOIN leads y ON y.p_star = pr.a AND y.model = 'naive' AND y.series = x.series AND y.day = x.day),
 es AS (SELECT w, a, AVG(CASE WHEN lw IS NOT NULL THEN 1 ELSE 0 END) AS events_detected_watch, AVG(CASE WHEN la IS NOT NULL THEN 1 ELSE 0 END) AS events_detected_alert, quantile_cont(lw, 0.5) AS lead_median_watch, quantile_cont(la, 0.5) AS lead_median_alert, AVG(CASE WHEN lw > la THEN 1 WHEN lw <= la THEN 0 END) AS watch_earlier_than_alert,
  AVG(lw - la) AS days_watch_to_alert_mean, quantile_cont(CASE WHEN lw > la THEN lw - la END, 0.5) AS days_watch_to_alert_median_if_earlier, AVG(CASE WHEN lw IS NOT NULL AND la IS NULL THEN 1 ELSE 0 END) AS watch_only_events_detected FROM l2 GROUP BY 1, 2)"""


def tiers(spark, sf):
    return stored(spark, sf, "tiers", lambda: al.two_tier(weeks(spark, sf).where("model = 'naive'"), leads(spark, sf).where("model = 'naive'"), PAIRS))


@query("i22_two_tier", chain(C_EW, C_EP, C_LEADS, C_TWO, f"SELECT wl.w AS watch_p, wl.a AS alert_p, {', '.join(f'{R(c, 5)} AS {c}' for c in _TIER_COLS)} FROM wl JOIN es ON es.w = wl.w AND es.a = wl.a"))
def i22(spark, sf):
    return rounded(tiers(spark, sf).select("watch_p", "alert_p", *_TIER_COLS), *_TIER_COLS, digits=5)


@query("i23_cost_loss", chain(C_EW, C_SWEEP, f"c AS (SELECT unnest([0.12, 0.2, 0.34, 0.5]) AS c), n AS (SELECT CAST(c AS DOUBLE) AS c_over_l, s.*, row_number() OVER (PARTITION BY c ORDER BY ROUND(ABS(p_star - c), 9), p_star) AS rn FROM sw s CROSS JOIN c WHERE model = 'naive')",
 f"SELECT c_over_l, p_star AS nearest_p, {R('sensitivity')} AS sensitivity, {R('false_alarm_per100')} AS false_alarm_per100, {R('ppv')} AS ppv FROM n WHERE rn = 1"))
def i23(spark, sf):
    c = al.cost_loss(sweep(spark, sf).where("model = 'naive'"), (0.12, 0.2, 0.34, 0.5))
    return rounded(c, "sensitivity", "false_alarm_per100", "ppv")


@query("i24_recommended_pair", chain(C_EW, C_EP, C_LEADS, C_TWO, "ok AS (SELECT * FROM wl WHERE ABS(w - 0.3) < 1e-9 AND false_orders_week <= 0.5)", f"""x AS (SELECT 1 AS o, * FROM (SELECT * FROM ok ORDER BY alert_sensitivity DESC, w, a LIMIT 1) UNION ALL SELECT 2, * FROM (SELECT * FROM wl ORDER BY false_orders_week, w, a LIMIT 1))""",
 f"SELECT w AS watch_p, a AS alert_p, {R('alert_sensitivity', 5)} AS alert_sensitivity, {R('false_orders_week', 5)} AS false_orders_week FROM x ORDER BY o LIMIT 1"))
def i24(spark, sf):
    return rounded(al.recommended_pair(tiers(spark, sf)), "alert_sensitivity", "false_orders_week", digits=5)


_PRAC = "COUNT(DISTINCT series) AS sites, COUNT(*) AS site_weeks, COUNT(*) FILTER (prob >= p) AS alert_weeks, COUNT(*) FILTER (prob >= p AND event) AS true_weeks, COUNT(*) FILTER (prob >= p AND NOT event) AS false_weeks, COUNT(*) FILTER (event) AS event_weeks, COUNT(*) FILTER (prob < p AND event) AS missed_weeks"
C_PRAC = f"pc AS (SELECT CAST(p AS DOUBLE) AS p_star, region, etype, CAST(year AS BIGINT) AS year, {_PRAC} FROM wks CROSS JOIN (SELECT unnest([0.3, 0.5]) AS p) WHERE model = 'naive' GROUP BY 1, 2, 3, 4)"


@query("i25_practical_counts", chain(C_EW, C_PRAC, "SELECT * FROM pc"))
def i25(spark, sf):
    return al.practical_counts(weeks(spark, sf).where("model = 'naive'"), (0.3, 0.5)).withColumn("year", big("year"))


@query("i25b_season_means", chain(C_EW, C_PRAC, "SELECT p_star, region, etype, COUNT(*) AS seasons, MAX(sites) AS sites, " + ", ".join(f"{R(f'AVG({c})')} AS {c}" for c in ("alert_weeks", "true_weeks", "false_weeks", "event_weeks", "missed_weeks")) + " FROM pc GROUP BY 1, 2, 3"))
def i25b(spark, sf):
    m = al.season_means(al.practical_counts(weeks(spark, sf).where("model = 'naive'"), (0.3, 0.5)))
    return rounded(m, "alert_weeks", "true_weeks", "false_weeks", "event_weeks", "missed_weeks")


@query("i26_rules_vs_model", chain(C_EW, "rr AS (SELECT region, m.method, event, CASE m.method WHEN 'count>=1' THEN raw7 >= 1 WHEN 'count>=5' THEN raw7 >= 5 WHEN 'p>=0.3' THEN prob >= 0.3 ELSE prob >= 0.5 END AS flag FROM wks CROSS JOIN (SELECT unnest(['count>=1', 'count>=5', 'p>=0.3', 'p>=0.5']) AS method) m WHERE model = 'naive')",
 "c AS (SELECT region, method, COUNT(*) FILTER (flag AND event) AS tp, COUNT(*) FILTER (flag AND NOT event) AS fp, COUNT(*) FILTER (NOT flag AND event) AS fn, COUNT(*) FILTER (NOT flag AND NOT event) AS tn FROM rr GROUP BY 1, 2)",
 "wn AS (SELECT region, event, raw7 FROM wks WHERE model = 'naive')", _auc_cte("wn", "region", "au", "raw7"),
 f"SELECT c.region, method, tp, fp, fn, tn, {_RS}, {R('auc')} AS auc_count FROM c JOIN au ON au.region = c.region"))
def i26(spark, sf):
    w = weeks(spark, sf).where("model = 'naive'")
    m = al.metrics(al.rule_rows(w, (1, 5), (0.3, 0.5)), ["region", "method"], F.col("flag"), F.col("event")).drop("alerts")
    a = ranks.auc(w, ["region"], score="raw7").select("region", F.col("auc").alias("auc_count"))
    return rounded(m.join(a, "region"), "sensitivity", "false_alarm_per100", "ppv", "auc_count")


C_MAX14 = "m14 AS (SELECT e.series, e.day, e.thr, split_part(e.series, '|', 1) AS county, MAX(d.s7) AS s7_max14 FROM ep e JOIN dthr d ON d.series = e.series AND d.day BETWEEN e.day AND e.day + 14 GROUP BY 1, 2, 3)"


def hit_examples(spark, sf):
    l3 = leads(spark, sf).where("model = 'naive' and p_star = 0.3")
    e = episodes(spark, sf)
    ahead = e.select("series", "day", "thr", F.explode(F.sequence("day", F.date_add("day", 14))).alias("at"))
    d = daily(spark, sf).select("series", F.col("day").alias("at"), "s7")
    m = ahead.join(d, ["series", "at"]).groupBy("series", "day", "thr").agg(F.max("s7").alias("s7_max14"))
    m = m.join(l3.select("series", "day", "lead"), ["series", "day"]).withColumn("county", lb.series_part(F.col("series"), 0))
    return m


@query("i27_example_selection", chain(C_EW, C_EP, C_LEADS, C_MAX14, """x AS (SELECT m.*, l.lead FROM m14 m JOIN leads l ON l.series = m.series AND l.day = m.day AND l.model = 'naive' AND l.p_star = 0.3),
 hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY s7_max14 DESC, series, day) AS rn FROM x WHERE lead >= 3) WHERE rn = 1 ORDER BY s7_max14 DESC, series, day LIMIT 4),
 miss AS (SELECT * FROM x WHERE lead IS NULL ORDER BY s7_max14 DESC, series, day LIMIT 3)""",
 "SELECT 'hit' AS kind, series, CAST(day AS VARCHAR) AS day, s7_max14, CAST(lead AS BIGINT) AS lead FROM hits UNION ALL SELECT 'miss', series, CAST(day AS VARCHAR), s7_max14, CAST(lead AS BIGINT) FROM miss"))
def i27(spark, sf):
    m = hit_examples(spark, sf)
    order = [F.desc("s7_max14"), F.asc("series"), F.asc("day")]
    a = al.top_per_group(m.where("lead >= 3"), ["county"], order, 4).withColumn("kind", F.lit("hit"))
    b = m.where("lead is null").orderBy(*order).limit(3).withColumn("kind", F.lit("miss"))
    return a.unionByName(b).select("kind", "series", text("day").alias("day"), "s7_max14", big("lead").alias("lead"))


@query("i27b_timelines", chain(C_EW, C_EP, C_LEADS, C_MAX14, """x AS (SELECT m.series, m.day AS origin FROM m14 m JOIN leads l ON l.series = m.series AND l.day = m.day AND l.model = 'naive' AND l.p_star = 0.3 WHERE lead IS NULL ORDER BY s7_max14 DESC, m.series, m.day LIMIT 3)""",
 """SELECT x.series, CAST(x.origin AS VARCHAR) AS origin, CAST(d.day AS VARCHAR) AS day, d.n AS final, CASE WHEN d.day <= x.origin THEN CAST(COALESCE((SELECT SUM(h.n) FROM hist h WHERE h.series = x.series AND h.onset = d.day AND h.onset + h.delay <= x.origin), 0) AS BIGINT) END AS known
 FROM x JOIN daily d ON d.series = x.series AND d.day BETWEEN x.origin - 10 AND x.origin + 12"""))
def i27b(spark, sf):
    m = hit_examples(spark, sf).where("lead is null").orderBy(F.desc("s7_max14"), "series", "day").limit(3)
    marks = m.select("series", F.col("day").alias("origin"))
    known = ll.known_counts(histogram(spark, sf), marks, 11).withColumn("adj", F.col("n").cast("double"))
    t = al.timelines(marks, daily(spark, sf), known, 10, 12)
    return t.select("series", text("origin").alias("origin"), text("day").alias("day"), "final", "known")


@query("i28_batch_share", chain(C_DAILY, C_EP, C_ORIGINS, f"""k AS (SELECT o.origin, s.series, COALESCE((SELECT SUM(n) FROM hist h WHERE h.series = s.series AND h.onset > o.origin - 14 AND h.onset + h.delay <= o.origin), 0) AS n14 FROM origins o CROSS JOIN (SELECT DISTINCT series FROM hist) s),
 l AS (SELECT e.series, e.day, arg_max(k.n14, k.origin) AS n14 FROM ep e JOIN k ON k.series = e.series AND k.origin < e.day GROUP BY 1, 2)""", f"SELECT COUNT(*) AS n_episodes, {R('AVG(CASE WHEN n14 = 0 THEN 1 ELSE 0 END)')} AS share_batch FROM l"))
def i28(spark, sf):
    k = nc.window_sums(nc.dense_known(histogram(spark, sf), daily_origins(spark, sf), 14), 14, "n14")
    return rounded(al.batch_share(episodes(spark, sf), k.withColumn("n14", big("n14"))), "share_batch")


@query("i29_strongest_example", chain(C_EW, C_EP, f"""x AS (SELECT e.series, a.origin, e.day, e.day - a.origin AS lead, e.thr, ROUND(a.prob, 9) AS prob FROM ep e JOIN anyr a ON a.series = e.series AND a.model = 'naive' AND a.origin BETWEEN e.day - 14 AND e.day - 3 WHERE e.thr >= 4)""",
 f"SELECT series, CAST(origin AS VARCHAR) AS origin, CAST(day AS VARCHAR) AS day, CAST(lead AS BIGINT) AS lead, {R('thr', 5)} AS crossing_thr, {R('prob', 5)} AS prob FROM x ORDER BY x.prob DESC, x.lead, x.series DESC, x.day DESC LIMIT 1"))
def i29(spark, sf):
    a = any_rows(spark, sf).where("model = 'naive'").withColumn("prob", F.round("prob", 9))
    s = al.strongest_example(episodes(spark, sf), a, min_thr=4.0)
    return s.select("series", text("origin").alias("origin"), text("day").alias("day"), big("lead").alias("lead"), rnd("crossing_thr", 5).alias("crossing_thr"), rnd("prob", 5).alias("prob"))


@query("i30_workload", chain(C_EW, C_EP, C_LEADS, C_SWEEP, "lsum AS (SELECT p_star, AVG(CASE WHEN lead IS NOT NULL THEN 1 ELSE 0 END) AS detected, quantile_cont(lead, 0.5) AS lead_median FROM leads WHERE model = 'naive' GROUP BY 1)",
 f"""SELECT s.p_star, {R('sensitivity')} AS sensitivity, {R('alerts / CAST(n_weeks AS DOUBLE)')} AS alerts_per_site_week, {R('20.0 * alerts / n_weeks')} AS alerts_week_district, {R('20.0 * alerts / n_weeks * (1 - COALESCE(ppv, 0))')} AS false_week_district, {R('detected')} AS detected, CAST(lead_median AS DOUBLE) AS lead_median
 FROM sw s LEFT JOIN lsum l ON l.p_star = s.p_star WHERE s.model = 'naive'"""))
def i30(spark, sf):
    w = al.workload(sweep(spark, sf).where("model = 'naive'"), leads(spark, sf).where("model = 'naive'"))
    return rounded(w.drop("false_alarm_per100", "ppv"), "sensitivity", "alerts_per_site_week", "alerts_week_district", "false_week_district", "detected")
