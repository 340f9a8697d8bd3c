"""The early-warning backtest as of each origin: four modes of what was known, two models, and the alert evaluation of each pair.

SQL that rebuilds a context of two years for every origin, series and mode is too slow on the given tables; the backtest is held
against plain loops in tests/test_asof_backtest.py, and its mode ``final`` against the queries that have SQL.
"""

from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import asof_backtest as ab
from ..operators import calibration as cb
from ..operators import detectors as dt
from ..operators import ranks
from .registry import big, query, rnd, rounded, text
from .testbed import CITIES, EW_HS, EW_WARMUP, EW_WINDOW, GRID, daily, episodes, histogram, stored

MODES = ("final", "asof", "asof_adj", "asof_nc7")
BY = ["mode", "model"]


def early_warning(spark, sf):
    """Both models in all modes, every horizon and day from the second year on; scored, stored."""

    def make():
        f = ab.early_warning(histogram(spark, sf), MODES, ("naive", "snaive"), horizon=14, hs=EW_HS, season=364, window=EW_WINDOW, warmup=EW_WARMUP)
        return al.score_daily(f.withColumn("year", F.year("origin")))

    return stored(spark, sf, "early_warning_asof", make)


def any_rows(spark, sf):
    return stored(spark, sf, "any_rows_asof", lambda: al.any_crossing(early_warning(spark, sf), ("model", "mode", "series", "origin", "year", "s7")))


def weeks(spark, sf):
    def make():
        w = al.weekly(any_rows(spark, sf), extra=[F.min("year").alias("year"), F.max("s7").alias("raw7")])
        return al.add_strata(w, CITIES).withColumn("prob", F.round("prob", 9))

    return stored(spark, sf, "weeks_asof", make)


def sweep(spark, sf):
    return stored(spark, sf, "sweep_asof", lambda: al.sweep(weeks(spark, sf), BY, GRID))


def leads(spark, sf):
    return stored(spark, sf, "leads_asof", lambda: al.model_leads(episodes(spark, sf), any_rows(spark, sf), GRID))


@query("h4b_any_crossing_asof")
def h4b(spark, sf):
    a = any_rows(spark, sf).select(*BY, "series", text("origin").alias("origin"), "prob", "event", "y", "thr", "thr_final")
    return rounded(a, "prob", "thr", "thr_final", digits=5)


@query("e7b_asof_forecasts")
def e7b(spark, sf):
    """Mean width, error and threshold of the forecasts of each mode, by horizon."""
    f = early_warning(spark, sf).groupBy(*BY, big("h").alias("h")).agg(
        F.count("*").alias("n"), F.avg(F.col("q90") - F.col("q10")).alias("width"), F.avg("wis").alias("wis"), F.avg(F.col("cov80").cast("int")).alias("cov80"),
        F.avg(F.col("median") - F.col("y")).alias("bias"), F.avg(F.col("thr") - F.col("thr_final")).alias("thr_gap"),
    )
    return rounded(f, "width", "wis", "cov80", "bias", "thr_gap", digits=4)


@query("i5b_alert_metrics_asof")
def i5b(spark, sf):
    return rounded(al.metrics(weeks(spark, sf), BY, F.col("prob") >= 0.3, F.col("event")), "sensitivity", "false_alarm_per100", "ppv")


@query("i6b_sweep_asof")
def i6b(spark, sf):
    s = sweep(spark, sf).select(*BY, "p_star", "tp", "fp", "fn", "tn", "alert_rate", "sensitivity", "false_alarm_per100", "ppv")
    return rounded(s, "alert_rate", "sensitivity", "false_alarm_per100", "ppv")


@query("i8b_strata_asof")
def i8b(spark, sf):
    by = [*BY, "region", "etype"]
    m = al.metrics(weeks(spark, sf), by, F.col("prob") >= 0.3, F.col("event")).drop("alerts")
    return rounded(m.join(ranks.auc(weeks(spark, sf), by).select(*by, "auc"), by), "sensitivity", "false_alarm_per100", "ppv", "auc")


@query("i11b_lead_summary_asof")
def i11b(spark, sf):
    s = al.lead_summary(leads(spark, sf), [*BY, "p_star"])
    return rounded(s, "detected")


@query("i13b_matched_points_asof")
def i13b(spark, sf):
    """Each detector against each mode and model at its rate of false alarms; the detectors see final counts."""
    d = daily(spark, sf).select("series", "day", "n")
    cusum = stored(spark, sf, "cusum", lambda: dt.cusum(d, ["series"], "n", "day"))
    rate = al.metrics(
        al.weekly(cusum.select("series", F.col("day").alias("origin"), F.col("alarm").cast("double").alias("prob"), F.lit(False).alias("event"), F.lit("cusum").alias("method")), ["method"], thr=None)
        .drop("event").join(weeks(spark, sf).where("mode = 'final' and model = 'naive'").select("series", "week", "event"), ["series", "week"]),
        ["method"], F.col("prob") > 0, F.col("event"),
    ).select("method", F.col("false_alarm_per100").alias("false_per100"))
    return rounded(al.matched_points(sweep(spark, sf), rate, BY), "false_per100", "sensitivity", "false_alarm_per100", "ppv")


@query("i14b_equal_budget_asof")
def i14b(spark, sf):
    """Modes and models at the same budget of false alarms per 100 site-weeks."""
    e = al.equal_budget(weeks(spark, sf), leads(spark, sf), BY, (0.05, 2.0, 10.0, 30.0), GRID)
    return rounded(e.select(*BY, "budget", "auc", "p_star", "sensitivity", "false_alarm_per100", "detected", "lead_median"), "auc", "sensitivity", "false_alarm_per100", "detected")


@query("i15b_stratified_wis_asof")
def i15b(spark, sf):
    e = al.add_strata(early_warning(spark, sf), CITIES, thr="thr_final")
    return rounded(al.stratified_wis(e, [*BY, "region", "etype"]), "wis", "cov80", digits=5)


@query("i16b_isotonic_asof")
def i16b(spark, sf):
    """One calibration map for each mode and model."""
    rows = any_rows(spark, sf).withColumn("prob", F.round("prob", 9))
    knots = cb.isotonic_fit(cb.counts_by_score(rows, BY), BY)
    return knots.select(*BY, rnd("x").alias("x"), rnd("y").alias("y"), big("n").alias("n"))


@query("i19b_probability_scores_asof")
def i19b(spark, sf):
    s = cb.probability_scores(any_rows(spark, sf), [*BY, "year"])
    return rounded(s, "event_rate", "brier", "logloss", "ece").withColumn("year", big("year"))


def _adjusted(df):
    """The headline mode: reported counts divided by their completeness, of the forecaster in use."""
    return df.where("mode = 'asof_adj' and model = 'naive'")


@query("i22b_two_tier_asof")
def i22b(spark, sf):
    pairs = [(w, a) for w in (0.2, 0.3, 0.4) for a in (0.4, 0.5, 0.6) if a > w]
    t = stored(spark, sf, "tiers_asof", lambda: al.two_tier(_adjusted(weeks(spark, sf)), _adjusted(leads(spark, sf)), pairs))
    return rounded(t, *[c for c in t.columns if c not in ("watch_p", "alert_p")], digits=5)


@query("i25c_practical_counts_asof")
def i25c(spark, sf):
    return al.practical_counts(_adjusted(weeks(spark, sf)), (0.3, 0.5)).withColumn("year", big("year"))


@query("i30b_workload_asof")
def i30b(spark, sf):
    w = al.workload(_adjusted(sweep(spark, sf)), _adjusted(leads(spark, sf)))
    return rounded(w, "sensitivity", "alerts_per_site_week", "alerts_week_district", "false_week_district", "detected", "false_alarm_per100", "ppv")
