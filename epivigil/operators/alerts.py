"""Alert evaluation: site-week tables, threshold sweeps, lead times, budgets, workload.

Probabilities are reduced to counts per position on the p* grid before anything is multiplied by the grid, so a sweep
costs one pass over the rows. Episodes meet origins by equality on (series, day) after each episode is spread over its
few days of lead; no range join is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import quantiles as qx
from . import ranks


def alert_week(d: Column) -> Column:
    """Monday of the alert week (Monday..Sunday)."""
    return F.date_trunc("week", d).cast("date")


def score_daily(forecasts: DataFrame, thr: str = "thr", thr_final: str = "thr_final", cap: float = 0.02, ties: str = "last") -> DataFrame:
    """wis, cov80, prob (against the threshold known at the origin) and event (against the final threshold)."""
    q, y = qx.qcols(), F.col("y")
    return forecasts.withColumns(
        {"wis": qx.wis(y, q), "cov80": qx.covered(y, q, 80), "prob": qx.prob_ge(q, F.col(thr), cap, ties), "event": y >= F.col(thr_final)}
    )


def any_crossing(scored: DataFrame, keys: Sequence[str] = ("model", "mode", "series", "origin")) -> DataFrame:
    """h = 0 rows: largest probability over the horizons, event when any horizon has one."""
    return scored.groupBy(*keys).agg(
        F.max("prob").alias("prob"), F.max("event").alias("event"), F.max("y").alias("y"), F.first("thr").alias("thr"),
        F.first("thr_final").alias("thr_final"),
    ).withColumn("h", F.lit(0))


def weekly(rows: DataFrame, by: Sequence[str] = ("mode", "model"), prob: str = "prob", thr: str | None = "thr_final", extra: Sequence[Column] = ()) -> DataFrame:
    """Site-week table: largest probability, any event, largest threshold."""
    aggs = [F.max(prob).alias("prob"), F.max("event").alias("event")]
    if thr:
        aggs.append(F.max(thr).alias("thr_max"))
    return rows.withColumn("week", alert_week(F.col("origin"))).groupBy(*by, "series", "week").agg(*aggs, *extra)


def add_strata(wk: DataFrame, cities: Sequence[str], floor: float = 3.0, thr: str = "thr_max") -> DataFrame:
    return wk.withColumns({"region": lb.region_of(F.col("series"), cities), "etype": lb.event_type(F.col(thr), floor)})


def metrics(df: DataFrame, by: Sequence[str], alarm: Column, event: Column) -> DataFrame:
    """alerts, sensitivity, false_alarm_per100, ppv, tp, fp, fn, tn per group."""
    g = df.groupBy(*by).agg(*[c.alias(k) for k, c in qx.confusion(event, alarm).items()])
    return _rates(g)


def _rates(g: DataFrame) -> DataFrame:
    def over(a: Column, b: Column) -> Column:
        return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.withColumns(
        {"alerts": tp + fp, "sensitivity": over(tp, tp + fn), "false_alarm_per100": over(fp * 100, fp + tn), "ppv": over(tp, tp + fp)}
    )


def sweep(df: DataFrame, by: Sequence[str], grid: Sequence[float], prob: str = "prob", event: str = "event") -> DataFrame:
    """Metrics at every p* of the grid, with the alert rate per row, rows and events of the group."""
    g = sorted(grid)
    arr = F.array(*[F.lit(float(p)) for p in g])
    k = F.size(F.filter(arr, lambda p: p <= F.col(prob)))
    small = df.withColumn("_k", k).groupBy(*by, "_k").agg(F.count_if(F.col(event)).alias("_pos"), F.count_if(~F.col(event)).alias("_neg"))
    e = small.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(len(g)))))
    on = F.col("_k") >= F.col("_i")
    t = e.groupBy(*by, "_i").agg(
        F.sum(F.when(on, F.col("_pos")).otherwise(0)).alias("tp"), F.sum(F.when(on, F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~on, F.col("_pos")).otherwise(0)).alias("fn"), F.sum(F.when(~on, F.col("_neg")).otherwise(0)).alias("tn"),
    )
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return _rates(t).withColumns(
        {
            "p_star": F.element_at(arr, F.col("_i").cast("int")), "alert_rate": F.col("alerts") / n, "n_weeks": n,
            "event_weeks": F.col("tp") + F.col("fn"),
        }
    ).drop("_i")


def sweep_with_auc(wk: DataFrame, by: Sequence[str], grid: Sequence[float]) -> DataFrame:
    a = ranks.auc(wk, by).select(*by, "auc")
    return sweep(wk, by, grid).join(a, list(by))


def model_leads(
    ep: DataFrame, rows: DataFrame, grid: Sequence[float], window: int = 14, by: Sequence[str] = ("mode", "model"),
    prob: str = "prob",
) -> DataFrame:
    """Days from the earliest alerting origin within ``window`` days before each crossing; null if none alerted.

    ``ep``: series, day. ``rows``: by, series, origin, prob. Result (by, series, day, p_star, lead) for every episode,
    group and grid point. The groups (few models and modes) travel as one array.
    """
    e = ep.select("series", "day").distinct()
    if by:
        kinds = rows.select(F.struct(*by).alias("g")).distinct().agg(F.collect_list("g").alias("v")).scalar()
        e = e.withColumn("_g", F.explode(kinds)).select("series", "day", *[F.col(f"_g.{c}").alias(c) for c in by])
    d = e.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(window)))).withColumn("origin", F.date_sub("day", F.col("k")))
    j = d.join(rows.select(*by, "series", "origin", F.col(prob).alias("_p")), [*by, "series", "origin"], "left")
    g = j.groupBy(*by, "series", "day").agg(
        F.array(*[
            F.struct(F.lit(float(p)).alias("p_star"), F.max(F.when(F.col("_p") >= p, F.col("k"))).alias("lead")) for p in grid
        ]).alias("_l")
    )
    return g.withColumn("_l", F.explode("_l")).select(*by, "series", "day", "_l.p_star", F.col("_l.lead").cast("int").alias("lead"))


def flag_leads(ep: DataFrame, flags: DataFrame, day: str, flag: str, window: int = 14, first: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """The same for yes/no alarms by day; ``first`` = 0 counts the crossing day itself (detectors)."""
    e = ep.select("series", "day").distinct()
    if by:
        kinds = flags.select(F.struct(*by).alias("g")).distinct().agg(F.collect_list("g").alias("v")).scalar()
        e = e.withColumn("_g", F.explode(kinds)).select("series", "day", *[F.col(f"_g.{c}").alias(c) for c in by])
    d = e.withColumn("k", F.explode(F.sequence(F.lit(first), F.lit(window)))).withColumn("_at", F.date_sub("day", F.col("k")))
    f = flags.where(F.col(flag)).select(*by, "series", F.col(day).alias("_at"), F.lit(True).alias("_on"))
    return d.join(f, [*by, "series", "_at"], "left").groupBy(*by, "series", "day").agg(
        F.max(F.when(F.col("_on"), F.col("k"))).cast("int").alias("lead")
    )


def lead_summary(leads: DataFrame, by: Sequence[str]) -> DataFrame:
    """Episodes, detected share, median lead, share with >= 3 days (of all, and of the detected).

    A lead takes a handful of values, so the exact percentile keeps a handful of counters.
    """
    return leads.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.col("lead").isNotNull().cast("int")).alias("detected"),
        F.expr("percentile(lead, 0.5D)").alias("lead_median"),
        F.avg(F.coalesce((F.col("lead") >= 3).cast("int"), F.lit(0))).alias("ge3"),
        F.avg((F.col("lead") >= 3).cast("int")).alias("ge3_of_detected"),
    )


def detector_false_alarms(alarms: DataFrame, ep: DataFrame, by: Sequence[str] = ("method",), window: int = 14, season: Column | None = None) -> DataFrame:
    """Site-weeks with an alarm among the days further than ``window`` days from any episode of the series."""
    masked = ep.select("series", F.explode(F.sequence(F.date_sub("day", window), F.date_add("day", window))).alias("day")).distinct()
    d = alarms if season is None else alarms.where(season)
    wk = (
        d.join(masked, ["series", "day"], "left_anti")
        .withColumn("week", alert_week(F.col("day")))
        .groupBy(*by, "series", "week").agg(F.max("alarm").alias("alarm"))
    )
    return wk.groupBy(*by).agg(F.count("*").alias("n_weeks"), F.count_if(F.col("alarm")).alias("false_weeks")).withColumn(
        "false_per100", F.lit(100.0) * F.col("false_weeks") / F.col("n_weeks")
    )


def matched_points(sw: DataFrame, limits: DataFrame, by: Sequence[str], limit: str = "false_per100", label: str = "method") -> DataFrame:
    """For each limit row the most sensitive p* with no more false alarms (lowest p* of equals); no row when none fits.

    ``limits`` is a list of a few rows (detectors or budgets) and travels as one array.
    """
    lim = limits.select(F.struct(F.col(label).alias("label"), F.col(limit).cast("double").alias("far")).alias("g")).agg(F.collect_list("g").alias("v")).scalar()
    d = sw.withColumn("_g", F.explode(lim)).where(F.col("false_alarm_per100") <= F.col("_g.far"))
    best = F.max_by(
        F.struct("p_star", "sensitivity", "false_alarm_per100", "ppv"), F.struct(F.coalesce("sensitivity", F.lit(-1.0)), -F.col("p_star"))
    ).alias("_b")
    return d.groupBy(*by, F.col("_g.label").alias(label), F.col("_g.far").alias(limit)).agg(best).select(*by, label, limit, "_b.*")


def equal_budget(wk: DataFrame, leads: DataFrame, by: Sequence[str], budgets: Sequence[float], grid: Sequence[float]) -> DataFrame:
    """Per group and budget of false alarms per 100 site-weeks: best p*, its rates, and detected share and median lead.

    ``leads``: by, series, day, p_star, lead (of the group's own episodes). No feasible p* -> zeros.
    """
    sw = sweep_with_auc(wk, by, grid).where(F.col("event_weeks") > 0)
    spark = wk.sparkSession
    lim = spark.createDataFrame([(float(b), float(b)) for b in budgets], "budget double, far double")
    best = matched_points(sw, lim, by, "far", "budget").drop("far")
    base = sw.groupBy(*by).agg(F.first("n_weeks").alias("n_weeks"), F.first("event_weeks").alias("event_weeks"), F.first("auc").alias("auc"))
    base = base.withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))
    ls = lead_summary(leads, [*by, "p_star"]).select(*by, "p_star", F.col("n").alias("episodes"), "detected", "lead_median")
    j = base.join(best, [*by, "budget"], "left").join(ls, [*by, "p_star"], "left")
    none = F.col("p_star").isNull()
    return j.withColumns(
        {c: F.when(none, 0.0).otherwise(F.col(c)) for c in ("sensitivity", "false_alarm_per100", "detected")}
    )


def stratified_wis(scored: DataFrame, by: Sequence[str], h: int = 7) -> DataFrame:
    return scored.where(F.col("h") == h).groupBy(*by).agg(
        F.avg("wis").alias("wis"), F.avg(F.col("cov80").cast("int")).alias("cov80"), F.count("*").alias("n")
    )


def two_tier(wk: DataFrame, leads: DataFrame, pairs: Sequence[tuple[float, float]], n_sites: int = 20) -> DataFrame:
    """Workload, sensitivities, leads and escalation for (watch, alert) probability pairs.

    ``leads`` holds (series, day, p_star, lead) for every p* used. Site-weeks are first counted by where their
    probability falls among those p*, so pairs multiply a handful of rows.
    """
    ps = sorted({p for pr in pairs for p in pr})
    pos = F.size(F.filter(F.array(*[F.lit(float(p)) for p in ps]), lambda p: p <= F.col("prob")))
    small = wk.withColumn("_k", pos).groupBy("_k").agg(F.count_if(F.col("event")).alias("_ev"), F.count("*").alias("_n"))
    lvl = {p: i + 1 for i, p in enumerate(ps)}
    parr = F.array(*[
        F.struct(F.lit(float(a)).alias("w"), F.lit(float(b)).alias("a"), F.lit(lvl[a]).alias("kw"), F.lit(lvl[b]).alias("ka")) for a, b in pairs
    ])
    d = small.withColumn("_p", F.explode(parr))
    w, a = F.col("_k") >= F.col("_p.kw"), F.col("_k") >= F.col("_p.ka")
    add = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    g = d.groupBy(F.col("_p.w").alias("watch_p"), F.col("_p.a").alias("alert_p")).agg(
        F.sum("_n").alias("n"), F.sum("_ev").alias("ev"), add(w, "_n").alias("wn"), add(a, "_n").alias("an"),
        add(w & ~a, "_n").alias("won"), add(w, "_ev").alias("we"), add(a, "_ev").alias("ae"),
    )
    n, one = F.col("n"), F.lit(1)
    wl = g.select(
        "watch_p", "alert_p", (F.col("wn") / n).alias("watch_flags_per_site_week"), (F.col("an") / n).alias("alert_orders_per_site_week"),
        (F.col("won") / n).alias("watch_only_per_site_week"), (F.col("wn") / n * n_sites).alias("watch_flags_week"),
        (F.col("an") / n * n_sites).alias("alert_orders_week"), ((F.col("an") - F.col("ae")) / n * n_sites).alias("false_orders_week"),
        (F.col("we") / F.greatest("ev", one)).alias("watch_sensitivity"), (F.col("ae") / F.greatest("ev", one)).alias("alert_sensitivity"),
        (F.col("ae") / F.greatest("an", one)).alias("alert_ppv"),
        (F.lit(100.0) * (F.col("an") - F.col("ae")) / F.greatest(n - F.col("ev"), one)).alias("alert_false_per100"),
        (F.lit(100.0) * (F.col("wn") - F.col("we")) / F.greatest(n - F.col("ev"), one)).alias("watch_false_per100"),
    )
    m = leads.groupBy("series", "day").agg(F.map_from_entries(F.collect_list(F.struct("p_star", "lead"))).alias("_m"))
    l2 = m.withColumn("_p", F.explode(parr)).select(
        F.col("_p.w").alias("watch_p"), F.col("_p.a").alias("alert_p"), F.col("_m")[F.col("_p.w")].alias("lw"), F.col("_m")[F.col("_p.a")].alias("la")
    )
    both = F.col("lw").isNotNull() & F.col("la").isNotNull()
    gap = F.col("lw") - F.col("la")
    esc = l2.groupBy("watch_p", "alert_p").agg(
        F.avg(F.col("lw").isNotNull().cast("int")).alias("events_detected_watch"), F.avg(F.col("la").isNotNull().cast("int")).alias("events_detected_alert"),
        F.expr("percentile(lw, 0.5D)").alias("lead_median_watch"), F.expr("percentile(la, 0.5D)").alias("lead_median_alert"),
        F.avg(F.when(both, (gap > 0).cast("int"))).alias("watch_earlier_than_alert"), F.avg(F.when(both, gap)).alias("days_watch_to_alert_mean"),
        F.expr("percentile(case when lw - la > 0 then lw - la end, 0.5D)").alias("days_watch_to_alert_median_if_earlier"),
        F.avg((F.col("lw").isNotNull() & F.col("la").isNull()).cast("int")).alias("watch_only_events_detected"),
    )
    return wl.join(esc, ["watch_p", "alert_p"], "left")


def cost_loss(sw: DataFrame, ratios: Sequence[float] = (0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    """Sweep row nearest to p* = C/L (the lower p* of two as near)."""
    d = sw.withColumn("c_over_l", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    near = F.struct(F.round(F.abs(F.col("p_star") - F.col("c_over_l")), 9), F.col("p_star"))
    cols = [c for c in ("sensitivity", "false_alarm_per100", "ppv", "events_detected", "lead_median") if c in sw.columns]
    return d.groupBy("c_over_l").agg(F.min_by(F.struct(F.col("p_star").alias("nearest_p"), *cols), near).alias("_b")).select("c_over_l", "_b.*")


def recommended_pair(tiers: DataFrame, watch: float = 0.3, max_false: float = 0.5) -> DataFrame:
    """Most sensitive alert level with this watch level and at most ``max_false`` false orders a week, else the fewest false."""
    ok = (F.abs(F.col("watch_p") - watch) < 1e-9) & (F.col("false_orders_week") <= max_false)
    row = F.struct("watch_p", "alert_p", "alert_sensitivity", "false_orders_week")
    # earliest pair of equals, as listed: lowest watch, then lowest alert
    return tiers.agg(
        F.max_by(F.when(ok, row), F.when(ok, F.struct("alert_sensitivity", -F.col("watch_p"), -F.col("alert_p")))).alias("a"),
        F.min_by(row, F.struct("false_orders_week", "watch_p", "alert_p")).alias("b"),
    ).select(F.coalesce("a", "b").alias("r")).select("r.*")


def practical_counts(wk: DataFrame, ps: Sequence[float]) -> DataFrame:
    """Per p*, region, event type and year: sites, site-weeks, alerts, true, false, event and missed weeks."""
    d = wk.withColumn("p_star", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    al, ev = F.col("prob") >= F.col("p_star"), F.col("event")
    return d.groupBy("p_star", "region", "etype", "year").agg(
        F.countDistinct("series").alias("sites"), F.count("*").alias("site_weeks"), F.count_if(al).alias("alert_weeks"),
        F.count_if(al & ev).alias("true_weeks"), F.count_if(al & ~ev).alias("false_weeks"), F.count_if(ev).alias("event_weeks"),
        F.count_if(~al & ev).alias("missed_weeks"),
    )


def season_means(prac: DataFrame) -> DataFrame:
    return prac.groupBy("p_star", "region", "etype").agg(
        F.count("*").alias("seasons"), F.max("sites").alias("sites"),
        *[F.avg(c).alias(c) for c in ("alert_weeks", "true_weeks", "false_weeks", "event_weeks", "missed_weeks")],
    )


def rule_rows(wk: DataFrame, counts: Sequence[int], ps: Sequence[float], raw: str = "raw7") -> DataFrame:
    """Each site-week once per rule: 'reported >= k in 7 days' and 'probability >= p', with the flag of that rule."""
    rules = [F.struct(F.lit(f"count>={k}").alias("method"), (F.col(raw) >= k).alias("flag")) for k in counts]
    rules += [F.struct(F.lit(f"p>={p}").alias("method"), (F.col("prob") >= p).alias("flag")) for p in ps]
    return wk.withColumn("_r", F.explode(F.array(*rules))).select("*", "_r.method", "_r.flag").drop("_r")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, per: int = 1) -> DataFrame:
    """The first ``per`` rows of each group, then the best ``n`` of all groups (report selection)."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per).drop("_rn").orderBy(*order).limit(n)


def timelines(marks: DataFrame, final: DataFrame, known: DataFrame, pre: int, post: int) -> DataFrame:
    """Days origin-pre..origin+post of each marked (series, origin): final count, and known / adjusted up to the origin.

    ``final``: series, day, n. ``known``: origin, series, onset, n, adj.
    """
    d = marks.select("series", "origin").distinct().withColumn("day", F.explode(F.sequence(F.date_sub("origin", pre), F.date_add("origin", post))))
    j = d.join(final.select("series", "day", F.col("n").alias("final")), ["series", "day"])
    k = known.select("origin", "series", F.col("onset").alias("day"), F.col("n").alias("known"), F.col("adj").alias("adjusted"))
    past = F.col("day") <= F.col("origin")
    return j.join(k, ["origin", "series", "day"], "left").withColumns(
        {c: F.when(past, F.coalesce(F.col(c), F.lit(0))) for c in ("known", "adjusted")}
    )


def batch_share(ep: DataFrame, known14: DataFrame) -> DataFrame:
    """Share of episodes with nothing reported from the last 14 days at the last origin before the crossing.

    The as-of join orders episodes and origins of a series by day in one window.
    """
    o = known14.select("series", F.col("origin").alias("day"), F.struct(F.col("origin").alias("o"), F.col("n14").alias("n")).alias("_o"), F.lit(1).alias("_k"))
    e = ep.select("series", "day", F.lit(None).cast("struct<o:date,n:bigint>").alias("_o"), F.lit(0).alias("_k"))
    w = W.partitionBy("series").orderBy("day", "_k").rowsBetween(W.unboundedPreceding, -1)
    d = e.unionByName(o.withColumn("_o", F.col("_o").cast("struct<o:date,n:bigint>"))).withColumn("_at", F.last("_o", ignorenulls=True).over(w))
    d = d.where((F.col("_k") == 0) & F.col("_at").isNotNull())
    return d.agg(F.count("*").alias("n_episodes"), F.avg((F.col("_at.n") == 0).cast("int")).alias("share_batch"))


def strongest_example(ep: DataFrame, rows: DataFrame, min_lead: int = 3, window: int = 14, min_thr: float = 20.0) -> DataFrame:
    """The (episode, origin) with the highest probability min_lead..window days before a crossing of a threshold >= min_thr."""
    e = ep.where(F.col("thr") >= min_thr).select("series", "day", F.col("thr").alias("crossing_thr"))
    d = e.withColumn("lead", F.explode(F.sequence(F.lit(min_lead), F.lit(window)))).withColumn("origin", F.date_sub("day", F.col("lead")))
    j = d.join(rows.select("series", "origin", "prob"), ["series", "origin"])
    best = F.max_by(
        F.struct("series", "origin", "day", "lead", "crossing_thr", "prob"),
        F.struct("prob", -F.col("lead"), F.col("series"), F.col("day")),
    )
    return j.agg(best.alias("b")).where(F.col("b").isNotNull()).select("b.*")


def workload(sw: DataFrame, leads: DataFrame, n_sites: int = 20) -> DataFrame:
    """Alerts and false alerts per site-week and per district-week by p*, beside the lead statistics."""
    ls = lead_summary(leads, ["p_star"]).select("p_star", "detected", "lead_median")
    rate = F.col("alerts") / F.col("n_weeks")
    return sw.join(ls, "p_star", "left").select(
        "p_star", "sensitivity", "false_alarm_per100", "ppv", rate.alias("alerts_per_site_week"), (rate * n_sites).alias("alerts_week_district"),
        (rate * n_sites * (1 - F.coalesce("ppv", F.lit(0.0)))).alias("false_week_district"), "detected", "lead_median",
    )


def tiers(rows: DataFrame, alert: float = 0.4, watch: float = 0.3, prob: str = "p_any", known: str = "known7", thr: str = "thr") -> DataFrame:
    """Tier and 'already at the threshold' flag of a live table."""
    t = F.when(F.col(prob) >= alert, "alert").when(F.col(prob) >= watch, "watch").otherwise("")
    return rows.withColumns({"tier": t, "rule_now": F.col(known) >= F.col(thr)})


def county_rollup(tiered: DataFrame) -> DataFrame:
    return tiered.groupBy(lb.series_part(F.col("series"), 0).alias("county")).agg(
        *[F.sum(c).alias(c) for c in ("confirmed14", "pending14", "known7")], F.count_if(F.col("tier") == "watch").alias("n_watch"),
        F.count_if(F.col("tier") == "alert").alias("n_alert"),
    )
