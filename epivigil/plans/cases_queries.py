"""Line list, report delay and nowcasts."""

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..operators import asof_backtest as ab
from ..operators import linelist as ll
from .registry import R, big, chain, query, rnd, rounded, text
from .sources_queries import C_SNAP, snapshot
from .testbed import C_DAILY, C_HIST, C_LL, C_ORIGINS, CITIES, daily, histogram, line_list, daily_origins, stored


@query("e1_daily_panel", chain(C_DAILY, "SELECT series, CAST(day AS VARCHAR) AS day, n FROM daily"))
def e1(spark, sf):
    return ll.daily_panel(histogram(spark, sf)).select("series", text("day").alias("day"), "n")


@query("e2_delay_histogram", chain(C_LL, "SELECT county || '|' || township AS series, CAST(onset AS VARCHAR) AS onset, CAST(delay AS BIGINT) AS delay, CAST(SUM(n) AS BIGINT) AS n FROM ll WHERE NOT imported AND county IN ('AFRICA', 'AMERICA') AND onset >= DATE '1996-01-01' GROUP BY 1, 2, 3"))
def e2(spark, sf):
    return ll.delay_histogram(line_list(spark, sf), CITIES, start="1996-01-01").select("series", text("onset").alias("onset"), big("delay").alias("delay"), "n")


C_KNOWN = "known AS (SELECT o.origin, h.series, h.onset, o.origin - h.onset AS k, CAST(SUM(n) AS BIGINT) AS n FROM origins o JOIN hist h ON h.onset + h.delay <= o.origin AND h.onset > o.origin - {back} GROUP BY 1, 2, 3, 4)"


@query("e3_known_counts", chain(C_HIST, C_ORIGINS, C_KNOWN.format(back=21), "SELECT CAST(origin AS VARCHAR) AS origin, series, CAST(onset AS VARCHAR) AS onset, CAST(k AS BIGINT) AS k, n FROM known"))
def e3(spark, sf):
    k = ll.known_counts(histogram(spark, sf), daily_origins(spark, sf), 21)
    return k.select(text("origin").alias("origin"), "series", text("onset").alias("onset"), big("k").alias("k"), "n")


@query("e3b_known_window_sum", chain(C_DAILY, """SELECT d.series, CAST(d.day AS VARCHAR) AS day, CAST(COALESCE(SUM(h.n), 0) AS BIGINT) AS n FROM daily d LEFT JOIN hist h ON h.series = d.series AND h.onset BETWEEN d.day - 6 AND d.day AND h.onset + h.delay <= d.day GROUP BY 1, 2"""))
def e3b(spark, sf):
    h = histogram(spark, sf)
    b = h.agg(F.struct(F.min("onset").alias("a"), F.max("onset").alias("b"))).scalar()
    return ll.known_window_sum(h, 7, b["a"], b["b"]).select("series", text("day").alias("day"), "n")


LOOK, DMAX = 365, 40
C_COMP = f"""hd AS (SELECT onset, delay, SUM(n) AS n FROM hist GROUP BY 1, 2),
 cn AS (SELECT o.origin, h.delay, SUM(h.n) AS n FROM origins o JOIN hd h ON h.onset >= o.origin - {LOOK + DMAX} AND h.onset < o.origin - {DMAX} GROUP BY 1, 2),
 ck AS (SELECT o.origin, k, COALESCE(n, 0) AS n FROM origins o CROSS JOIN (SELECT unnest(range(0, {DMAX + 1})) AS k) LEFT JOIN cn ON cn.origin = o.origin AND cn.delay = k),
 comp AS (SELECT origin, k, GREATEST(COALESCE(SUM(n) OVER (PARTITION BY origin ORDER BY k) / NULLIF(CAST(SUM(n) OVER (PARTITION BY origin) AS DOUBLE), 0), 1.0), 0.05) AS share FROM ck)"""


def comp_table(spark, sf):
    return stored(spark, sf, "completeness", lambda: ll.completeness(histogram(spark, sf), daily_origins(spark, sf), LOOK, DMAX))


@query("e4_completeness", chain(C_HIST, C_ORIGINS, C_COMP, f"SELECT CAST(origin AS VARCHAR) AS origin, CAST(k AS BIGINT) AS k, {R('share')} AS share FROM comp"))
def e4(spark, sf):
    return ll.completeness(histogram(spark, sf), daily_origins(spark, sf), LOOK, DMAX).select(text("origin").alias("origin"), big("k").alias("k"), rnd("share").alias("share"))


@query("e5_adjusted_counts", chain(C_HIST, C_ORIGINS, C_KNOWN.format(back=21), C_COMP, f"SELECT CAST(known.origin AS VARCHAR) AS origin, series, CAST(onset AS VARCHAR) AS onset, {R('n / GREATEST(share, 0.2)')} AS n FROM known JOIN comp ON comp.origin = known.origin AND comp.k = known.k"))
def e5(spark, sf):
    k = ll.known_counts(histogram(spark, sf), daily_origins(spark, sf), 21)
    return ll.adjusted_counts(k, comp_table(spark, sf), DMAX).select(text("origin").alias("origin"), "series", text("onset").alias("onset"), rnd("n").alias("n"))


C_DENSE = """sg AS (SELECT DISTINCT series FROM hist),
 dense AS (SELECT o.origin, s.series, o.origin - CAST(u.k AS INTEGER) AS onset, u.k, COALESCE(n, 0) AS r FROM origins o CROSS JOIN sg s CROSS JOIN (SELECT unnest(range(0, 36)) AS k) u LEFT JOIN known kn ON kn.origin = o.origin AND kn.series = s.series AND kn.k = u.k)"""


def _gp(passes, triggered):
    out = """gp0 AS (SELECT d.*, c.share AS c FROM dense d JOIN comp c ON c.origin = d.origin AND c.k = d.k),
 l1 AS (SELECT origin, series, AVG(r / c) AS lam FROM gp0 WHERE k BETWEEN 8 AND 35 GROUP BY 1, 2)"""
    trig = "CASE WHEN r >= 1 THEN 1 ELSE 0 END *" if triggered else ""
    out += f",\n gp1 AS (SELECT g.*, r + {trig} (7.0 * lam + r) * (1 - c) / (7.0 + c) AS o FROM gp0 g JOIN l1 ON l1.origin = g.origin AND l1.series = g.series)"
    if passes == 2:
        out += f""",
 l2 AS (SELECT origin, series, AVG(o) AS lam FROM gp1 WHERE k BETWEEN 2 AND 34 GROUP BY 1, 2),
 gp2 AS (SELECT g.origin, g.series, g.k, r + {trig} (7.0 * lam + r) * (1 - c) / (7.0 + c) AS o FROM gp1 g JOIN l2 ON l2.origin = g.origin AND l2.series = g.series)"""
    return out


@query("e6_gamma_poisson", chain(C_HIST, C_ORIGINS, C_KNOWN.format(back=36), C_COMP, C_DENSE, _gp(2, True),
 f"SELECT CAST(origin AS VARCHAR) AS origin, series, {R('SUM(o)', 5)} AS n FROM gp2 WHERE k < 7 GROUP BY 1, 2"))
def e6(spark, sf):
    h, o = histogram(spark, sf), daily_origins(spark, sf)
    out = ab.seen_counts(h, o, "asof_ncr7x2", 36, DMAX, comp_table(spark, sf), summed={"n": 7})
    return out.select(text("origin").alias("origin"), "series", rnd("n", 5).alias("n"))


@query("e7_context_modes", chain(C_HIST, C_ORIGINS, C_KNOWN.format(back=36), C_COMP.replace(f"{LOOK + DMAX}", f"{730 + DMAX}"), C_DENSE, _gp(1, False),
 f"""SELECT 'asof' AS mode, CAST(origin AS VARCHAR) AS origin, {R('SUM(r)', 5)} AS n FROM dense WHERE k < 7 GROUP BY 2 UNION ALL SELECT 'asof_adj', CAST(d.origin AS VARCHAR), {R('SUM(r / GREATEST(share, 0.2))', 5)} FROM dense d JOIN comp c ON c.origin = d.origin AND c.k = d.k WHERE d.k < 7 GROUP BY 2
 UNION ALL SELECT 'asof_nc7', CAST(origin AS VARCHAR), {R('SUM(o)', 5)} FROM gp1 WHERE k < 7 GROUP BY 2
 UNION ALL SELECT 'final', CAST(o.origin AS VARCHAR), {R('COALESCE((SELECT SUM(n) FROM hist h WHERE h.onset BETWEEN o.origin - 6 AND o.origin), 0)', 5)} FROM origins o"""))
def e7(spark, sf):
    h, o = histogram(spark, sf), daily_origins(spark, sf)
    out = None
    for mode in ("final", "asof", "asof_adj", "asof_nc7"):
        c = ab.seen_counts(h, o, mode, 7, DMAX)
        g = c.groupBy(F.lit(mode).alias("mode"), text("origin").alias("origin")).agg(rnd(F.sum("n"), 5).alias("n"))
        out = g if out is None else out.unionByName(g)
    return out


@query("e8_rolling_sum", chain(C_DAILY, "SELECT series, CAST(day AS VARCHAR) AS day, s7 FROM dthr"))
def e8(spark, sf):
    return ll.rolling_sum(ll.daily_panel(histogram(spark, sf)), "n").select("series", text("day").alias("day"), "s7")


@query("e9_warning_threshold", chain(C_DAILY, f"SELECT series, CAST(day AS VARCHAR) AS day, {R('thr')} AS thr FROM dthr"))
def e9(spark, sf):
    return ll.warning_threshold(ll.daily_panel(histogram(spark, sf)), "n").select("series", text("day").alias("day"), rnd("thr").alias("thr"))


@query("e9b_asof_thresholds", chain(C_HIST, C_ORIGINS, C_KNOWN.format(back=36), C_COMP, C_DENSE, f"""SELECT CAST(d.origin AS VARCHAR) AS origin, series, {R('SUM(CASE WHEN d.k < 7 THEN r / GREATEST(share, 0.2) ELSE 0 END)', 5)} AS s7, {R('GREATEST(2.0 / 3 * SUM(r / GREATEST(share, 0.2)), 3)', 5)} AS thr
 FROM dense d JOIN comp c ON c.origin = d.origin AND c.k = d.k WHERE d.k < 21 GROUP BY 1, 2"""))
def e9b(spark, sf):
    t = ab.seen_counts(histogram(spark, sf), daily_origins(spark, sf), "asof_adj", 21, DMAX, comp_table(spark, sf), summed={"s7": 7, "s21": 21})
    t = t.withColumn("thr", F.greatest(F.lit(2.0 / 3) * F.col("s21"), F.lit(3.0)))
    return t.select(text("origin").alias("origin"), "series", rnd("s7", 5).alias("s7"), rnd("thr", 5).alias("thr"))


@query("e10_delay_profile", chain(C_HIST, "origins AS (SELECT MAX(onset) AS origin FROM hist)", C_COMP.replace(f"{LOOK + DMAX}", f"{730 + DMAX}"),
 """d AS (SELECT delay, SUM(n) AS n FROM hist GROUP BY 1), c AS (SELECT delay, SUM(n) OVER (ORDER BY delay) / CAST(SUM(n) OVER () AS DOUBLE) AS f FROM d), x AS (SELECT delay FROM hist, range(0, n))""",
 f"""SELECT CAST(quantile_cont(delay, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(delay, 0.75) AS DOUBLE) AS p75, CAST(quantile_cont(delay, 0.9) AS DOUBLE) AS p90, CAST(quantile_cont(delay, 0.95) AS DOUBLE) AS p95, COUNT(*) AS n_cases,
 (SELECT CAST(MIN(delay) AS BIGINT) FROM c WHERE f >= 0.5) AS median, (SELECT CAST(MIN(delay) AS BIGINT) FROM c WHERE f >= 0.95) AS p95_first, (SELECT {R('AVG(share)')} FROM comp WHERE k < 7) AS recent7_complete FROM x"""))
def e10(spark, sf):
    h = histogram(spark, sf)
    p = ll.delay_profile(h, h.agg(F.max("onset")).scalar(), dmax=DMAX)
    return rounded(p, "p50", "p75", "p90", "p95", "recent7_complete").withColumns({"median": big("median"), "p95_first": big("p95_first")})


@query("e11_peak_by_group", chain(C_DAILY, """c AS (SELECT split_part(series, '|', 1) AS grp, day, SUM(n) AS n FROM daily GROUP BY 1, 2), s AS (SELECT grp, day, n, SUM(n) OVER (PARTITION BY grp ORDER BY day ROWS 6 PRECEDING) AS s7 FROM c)""",
 "SELECT grp, CAST(SUM(n) AS BIGINT) AS total, CAST(MAX(s7) AS BIGINT) AS peak7, CAST(arg_max(day, s7 * 100000 - (day - DATE '1970-01-01')) AS VARCHAR) AS peak_day FROM s GROUP BY grp HAVING SUM(n) >= 100"))
def e11(spark, sf):
    return ll.peak_by_group(ll.daily_panel(histogram(spark, sf)), lb.series_part(F.col("series"), 0)).withColumn("peak_day", text("peak_day"))


@query("e12_recent_summary", chain(C_SNAP, "s AS (SELECT county || '|' || town AS series, date AS day, confirmed, pending FROM snap WHERE date_type = 'onset'), e AS (SELECT MAX(day) AS d FROM s)",
 """SELECT series, CAST(SUM(CASE WHEN d - day < 7 THEN confirmed ELSE 0 END) AS BIGINT) AS known7, CAST(SUM(CASE WHEN d - day < 14 THEN confirmed ELSE 0 END) AS BIGINT) AS confirmed14,
 CAST(SUM(CASE WHEN d - day < 14 THEN pending ELSE 0 END) AS BIGINT) AS pending14, CAST(MAX(CASE WHEN confirmed > 0 THEN day END) AS VARCHAR) AS last_onset FROM s, e GROUP BY series"""))
def e12(spark, sf):
    r = ll.recent_summary(recent_snapshot(spark, sf), line_list(spark, sf).agg(F.max("onset")).scalar())
    return r.withColumn("last_onset", text("last_onset"))


def recent_snapshot(spark, sf):
    return snapshot(spark, sf).where("date_type = 'onset'").select(F.concat("county", F.lit("|"), "town").alias("series"), F.col("date").cast("date").alias("day"), "confirmed", "pending")
