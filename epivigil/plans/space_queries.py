"""Spatial operators on the vectors read as points of a plane."""

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import quantiles as qx
from ..operators import linelist as ll
from ..operators import ranks
from ..operators import spatial as sp
from .registry import R, big, chain, query, rnd, rounded, text
from .testbed import C_PTS, point_origins, points, stored, table

C_PO = "po AS (SELECT DISTINCT onset AS origin FROM pts)"
C_PCOMP = """phd AS (SELECT onset, report - onset AS delay, COUNT(*) AS n FROM pts GROUP BY 1, 2),
 pcn AS (SELECT o.origin, h.delay, SUM(h.n) AS n FROM po o JOIN phd h ON h.onset >= o.origin - 37 AND h.onset < o.origin - 7 GROUP BY 1, 2),
 pck AS (SELECT o.origin, k, COALESCE(n, 0) AS n FROM po o CROSS JOIN (SELECT unnest(range(0, 8)) AS k) LEFT JOIN pcn ON pcn.origin = o.origin AND pcn.delay = k),
 pcomp AS (SELECT origin, k, GREATEST(COALESCE(SUM(n) OVER (PARTITION BY origin ORDER BY k) / NULLIF(CAST(SUM(n) OVER (PARTITION BY origin) AS DOUBLE), 0), 1.0), 0.05) AS share FROM pck)"""
C_PW = """pw0 AS (SELECT o.origin, p.x, p.y, p.n * POWER(0.5, (o.origin - p.onset) / 14.0) / GREATEST(COALESCE(c.share, 1), 0.2) AS w FROM po o JOIN pts p ON p.onset <= o.origin AND p.report <= o.origin AND o.origin - p.onset < 60 LEFT JOIN pcomp c ON c.origin = o.origin AND c.k = LEAST(o.origin - p.onset, 7)),
 pw AS (SELECT origin, x, y, SUM(w) AS w FROM pw0 GROUP BY 1, 2, 3)"""


def point_comp(spark, sf):
    h = points(spark, sf).groupBy("series", "onset", F.datediff("report", "onset").alias("delay")).agg(F.count("*").alias("n"))
    return ll.completeness(h, point_origins(spark, sf), 30, 7)


def weighted(spark, sf):
    def make():
        return sp.weighted_points(points(spark, sf), point_origins(spark, sf), "asof_adj", sp.SPATIAL_MODELS["kde_rv"], point_comp(spark, sf), 7)

    return stored(spark, sf, "weighted_points", make)


@query("j1_weighted_points", chain(C_PTS, C_PO, C_PCOMP, C_PW, f"SELECT CAST(origin AS VARCHAR) AS origin, {R('x')} AS x, {R('y')} AS y, {R('w')} AS w FROM pw"))
def j1(spark, sf):
    return weighted(spark, sf).select(text("origin").alias("origin"), rnd("x").alias("x"), rnd("y").alias("y"), rnd("w").alias("w"))


@query("j1b_season_points", chain(C_PTS, C_PO, f"""a AS (SELECT o.origin, p.n * POWER(0.5, (o.origin - p.onset) / 14.0) AS w FROM po o JOIN pts p ON p.onset <= o.origin AND o.origin - p.onset < 60
 UNION ALL SELECT o.origin + 365, 0.2 * p.n FROM po o JOIN pts p ON ABS(p.onset - (o.origin + 7)) <= 21 UNION ALL SELECT o.origin + 365, p.n * POWER(0.5, (o.origin + 365 - p.onset) / 14.0) FROM po o JOIN pts p ON o.origin + 365 - p.onset < 60)""", f"SELECT CAST(origin AS VARCHAR) AS origin, {R('SUM(w)')} AS w FROM a GROUP BY 1"))
def j1b(spark, sf):
    """Origins of this year and of the same days a year later, which see these cases as last season's."""
    o = point_origins(spark, sf)
    o = o.unionByName(o.select(F.date_add("origin", 365).alias("origin")))
    return sp.weighted_points(points(spark, sf), o, "final", sp.SPATIAL_MODELS["kde_rv_season"]).groupBy(text("origin").alias("origin")).agg(rnd(F.sum("w")).alias("w"))


C_GEO = """gt AS (SELECT series, SUM(x * n) / SUM(n) AS x, SUM(y * n) / SUM(n) AS y, CAST(SUM(n) AS BIGINT) AS cases FROM pts GROUP BY 1),
 gv0 AS (SELECT village_code, MIN(series) AS series, AVG(x) AS x, AVG(y) AS y, CAST(SUM(n) AS BIGINT) AS cases FROM pts GROUP BY 1),
 gv AS (SELECT *, cases / CAST(SUM(cases) OVER (PARTITION BY series) AS DOUBLE) AS share FROM gv0)"""


def geometry(spark, sf):
    t, v = sp.geometry(points(spark, sf))
    return stored(spark, sf, "towns", lambda: t), stored(spark, sf, "villages", lambda: v)


C_CTX = """ctx AS (SELECT o.origin, s.series, k, COALESCE(COUNT(p.vec_id), 0) AS n FROM po o CROSS JOIN (SELECT DISTINCT series FROM pts) s CROSS JOIN (SELECT unnest(range(0, 60)) AS k) LEFT JOIN pts p ON p.series = s.series AND p.onset = o.origin - CAST(k AS INTEGER) GROUP BY 1, 2, 3)"""


def context(spark, sf):
    from ..operators import nowcast as nc

    h = points(spark, sf).groupBy("series", "onset").agg(F.count("*").alias("n")).withColumn("delay", F.lit(0))
    return nc.dense_known(h, point_origins(spark, sf), 60).withColumn("n", F.col("n").cast("double"))


@query("j2_town_points", chain(C_PTS, C_PO, C_GEO, C_CTX, "t AS (SELECT origin, series, SUM(n * POWER(0.5, k / 14.0)) AS w FROM ctx GROUP BY 1, 2)",
 f"SELECT 'centre' AS kind, CAST(origin AS VARCHAR) AS origin, COUNT(*) AS n, {R('SUM(w)')} AS w, {R('SUM(w * x)')} AS wx FROM t JOIN gt ON gt.series = t.series WHERE w > 0 GROUP BY 2 UNION ALL SELECT 'village', CAST(origin AS VARCHAR), COUNT(*), {R('SUM(w * share)')}, {R('SUM(w * share * x)')} FROM t JOIN gv ON gv.series = t.series WHERE w * share > 0 GROUP BY 2"))
def j2(spark, sf):
    towns, vill = geometry(spark, sf)
    k, c = sp.SpatialModel(), context(spark, sf)
    a = sp.town_points(c, towns.withColumn("share", F.lit(1.0)), k).withColumn("kind", F.lit("centre"))
    b = sp.town_points(c, vill, k).withColumn("kind", F.lit("village"))
    return a.unionByName(b).groupBy("kind", text("origin").alias("origin")).agg(F.count("*").alias("n"), rnd(F.sum("w")).alias("w"), rnd(F.sum(F.col("w") * F.col("x"))).alias("wx"))


@query("j3_geometry", chain(C_PTS, C_GEO, f"SELECT 'town' AS kind, series, series AS place, {R('x')} AS x, {R('y')} AS y, CAST(cases AS DOUBLE) AS w FROM gt UNION ALL SELECT 'village', series, village_code, {R('x')}, {R('y')}, {R('share')} FROM gv"))
def j3(spark, sf):
    t, v = geometry(spark, sf)
    a = t.select(F.lit("town").alias("kind"), "series", F.col("series").alias("place"), "x", "y", F.col("cases").cast("double").alias("w"))
    return rounded(a.unionByName(v.select(F.lit("village").alias("kind"), "series", F.col("village_code").alias("place"), "x", "y", F.col("share").alias("w"))), "x", "y", "w")


C_KNN = """pr AS (SELECT origin, x, y, row_number() OVER () AS r FROM pw0),
 p1 AS (SELECT origin, x, y, MIN(r) AS r FROM pr GROUP BY 1, 2, 3),
 kd AS (SELECT a.origin, a.x, a.y, SQRT(POWER(a.x - b.x, 2) + POWER(a.y - b.y, 2)) AS d FROM p1 a JOIN pr b ON b.origin = a.origin AND a.r <> b.r),
 kr AS (SELECT origin, x, y, AVG(d) AS rbar, COUNT(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY origin, x, y ORDER BY d) AS rn FROM kd) WHERE rn <= 10 GROUP BY 1, 2, 3),
 sg AS (SELECT p.origin, p.x, p.y, p.w, CASE WHEN c = 10 THEN GREATEST(0.5, LEAST(10.0, SQRT(pi()) / SQRT(10) * rbar)) ELSE 10.0 END AS sigma FROM pw p LEFT JOIN kr ON kr.origin = p.origin AND kr.x = p.x AND kr.y = p.y)"""


@query("j4_bandwidth", chain(C_PTS, C_PO, C_PCOMP, C_PW, C_KNN, f"SELECT CAST(origin AS VARCHAR) AS origin, {R('x')} AS x, {R('y')} AS y, {R('sigma')} AS sigma FROM sg"))
def j4(spark, sf):
    s = sp.bandwidth(weighted(spark, sf), sp.SPATIAL_MODELS["kde_rv"].width)
    return s.select(text("origin").alias("origin"), rnd("x").alias("x"), rnd("y").alias("y"), rnd("sigma").alias("sigma"))


@query("j5_intensity", chain(C_PTS, C_PO, C_PCOMP, C_PW, C_KNN, C_GEO, f"""SELECT CAST(origin AS VARCHAR) AS origin, village_code, {R('SUM(w / (2 * pi() * sigma * sigma) * EXP(-(POWER(sg.x - gv.x, 2) + POWER(sg.y - gv.y, 2)) / (2 * sigma * sigma)))')} AS lam FROM sg CROSS JOIN gv GROUP BY 1, 2"""))
def j5(spark, sf):
    k = sp.SPATIAL_MODELS["kde_rv"]
    _, v = geometry(spark, sf)
    lam = sp.intensity(sp.bandwidth(weighted(spark, sf), k.width), v, "village_code", k.width.range())
    return lam.select(text("origin").alias("origin"), "village_code", rnd("lam").alias("lam"))


C_SPF = """lam AS (SELECT origin, series, SUM(w / (8 * pi()) * EXP(-(POWER(pw.x - gv.x, 2) + POWER(pw.y - gv.y, 2)) / 8)) AS lam FROM pw CROSS JOIN gv GROUP BY 1, 2),
 ow AS (SELECT origin, series, SUM(CASE WHEN k < 7 THEN n ELSE 0 END) AS own7, SUM(CASE WHEN k BETWEEN 7 AND 13 THEN n ELSE 0 END) AS p7 FROM ctx GROUP BY 1, 2),
 tt AS (SELECT ow.origin, SUM(own7) AS tot7, SUM(p7) AS p7, SUM(lam) AS tlam, COUNT(*) AS ns FROM ow LEFT JOIN lam ON lam.origin = ow.origin AND lam.series = ow.series GROUP BY 1),
 fm AS (SELECT ow.origin, ow.series, own7, tot7, GREATEST(0.5, LEAST(2.0, (tot7 + 5) / (tt.p7 + 5.0))) AS g, CASE WHEN tlam > 0 THEN COALESCE(lam, 0) / tlam WHEN tot7 > 0 THEN own7 / CAST(tot7 AS DOUBLE) ELSE 1.0 / ns END AS share FROM ow JOIN tt ON tt.origin = ow.origin LEFT JOIN lam ON lam.origin = ow.origin AND lam.series = ow.series),
 mu AS (SELECT origin, series, h, share, g, (0.5 * share * tot7 + 0.5 * own7) * POWER(g, h / 7.0) AS mu FROM fm CROSS JOIN (SELECT unnest([1, 7, 14]) AS h))"""


def spatial(spark, sf):
    def make():
        k = sp.SPATIAL_MODELS["kde_mix_fix"]
        _, v = geometry(spark, sf)
        pts = sp.weighted_points(points(spark, sf), point_origins(spark, sf), "asof_adj", k, point_comp(spark, sf), 7)
        lam = sp.intensity(sp.bandwidth(pts, k.width), v, "village_code", k.width.range())
        return sp.spatial_forecast(context(spark, sf), lam, v, k, (1, 7, 14), pts)

    return stored(spark, sf, "spatial_forecast", make)


@query("j6_spatial_forecast", chain(C_PTS, C_PO, C_PCOMP, C_PW, C_GEO, C_CTX, C_SPF, f"SELECT CAST(origin AS VARCHAR) AS origin, series, CAST(h AS BIGINT) AS h, {R('share')} AS share, {R('g')} AS g, {R('mu', 5)} AS mu FROM mu"))
def j6(spark, sf):
    return spatial(spark, sf).select(text("origin").alias("origin"), "series", big("h").alias("h"), rnd("share").alias("share"), rnd("g").alias("g"), rnd("mu", 5).alias("mu"))


_CDF = "1 - POWER(1 - p, k + 1) * (1 + (k + 1) * p)"


@query("j7_negative_binomial", chain("m AS (SELECT DISTINCT ROUND(o_totalprice / 5000, 1) AS mu FROM orders)", "p AS (SELECT mu, 2 / (2 + mu) AS p FROM m)", f"c AS (SELECT mu, p, k, {_CDF} AS cdf FROM p CROSS JOIN (SELECT unnest(range(0, 1000)) AS k))",
 f"SELECT mu, {', '.join(f'CAST(MIN(CASE WHEN cdf >= {i / 10} THEN k END) AS DOUBLE) AS q{10 * i}' for i in range(1, 10))}, {R('MIN(1 - p * p - 2 * p * p * (1 - p))')} AS tail2 FROM c GROUP BY mu"))
def j7(spark, sf):
    m = table(spark, sf, "orders").select(F.round(F.col("o_totalprice") / 5000, 1).alias("mu")).distinct()
    d = sp.add_deciles(m).withColumn("tail2", rnd(geo.nb_tail(F.col("mu"), 2)))
    return d.select("mu", *qx.QCOLS, "tail2")


C_HOT = """vg AS (SELECT village_code, series AS town, x, y FROM gv),
 kn AS (SELECT o.origin, p.village_code, o.origin - p.onset AS age, SUM(n) AS n FROM po o JOIN pts p ON p.onset <= o.origin AND p.report <= o.origin AND o.origin - p.onset < 60 GROUP BY 1, 2, 3),
 ov AS (SELECT origin, village_code, SUM(CASE WHEN age < 14 THEN n ELSE 0 END) AS own14, SUM(CASE WHEN age BETWEEN 14 AND 27 THEN n ELSE 0 END) AS prev14 FROM kn GROUP BY 1, 2),
 ot AS (SELECT origin, SUM(own14) AS t14, SUM(prev14) AS tp FROM ov GROUP BY 1),
 yt AS (SELECT o.origin, p.village_code, SUM(n) AS y FROM po o JOIN pts p ON p.onset > o.origin AND p.onset <= o.origin + 14 GROUP BY 1, 2),
 hb AS (SELECT o.origin, v.village_code, v.town, COALESCE(own14, 0) AS own14, COALESCE(t14, 0) AS t14, COALESCE(yt.y, 0) AS y, GREATEST(0.5, LEAST(2.0, (COALESCE(t14, 0) + 5) / (COALESCE(tp, 0) + 5.0))) AS g FROM po o CROSS JOIN vg v LEFT JOIN ov ON ov.origin = o.origin AND ov.village_code = v.village_code LEFT JOIN ot ON ot.origin = o.origin LEFT JOIN yt ON yt.origin = o.origin AND yt.village_code = v.village_code),
 hl AS (SELECT kn.origin, e.village_code, SUM(n * POWER(0.5, age / 14.0) / (2 * pi()) * EXP(-(POWER(a.x - e.x, 2) + POWER(a.y - e.y, 2)) / 2)) AS lam FROM kn JOIN vg a ON a.village_code = kn.village_code CROSS JOIN vg e GROUP BY 1, 2),
 hm AS (SELECT hb.*, AVG(own14) OVER (PARTITION BY hb.origin, town) * g AS mt, COALESCE(lam / SUM(lam) OVER (PARTITION BY hb.origin), 0) * t14 * g AS mk FROM hb LEFT JOIN hl ON hl.origin = hb.origin AND hl.village_code = hb.village_code),
 hs AS (SELECT origin, village_code, town, CAST(y AS DOUBLE) AS y, CAST(own14 AS DOUBLE) AS own_raw, {0} AS own, {1} AS town_score, {2} AS kde_1, {3} AS kde_1_mix FROM hm)"""


def _tail(mu):
    p = f"(2 / (2 + GREATEST({mu}, 1e-12)))"
    return f"1 - {p} * {p} - 2 * {p} * {p} * (1 - {p})"


C_HOT = C_HOT.format(_tail("own14"), _tail("mt"), _tail("mk"), _tail("(0.5 * mk + 0.5 * own14)"))


def hotspots(spark, sf):
    def make():
        _, v = geometry(spark, sf)
        models = [sp.Hotspot("town_score", "town") if n == "town" else m for n, m in sp.HOTSPOTS.items()]
        return sp.hotspot_scores(v.withColumnRenamed("series", "town"), points(spark, sf), point_origins(spark, sf), "asof", models, events=(2, 3))

    return stored(spark, sf, "hotspots", make)


@query("j8_hotspot_scores", chain(C_PTS, C_PO, C_GEO, C_HOT, f"SELECT CAST(origin AS VARCHAR) AS origin, village_code, y, own_raw, {R('own')} AS own, {R('town_score')} AS town_score, {R('kde_1')} AS kde_1, {R('kde_1_mix')} AS kde_1_mix FROM hs"))
def j8(spark, sf):
    s = hotspots(spark, sf).select(text("origin").alias("origin"), "village_code", "y", "own_raw", "own", "town_score", "kde_1", "kde_1_mix")
    return rounded(s, "own", "town_score", "kde_1", "kde_1_mix")


_WIDTHS = {"km05": "0.5", "km1": "1.0", "km2": "2.0", "near": "sigma"}
_LAMS = ", ".join(f"SUM(k.n * POWER(0.5, k.age / 14.0) / (2 * pi() * {s} * {s}) * EXP(-(POWER(k.x - e.x, 2) + POWER(k.y - e.y, 2)) / (2 * {s} * {s}))) AS {n}" for n, s in _WIDTHS.items())
C_HOT_ALL = f"""va AS (SELECT o.origin, p.village_code, a.x, a.y, o.origin - p.onset AS age, p.n, row_number() OVER () AS r FROM po o JOIN pts p ON p.onset <= o.origin AND p.report <= o.origin AND o.origin - p.onset < 60 JOIN vg a ON a.village_code = p.village_code),
 vp AS (SELECT origin, village_code, x, y, MIN(r) AS r FROM va GROUP BY 1, 2, 3, 4),
 vd AS (SELECT a.origin, a.village_code, SQRT(POWER(a.x - b.x, 2) + POWER(a.y - b.y, 2)) AS d FROM vp a JOIN va b ON b.origin = a.origin AND a.r <> b.r),
 vk AS (SELECT origin, village_code, AVG(d) AS rbar, COUNT(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY origin, village_code ORDER BY d) AS rn FROM vd) WHERE rn <= 10 GROUP BY 1, 2),
 vs AS (SELECT va.*, CASE WHEN c = 10 THEN GREATEST(0.2, LEAST(5.0, SQRT(pi()) / SQRT(10) * rbar)) ELSE 5.0 END AS sigma FROM va LEFT JOIN vk ON vk.origin = va.origin AND vk.village_code = va.village_code),
 vl AS (SELECT k.origin, e.village_code, {_LAMS} FROM vs k CROSS JOIN vg e GROUP BY 1, 2),
 vm AS (SELECT hm.origin, hm.village_code, town, CAST(y AS DOUBLE) AS y, own14, mt, {", ".join(f"COALESCE(vl.{n} / SUM(vl.{n}) OVER (PARTITION BY hm.origin), 0) * t14 * g AS {n}" for n in _WIDTHS)} FROM hm LEFT JOIN vl ON vl.origin = hm.origin AND vl.village_code = hm.village_code)"""
_MEANS = {
    "own": "own14", "town_score": "mt", "kde_05": "km05", "kde_1": "km1", "kde_2": "km2", "kde_rv": "near",
    "kde_05_mix": "(0.5 * km05 + 0.5 * own14)", "kde_1_mix": "(0.5 * km1 + 0.5 * own14)", "kde_rv_mix": "(0.5 * near + 0.5 * own14)",
}


def _tail3(mu):
    p = f"(2 / (2 + GREATEST({mu}, 1e-12)))"
    return f"{_tail(mu)} - 3 * {p} * {p} * (1 - {p}) * (1 - {p})"


@query("j8b_all_village_models", chain(C_PTS, C_PO, C_GEO, C_HOT, C_HOT_ALL, f"SELECT CAST(origin AS VARCHAR) AS origin, village_code, y, {', '.join(f'{R(_tail(m))} AS {n}, {R(_tail3(m))} AS {n}_ge3' for n, m in _MEANS.items())} FROM vm"))
def j8b(spark, sf):
    names = [x for n in _MEANS for x in (n, f"{n}_ge3")]
    return rounded(hotspots(spark, sf).select(text("origin").alias("origin"), "village_code", "y", *names), *names)


def by_region(scores):
    """Long rows of all nine models and both event sizes: towns s0 to s4 are one region, the others the second."""
    rows = [F.struct(F.lit(n).alias("model"), F.lit(k).cast("long").alias("least"), F.round(n if k == 2 else f"{n}_ge3", 9).alias("score"), (F.col("y") >= k).alias("event")) for n in _MEANS for k in (2, 3)]
    d = scores.withColumn("region", F.when(F.col("town") <= "s4", "first").otherwise("second")).withColumn("_m", F.explode(F.array(*rows)))
    return d.select("origin", "village_code", "town", F.concat_ws(":", "region", "_m.model", F.col("_m.least").cast("string")).alias("region"), "_m.score", "_m.event")


@query("j9c_topk_by_region", chain(C_PTS, C_PO, C_GEO, C_HOT, C_HOT_ALL, "m AS (" + " UNION ALL ".join(f"SELECT origin, village_code, CASE WHEN town <= 's4' THEN 'first' ELSE 'second' END || ':{n}:{k}' AS region, ROUND({_tail(m) if k == 2 else _tail3(m)}, 9) AS s, y >= {k} AS event FROM vm" for n, m in _MEANS.items() for k in (2, 3)) + ")",
 "r AS (SELECT *, row_number() OVER (PARTITION BY region, origin ORDER BY s DESC, village_code) AS rn FROM m)",
 "g AS (SELECT region, origin, COUNT(*) FILTER (event) AS ev, COUNT(*) FILTER (event AND rn <= 5) AS h5, COUNT(*) FILTER (event AND rn <= 10) AS h10 FROM r GROUP BY 1, 2 HAVING COUNT(*) FILTER (event) > 0)",
 f"SELECT region, COUNT(*) AS days_with_events, {R('AVG(h5 / CAST(ev AS DOUBLE))')} AS recall_5, {R('AVG(h10 / CAST(ev AS DOUBLE))')} AS recall_10, {R('AVG(h5 / 5.0)')} AS precision_5, {R('AVG(h10 / 10.0)')} AS precision_10 FROM g GROUP BY region"))
def j9c(spark, sf):
    return rounded(sp.topk_quality(by_region(hotspots(spark, sf)), "score", (5, 10)), "recall_5", "recall_10", "precision_5", "precision_10")


C_SAME = "same AS (SELECT series AS origin, CASE WHEN vec_id % 3 = 0 THEN 1.25 ELSE x END AS x, CASE WHEN vec_id % 3 = 0 THEN -0.5 ELSE y END AS y, row_number() OVER () AS r FROM pts)"


@query("j4b_neighbours_at_one_place", chain(C_PTS, C_SAME, "p1 AS (SELECT origin, x, y, MIN(r) AS r FROM same GROUP BY 1, 2, 3)",
 "d AS (SELECT a.origin, a.x, a.y, SQRT(POWER(a.x - b.x, 2) + POWER(a.y - b.y, 2)) AS d FROM p1 a JOIN same b ON b.origin = a.origin AND a.r <> b.r)",
 f"SELECT origin, {R('x')} AS x, {R('y')} AS y, {R('AVG(d)')} AS rbar FROM (SELECT *, row_number() OVER (PARTITION BY origin, x, y ORDER BY d) AS rn FROM d) WHERE rn <= 10 GROUP BY origin, x, y HAVING COUNT(*) = 10"))
def j4b(spark, sf):
    """A third of the cases of each series stand at one place."""
    at = lambda c, v: F.when(F.col("vec_id") % 3 == 0, F.lit(v)).otherwise(F.col(c)).alias(c)
    p = points(spark, sf).select(F.col("series").alias("origin"), at("x", 1.25), at("y", -0.5))
    return rounded(sp.knn_mean_distance(p, 10), "x", "y", "rbar")


@query("j9_topk_quality", chain(C_PTS, C_PO, C_GEO, C_HOT, "r AS (SELECT *, y >= 2 AS event, row_number() OVER (PARTITION BY origin ORDER BY ROUND(kde_1, 9) DESC, village_code) AS rn FROM hs)",
 "g AS (SELECT origin, COUNT(*) FILTER (event) AS ev, COUNT(*) FILTER (event AND rn <= 5) AS h5, COUNT(*) FILTER (event AND rn <= 20) AS h20 FROM r GROUP BY 1 HAVING COUNT(*) FILTER (event) > 0)",
 f"SELECT 'all' AS region, COUNT(*) AS days_with_events, {R('AVG(h5 / CAST(ev AS DOUBLE))')} AS recall_5, {R('AVG(h20 / CAST(ev AS DOUBLE))')} AS recall_20, {R('AVG(h5 / 5.0)')} AS precision_5, {R('AVG(h20 / 20.0)')} AS precision_20 FROM g"))
def j9(spark, sf):
    s = hotspots(spark, sf).withColumns({"region": F.lit("all"), "event": F.col("y") >= 2, "kde_1": F.round("kde_1", 9)})
    return rounded(sp.topk_quality(s, "kde_1", (5, 20)), "recall_5", "recall_20", "precision_5", "precision_20")


@query("j9b_hotspot_auc", chain(C_PTS, C_PO, C_GEO, C_HOT, "e AS (SELECT CASE WHEN own_raw <= 0.5 THEN '0' WHEN own_raw <= 1.5 THEN '1' ELSE '>=2' END AS stratum, y >= 2 AS event, ROUND(kde_1, 9) AS s FROM hs)",
 "r AS (SELECT stratum, event, rank() OVER (PARTITION BY stratum ORDER BY s) + (COUNT(*) OVER (PARTITION BY stratum, s) - 1) / 2.0 AS r FROM e)",
 f"SELECT stratum, {R('(SUM(CASE WHEN event THEN r END) - COUNT(*) FILTER (event) * (COUNT(*) FILTER (event) + 1) / 2.0) / NULLIF(CAST(COUNT(*) FILTER (event) AS DOUBLE) * COUNT(*) FILTER (NOT event), 0)')} AS auc, COUNT(*) AS n, COUNT(*) FILTER (event) AS n_event FROM r GROUP BY 1"))
def j9b(spark, sf):
    from ..functions import labels as lb

    s = hotspots(spark, sf).withColumns({"stratum": lb.count_stratum(F.col("own_raw")), "event": F.col("y") >= 2, "kde_1": F.round("kde_1", 9)})
    return rounded(ranks.auc(s, ["stratum"], score="kde_1"), "auc")


def triangles(spark, sf):
    """One triangle per occupied 0.5 km square: the half below its diagonal; every other one has a second, small ring."""
    c = points(spark, sf).select(F.floor(F.col("x") / 0.5).cast("int").alias("cx"), F.floor(F.col("y") / 0.5).cast("int").alias("cy")).distinct()
    code = F.concat(F.lit("t"), F.col("cx").cast("string"), F.lit("_"), F.col("cy").cast("string"))
    v = F.explode(F.array(*[F.struct(F.lit(r).alias("ring"), F.lit(i).alias("seq"), F.lit(a).alias("a"), F.lit(b).alias("b")) for r, i, a, b in (
        (0, 0, 0.0, 0.0), (0, 1, 0.5, 0.0), (0, 2, 0.0, 0.5), (1, 0, 0.4, 0.4), (1, 1, 0.45, 0.4), (1, 2, 0.4, 0.45))]))
    d = c.select(code.alias("village_code"), "cx", "cy", v.alias("v")).where((F.col("v.ring") == 0) | (F.pmod(F.col("cx") + F.col("cy"), F.lit(2)) == 0))
    return d.select("village_code", F.col("v.ring").alias("ring"), F.col("v.seq").alias("seq"), (F.col("cx") * 0.5 + F.col("v.a")).alias("x"), (F.col("cy") * 0.5 + F.col("v.b")).alias("y"))


C_TRI = "tc AS (SELECT DISTINCT CAST(floor(x / 0.5) AS INTEGER) AS cx, CAST(floor(y / 0.5) AS INTEGER) AS cy FROM pts)"


@query("j10_areas", chain(C_PTS, C_TRI, f"""SELECT 't' || CAST(cx AS VARCHAR) || '_' || CAST(cy AS VARCHAR) AS village_code, {R('0.125 + CASE WHEN (cx + cy) % 2 = 0 THEN 0.00125 ELSE 0 END')} AS area,
 {R('(0.125 * (cx * 0.5 + 0.5 / 3) + CASE WHEN (cx + cy) % 2 = 0 THEN 0.00125 * (cx * 0.5 + 0.4 + 0.05 / 3) ELSE 0 END) / (0.125 + CASE WHEN (cx + cy) % 2 = 0 THEN 0.00125 ELSE 0 END)')} AS x FROM tc"""))
def j10(spark, sf):
    return rounded(sp.areas(triangles(spark, sf)), "area", "x").select("village_code", "area", "x")


@query("j11_assign_villages", chain(C_PTS, "q AS (SELECT vec_id, x, y, floor(x / 0.5) AS cx, floor(y / 0.5) AS cy, x - 0.5 * floor(x / 0.5) AS fx, y - 0.5 * floor(y / 0.5) AS fy, series FROM pts)",
 "a AS (SELECT vec_id, CASE WHEN series = 's3' THEN 'named' WHEN fx + fy < 0.5 OR (CAST(cx + cy AS INTEGER) % 2 = 0 AND fx > 0.4 AND fy > 0.4 AND fx - 0.4 + fy - 0.4 < 0.05) THEN 't' || CAST(CAST(cx AS INTEGER) AS VARCHAR) || '_' || CAST(CAST(cy AS INTEGER) AS VARCHAR) END AS village_code, series <> 's3' AS by_geometry FROM q)",
 "SELECT * FROM a WHERE village_code IS NOT NULL"))
def j11(spark, sf):
    p = points(spark, sf).select("vec_id", F.col("series").alias("vname"), "x", "y")
    names = p.where("vname = 's3'").select("vname", F.lit("named").alias("village_code")).distinct()
    return sp.assign_villages(p, triangles(spark, sf), names).select("vec_id", "village_code", "by_geometry")
