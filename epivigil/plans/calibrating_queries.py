"""Probability calibration and scores."""

from pyspark.sql import functions as F

from ..operators import calibration as cb
from .registry import R, big, chain, query, rnd, rounded, text
from .testbed import C_EW, any_rows, stored

_EDGES = "[" + ", ".join(repr(e) for e in cb.edges()) + "]"
_BIN = f"GREATEST(len(list_filter({_EDGES}, lambda e: e <= prob)) - 1, 0)"


def naive_rows(spark, sf):
    return any_rows(spark, sf).where("model = 'naive'")


def scores(spark, sf):
    """Probabilities to nine decimals: sums in another order do not part equal scores."""
    return naive_rows(spark, sf).withColumn("prob", F.round("prob", 9))


def _knots(src: str, key: str) -> str:
    """CTE kn (key, x, y, n): isotonic knots of ``src`` (key, p, n, pos). A block ends where no mean that ends there exceeds a mean that starts behind it."""
    mean = "({1}.cp - {0}.cp) / CAST({1}.cn - {0}.cn AS DOUBLE)"
    return f"""pt0 AS (SELECT {key} AS k, p, n, pos, row_number() OVER w AS i, SUM(n) OVER w AS cn, SUM(pos) OVER w AS cp FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY p)),
 pt AS (SELECT k, i, cn, cp FROM pt0 UNION ALL SELECT DISTINCT k, 0, 0, 0 FROM pt0),
 bd AS (SELECT a.k, a.i, MAX(CASE WHEN b.i < a.i THEN {mean.format("b", "a")} END) <= COALESCE(MIN(CASE WHEN b.i > a.i THEN {mean.format("a", "b")} END), 2) AS is_end FROM pt a JOIN pt b ON a.k = b.k AND a.i <> b.i WHERE a.i > 0 GROUP BY 1, 2),
 bl AS (SELECT pt0.*, COALESCE(SUM(CAST(is_end AS INTEGER)) OVER (PARTITION BY pt0.k ORDER BY pt0.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blk FROM pt0 JOIN bd ON bd.k = pt0.k AND bd.i = pt0.i),
 kn AS (SELECT k, SUM(p * n) / SUM(n) AS x, SUM(pos) / CAST(SUM(n) AS DOUBLE) AS y, SUM(n) AS n FROM bl GROUP BY k, blk)"""


def _between_knots(points: str) -> str:
    """CTE cal (k, p, v): the knots' value at each of ``points`` (k, p)."""
    return f"""ar AS (SELECT q.k, q.p, arg_max(kn.y, kn.x) FILTER (kn.x <= q.p) AS ly, MAX(kn.x) FILTER (kn.x <= q.p) AS lx, arg_min(kn.y, kn.x) FILTER (kn.x >= q.p) AS hy, MIN(kn.x) FILTER (kn.x >= q.p) AS hx FROM {points} q JOIN kn ON kn.k = q.k GROUP BY 1, 2),
 cal AS (SELECT k, p, GREATEST(0.0, LEAST(1.0, CASE WHEN lx IS NULL THEN hy WHEN hx IS NULL THEN ly WHEN hx > lx THEN ly + (hy - ly) * (p - lx) / (hx - lx) ELSE ly END)) AS v FROM ar)"""


def _platt(src: str, rounds: int = 12) -> str:
    """CTE pl (k, a, b): Newton steps from (1, 0) over ``src`` (k, p, n, pos), with the weights' and the diagonal's small terms."""
    z = "LN(GREATEST(0.001, LEAST(0.999, p)) / (1 - GREATEST(0.001, LEAST(0.999, p))))"
    parts = [f"zz AS (SELECT k, n, pos, {z} AS z FROM {src})", "n0 AS (SELECT DISTINCT k, CAST(1 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM zz)"]
    for i in range(1, rounds + 1):
        parts.append(f"""s{i} AS (SELECT k, MIN(a) AS a, MIN(b) AS b, SUM((q * n - pos) * z) AS g0, SUM(q * n - pos) AS g1, SUM((q * (1 - q) + 1e-9) * n * z * z) + 1e-6 AS h00, SUM((q * (1 - q) + 1e-9) * n * z) AS h01, SUM((q * (1 - q) + 1e-9) * n) + 1e-6 AS h11
  FROM (SELECT zz.*, a, b, 1 / (1 + EXP(-(a * z + b))) AS q FROM zz JOIN n{i - 1} AS o ON o.k = zz.k) GROUP BY k),
 n{i} AS (SELECT k, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM s{i})""")
    return ",\n ".join([*parts, f"pl AS (SELECT * FROM n{rounds})"])


_SIGMOID = "1 / (1 + EXP(-(a * LN(GREATEST(0.001, LEAST(0.999, {0})) / (1 - GREATEST(0.001, LEAST(0.999, {0})))) + b)))"
C_NAIVE = C_EW + ",\n nv AS (SELECT * REPLACE (ROUND(prob, 9) AS prob) FROM anyr WHERE model = 'naive'),\n byp AS (SELECT mode, year, prob AS p, COUNT(*) AS n, COUNT(*) FILTER (event) AS pos FROM nv GROUP BY 1, 2, 3)"
C_ALL_YEARS = "ap AS (SELECT 'all' AS k, mode, p, SUM(n) AS n, SUM(pos) AS pos FROM byp GROUP BY 1, 2, 3)"
C_OTHER_YEARS = "lo AS (SELECT y.year AS k, p, SUM(n) AS n, SUM(pos) AS pos FROM (SELECT DISTINCT year FROM byp) y JOIN byp ON byp.year <> y.year GROUP BY 1, 2)"


@query("i16_isotonic", chain(C_NAIVE, C_ALL_YEARS, _knots("ap", "mode"), f"SELECT k AS mode, {R('x')} AS x, {R('y')} AS y, CAST(n AS BIGINT) AS n FROM kn"))
def i16(spark, sf):
    knots = cb.isotonic_fit(cb.counts_by_score(scores(spark, sf), ["mode"]), ["mode"])
    return knots.select("mode", rnd("x").alias("x"), rnd("y").alias("y"), big("n").alias("n"))


@query("i17_platt", chain(C_NAIVE, C_ALL_YEARS, _platt("ap"), f"SELECT p, CAST(n AS DOUBLE) AS n, CAST(pos AS DOUBLE) AS pos, {R(_SIGMOID.format('p'))} AS calibrated FROM ap JOIN pl ON pl.k = ap.k"))
def i17(spark, sf):
    r = scores(spark, sf)
    counts = cb.counts_by_score(r.withColumn("fold", F.lit("all")), ["fold"])
    params = cb.platt_fit(counts, "fold")
    return counts.select("p", "n", "pos", rnd(cb.platt_predict(F.col("p"), F.col("fold"), params)).alias("calibrated"))


@query("i18_leave_one_year_out", chain(C_NAIVE, C_OTHER_YEARS, _knots("lo", "k"), "yp AS (SELECT DISTINCT year AS k, p FROM byp)", _between_knots("yp"), _platt("lo"),
 f"SELECT nv.series, CAST(nv.origin AS VARCHAR) AS origin, nv.year, event, {R('prob')} AS prob, {R('v')} AS prob_cal, {R(_SIGMOID.format('prob'))} AS prob_platt FROM nv LEFT JOIN cal ON cal.k = nv.year AND cal.p = nv.prob LEFT JOIN pl ON pl.k = nv.year"))
def i18(spark, sf):
    r = scores(spark, sf)
    a = cb.loyo(r, out="prob_cal")
    b = cb.loyo(a, method="platt", out="prob_platt")
    return b.select("series", text("origin").alias("origin"), "year", "event", rnd("prob").alias("prob"), rnd("prob_cal").alias("prob_cal"), rnd("prob_platt").alias("prob_platt"))


@query("i19_probability_scores", chain(C_EW, "c AS (SELECT model, year, CAST(event AS INTEGER) AS y, prob, GREATEST(0.001, LEAST(0.999, prob)) AS pc FROM anyr)",
 f"b AS (SELECT model, year, {_BIN} AS b, SUM(prob) AS sp, SUM(y) AS sy FROM c GROUP BY 1, 2, 3), e AS (SELECT model, year, SUM(ABS(sp - sy)) AS d FROM b GROUP BY 1, 2)",
 f"""SELECT c.model, CAST(c.year AS BIGINT) AS year, COUNT(*) AS n, {R('AVG(y)')} AS event_rate, {R('AVG((prob - y) * (prob - y))')} AS brier, {R('AVG(-(y * LN(pc) + (1 - y) * LN(1 - pc)))')} AS logloss, {R('MIN(d) / COUNT(*)')} AS ece
 FROM c JOIN e ON e.model = c.model AND e.year = c.year GROUP BY 1, 2"""))
def i19(spark, sf):
    s = cb.probability_scores(any_rows(spark, sf), ["model", "year"])
    return rounded(s, "event_rate", "brier", "logloss", "ece").withColumn("year", big("year"))


@query("i20_reliability", chain(C_EW, f"b AS (SELECT {_BIN} AS bin, COUNT(*) AS n, AVG(prob) AS mp, AVG(CAST(event AS INTEGER)) AS ob FROM anyr WHERE model = 'naive' GROUP BY 1)",
 f"SELECT CAST(s.bin AS BIGINT) AS bin, COALESCE(n, 0) AS n, {R('mp')} AS mean_pred, {R('ob')} AS observed FROM (SELECT unnest(range(0, 10)) AS bin) s LEFT JOIN b ON b.bin = s.bin"))
def i20(spark, sf):
    return rounded(cb.reliability(naive_rows(spark, sf)), "mean_pred", "observed").withColumn("bin", big("bin"))


@query("i21_calibration_map", chain(C_NAIVE, C_ALL_YEARS, _knots("ap", "k"), "gr AS (SELECT 'all' AS k, ROUND(CAST(i AS DOUBLE) * 0.01, 6) AS p FROM (SELECT unnest(range(0, 101)) AS i))", _between_knots("gr"), f"SELECT p AS raw, {R('v')} AS calibrated FROM cal"))
def i21(spark, sf):
    knots = cb.isotonic_fit(cb.counts_by_score(scores(spark, sf), []), [])
    return rounded(cb.calibration_map(knots), "calibrated")
