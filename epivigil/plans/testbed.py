"""Surveillance tables derived from the given tables, and the same derivations as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quantiles as qx
from ..operators import alerts as al
from ..operators import baselines as bl
from ..operators import calendar as cal
from ..operators import linelist as ll
from ..operators import panel as pn
from ..operators import scores as sc
from ..session import new_path, written_once

SEGS = {"early": (1997, 1998), "mid": (1999, 2000)}
CITIES = ("AFRICA", "AMERICA")
GRID = [round(0.1 * i, 1) for i in range(1, 10)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(spark: SparkSession, sf: str, key: str, make) -> DataFrame:
    """A stage that later steps read from storage, as the stages of a run exchange tables."""
    return written_once(spark, f"{sf}#{key}", make, reads=sf)


# --------------------------------------------------------------------------- weekly
def visits(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as visits: week, visit type, age, county, cases, total."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    d = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    d = d.select(
        "o_orderkey", "day", F.col("c_mktsegment").alias("visit_type"), F.col("o_orderpriority").alias("age"), F.col("n_name").alias("county"),
        (F.col("o_orderstatus") == "F").cast("long").alias("cases"), F.lit(1).cast("long").alias("total"),
    )
    return cal.add_week(d, "day")


YW = "CAST(year({0} + 3) AS VARCHAR) || lpad(CAST((dayofyear({0} + 3) - 1) // 7 + 1 AS VARCHAR), 2, '0')"


def yw_sql(start: str) -> str:
    return YW.format(start)


def yw_idx_sql(idx: str) -> str:
    return YW.format(f"(DATE '1970-01-04' + CAST(7 * ({idx}) AS INTEGER))")


def sunday_sql(d: str) -> str:
    return f"(CAST({d} AS DATE) - CAST(dayofweek({d}) AS INTEGER))"


C_VISITS = f"""visits AS (
 SELECT o_orderkey, day, visit_type, age, county, cases, total, ws, (ws - DATE '1970-01-04') // 7 AS week_idx, {yw_sql('ws')} AS yw FROM (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, {sunday_sql('o_orderdate')} AS ws, c_mktsegment AS visit_type,
   o_orderpriority AS age, n_name AS county, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS cases, 1 AS total
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))"""

C_NAT = C_VISITS + """,
 nat0 AS (SELECT week_idx, CAST(SUM(cases) AS BIGINT) AS cases, CAST(SUM(total) AS BIGINT) AS total FROM visits GROUP BY week_idx),
 nat AS (SELECT w AS week_idx, cases, total FROM (SELECT unnest(range(MIN(week_idx), MAX(week_idx) + 1)) AS w FROM visits) LEFT JOIN nat0 ON w = week_idx)"""

C_CPANEL = C_VISITS + """,
 csum AS (SELECT county, week_idx, SUM(cases) AS c, SUM(total) AS t FROM visits GROUP BY county, week_idx),
 cspan AS (SELECT unnest(range(MIN(week_idx), MAX(week_idx) + 1)) AS w FROM visits),
 cpanel AS (SELECT g.county, w AS week_idx, CAST(COALESCE(c, 0) AS BIGINT) AS cases, CAST(COALESCE(t, 0) AS BIGINT) AS total
  FROM (SELECT DISTINCT county FROM visits) g CROSS JOIN cspan LEFT JOIN csum ON csum.county = g.county AND csum.week_idx = w)"""


def national(spark: SparkSession, sf: str) -> DataFrame:
    """(week_idx, yw, week_start, cases, total) on the full range of weeks."""

    def make():
        v = visits(spark, sf)
        g = v.groupBy("week_idx").agg(F.sum("cases").alias("cases"), F.sum("total").alias("total"))
        s = pn.spine(*pn.bounds(v, "week_idx"), spark)
        return s.join(g, "week_idx", "left")

    return stored(spark, sf, "national", make)


def county_panel(spark: SparkSession, sf: str) -> DataFrame:
    """(county, week_idx, cases, total) on the full grid, zeros included."""

    def make():
        v = visits(spark, sf)
        g = v.groupBy("county", "week_idx").agg(F.sum("cases").alias("cases"), F.sum("total").alias("total"))
        lo, hi = pn.bounds(v, "week_idx")
        grid = g.select("county").distinct().withColumn("week_idx", F.explode(F.sequence(lo, hi)))
        return grid.join(g, ["county", "week_idx"], "left").select(
            "county", "week_idx", F.coalesce("cases", F.lit(0)).alias("cases"), F.coalesce("total", F.lit(0)).alias("total")
        )

    return stored(spark, sf, "county_panel", make)


def long_series(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly totals per age group and nationally as (source, week_idx, value), null where a week has no row."""

    def make():
        v = visits(spark, sf)
        ages = v.groupBy("age", "week_idx").agg(F.sum("total").cast("double").alias("value"))
        both = ages.withColumn("source", F.explode(F.array(F.lit("all"), F.col("age"))))
        g = both.groupBy("source", "week_idx").agg(F.sum("value").alias("value"))
        lo, hi = pn.bounds(v, "week_idx")
        return g.select("source").distinct().withColumn("week_idx", F.explode(F.sequence(lo, hi))).join(g, ["source", "week_idx"], "left")

    return stored(spark, sf, "long_series", make)


C_LONG = C_VISITS + """,
 lsum AS (SELECT source, week_idx, SUM(total) AS value FROM (SELECT 'all' AS source, * FROM visits UNION ALL SELECT age AS source, * FROM visits) GROUP BY 1, 2),
 lspan AS (SELECT unnest(range(MIN(week_idx), MAX(week_idx) + 1)) AS w FROM visits),
 lseries AS (SELECT g.source, w AS week_idx, CAST(value AS DOUBLE) AS value
  FROM (SELECT DISTINCT source FROM lsum) g CROSS JOIN lspan LEFT JOIN lsum ON lsum.source = g.source AND lsum.week_idx = w)"""

LV = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"


def backtest_cte(src: str, key: str, value: str, name: str = "bt", season: int = 52, window: int | None = None, warmup: int = 104,
                 horizon: int = 4, hs=(1, 2, 3, 4), models=("naive", "snaive", "ma3"), idx: str = "week_idx") -> str:
    """Baseline forecasts of table ``src`` (key, idx, value) with truth, as CTEs ending in ``name``."""
    w = f"(PARTITION BY {key} ORDER BY {idx})"

    def frame(skip: int, end: int) -> str:
        start = "UNBOUNDED PRECEDING" if window is None else f"{window - 1 - skip} PRECEDING"
        stop = "CURRENT ROW" if end == 0 else f"{end} PRECEDING"
        return f"OVER (PARTITION BY {key} ORDER BY {idx} ROWS BETWEEN {start} AND {stop})"

    a = [f"lead(x, {h}) OVER {w} AS y{h}" for h in hs] + [f"x - lag(x, {season}) OVER {w} AS es", f"lag(x, 1) OVER {w} AS l1", f"lag(x, 2) OVER {w} AS l2"]
    a += [f"lag(x, {season - h}) OVER {w} AS s{h}" for h in hs]
    m = {1: "(l2 + l1 + x) / 3.0", 2: "(l1 + x + m1) / 3.0", 3: "(x + m1 + m2) / 3.0", 4: "(m1 + m2 + m3) / 3.0"}
    ctes = [
        f"{name}_a AS (SELECT {key}, {idx}, x, row_number() OVER {w} AS rn, lead(x, {horizon}) OVER {w} AS fut, {', '.join(a)} FROM (SELECT {key}, {idx}, CAST({value} AS DOUBLE) AS x FROM {src}))"
    ]
    last = f"{name}_a"
    if "ma3" in models:
        for h in range(1, max(hs) + 1):
            ctes.append(f"{name}_m{h} AS (SELECT *, {m[h]} AS m{h} FROM {last})")
            last = f"{name}_m{h}"
    q = [f"AVG(ABS(es)) OVER (PARTITION BY {key} ORDER BY {idx} ROWS UNBOUNDED PRECEDING) AS scale"]
    if "snaive" in models:
        q.append(f"quantile_cont(es, {LV}) {frame(season, 0)} AS q_snaive")
    for h in hs:
        if "naive" in models:
            q.append(f"quantile_cont(y{h} - x, {LV}) {frame(0, horizon)} AS q_naive_{h}")
        if "ma3" in models:
            q.append(f"quantile_cont(y{h} - m{h}, {LV}) {frame(2, horizon)} AS q_ma3_{h}")
    ctes.append(f"{name}_q AS (SELECT *, {', '.join(q)} FROM {last})")
    sel = []
    for mod in models:
        for h in hs:
            p = {"naive": "x", "snaive": f"s{h}", "ma3": f"m{h}"}[mod]
            e = "q_snaive" if mod == "snaive" else f"q_{mod}_{h}"
            qs = ", ".join(f"GREATEST(0.0, floor(({p} + {e}[{i + 1}] - {e}[5]) * 1e9 + 0.5) / 1e9) AS q{10 * (i + 1)}" for i in range(9))
            least = season + 8 if mod == "snaive" else 0
            sel.append(
                f"SELECT {key}, '{mod}' AS model, {idx} AS origin, {h} AS h, y{h} AS y, x AS y_origin, scale AS mase_scale, {qs} FROM {name}_q WHERE rn >= {warmup} AND fut IS NOT NULL AND rn >= {least}"
            )
    ctes.append(f"{name}_u AS ({' UNION ALL '.join(sel)})")
    ctes.append(f"{name} AS (SELECT *, q50 AS median FROM {name}_u)")
    return ",\n".join(ctes)


def wis_sql(y: str = "y") -> str:
    t = f"0.5 * ABS({y} - q50)"
    for lo, hi, a in ((10, 90, 0.2), (20, 80, 0.4), (30, 70, 0.6), (40, 60, 0.8)):
        t += (f" + {a / 2} * ((q{hi} - q{lo}) + CASE WHEN {y} < q{lo} THEN {2 / a} * (q{lo} - {y}) ELSE 0 END"
              f" + CASE WHEN {y} > q{hi} THEN {2 / a} * ({y} - q{hi}) ELSE 0 END)")
    return f"(({t}) / 4.5)"


def prob_sql(thr: str, cap: float, ties: str) -> str:
    q = [f"q{10 * (i + 1)}" for i in range(9)]

    def mid(i: int) -> str:
        return f"1 - ({(i + 1) / 10} + CASE WHEN {q[i + 1]} > {q[i]} THEN ({thr} - {q[i]}) / ({q[i + 1]} - {q[i]}) ELSE 0 END * 0.1)"

    if ties == "first":
        body = f"WHEN {thr} <= q10 THEN {1 - cap} WHEN {thr} >= q90 THEN {cap} "
        body += " ".join(f"WHEN {q[i]} <= {thr} AND {thr} <= {q[i + 1]} THEN {mid(i)}" for i in range(8))
        return f"(CASE {body} ELSE 0.5 END)"
    n = " + ".join(f"CASE WHEN {x} <= {thr} THEN 1 ELSE 0 END" for x in q)
    body = " ".join(f"WHEN {i + 1} THEN {mid(i)}" for i in range(8))
    return f"(CASE ({n}) WHEN 0 THEN {1 - cap} WHEN 9 THEN {cap} {body} END)"


C_SCORED = C_CPANEL + ",\n" + backtest_cte("cpanel", "county", "cases") + f""",
 scored AS (SELECT *, {yw_idx_sql('origin')} AS origin_yw, {yw_idx_sql('origin + h')} AS target_yw, ABS(y - q50) AS abs_err, {wis_sql()} AS wis,
  y >= q10 AND y <= q90 AS cov80, y >= q20 AND y <= q80 AS cov60, (y > y_origin) = (q50 > y_origin) AS dir_hit,
  (CASE WHEN (y - y_origin) / GREATEST(ABS(y_origin), 1e-9) > 0.05 THEN 1 WHEN (y - y_origin) / GREATEST(ABS(y_origin), 1e-9) < -0.05 THEN -1 ELSE 0 END) =
  (CASE WHEN (q50 - y_origin) / GREATEST(ABS(y_origin), 1e-9) > 0.05 THEN 1 WHEN (q50 - y_origin) / GREATEST(ABS(y_origin), 1e-9) < -0.05 THEN -1 ELSE 0 END) AS dir_hit3,
  ABS(q50 - y) <= 0.1 * ABS(y) AS hit_tol10 FROM bt),
 results AS (SELECT *, model AS config, 'cases' AS target, CAST(substr(target_yw, 1, 4) AS INTEGER) AS target_year,
  CASE WHEN CAST(substr(target_yw, 1, 4) AS INTEGER) BETWEEN 1997 AND 1998 THEN 'early' WHEN CAST(substr(target_yw, 1, 4) AS INTEGER) BETWEEN 1999 AND 2000 THEN 'mid' ELSE 'other' END AS segment
  FROM scored)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Scored county backtest of three baselines, stored."""

    def make():
        f = bl.forecasts(county_panel(spark, sf), ["county"], "week_idx", "cases", horizon=4)
        f = sc.add_scores(f).withColumns(
            {
                "origin_yw": cal.yw_of_index(F.col("origin")), "target_yw": cal.yw_of_index(F.col("origin") + F.col("h")),
                "config": F.col("model"), "target": F.lit("cases"),
            }
        )
        return f.withColumn("target_year", F.substring("target_yw", 1, 4).cast("int"))

    return stored(spark, sf, "results", make)


# --------------------------------------------------------------------------- daily
def line_list(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as cases: onset = order day, county = region, township = nation, derived delay."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("onset"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    place = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("r_name").alias("county"), F.col("n_name").alias("township"))
    delay = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3, F.lit(40)).cast("int")
    d = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(place, c.c_nationkey == place.n_nationkey)
    return d.select(
        "l_orderkey", "l_linenumber", "onset", F.date_add("onset", delay).alias("report"), "county", "township",
        (F.col("l_returnflag") == "R").alias("imported"), F.lit(1).alias("n"), delay.alias("delay"),
    )


C_LL = """ll AS (SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS onset, r_name AS county, n_name AS township, l_returnflag = 'R' AS imported, 1 AS n,
  CAST((l_orderkey * 7 + l_linenumber * 3) % 40 AS INTEGER) AS delay
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
C_HIST = C_LL + """,
 hist AS (SELECT county || '|' || township AS series, onset, delay, CAST(SUM(n) AS BIGINT) AS n FROM ll WHERE NOT imported GROUP BY 1, 2, 3)"""
C_DAILY = C_HIST + """,
 dsum AS (SELECT series, onset AS day, SUM(n) AS n FROM hist GROUP BY 1, 2),
 dspan AS (SELECT unnest(range(0, (MAX(onset) - MIN(onset)) + 1)) AS i, MIN(onset) AS d0 FROM hist),
 daily AS (SELECT g.series, CAST(d0 + CAST(i AS INTEGER) AS DATE) AS day, CAST(COALESCE(n, 0) AS BIGINT) AS n
  FROM (SELECT DISTINCT series FROM hist) g CROSS JOIN dspan LEFT JOIN dsum ON dsum.series = g.series AND dsum.day = d0 + CAST(i AS INTEGER)),
 dthr AS (SELECT series, day, n, CAST(SUM(n) OVER (PARTITION BY series ORDER BY day ROWS 6 PRECEDING) AS BIGINT) AS s7,
  GREATEST(2.0 / 3 * SUM(n) OVER (PARTITION BY series ORDER BY day ROWS 20 PRECEDING), 3.0) AS thr FROM daily)"""


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "histogram", lambda: ll.delay_histogram(line_list(spark, sf)))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """(series, day, n, s7, thr) on every day."""
    d = ll.rolling_sum(ll.daily_panel(histogram(spark, sf)), "n")
    return ll.warning_threshold(d, "n")


def daily_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Every day with an onset as origin."""
    return histogram(spark, sf).select(F.col("onset").alias("origin")).distinct()


C_ORIGINS = "origins AS (SELECT DISTINCT onset AS origin FROM hist)"

EW_WINDOW, EW_WARMUP, EW_HS = 728, 365, tuple(range(1, 15))


def early_warning(spark: SparkSession, sf: str) -> DataFrame:
    """Daily backtest of the 7-day sum with final data: two baselines, all fourteen horizons, every day from the second year on as origin; stored."""

    def make():
        d = daily(spark, sf)
        f = bl.forecasts(d, ["series"], "day", "s7", ["naive", "snaive"], horizon=14, hs=EW_HS, season=364, window=EW_WINDOW, warmup=EW_WARMUP)
        t = d.select("series", F.col("day").alias("origin"), "thr", F.col("thr").alias("thr_final"), "s7")
        f = f.join(t, ["series", "origin"]).withColumns({"mode": F.lit("final"), "year": F.year("origin")})
        return al.score_daily(f)

    return stored(spark, sf, "early_warning", make)


C_EW = C_DAILY + ",\n" + backtest_cte("dthr", "series", "s7", "ewf", 364, EW_WINDOW, EW_WARMUP, 14, EW_HS, ("naive", "snaive"), "day") + f""",
 ew AS (SELECT f.*, 'final' AS mode, t.thr, t.thr AS thr_final, t.s7, CAST(year(f.origin) AS INTEGER) AS year, {wis_sql('f.y')} AS wis, f.y >= q10 AND f.y <= q90 AS cov80,
  {prob_sql('t.thr', 0.02, 'last')} AS prob, f.y >= t.thr AS event FROM ewf f JOIN dthr t ON t.series = f.series AND t.day = f.origin),
 anyr AS (SELECT model, mode, series, origin, year, MAX(prob) AS prob, MAX(event) AS event, MAX(y) AS y, MIN(thr) AS thr, MIN(thr_final) AS thr_final, MIN(s7) AS s7 FROM ew GROUP BY ALL),
 wkt AS (SELECT mode, model, series, CAST(date_trunc('week', origin) AS DATE) AS week, MAX(prob) AS prob, MAX(event) AS event, MAX(thr_final) AS thr_max, MIN(year) AS year, MAX(s7) AS raw7 FROM anyr GROUP BY 1, 2, 3, 4),
 wks AS (SELECT *, CASE WHEN split_part(series, '|', 1) IN ('AFRICA', 'AMERICA') THEN 'focus' ELSE 'other' END AS region,
  CASE WHEN thr_max <= 3 THEN 'first_cluster' ELSE 'accelerating' END AS etype FROM wkt)"""
C_EP = """eb AS (SELECT series, day, s7, thr, s7 >= thr AS up, MAX(CASE WHEN s7 >= thr THEN day END) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM dthr),
 ep AS (SELECT series, day, s7, thr FROM eb WHERE up AND (prev IS NULL OR day - prev > 14))"""


def any_rows(spark: SparkSession, sf: str) -> DataFrame:
    return stored(
        spark, sf, "any_rows",
        lambda: al.any_crossing(early_warning(spark, sf), ("model", "mode", "series", "origin", "year", "s7")),
    )


def weeks(spark: SparkSession, sf: str) -> DataFrame:
    w = al.weekly(any_rows(spark, sf), extra=[F.min("year").alias("year"), F.max("s7").alias("raw7")])
    return al.add_strata(w, CITIES)


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import detectors as dt

    return stored(spark, sf, "episodes", lambda: dt.episodes(daily(spark, sf)).select("series", "day", "s7", "thr"))


# --------------------------------------------------------------------------- points
def points(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as cases on the plane: series = label, village = label and a fifth of the ids, onset and report by id."""
    e = table(spark, sf, "embeddings")
    on = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("vec_id", F.lit(60)).cast("int"))
    return e.select(
        "vec_id", F.concat(F.lit("s"), F.col("label").cast("string")).alias("series"),
        F.concat(F.lit("v"), F.col("label").cast("string"), F.lit("_"), F.pmod("vec_id", F.lit(5)).cast("string")).alias("village_code"),
        (F.col("embedding")[0].cast("double") * 10).alias("x"), (F.col("embedding")[1].cast("double") * 10).alias("y"),
        on.alias("onset"), F.date_add(on, F.pmod("vec_id", F.lit(7)).cast("int")).alias("report"), F.lit(1).alias("n"),
    )


C_PTS = """pts AS (SELECT vec_id, 's' || CAST(label AS VARCHAR) AS series, 'v' || CAST(label AS VARCHAR) || '_' || CAST(vec_id % 5 AS VARCHAR) AS village_code,
  CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, DATE '2020-01-01' + CAST(vec_id % 60 AS INTEGER) AS onset,
  DATE '2020-01-01' + CAST(vec_id % 60 AS INTEGER) + CAST(vec_id % 7 AS INTEGER) AS report, 1 AS n FROM embeddings)"""


def point_origins(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select(F.col("onset").alias("origin")).distinct()


def scratch_csv(df: DataFrame, name: str, **options) -> str:
    """The table written as CSV in the shared folder; gives the folder."""
    path = new_path(df.sparkSession, name)
    w = df.write.option("header", True)
    for k, v in options.items():
        w = w.option(k, v)
    w.csv(path)
    return path


QCOLS = qx.QCOLS
