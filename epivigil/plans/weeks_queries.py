"""Calendar and covariates."""

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import covariates as cov
from .registry import R, big, chain, query, rnd, text
from .testbed import C_NAT, C_VISITS, national, sunday_sql, table, visits, yw_sql


def date_map(spark, sf):
    """Order days as a (date, year, week) map under the Sunday rule."""
    d = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    yw = cal.yw_of_date(F.col("date"))
    return d.select("date", F.substring(yw, 1, 4).cast("int").alias("year"), F.substring(yw, 5, 2).cast("int").alias("week"))


def dimension(spark, sf):
    return cal.week_dimension(date_map(spark, sf))


C_DIM = f"""dmap AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, {yw_sql(sunday_sql('o_orderdate'))} AS yw FROM orders),
 dim0 AS (SELECT yw, CAST(substr(yw, 1, 4) AS INTEGER) AS year, CAST(substr(yw, 5, 2) AS INTEGER) AS week, MIN(date) AS week_start, MAX(date) AS week_end, COUNT(*) AS n_days FROM dmap GROUP BY yw),
 dim AS (SELECT *, MAX(week) OVER (PARTITION BY year) AS n_weeks_in_year, row_number() OVER (ORDER BY week_start) - 1 AS week_idx FROM dim0)"""


@query("c1_week_dimension", chain(C_DIM, """SELECT yw, CAST(year AS BIGINT) AS year, CAST(week AS BIGINT) AS week, CAST(week_start AS VARCHAR) AS week_start,
 CAST(week_end AS VARCHAR) AS week_end, n_days, CAST(n_weeks_in_year AS BIGINT) AS n_weeks_in_year, week_idx FROM dim"""))
def c1(spark, sf):
    return dimension(spark, sf).select(
        "yw", big("year").alias("year"), big("week").alias("week"), text("week_start").alias("week_start"), text("week_end").alias("week_end"),
        "n_days", big("n_weeks_in_year").alias("n_weeks_in_year"), big("week_idx").alias("week_idx"),
    )


@query("c2_week_shift", chain(C_DIM, """SELECT d.yw, s.step, n.yw AS next_yw, b.yw AS previous_yw FROM dim d
 CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS step) s JOIN dim n ON n.week_idx = d.week_idx + s.step JOIN dim b ON b.week_idx = d.week_idx - 1
 WHERE d.week_idx BETWEEN (SELECT week_idx FROM dim WHERE yw = '199510') AND (SELECT week_idx FROM dim WHERE yw = '200052')"""))
def c2(spark, sf):
    dim = dimension(spark, sf)
    rng = cal.week_range(dim, "199510", "200052").select("yw")
    ahead = cal.next_weeks(rng, dim, 4)
    return cal.shift_week(ahead, dim, -1, out="previous_yw").select("yw", "step", "next_yw", "previous_yw")


@query("c3_week_of_date", chain(C_DIM, """SELECT d.yw, COUNT(*) AS orders FROM orders o JOIN dim d ON CAST(o.o_orderdate AS DATE) BETWEEN d.week_start AND d.week_end GROUP BY 1"""))
def c3(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return cal.week_of_date(o, "day", dimension(spark, sf)).groupBy("yw").agg(F.count("*").alias("orders"))


@query("c4_asof_week", chain(C_DIM, """s AS (SELECT CAST(l_shipdate AS DATE) AS ship, COUNT(*) AS n FROM lineitem GROUP BY 1)""",
 """SELECT yw, CAST(SUM(n) AS BIGINT) AS items FROM (SELECT s.n, (SELECT max_by(d.yw, d.week_start) FROM dim d WHERE d.week_start <= s.ship) AS yw FROM s) GROUP BY yw"""))
def c4(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("ship")).groupBy("ship").agg(F.count("*").alias("n"))
    return cal.asof_week(d, "ship", dimension(spark, sf)).groupBy("yw").agg(F.sum("n").alias("items"))


def _wiy(y):
    return f"((dayofyear(make_date({y}, 12, 31)) - ((3 - dayofweek(make_date({y}, 1, 1)) + 7) % 7) - 1) // 7 + 1)"


@query("c5_season", chain(C_NAT, f"""w AS (SELECT {yw_sql("(DATE '1970-01-04' + CAST(7 * week_idx AS INTEGER))")} AS yw FROM nat),
 p AS (SELECT yw, (CAST(substr(yw, 5, 2) AS INTEGER) - 0.5) / {_wiy("CAST(substr(yw, 1, 4) AS BIGINT)")} AS ph, CAST(substr(yw, 5, 2) AS INTEGER) - 1 AS k FROM w)""",
 f"""SELECT yw, {R('ph')} AS phase, {R('sin(2 * pi() * ph)')} AS season_sin, {R('cos(2 * pi() * ph)')} AS season_cos, {R('sin(2 * pi() * k / 52.18)')} AS s2_sin1,
 {R('cos(2 * pi() * k / 52.18)')} AS s2_cos1, {R('sin(4 * pi() * k / 52.18)')} AS s2_sin2, {R('cos(4 * pi() * k / 52.18)')} AS s2_cos2 FROM p"""))
def c5(spark, sf):
    yw = F.col("yw")
    ph = cal.seasonal_phase(F.substring(yw, 5, 2).cast("int"), cal.weeks_in_year(F.substring(yw, 1, 4).cast("int")))
    cols = {**cal.harmonics(yw), **cal.double_harmonics(yw)}
    return national(spark, sf).select("yw", rnd(ph).alias("phase"), *[rnd(c).alias(k) for k, c in cols.items()])


def holidays(spark, sf):
    """First of each month as a holiday of the order days; February's belongs to the new-year break, weekends are weekends."""
    d = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    m, dom, wd = F.month("date"), F.dayofmonth("date"), F.dayofweek("date")
    return d.where((dom == 1) | wd.isin(1, 7)).select(
        "date", F.when((dom == 1) & (m == 2), "春節").when(dom == 1, "month start").alias("name"), F.lit(True).alias("isHoliday"),
        F.when(dom == 1, F.lit("public")).otherwise(cov.WEEKEND_CATEGORY).alias("holidayCategory"), F.lit("").alias("description"),
    )


def closures(spark, sf):
    """Days with few orders as closures."""
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    g = o.groupBy("date").agg(F.count("*").alias("n_counties"))
    avg = g.agg(F.avg("n_counties")).scalar()
    return g.where(F.col("n_counties") < 0.4 * avg).select(
        "date", F.lit("closed").alias("name"), F.lit("all").alias("scope"), F.col("n_counties").cast("int").alias("n_counties"), F.lit("").alias("source"), F.lit("").alias("status")
    )


C_HOL = f"""odays AS (SELECT CAST(o_orderdate AS DATE) AS date, COUNT(*) AS n FROM orders GROUP BY 1),
 hol AS (SELECT date, CASE WHEN day(date) = 1 AND month(date) = 2 THEN '春節' WHEN day(date) = 1 THEN 'month start' END AS name, day(date) = 1 AS pub FROM odays WHERE day(date) = 1 OR dayofweek(date) IN (0, 6)),
 clo AS (SELECT date, 'closed' AS name FROM odays WHERE n < 0.4 * (SELECT AVG(n) FROM odays)),
 xclo AS (SELECT * FROM clo WHERE dayofweek(date) BETWEEN 1 AND 5 AND date NOT IN (SELECT date FROM hol WHERE pub)),
 hparts AS (SELECT {sunday_sql('date')} AS ws, 1 AS h, 0 AS c, 0 AS y FROM hol WHERE pub UNION ALL SELECT {sunday_sql('date')}, 0, 1, 0 FROM xclo UNION ALL SELECT {sunday_sql('date')}, 0, 0, 1 FROM hol WHERE name = '春節'),
 hw0 AS (SELECT ws, SUM(h) AS h, SUM(c) AS c, MAX(y) AS y FROM hparts GROUP BY ws),
 hwk AS (SELECT w.week_idx, w.ws, COALESCE(h, 0) + COALESCE(c, 0) AS holiday_days, COALESCE(y, 0) AS cny_week, COALESCE(c, 0) AS closure_days
  FROM (SELECT week_idx, DATE '1970-01-04' + CAST(7 * week_idx AS INTEGER) AS ws FROM nat) w LEFT JOIN hw0 ON hw0.ws = w.ws)"""


def holiday_table(spark, sf):
    return cov.holiday_weeks(national(spark, sf).select("yw", "week_start"), holidays(spark, sf), closures(spark, sf), new_year={})


@query("c6_holiday_weeks", chain(C_NAT, C_HOL, f"""SELECT {yw_sql('ws')} AS yw, CAST(holiday_days AS DOUBLE) AS holiday_days, CAST(cny_week AS DOUBLE) AS cny_week, CAST(closure_days AS DOUBLE) AS closure_days FROM hwk"""))
def c6(spark, sf):
    return holiday_table(spark, sf).select("yw", "holiday_days", "cny_week", "closure_days")


C_SCHOOL = f"""sc0 AS (SELECT {yw_sql('ws')} AS yw, ws, ws + 3 AS d, CAST(year(ws + 3) AS BIGINT) AS y FROM (SELECT DATE '1970-01-04' + CAST(7 * week_idx AS INTEGER) AS ws FROM nat)),
 sc1 AS (SELECT yw, ws, CASE WHEN d BETWEEN make_date(y, 7, 1) AND make_date(y, 8, 29) THEN 1 ELSE 0 END AS summer_break,
  CASE WHEN d BETWEEN make_date(y, 1, 21) AND GREATEST(make_date(y, 2, 10), make_date(y, 2, 5) + 6) THEN 1 ELSE 0 END AS winter_break FROM sc0),
 sc2 AS (SELECT *, CASE WHEN LAG(GREATEST(summer_break, winter_break), 1, 0) OVER (ORDER BY ws) = 1 AND GREATEST(summer_break, winter_break) = 0 THEN 1 ELSE 0 END AS e FROM sc1),
 school AS (SELECT yw, ws, summer_break, winter_break, GREATEST(e, LAG(e, 1, 0) OVER (ORDER BY ws)) AS reopen FROM sc2)"""


@query("c7_school_calendar", chain(C_NAT, C_SCHOOL, "SELECT yw, CAST(summer_break AS BIGINT) AS summer_break, CAST(winter_break AS BIGINT) AS winter_break, CAST(reopen AS BIGINT) AS reopen FROM school"))
def c7(spark, sf):
    s = cov.school_weeks(national(spark, sf).select("yw", "week_start"))
    return s.select("yw", *[big(c).alias(c) for c in ("summer_break", "winter_break", "reopen")])


@query("c8_future_covariates", chain(
    C_NAT,
    "nat2 AS (SELECT week_idx, DATE '1970-01-04' + CAST(7 * week_idx AS INTEGER) AS ws FROM nat UNION ALL SELECT m + k, DATE '1970-01-04' + CAST(7 * (m + k) AS INTEGER) FROM (SELECT MAX(week_idx) AS m FROM nat), (SELECT unnest([1, 2, 3, 4]) AS k))",
    C_HOL.replace("FROM nat)", "FROM nat2)"), C_SCHOOL.replace("FROM nat)", "FROM nat2)"),
    f"""SELECT s.yw, {R(f'sin(2 * pi() * (CAST(substr(s.yw, 5, 2) AS INTEGER) - 0.5) / ' + _wiy('CAST(substr(s.yw, 1, 4) AS BIGINT)') + ')')} AS season_sin,
 {R(f'cos(2 * pi() * (CAST(substr(s.yw, 5, 2) AS INTEGER) - 0.5) / ' + _wiy('CAST(substr(s.yw, 1, 4) AS BIGINT)') + ')')} AS season_cos,
 CAST(s.summer_break AS BIGINT) AS summer_break, CAST(s.winter_break AS BIGINT) AS winter_break, CAST(s.reopen AS BIGINT) AS reopen, CAST(h.cny_week AS DOUBLE) AS cny_week, CAST(h.holiday_days AS DOUBLE) AS holiday_days
 FROM school s JOIN hwk h ON h.ws = s.ws"""))
def c8(spark, sf):
    w = cov.horizon_weeks(national(spark, sf).select("week_start"), 4)
    # the listed new-year dates lie decades after these weeks and mark none of them
    f = cov.future_covariates(w, ("season", "school", "cny", "holiday"), holidays(spark, sf), closures(spark, sf))
    return f.select(
        "yw", rnd("season_sin").alias("season_sin"), rnd("season_cos").alias("season_cos"), *[big(c).alias(c) for c in ("summer_break", "winter_break", "reopen")],
        "cny_week", "holiday_days",
    )


@query("c9_past_only", chain(C_VISITS, """s AS (SELECT week_idx, county, CAST(SUM(CASE WHEN cases = 1 THEN total END) AS DOUBLE) AS v FROM visits GROUP BY 1, 2),
 l AS (SELECT county, week_idx, v, LAG(v, 2) OVER (PARTITION BY county ORDER BY week_idx) AS x FROM s)""",
 """SELECT county, week_idx, COALESCE(FIRST_VALUE(x IGNORE NULLS) OVER (PARTITION BY county ORDER BY week_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
 LAST_VALUE(x IGNORE NULLS) OVER (PARTITION BY county ORDER BY week_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS v FROM l"""))
def c9(spark, sf):
    s = visits(spark, sf).groupBy("county", "week_idx").agg(F.sum(F.when(F.col("cases") == 1, F.col("total"))).cast("double").alias("v"))
    return cov.past_only(s, ["v"], 2, "week_idx", ["county"]).select("county", big("week_idx").alias("week_idx"), "v")
