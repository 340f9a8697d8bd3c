"""Labels, predicates and scalar rules."""

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import labels as lb
from ..operators import linelist as ll
from .registry import R, big, chain, query, rnd
from .testbed import CITIES, C_CPANEL, C_DAILY, C_VISITS, county_panel, daily, points, table, visits, C_PTS

AGE_MAP = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}


@query("b1_normalize_labels", """SELECT CASE trim(o_orderpriority) WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE trim(o_orderpriority) END AS age,
 CASE o_orderstatus WHEN 'F' THEN '台南市' WHEN 'O' THEN '桃園市' ELSE 'P' END AS county, COUNT(*) AS n FROM orders GROUP BY 1, 2""")
def b1(spark, sf):
    o = table(spark, sf, "orders")
    raw = F.when(F.col("o_orderstatus") == "F", " 臺南市 ").when(F.col("o_orderstatus") == "O", "桃園縣").otherwise("P")
    return o.select(
        lb.normalize_label(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")), AGE_MAP).alias("age"), lb.normalize_label(raw, lb.COUNTY_VARIANTS).alias("county")
    ).groupBy("age", "county").agg(F.count("*").alias("n"))


@query("b2_compose_yw", """SELECT CASE WHEN week(o_orderdate) % 2 = 0 THEN CAST(year(o_orderdate) AS VARCHAR) || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0')
 ELSE CAST(year(o_orderdate) AS VARCHAR) || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') END AS yw, COUNT(*) AS n FROM orders GROUP BY 1""")
def b2(spark, sf):
    d = F.col("o_orderdate")
    wk = F.weekofyear(d)
    # half of the rows carry year and week joined already, the others a bare week number
    raw = F.when(wk % 2 == 0, F.concat(F.year(d).cast("string"), F.lpad(wk.cast("string"), 2, "0"))).otherwise(wk.cast("string"))
    return table(spark, sf, "orders").select(lb.compose_yw(raw, F.year(d).cast("string")).alias("yw")).groupBy("yw").agg(F.count("*").alias("n"))


@query("b3_count_or_zero", """SELECT o_orderpriority AS age, CAST(SUM(COALESCE(CAST(TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS BIGINT), 0)) AS BIGINT) AS digits,
 CAST(SUM(COALESCE(CAST(TRY_CAST(o_orderstatus AS DOUBLE) AS BIGINT), 0)) AS BIGINT) AS garbage, CAST(SUM(CAST(trunc(o_totalprice) AS BIGINT)) AS BIGINT) AS whole FROM orders GROUP BY 1""")
def b3(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("age")).agg(
        F.sum(lb.count_or_zero(F.substring("o_orderpriority", 1, 1))).alias("digits"), F.sum(lb.count_or_zero(F.col("o_orderstatus"))).alias("garbage"),
        F.sum(lb.count_or_zero(F.col("o_totalprice").cast("string"))).alias("whole"),
    )


@query("b4_ratios", chain(C_CPANEL, f"SELECT county, week_idx, {R('100.0 * cases / NULLIF(total, 0)')} AS rate_pct, {R('1000.0 * cases / NULLIF(total, 0)')} AS per_1k, {R('cases / NULLIF(CAST(total AS DOUBLE), 0)')} AS share FROM cpanel"))
def b4(spark, sf):
    c, t = F.col("cases"), F.col("total")
    return county_panel(spark, sf).select(
        "county", big("week_idx").alias("week_idx"), rnd(lb.ratio(c, t, 100)).alias("rate_pct"), rnd(lb.ratio(c, t, 1000)).alias("per_1k"), rnd(lb.ratio(c, t)).alias("share")
    )


@query("b5_valid_keys", chain(C_VISITS, "SELECT k AS yw, COUNT(*) AS n FROM (SELECT CASE WHEN age = '5-LOW' THEN yw || 'x' ELSE yw END AS k FROM visits) WHERE regexp_full_match(k, '[0-9]{6}') GROUP BY 1"))
def b5(spark, sf):
    k = F.when(F.col("age") == "5-LOW", F.concat("yw", F.lit("x"))).otherwise(F.col("yw"))
    return visits(spark, sf).select(k.alias("yw")).where(lb.is_week_key(F.col("yw"))).groupBy("yw").agg(F.count("*").alias("n"))


@query("b6_keep_and_drop_groups", chain(C_VISITS, "keep AS (SELECT n_name FROM nation WHERE n_regionkey <= 2), done AS (SELECT n_name FROM nation WHERE n_regionkey = 1)",
 "SELECT county, COUNT(*) AS n FROM visits WHERE county IN (SELECT n_name FROM keep) AND county NOT IN (SELECT n_name FROM done) GROUP BY 1"))
def b6(spark, sf):
    n = table(spark, sf, "nation")
    d = lb.keep_groups(visits(spark, sf), "county", n.where("n_regionkey <= 2").select("n_name"))
    return lb.drop_groups(d, "county", n.where("n_regionkey = 1").select("n_name")).groupBy("county").agg(F.count("*").alias("n"))


@query("b7_region_of_series", chain(C_DAILY, "SELECT CASE WHEN split_part(series, '|', 1) IN ('AFRICA', 'AMERICA') THEN 'focus' ELSE 'other' END AS region, COUNT(DISTINCT series) AS series, CAST(SUM(n) AS BIGINT) AS n FROM daily GROUP BY 1"))
def b7(spark, sf):
    d = ll.series_region(daily(spark, sf), CITIES)
    return d.groupBy("region").agg(F.countDistinct("series").alias("series"), F.sum("n").alias("n"))


@query("b8_series_parts", chain(C_DAILY, "SELECT split_part(series, '|', 1) AS county, split_part(series, '|', 2) AS township, CAST(SUM(n) AS BIGINT) AS n FROM daily GROUP BY 1, 2"))
def b8(spark, sf):
    s = F.col("series")
    return daily(spark, sf).groupBy(lb.series_part(s, 0).alias("county"), lb.series_part(s, 1).alias("township")).agg(F.sum("n").alias("n"))


@query("b9_to_km", chain(C_PTS, f"SELECT vec_id, {R('(120 + x / 10 - 120.5) * 111.32 * cos(radians(23.0))')} AS x_km, {R('(22 + y / 10 - 23.0) * 111.0')} AS y_km FROM pts"))
def b9(spark, sf):
    x, y = geo.to_km(F.lit(120) + F.col("x") / 10, F.lit(22) + F.col("y") / 10)
    return points(spark, sf).select("vec_id", rnd(x).alias("x_km"), rnd(y).alias("y_km"))


_PREV = "LAG(total) OVER (PARTITION BY county ORDER BY week_idx)"


@query("b10_direction", chain(C_CPANEL, f"p AS (SELECT total AS v, {_PREV} AS y0 FROM cpanel)",
 "SELECT CASE WHEN (v - y0) / GREATEST(ABS(y0), 1e-9) > 0.05 THEN 1 WHEN (v - y0) / GREATEST(ABS(y0), 1e-9) < -0.05 THEN -1 ELSE 0 END AS direction, COUNT(*) AS n FROM p WHERE y0 IS NOT NULL GROUP BY 1"))
def b10(spark, sf):
    from pyspark.sql import Window as W

    p = county_panel(spark, sf).select(F.col("total").alias("v"), F.lag("total").over(W.partitionBy("county").orderBy("week_idx")).alias("y0")).where("y0 is not null")
    return p.groupBy(lb.direction_class(F.col("v"), F.col("y0")).alias("direction")).agg(F.count("*").alias("n"))


@query("b11_segment", chain(C_VISITS, "SELECT CASE WHEN y BETWEEN 1996 AND 1997 THEN 'a' WHEN y BETWEEN 1998 AND 2000 THEN 'b' ELSE 'other' END AS segment, COUNT(*) AS n FROM (SELECT CAST(substr(yw, 1, 4) AS INTEGER) AS y FROM visits) GROUP BY 1"))
def b11(spark, sf):
    y = F.substring("yw", 1, 4).cast("int")
    return visits(spark, sf).groupBy(lb.segment_of(y, {"a": (1996, 1997), "b": (1998, 2000)}).alias("segment")).agg(F.count("*").alias("n"))


@query("b12_event_type", chain(C_DAILY, "SELECT CASE WHEN thr <= 3 THEN 'first_cluster' ELSE 'accelerating' END AS etype, COUNT(*) AS n, CAST(SUM(s7) AS BIGINT) AS s7 FROM dthr GROUP BY 1"))
def b12(spark, sf):
    return daily(spark, sf).groupBy(lb.event_type(F.col("thr")).alias("etype")).agg(F.count("*").alias("n"), F.sum("s7").alias("s7"))


@query("b13_stratum", chain(C_DAILY, "SELECT CASE WHEN n <= 0.5 THEN '0' WHEN n <= 1.5 THEN '1' ELSE '>=2' END AS stratum, COUNT(*) AS days FROM daily GROUP BY 1"))
def b13(spark, sf):
    return daily(spark, sf).groupBy(lb.count_stratum(F.col("n")).alias("stratum")).agg(F.count("*").alias("days"))


@query("b14_words", chain(C_CPANEL, f"""p AS (SELECT 100.0 * (total / CAST(NULLIF({_PREV}, 0) AS DOUBLE) - 1) AS pct, 100.0 * percent_rank() OVER (PARTITION BY county ORDER BY total) AS pr FROM cpanel)""",
 """SELECT CASE WHEN pct IS NULL THEN NULL WHEN pct >= 15 THEN 'fast_up' WHEN pct >= 5 THEN 'up' WHEN pct > -5 THEN 'flat' WHEN pct > -15 THEN 'down' ELSE 'fast_down' END AS trend,
 CASE WHEN pr >= 90 THEN 'high' WHEN pr >= 75 THEN 'elevated' WHEN pr >= 40 THEN 'medium' ELSE 'low' END AS level,
 CASE WHEN pct >= 5 THEN 'rising' WHEN pct <= -5 THEN 'falling' WHEN pr >= 75 THEN 'plateau' ELSE 'low_activity' END AS stage, COUNT(*) AS n FROM p GROUP BY 1, 2, 3"""))
def b14(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("county")
    prev = F.nullif(F.lag("total").over(w.orderBy("week_idx")), F.lit(0))
    p = county_panel(spark, sf).select((F.lit(100.0) * (F.col("total") / prev - 1)).alias("pct"), (F.lit(100.0) * F.percent_rank().over(w.orderBy("total"))).alias("pr"))
    level, two = lb.level_word(F.col("pr")), F.lit(2)
    return p.groupBy(lb.trend_word(F.col("pct")).alias("trend"), level.alias("level"), lb.stage_word(level, F.col("pct"), two, two).alias("stage")).agg(F.count("*").alias("n"))


@query("b15_pct5", """SELECT CAST(round_even(l_discount * 10 * 20 / 20 * 20, 0) * 5 AS BIGINT) AS pct, COUNT(*) AS n FROM lineitem GROUP BY 1""")
def b15(spark, sf):
    p = F.col("l_discount") * 10
    return table(spark, sf, "lineitem").groupBy(lb.pct5(p).cast("long").alias("pct")).agg(F.count("*").alias("n"))


@query("b16_epidemic_years", chain(C_DAILY, "SELECT CAST(year(day) AS BIGINT) AS year, CAST(SUM(n) AS BIGINT) AS cases FROM daily WHERE split_part(series, '|', 1) IN ('AFRICA', 'AMERICA') GROUP BY 1 HAVING SUM(n) >= 1000"))
def b16(spark, sf):
    e = ll.epidemic_years(daily(spark, sf), lb.series_part(F.col("series"), 0).isin(*CITIES))
    return e.select(big("year").alias("year"), "cases")


@query("b17_round_or_null", f"""SELECT event_id, ROUND(CASE WHEN event_type = 'error' THEN NULL ELSE value END, 1) + 0.0 AS v FROM events""")
def b17(spark, sf):
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", lb.round_or_null(v, 1).alias("v"))
