"""Readers and sinks. Each reader query writes a table derived from the given ones and reads it back."""

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..operators import calendar as cal
from ..operators import linelist as ll
from ..operators import panel as pn
from ..operators import scores as sc
from ..session import new_path
from ..sources import html, readers, sinks
from .registry import R, big, chain, query, rnd, text
from .testbed import (C_CPANEL, C_EW, C_HIST, C_LL, C_NAT, C_PTS, C_SCORED, C_VISITS, any_rows, county_panel, early_warning, histogram, line_list, national,
                      points, results, scratch_csv, table, visits, yw_idx_sql)
from .weeks_queries import closures, holidays


def raw_visits(spark, sf):
    """Per-visit rows in the layout of the claims file, with old spellings and a garbage count."""
    v = visits(spark, sf)
    return v.select(
        F.substring("yw", 1, 4).alias("年"), F.col("yw").alias("週"), F.col("visit_type").alias("就診類別"),
        F.when(F.col("age") == "5-LOW", "65-").otherwise(F.col("age")).alias("年齡別"),
        F.when(F.col("county") == "NATION_0", "臺南市").otherwise(F.col("county")).alias("縣市"),
        F.when(F.col("age") == "1-URGENT", "n/a").otherwise(F.col("cases").cast("string")).alias("類流感人次"), F.col("total").alias("健保就診總人次"),
    )


C_RAW = C_VISITS + """,
 raw AS (SELECT yw, visit_type, CASE WHEN age = '5-LOW' THEN '65+' ELSE age END AS age, CASE WHEN county = 'NATION_0' THEN '台南市' ELSE county END AS county,
  CASE WHEN age = '1-URGENT' THEN 0 ELSE cases END AS cases, total FROM visits)"""


def _sums(df, keys, cols):
    return df.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in cols])


def _sql_sums(src, keys, cols):
    return f"SELECT {', '.join(keys)}, {', '.join(f'CAST(SUM({c}) AS BIGINT) AS {c}' for c in cols)} FROM {src} GROUP BY {', '.join(keys)}"


@query("a1_read_visits", chain(C_RAW, _sql_sums("raw", ["yw", "visit_type", "age", "county"], ["cases", "total"])))
def a1(spark, sf):
    path = scratch_csv(raw_visits(spark, sf), "visits")
    return _sums(readers.read_visits(spark, path, "UTF-8"), ["yw", "visit_type", "age", "county"], ["cases", "total"])


@query("a2_read_emergency", chain(C_RAW, "e AS (SELECT yw, age, county, visit_type AS town, 'H' || CAST(o_orderkey % 10 AS VARCHAR) AS hospital, c2 AS ili, total FROM (SELECT *, cases AS c2 FROM (SELECT r.*, o_orderkey FROM (SELECT *, CASE WHEN county = 'NATION_0' THEN '台南市' ELSE county END AS cc FROM visits) r) ) )".replace("SELECT yw, age, county,", "SELECT yw, CASE WHEN age = '5-LOW' THEN '65+' ELSE age END AS age, cc AS county,"),
 _sql_sums("e", ["yw", "age", "county", "town", "hospital"], ["ili", "total"])))
def a2(spark, sf):
    n = readers.EMERGENCY_COLUMNS
    v = visits(spark, sf)
    raw = v.select(
        F.substring("yw", 1, 4).alias("年"), F.col("yw").alias(n["yw"]), F.when(F.col("age") == "5-LOW", "65-").otherwise(F.col("age")).alias(n["age"]),
        F.when(F.col("county") == "NATION_0", "臺南市").otherwise(F.col("county")).alias(n["county"]), F.col("visit_type").alias(n["town"]),
        F.concat(F.lit("H"), F.pmod("o_orderkey", F.lit(10)).cast("string")).alias(n["hospital"]), F.col("cases").alias(n["ili"]), F.col("total").alias(n["total"]),
    )
    return _sums(readers.read_emergency(spark, scratch_csv(raw, "er"), "UTF-8"), ["yw", "age", "county", "town", "hospital"], ["ili", "total"])


@query("a3_read_severe_cases", chain(C_VISITS, "s AS (SELECT yw, county, visit_type AS town, 'x' AS sex, cases = 1 AS imported, age, total AS cases FROM visits)",
 _sql_sums("s", ["yw", "county", "town", "sex", "imported"], ["cases"])))
def a3(spark, sf):
    n = readers.SEVERE_COLUMNS
    raw = visits(spark, sf).select(
        F.col("yw").alias(n["yw"]), F.col("county").alias(n["county"]), F.col("visit_type").alias(n["town"]), F.lit("x").alias(n["sex"]),
        F.when(F.col("cases") == 1, readers.YES).otherwise("否").alias(n["imported"]), F.col("age").alias(n["age"]), F.col("total").alias(n["cases"]),
    )
    return _sums(readers.read_severe_cases(spark, scratch_csv(raw, "severe"), "UTF-8"), ["yw", "county", "town", "sex", "imported"], ["cases"])


@query("a4_read_lab", chain(C_VISITS, """t AS (SELECT yw, CAST(SUM(cases) AS BIGINT) AS flu_a, CAST(SUM(CASE WHEN age = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS flu_b, CAST(SUM(CASE WHEN age = '5-LOW' THEN 1 ELSE 0 END) AS BIGINT) AS flu_u,
 CAST(SUM(total) AS BIGINT) AS tests FROM visits GROUP BY yw)""", "SELECT * FROM t"))
def a4(spark, sf):
    n, m = readers.LAB_TYPE_COLUMNS, readers.LAB_TEST_COLUMNS
    v = visits(spark, sf)
    one = lambda a: (F.col("age") == a).cast("int")
    types = v.select(
        F.col("yw").alias(n["yw"]), F.col("county").alias(n["county"]), F.col("visit_type").alias(n["town"]), F.lit("h").alias(n["hospital"]),
        F.col("cases").alias(n["flu_a"]), one("2-HIGH").alias(n["flu_b"]), one("5-LOW").alias(n["flu_u"]),
    )
    tests = v.select(F.col("yw").alias(m["yw"]), F.lit("h").alias(m["hospital"]), F.lit("c").alias(m["nhi_code"]), F.col("total").alias(m["tests"]))
    a = _sums(readers.read_lab_types(spark, scratch_csv(types, "labt"), "UTF-8"), ["yw"], ["flu_a", "flu_b", "flu_u"])
    return a.join(_sums(readers.read_lab_tests(spark, scratch_csv(tests, "labn"), "UTF-8"), ["yw"], ["tests"]), "yw")


_PATH = {"Influenza": "age = '1-URGENT'", "RSV": "age = '2-HIGH'", "SARS-CoV-2": "age = '3-MEDIUM'", "hMPV": "age = '4-NOT SPECIFIED'", "Parainfluenza": "age = '5-LOW'",
         "Rhinovirus": "visit_type = 'BUILDING'", "Adeno": "visit_type = 'MACHINERY'", "Mycoplasma": "visit_type = 'FURNITURE'"}
_RP = [readers.PATHOGENS[k] for k in _PATH]
_TOT = " + ".join(_RP)


@query("a5_read_resp_lab", chain(C_VISITS, f"""p AS (SELECT yw, {', '.join(f'CAST(SUM(CASE WHEN {c} THEN 1 ELSE 0 END) AS DOUBLE) AS {readers.PATHOGENS[k]}' for k, c in _PATH.items())}, ROUND(100.0 * SUM(cases) / SUM(total), 3) AS resp_pos_pct FROM visits GROUP BY yw),
 q AS (SELECT *, {_TOT} AS tot, ({_TOT}) / NULLIF(resp_pos_pct / 100, 0) AS tests FROM p), z AS (SELECT *, 100 * resp_flu / NULLIF(tests, 0) AS rate FROM q)""",
 f"""SELECT yw, resp_flu, resp_myco, {R('resp_pos_pct')} AS resp_pos_pct, {R('tot')} AS resp_total_pos, {R('resp_flu / NULLIF(tot, 0)')} AS resp_flu_share, {R('tests', 4)} AS resp_tests_est, {R('rate')} AS resp_flu_pos_rate,
 {R('AVG(resp_flu) OVER (ORDER BY yw ROWS 2 PRECEDING)')} AS resp_flu_ma3, {R('AVG(rate) OVER (ORDER BY yw ROWS 2 PRECEDING)')} AS resp_flu_pos_rate_ma3 FROM z"""))
def a5(spark, sf):
    v = visits(spark, sf)
    g = v.groupBy(F.col("yw").alias("Year-Week of Specimen Received")).agg(
        *[F.sum(F.expr(c).cast("int")).alias(k) for k, c in _PATH.items()], F.round(F.lit(100.0) * F.sum("cases") / F.sum("total"), 3).alias("Positive (%)")
    )
    last = v.agg(F.max("week_idx")).scalar()
    blank = spark.range(1, 5).select(cal.yw_of_index(last + F.col("id").cast("int")).alias("Year-Week of Specimen Received"))
    d = readers.read_resp_lab(spark, scratch_csv(g.unionByName(blank, allowMissingColumns=True), "resp"))
    d4 = {"resp_tests_est": 4}
    cols = ["resp_pos_pct", "resp_total_pos", "resp_flu_share", "resp_tests_est", "resp_flu_pos_rate", "resp_flu_ma3", "resp_flu_pos_rate_ma3"]
    return d.select("yw", "resp_flu", "resp_myco", *[rnd(c, d4.get(c, 6)).alias(c) for c in cols])


@query("a6_read_holidays_closures", """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, COUNT(*) AS n FROM orders GROUP BY 1)
 SELECT 'holiday' AS kind, CAST(date AS VARCHAR) AS date, CASE WHEN day(date) = 1 AND month(date) = 2 THEN '春節' WHEN day(date) = 1 THEN 'month start' END AS name FROM d WHERE day(date) = 1 OR dayofweek(date) IN (0, 6)
 UNION ALL SELECT 'closure', CAST(date AS VARCHAR), 'closed' FROM d WHERE n < 0.4 * (SELECT AVG(n) FROM d)""")
def a6(spark, sf):
    h = readers.read_holidays(spark, scratch_csv(holidays(spark, sf), "hol")).where("isHoliday")
    c = readers.read_closures(spark, scratch_csv(closures(spark, sf), "clo"))
    absent = readers.read_closures(spark, new_path(spark, "no-such-file"))
    return h.select(F.lit("holiday").alias("kind"), text("date").alias("date"), "name").unionByName(
        c.unionByName(absent).select(F.lit("closure").alias("kind"), text("date").alias("date"), "name")
    )


@query("a7_read_csv_auto", chain(C_VISITS, "r AS (SELECT CASE WHEN county = 'NATION_0' THEN '臺南市' ELSE county END AS county, visit_type AS kind, CAST(COUNT(*) AS VARCHAR) AS n FROM visits GROUP BY 1, 2)", "SELECT file, county, kind, n FROM r CROSS JOIN (SELECT unnest(['utf-8', 'big5']) AS file)"))
def a7(spark, sf):
    """The same table in UTF-8 with a mark and in Big5 gives the same rows."""
    raw = raw_visits(spark, sf).groupBy("縣市", "就診類別").agg(F.count("*").alias("人次"))
    first, *rest = raw.columns
    utf = scratch_csv(raw.withColumnRenamed(first, sinks.BOM + first).coalesce(1), "utf8")
    spark.conf.set(readers.JAVA_CHARSETS, "true")
    big5 = scratch_csv(raw.coalesce(1), "big5", encoding=readers.BIG5)
    a, b = readers.read_csv_auto(spark, utf), readers.read_csv_auto(spark, big5)
    return a.withColumn("file", F.lit("utf-8")).unionByName(b.withColumn("file", F.lit("big5"))).select("file", F.col("縣市").alias("county"), F.col("就診類別").alias("kind"), F.col("人次").alias("n"))


_KIND = {"BUILDING": "門診", "MACHINERY": "住院"}


@query("a8_read_open_data", chain(C_VISITS, """k AS (SELECT yw, CASE visit_type WHEN 'BUILDING' THEN 'out' WHEN 'MACHINERY' THEN 'inp' ELSE 'er' END AS kind, age, CASE WHEN county = 'NATION_0' THEN '台南市' ELSE county END AS county, cases, total FROM visits)""",
 _sql_sums("k", ["yw", "kind", "age", "county"], ["cases", "total"])))
def a8(spark, sf):
    v = visits(spark, sf)
    raw = v.select(
        F.substring("yw", 1, 4).alias("年"), F.substring("yw", 5, 2).cast("int").cast("string").alias("週"),
        F.coalesce(F.try_element_at(lb.literal_map(_KIND), F.col("visit_type")), F.lit("急診")).alias("就診類別"), F.col("age").alias("年齡別"),
        F.when(F.col("county") == "NATION_0", "臺南市").otherwise(F.col("county")).alias("縣市"), F.col("cases").alias("COVID-19就診人次"), F.col("total").alias("健保就診總人次"),
    )
    return _sums(readers.read_open_visits(spark, scratch_csv(raw, "open"), "COVID"), ["yw", "kind", "age", "county"], ["cases", "total"])


@query("a9_trim_placeholder_tail", chain(C_NAT, f"SELECT {yw_idx_sql('week_idx')} AS yw, CAST(total AS DOUBLE) AS visits FROM nat WHERE week_idx <= (SELECT MAX(week_idx) FROM nat WHERE total > 0) - 3"))
def a9(spark, sf):
    n = national(spark, sf)
    last = n.where("total > 0").agg(F.max("week_idx")).scalar()
    raw = n.select(
        "yw", F.lit("全國").alias("area"), F.lit("全部").alias("age"), F.lit("oe").alias("case_type"),
        F.when(F.col("week_idx") > last - 3, 0).otherwise(F.col("total")).alias("visits"), F.lit(0.5).alias("rate_pct"),
    )
    return readers.read_region_visits(spark, scratch_csv(raw, "region")).select("yw", "visits")


@query("a10_read_severe_weekly", chain(C_NAT, f"SELECT {yw_idx_sql('week_idx')} AS yw, CAST(cases AS DOUBLE) AS severe FROM nat"))
def a10(spark, sf):
    path = scratch_csv(national(spark, sf).select("yw", F.col("cases").alias("severe")), "sev")
    return readers.read_severe_weekly(spark, path).unionByName(readers.read_severe_weekly(spark, new_path(spark, "absent")))


_LINE = "CASE WHEN l_linenumber = 7 THEN onset ELSE onset + delay * 4 - 5 END"


def raw_line_list(spark, sf):
    """The line list in the file's layout: some reports before onset, very late, or missing; some bad dates."""
    n = readers.LINE_LIST_COLUMNS
    d = line_list(spark, sf)
    fmt = lambda c: F.date_format(c, "yyyy/MM/dd")
    report = F.date_add("onset", F.col("delay") * 4 - 5)
    return d.select(
        fmt("onset").alias(n["onset"]), F.when(F.col("l_linenumber") == 7, "None").otherwise(fmt(report)).alias(n["report"]), fmt("onset").alias(n["confirm"]),
        F.concat(F.lit("臺"), "county").alias(n["county"]), F.col("township").alias(n["township"]), F.when(F.col("imported"), readers.YES).otherwise("否").alias(n["imported"]),
        F.when(F.col("l_linenumber") == 6, "").otherwise("2").alias(n["n"]), F.lit("d1").alias(n["serotype"]),
        (F.lit(120) + F.col("delay") / 100).alias(n["lon"]), (F.lit(22) + F.col("delay") / 50).alias(n["lat"]), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias(n["village_code"]),
    )


@query("a11_read_line_list", chain(C_LL, f"""SELECT CAST(onset AS VARCHAR) AS onset, '台' || county AS county, imported, CAST(GREATEST(0, LEAST(120, {_LINE} - onset)) AS BIGINT) AS delay,
 CAST(SUM(CASE WHEN l_linenumber = 6 THEN 1 ELSE 2 END) AS BIGINT) AS n FROM ll GROUP BY 1, 2, 3, 4"""))
def a11(spark, sf):
    d = readers.read_line_list(spark, scratch_csv(raw_line_list(spark, sf), "cases"))
    return d.groupBy(text("onset").alias("onset"), "county", "imported", big("delay").alias("delay")).agg(F.sum("n").alias("n"))


@query("a12_line_list_coords", chain(C_LL, f"""SELECT 'v' || CAST(l_linenumber AS VARCHAR) AS village_code, COUNT(*) AS cases, {R('AVG(120 + delay / 100.0)', 5)} AS lon, {R('AVG(22 + delay / 50.0)', 5)} AS lat FROM ll GROUP BY 1"""))
def a12(spark, sf):
    d = readers.read_line_list(spark, scratch_csv(raw_line_list(spark, sf), "coords"))
    return d.groupBy("village_code").agg(F.count("*").alias("cases"), rnd(F.avg("lon"), 5).alias("lon"), rnd(F.avg("lat"), 5).alias("lat"))


def snapshot(spark, sf):
    """Sparse daily snapshot (date_type, county, town, date, confirmed, pending, excluded)."""
    d = line_list(spark, sf)
    both = d.withColumn("date_type", F.explode(F.array(F.lit("onset"), F.lit("report")))).withColumn("date", F.when(F.col("date_type") == "onset", F.col("onset")).otherwise(F.col("report")))
    return both.groupBy("date_type", "county", F.col("township").alias("town"), text("date").alias("date")).agg(
        F.count_if(~F.col("imported") & (F.col("delay") < 20)).alias("confirmed"), F.count_if(~F.col("imported") & (F.col("delay") >= 20)).alias("pending"), F.count_if("imported").alias("excluded")
    )


C_SNAP = C_LL + """,
 snap AS (SELECT date_type, county, township AS town, date, COUNT(*) FILTER (NOT imported AND delay < 20) AS confirmed, COUNT(*) FILTER (NOT imported AND delay >= 20) AS pending, COUNT(*) FILTER (imported) AS excluded
  FROM (SELECT 'onset' AS date_type, onset AS date, * FROM ll UNION ALL SELECT 'report', onset + delay, * FROM ll) GROUP BY 1, 2, 3, 4)"""


@query("a13_densify_snapshot", chain(C_SNAP, "days AS (SELECT MIN(onset) AS d0, unnest(range(0, MAX(onset) - MIN(onset) + 1)) AS i FROM ll), keep AS (SELECT DISTINCT county || '|' || township AS series FROM ll WHERE county <> 'ASIA')",
 """SELECT k.series, CAST(d0 + CAST(i AS INTEGER) AS VARCHAR) AS day, CAST(COALESCE(confirmed, 0) AS BIGINT) AS value FROM keep k CROSS JOIN days LEFT JOIN snap s ON s.date_type = 'report' AND s.county || '|' || s.town = k.series AND s.date = d0 + CAST(i AS INTEGER)"""))
def a13(spark, sf):
    d = line_list(spark, sf)
    keep = d.where("county <> 'ASIA'").select(F.concat("county", F.lit("|"), "township").alias("series")).distinct()
    days = d.agg(F.min("onset").alias("a"), F.max("onset").alias("b"))
    m = ll.densify_snapshot(snapshot(spark, sf), keep, days.select("a").scalar(), days.select("b").scalar(), "report", "confirmed")
    return m.select("series", text("day").alias("day"), "value")


@query("a14_load_all", chain(C_RAW, "SELECT 'nhi_48x' AS source, COUNT(*) AS n, CAST(SUM(cases) AS BIGINT) AS cases FROM raw UNION ALL SELECT 'nidds', COUNT(*), CAST(SUM(total) AS BIGINT) FROM visits"))
def a14(spark, sf):
    folder = new_path(spark, "raw")
    n = readers.SEVERE_COLUMNS
    raw_visits(spark, sf).write.option("header", True).csv(f"{folder}/{readers.RAW_FILES['nhi_48x']}")
    visits(spark, sf).select(
        F.col("yw").alias(n["yw"]), F.col("county").alias(n["county"]), F.lit("t").alias(n["town"]), F.lit("x").alias(n["sex"]), F.lit("否").alias(n["imported"]),
        F.col("age").alias(n["age"]), F.col("total").alias(n["cases"]),
    ).write.option("header", True).csv(f"{folder}/{readers.RAW_FILES['nidds']}")
    files = {k: readers.RAW_FILES[k] for k in ("nhi_48x", "nidds", "resp_lab")}
    utf = {"nhi_48x": lambda s, p: readers.read_visits(s, p, "UTF-8"), "nidds": lambda s, p: readers.read_severe_cases(s, p, "UTF-8")}
    t = readers.load_all(spark, folder, files, readers=utf)
    out = None
    for name, d in t.items():
        g = d.agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.sum("cases").alias("cases"))
        out = g if out is None else out.unionByName(g)
    return out


_HITS = " + ".join(f"SUM(CASE WHEN {c} THEN 1 ELSE 0 END)" for c in _PATH.values())


@query("a14b_load_every_source", chain(C_RAW, f"""SELECT 'nhi_48x' AS source, COUNT(*) AS n, CAST(SUM(cases) AS BIGINT) AS cases FROM raw
 UNION ALL SELECT 'nhi_48x_er', COUNT(*), CAST(SUM(cases) AS BIGINT) FROM raw WHERE visit_type = 'BUILDING' UNION ALL SELECT 'nhi_487', COUNT(*), CAST(SUM(cases) AS BIGINT) FROM raw WHERE age <> '2-HIGH'
 UNION ALL SELECT 'nhi_487_er', COUNT(*), CAST(SUM(cases) AS BIGINT) FROM raw WHERE visit_type = 'MACHINERY' UNION ALL SELECT 'rods', COUNT(*), CAST(SUM(cases) AS BIGINT) FROM visits
 UNION ALL SELECT 'nidds', COUNT(*), CAST(SUM(total) AS BIGINT) FROM visits UNION ALL SELECT 'lab_types', COUNT(*), CAST(SUM(cases + CASE WHEN age IN ('2-HIGH', '5-LOW') THEN 1 ELSE 0 END) AS BIGINT) FROM visits
 UNION ALL SELECT 'lab_tests', COUNT(*), CAST(SUM(total) AS BIGINT) FROM visits UNION ALL SELECT 'resp_lab', COUNT(DISTINCT yw), CAST({_HITS} AS BIGINT) FROM visits"""))
def a14b(spark, sf):
    """All nine registered sources written in their layouts and loaded at once: rows and counts of each."""
    folder = new_path(spark, "raw")
    v, raw = visits(spark, sf), raw_visits(spark, sf)
    er, severe, types, tests = readers.EMERGENCY_COLUMNS, readers.SEVERE_COLUMNS, readers.LAB_TYPE_COLUMNS, readers.LAB_TEST_COLUMNS
    one = lambda a: (F.col("age") == a).cast("int")
    tables = {
        "nhi_48x": raw, "nhi_48x_er": raw.where("`就診類別` = 'BUILDING'"), "nhi_487": raw.where("`年齡別` <> '2-HIGH'"), "nhi_487_er": raw.where("`就診類別` = 'MACHINERY'"),
        "rods": v.select(
            F.col("yw").alias(er["yw"]), F.col("age").alias(er["age"]), F.col("county").alias(er["county"]), F.col("visit_type").alias(er["town"]), F.lit("h").alias(er["hospital"]),
            F.col("cases").alias(er["ili"]), F.col("total").alias(er["total"]),
        ),
        "nidds": v.select(
            F.col("yw").alias(severe["yw"]), F.col("county").alias(severe["county"]), F.lit("t").alias(severe["town"]), F.lit("x").alias(severe["sex"]), F.lit("否").alias(severe["imported"]),
            F.col("age").alias(severe["age"]), F.col("total").alias(severe["cases"]),
        ),
        "lab_types": v.select(
            F.col("yw").alias(types["yw"]), F.col("county").alias(types["county"]), F.col("visit_type").alias(types["town"]), F.lit("h").alias(types["hospital"]),
            F.col("cases").alias(types["flu_a"]), one("2-HIGH").alias(types["flu_b"]), one("5-LOW").alias(types["flu_u"]),
        ),
        "lab_tests": v.select(F.col("yw").alias(tests["yw"]), F.lit("h").alias(tests["hospital"]), F.lit("c").alias(tests["nhi_code"]), F.col("total").alias(tests["tests"])),
        "resp_lab": v.groupBy(F.col("yw").alias("Year-Week of Specimen Received")).agg(*[F.sum(F.expr(c).cast("int")).alias(k) for k, c in _PATH.items()], F.lit(50.0).alias("Positive (%)")),
    }
    for name, d in tables.items():
        d.write.option("header", True).csv(f"{folder}/{readers.RAW_FILES[name]}")
    utf = {n: (lambda s, p, f=f: f(s, p, "UTF-8")) for n, f in (
        *[(n, readers.read_visits) for n in ("nhi_48x", "nhi_48x_er", "nhi_487", "nhi_487_er")],
        ("rods", readers.read_emergency), ("nidds", readers.read_severe_cases), ("lab_types", readers.read_lab_types), ("lab_tests", readers.read_lab_tests),
    )}
    count = {"rods": "ili", "lab_types": "flu_a + flu_b + flu_u", "lab_tests": "tests", "resp_lab": "resp_total_pos"}
    out = None
    for name, d in readers.load_all(spark, folder, readers=utf).items():
        g = d.agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.sum(F.expr(count.get(name, "cases"))).cast("long").alias("cases"))
        out = g if out is None else out.unionByName(g)
    return out


@query("a15_read_panel", chain(C_CPANEL, "SELECT county, CAST(SUM(cases) AS BIGINT) AS cases FROM cpanel GROUP BY 1"))
def a15(spark, sf):
    path = new_path(spark, "panel")
    sinks.save_table(county_panel(spark, sf), path)
    return readers.read_panel(spark, path, ["county", "cases"]).groupBy("county").agg(F.sum("cases").alias("cases"))


@query("a16_merge_runs", chain(C_EW, f"SELECT mode, model, h, COUNT(*) AS n, {R('AVG(prob)', 5)} AS prob FROM (SELECT mode, model, h, prob FROM ew UNION ALL SELECT 'asof', model, h, prob FROM ew WHERE h = 7) GROUP BY 1, 2, 3"))
def a16(spark, sf):
    folder = new_path(spark, "runs")
    ew = early_warning(spark, sf).select("model", "mode", "series", "origin", "h", "prob")
    twice = ew.unionByName(ew.where("h = 3"))
    twice.write.parquet(f"{folder}/base_final_forecasts.parquet")
    ew.where("h = 7").withColumn("mode", F.lit("asof")).write.parquet(f"{folder}/base_asof_forecasts.parquet")
    ew.withColumn("mode", F.lit("other")).write.parquet(f"{folder}/base_all_final_forecasts.parquet")
    return readers.read_results(spark, folder, "base").groupBy("mode", "model", "h").agg(F.count("*").alias("n"), rnd(F.avg("prob"), 5).alias("prob"))


@query("a17_save_tables", chain(C_NAT, f"SELECT {yw_idx_sql('week_idx')} AS yw, cases, total, format FROM nat CROSS JOIN (SELECT unnest(['parquet', 'csv', 'json']) AS format)"))
def a17(spark, sf):
    """The same rows back from parquet, CSV and JSON."""
    path = new_path(spark, "saved")
    n = national(spark, sf).select("yw", "cases", "total")
    sinks.save_table(n, path, ("parquet", "csv", "json"))
    a = spark.read.parquet(f"{path}/parquet").select("yw", "cases", "total").withColumn("format", F.lit("parquet"))
    b = readers.read_text_csv(spark, f"{path}/csv").select("yw", F.col("cases").cast("long").alias("cases"), F.col("total").cast("long").alias("total")).withColumn("format", F.lit("csv"))
    c = spark.read.schema(n.schema).json(f"{path}/json").withColumn("format", F.lit("json"))
    return a.unionByName(b).unionByName(c)


@query("a18_resume_write", chain(C_EW, "SELECT year, CASE WHEN year = (SELECT MIN(year) FROM anyr) THEN 'first' ELSE 'second' END AS run, COUNT(*) AS n FROM anyr GROUP BY 1"))
def a18(spark, sf):
    """Years already stored are not computed again: the second run adds the missing ones only."""
    path = new_path(spark, "years")
    r = any_rows(spark, sf)
    todo = r.select("mode", "year").distinct()
    first = r.agg(F.min("year")).scalar()

    def rows(tag):
        return lambda items: r.join(items, ["mode", "year"], "left_semi").withColumn("run", F.lit(tag))

    sinks.resume_write(spark, todo.where(F.col("year") == first), rows("first"), path, ["mode", "year"])
    out = sinks.resume_write(spark, todo, rows("second"), path, ["mode", "year"])
    return out.groupBy("year", "run").agg(F.count("*").alias("n"))


def _chart(axis, a, b):
    return F.concat(
        F.lit("<script>hcJson.push({\"title_text\":\"t\",\"yAxis_title_text\":\"" + axis + "\",\"xAxis_categories\":[\"202401\",\"202402\",\"202403\"],\"series\":[{\"name\":\"a\",\"data\":["),
        a, F.lit(",undefined,{\"y\":"), b, F.lit("}]},{\"name\":\"b\",\"data\":["), b, F.lit("]}]});\n</script>"),
    )


C_CHART = """ch AS (SELECT page_id, period, series, CASE WHEN series = 'a' AND period = '202401' THEN length(url) WHEN series = 'a' AND period = '202403' THEN page_id WHEN series = 'b' AND period = '202401' THEN page_id END AS visits,
 CASE WHEN series = 'a' AND period = '202401' THEN page_id + 0.5 WHEN series = 'a' AND period = '202403' THEN length(url) WHEN series = 'b' AND period = '202401' THEN length(url) END AS rate_pct
 FROM pages, (SELECT unnest(['202401', '202402', '202403']) AS period), (SELECT unnest(['a', 'b']) AS series))"""


@query("a19_chart_json", chain(C_CHART, "SELECT page_id, period, series, CAST(visits AS DOUBLE) AS visits, CAST(rate_pct AS DOUBLE) AS rate_pct FROM ch"))
def a19(spark, sf):
    p = table(spark, sf, "pages")
    i, n = F.col("page_id").cast("string"), F.length("url").cast("string")
    page = F.concat("html", _chart("人次", n, i), F.lit("<p>between</p>"), _chart("比率(%)", F.concat(i, F.lit(".5")), n))
    rows = html.chart_rows(html.chart_blocks(p.select("page_id", page.alias("html"))), ["page_id"])
    return html.chart_table(rows, ["page_id"])


@query("a20_map_json", "SELECT page_id, r AS region, CAST(CASE r WHEN 'north' THEN page_id ELSE length(url) + 0.25 END AS DOUBLE) AS rate_pct FROM pages, (SELECT unnest(['north', 'south']) AS r)")
def a20(spark, sf):
    p = table(spark, sf, "pages")
    script = F.concat(
        F.lit("<script>var jdata1 = [{'code':'north','value':"), F.col("page_id").cast("string"), F.lit("},{'code':'south','value':"),
        (F.length("url") + 0.25).cast("string"), F.lit("}];</script>"),
    )
    return html.map_rows(p.select("page_id", F.concat("html", script).alias("html")), ["page_id"])
