"""Panels, data quality, snapshots."""

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import panel as pn
from ..operators import quality as ql
from ..operators import scores as sc
from ..operators import snapshots as sn
from .registry import R, big, chain, query, rnd, text
from .sources_queries import C_SNAP, snapshot
from .testbed import C_CPANEL, C_LL, C_LONG, C_NAT, C_VISITS, county_panel, line_list, long_series, national, stored, visits, yw_idx_sql
from .weeks_queries import C_HOL, holiday_table

MEASURES = [
    pn.Measure("out_cases", "visits", "cases", "claims", "visit_type = 'BUILDING'"), pn.Measure("out_total", "visits", "total", "claims", "visit_type = 'BUILDING'"),
    pn.Measure("er_cases", "visits", "cases", "er", "visit_type = 'MACHINERY'"), pn.Measure("er_total", "visits", "total", "er", "visit_type = 'MACHINERY'"),
    pn.Measure("severe", "severe", "cases", "severe"),
]
INDICATORS = [m.indicator for m in MEASURES]


def tables(spark, sf):
    v = visits(spark, sf)
    return {"visits": v, "severe": v.where("age = '1-URGENT'")}


def _nat_wide(spark, sf):
    return pn.wide(pn.national_long(tables(spark, sf), MEASURES), INDICATORS)


C_WIDE = C_VISITS + """,
 w0 AS (SELECT week_idx, SUM(CASE WHEN visit_type = 'BUILDING' THEN cases END) AS out_cases, SUM(CASE WHEN visit_type = 'BUILDING' THEN total END) AS out_total,
  SUM(CASE WHEN visit_type = 'MACHINERY' THEN cases END) AS er_cases, SUM(CASE WHEN visit_type = 'MACHINERY' THEN total END) AS er_total,
  SUM(CASE WHEN age = '1-URGENT' THEN cases END) AS severe FROM visits GROUP BY 1),
 wsp AS (SELECT unnest(range(MIN(week_idx), MAX(week_idx) + 1)) AS w FROM w0 WHERE COALESCE(out_total, er_total, severe) IS NOT NULL),
 wide AS (SELECT w AS week_idx, """ + yw_idx_sql("w") + """ AS yw, out_cases, out_total, er_cases, er_total, severe FROM wsp LEFT JOIN w0 ON w = week_idx)"""


@query("d1_national_panel", chain(C_WIDE, "SELECT yw, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in INDICATORS) + " FROM wide"))
def d1(spark, sf):
    return _nat_wide(spark, sf).select("yw", *INDICATORS)


def partial(df, value="value"):
    """The first and last weeks of each series thinned, as partly reported edges are."""
    from pyspark.sql import Window as W

    w = W.partitionBy("source")
    a, b = F.min("week_idx").over(w), F.max("week_idx").over(w)
    return df.withColumn(value, F.when((F.col("week_idx") <= a + 2) | (F.col("week_idx") >= b - 1), F.floor(F.col(value) / 3).cast("double")).otherwise(F.col(value)))


C_PART = C_LONG + """,
 part AS (SELECT source, week_idx, CASE WHEN week_idx <= MIN(week_idx) OVER (PARTITION BY source) + 2 OR week_idx >= MAX(week_idx) OVER (PARTITION BY source) - 1 THEN floor(value / 3) ELSE value END AS value FROM lseries)"""


def _edges_cte(src, name, ratio, where="TRUE", k=8):
    return f"""{name}_a AS (SELECT source, week_idx, value, row_number() OVER w - 1 AS t,
  quantile_cont(value, 0.5) OVER (PARTITION BY source ORDER BY week_idx ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS b,
  quantile_cont(value, 0.5) OVER (PARTITION BY source ORDER BY week_idx ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) AS f
  FROM {src} WHERE value IS NOT NULL AND {where} WINDOW w AS (PARTITION BY source ORDER BY week_idx)),
 {name}_l AS (SELECT source, MAX(t) AS lt FROM {name}_a WHERE t <= {k} OR value >= {ratio} * b GROUP BY 1),
 {name} AS (SELECT a.source, MIN(week_idx) AS raw_first, MAX(week_idx) AS raw_last, MIN(CASE WHEN t <= lt AND (lt + 1 - t <= {k} + 1 OR value >= {ratio} * f) THEN week_idx END) AS first_complete,
  MAX(CASE WHEN t = lt THEN week_idx END) AS last_complete FROM {name}_a a JOIN {name}_l l ON l.source = a.source GROUP BY 1)"""


_EDGE_COLS = ("raw_first", "raw_last", "first_complete", "last_complete")


@query("d2_edges", chain(C_PART, _edges_cte("part", "ed", 0.6), "SELECT source, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _EDGE_COLS) + " FROM ed"))
def d2(spark, sf):
    return ql.detect_edges(partial(long_series(spark, sf)), ["source"]).select("source", *[big(c).alias(c) for c in _EDGE_COLS])


def sparse(df):
    """Nulls punched into the first ten weeks."""
    from pyspark.sql import Window as W

    a = F.min("week_idx").over(W.partitionBy("source"))
    i = F.col("week_idx") - a
    return df.withColumn("value", F.when((i < 10) & (i % 3 == 1), F.lit(None)).when(i < 10, F.floor(F.col("value") / 20).cast("double")).otherwise(F.col("value")))


C_SPARSE = C_LONG + """,
 sp0 AS (SELECT *, week_idx - MIN(week_idx) OVER (PARTITION BY source) AS i FROM lseries),
 sparse AS (SELECT source, week_idx, CASE WHEN i < 10 AND i % 3 = 1 THEN NULL WHEN i < 10 THEN floor(value / 20) ELSE value END AS value FROM sp0)"""


def _head_cte(src, name, where="TRUE", k=8):
    return f"""{name}_a AS (SELECT source, week_idx, value, COUNT(value) OVER (PARTITION BY source ORDER BY week_idx ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING) AS n,
  quantile_cont(value, 0.5) OVER (PARTITION BY source ORDER BY week_idx ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) AS f FROM {src} WHERE {where}),
 {name} AS (SELECT source, COALESCE(MIN(CASE WHEN n = {k + 1} AND value >= 0.3 * f THEN week_idx END), MIN(CASE WHEN value IS NOT NULL THEN week_idx END)) AS first_complete FROM {name}_a GROUP BY 1)"""


@query("d3_sparse_head", chain(C_SPARSE, _head_cte("sparse", "hd"), "SELECT source, CAST(first_complete AS BIGINT) AS first_complete FROM hd"))
def d3(spark, sf):
    return ql.sparse_head(sparse(long_series(spark, sf)), ["source"]).select("source", big("first_complete").alias("first_complete"))


_ASOF = "2000-06-14"
_CUT = f"((DATE '{_ASOF}' - CAST(dayofweek(DATE '{_ASOF}') AS INTEGER)) - DATE '1970-01-04') // 7"


@query("d4_edges_asof", chain(
    C_SPARSE, _edges_cte("sparse", "ed", 0.6, f"week_idx < {_CUT}"),
    "raw AS (SELECT source, MIN(week_idx) AS raw_first, MAX(week_idx) AS raw_last FROM sparse WHERE value IS NOT NULL GROUP BY 1)",
    f"began AS (SELECT s.* FROM sparse s JOIN raw r ON r.source = s.source WHERE s.week_idx >= raw_first AND s.week_idx < {_CUT})", _head_cte("began", "hd"),
    f"tl AS (SELECT source, MAX(week_idx) AS last_complete FROM sparse WHERE value IS NOT NULL AND week_idx < {_CUT} GROUP BY 1)",
    """SELECT 'ratio' AS rule, e.source, CAST(r.raw_first AS BIGINT) AS raw_first, CAST(r.raw_last AS BIGINT) AS raw_last, CAST(e.first_complete AS BIGINT) AS first_complete, CAST(e.last_complete AS BIGINT) AS last_complete FROM ed e JOIN raw r ON r.source = e.source
 UNION ALL SELECT 'head', h.source, CAST(r.raw_first AS BIGINT), CAST(r.raw_last AS BIGINT), CAST(h.first_complete AS BIGINT), CAST(t.last_complete AS BIGINT) FROM hd h JOIN raw r ON r.source = h.source JOIN tl t ON t.source = h.source"""))
def d4(spark, sf):
    s, asof = sparse(long_series(spark, sf)), F.lit(_ASOF).cast("date")
    cols = [big(c).alias(c) for c in _EDGE_COLS]
    a = ql.edges_asof(s, ["source"], asof, ratio=0.6).select(F.lit("ratio").alias("rule"), "source", *cols)
    return a.unionByName(ql.edges_asof(s, ["source"], asof).select(F.lit("head").alias("rule"), "source", *cols))


def dropped(df):
    """The newest two weeks go, and the week before falls to half in every series."""
    from pyspark.sql import Window as W

    b = F.max("week_idx").over(W.partitionBy("source"))
    return df.withColumn("_b", b).where("week_idx <= _b - 2").withColumn(
        "value", F.when(F.col("week_idx") == F.col("_b") - 2, F.floor(F.col("value") * 0.8)).otherwise(F.col("value")).cast("double")
    ).drop("_b")


C_DROP = C_LONG + """,
 dr0 AS (SELECT *, MAX(week_idx) OVER (PARTITION BY source) AS b FROM lseries),
 drp AS (SELECT source, week_idx, CASE WHEN week_idx = b - 2 THEN floor(value * 0.8) ELSE value END AS value FROM dr0 WHERE week_idx <= b - 2)"""


def _drop_cte(at):
    return f"""dk AS (SELECT source, week_idx, value, row_number() OVER (PARTITION BY source ORDER BY week_idx) - 1 AS t, quantile_cont(value, 0.5) OVER (PARTITION BY source ORDER BY week_idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS m FROM drp WHERE value IS NOT NULL),
 dc AS (SELECT d.source, d.week_idx, d.value / NULLIF(d.m, 0) AS ratio, COALESCE(h.holiday_days, 0) AS hd, COALESCE(h.closure_days, 0) AS cd FROM dk d JOIN {at} a ON a.source = d.source AND a.week_idx = d.week_idx LEFT JOIN hwk h ON h.week_idx = d.week_idx WHERE d.t >= 4 AND d.value / NULLIF(d.m, 0) < 0.85)"""


def special(spark, sf):
    def make():
        h = holiday_table(spark, sf).withColumn("week_idx", cal.week_index(F.col("week_start")))
        return h.select("week_idx", "holiday_days", "closure_days")

    return stored(spark, sf, "special_days", make)


@query("d6_drop_check", chain(C_DROP, "nat0 AS (SELECT week_idx FROM visits)", "nat AS (SELECT DISTINCT week_idx FROM lseries)", C_HOL, "atw AS (SELECT source, MAX(week_idx) AS week_idx FROM drp GROUP BY 1)", _drop_cte("atw"),
 f"SELECT source, CAST(week_idx AS BIGINT) AS week_idx, {R('ratio')} AS drop_ratio, CASE WHEN hd > 0 THEN 'kept' ELSE 'paused' END AS action, CAST(hd AS DOUBLE) AS holiday_days, CAST(cd AS DOUBLE) AS closure_days FROM dc"))
def d6(spark, sf):
    d = dropped(long_series(spark, sf))
    at = d.groupBy("source").agg(F.max("week_idx").alias("week_idx"))
    r = ql.drop_check(d, ["source"], at, special(spark, sf))
    return r.select("source", big("week_idx").alias("week_idx"), rnd("drop_ratio").alias("drop_ratio"), "action", "holiday_days", "closure_days")


def coverage_of(spark, sf):
    d = dropped(partial(long_series(spark, sf)))
    rules = d.select("source").distinct().select(
        "source", F.when(F.col("source") == "5-LOW", 0.5).otherwise(0.6).alias("ratio"), F.when(F.col("source") == "5-LOW", 3).otherwise(0).alias("lag"), (F.col("source") != "5-LOW").alias("check")
    )
    return ql.coverage(d, rules, F.lit("2030-01-01").cast("date"), special(spark, sf))


C_COV = C_PART + """,
 nat AS (SELECT DISTINCT week_idx FROM lseries),
 dr0 AS (SELECT *, MAX(week_idx) OVER (PARTITION BY source) AS b FROM part),
 drp AS (SELECT source, week_idx, CASE WHEN week_idx = b - 2 THEN floor(value * 0.8) ELSE value END AS value, CASE WHEN source = '5-LOW' THEN 0.5 ELSE 0.6 END AS rt FROM dr0 WHERE week_idx <= b - 2)""" + ",\n" + C_HOL + ",\n" + _edges_cte("drp", "ed", "rt").replace("source, week_idx, value, row_number", "source, week_idx, value, rt, row_number") + """,
 atw AS (SELECT source, last_complete AS week_idx FROM ed WHERE source <> '5-LOW')""" + ",\n" + _drop_cte("atw") + """,
 cov AS (SELECT e.source, raw_first, raw_last, first_complete AS fi, last_complete - CASE WHEN c.hd = 0 THEN 1 ELSE 0 END - CASE WHEN e.source = '5-LOW' THEN 3 ELSE 0 END AS la,
  c.week_idx AS fw, c.ratio AS fr, CASE WHEN c.source IS NULL THEN NULL WHEN c.hd > 0 THEN 'kept' ELSE 'paused' END AS fa FROM ed e LEFT JOIN dc c ON c.source = e.source)"""


def _weeks_sql(a, b):
    return f"COALESCE((SELECT string_agg({yw_idx_sql('u.w')}, ',' ORDER BY u.w) FROM (SELECT unnest(range({a}, {b} + 1)) AS w) u), '')"


@query("d5_coverage", chain(C_COV, f"""SELECT source, {yw_idx_sql('raw_first')} AS raw_first, {yw_idx_sql('raw_last')} AS raw_last, {yw_idx_sql('fi')} AS first_complete, {yw_idx_sql('la')} AS last_complete,
 {_weeks_sql('raw_first', 'fi - 1')} AS dropped_head, {_weeks_sql('la + 1', 'raw_last')} AS dropped_tail, {yw_idx_sql('fw')} AS flag_week, {R('fr', 3)} AS flag_ratio, fa AS flag_action FROM cov"""))
def d5(spark, sf):
    c = coverage_of(spark, sf)
    return c.select(
        "source", "raw_first", "raw_last", "first_complete", "last_complete", F.array_join("dropped_head", ",").alias("dropped_head"), F.array_join("dropped_tail", ",").alias("dropped_tail"),
        "flag_week", rnd("flag_ratio", 3).alias("flag_ratio"), "flag_action",
    )


@query("d7_apply_coverage", chain(C_COV, """SELECT s.source, CAST(s.week_idx AS BIGINT) AS week_idx, CASE WHEN s.week_idx BETWEEN c.fi AND c.la THEN CASE WHEN s.source = '5-LOW' THEN COALESCE(s.value, 0) ELSE s.value END END AS value
 FROM lseries s JOIN cov c ON c.source = s.source"""))
def d7(spark, sf):
    return ql.apply_coverage(long_series(spark, sf), coverage_of(spark, sf), ["5-LOW"]).select("source", big("week_idx").alias("week_idx"), "value")


@query("d8_gate", chain(C_COV, f"""SELECT source, CAST(CASE WHEN source = 'all' THEN LEAST(la, (SELECT la FROM cov WHERE source = '5-LOW')) ELSE la END AS BIGINT) AS last_idx FROM cov"""))
def d8(spark, sf):
    return ql.gate(coverage_of(spark, sf), "all", "5-LOW").select("source", big("last_idx").alias("last_idx"))


def span_cov(spark, sf):
    """Complete range per source: the panel without its first 10 and last 5 weeks; severe ends three weeks earlier."""
    v = visits(spark, sf)
    e = v.agg((F.min("week_idx") + 10).alias("first_idx"), (F.max("week_idx") - 5).alias("last_idx"))
    return e.withColumn("source", F.explode(F.array(F.lit("claims"), F.lit("er"), F.lit("severe")))).withColumn(
        "last_idx", F.when(F.col("source") == "severe", F.col("last_idx") - 3).otherwise(F.col("last_idx"))
    )


@query("d9_grouped_panel", chain(C_VISITS, """e AS (SELECT MIN(week_idx) + 10 AS a, MAX(week_idx) - 5 AS b FROM visits), keep AS (SELECT n_name AS county FROM nation WHERE n_regionkey < 3),
 g AS (SELECT k.county, i.ind, unnest(range(a, b + 1 - i.lag)) AS w FROM keep k, e, (VALUES ('out_cases', 0), ('out_total', 0), ('er_cases', 0), ('er_total', 0), ('severe', 3)) i(ind, lag)),
 s AS (SELECT county, week_idx, 'out_cases' AS ind, SUM(cases) AS v FROM visits WHERE visit_type = 'BUILDING' GROUP BY 1, 2 UNION ALL SELECT county, week_idx, 'out_total', SUM(total) FROM visits WHERE visit_type = 'BUILDING' GROUP BY 1, 2
  UNION ALL SELECT county, week_idx, 'er_cases', SUM(cases) FROM visits WHERE visit_type = 'MACHINERY' GROUP BY 1, 2 UNION ALL SELECT county, week_idx, 'er_total', SUM(total) FROM visits WHERE visit_type = 'MACHINERY' GROUP BY 1, 2
  UNION ALL SELECT county, week_idx, 'severe', SUM(cases) FROM visits WHERE age = '1-URGENT' GROUP BY 1, 2)""",
 f"SELECT {yw_idx_sql('g.w')} AS yw, g.county, g.ind AS indicator, CAST(COALESCE(v, 0) AS DOUBLE) AS value FROM g LEFT JOIN s ON s.county = g.county AND s.week_idx = g.w AND s.ind = g.ind"))
def d9(spark, sf):
    from .testbed import table

    keep = table(spark, sf, "nation").where("n_regionkey < 3").select("n_name")
    return pn.grouped_panel(tables(spark, sf), MEASURES, "county", span_cov(spark, sf), keep).select("yw", "county", "indicator", "value")


@query("d10_collapse_and_pivot", chain(C_VISITS, """SELECT yw, CAST(SUM(CASE WHEN age IN ('1-URGENT', '2-HIGH') THEN cases END) AS BIGINT) AS c_top, CAST(SUM(CASE WHEN age = '5-LOW' THEN cases END) AS BIGINT) AS c_low,
 CAST(SUM(CASE WHEN age NOT IN ('1-URGENT', '2-HIGH', '5-LOW') THEN cases END) AS BIGINT) AS c_other, CAST(SUM(CASE WHEN visit_type = 'BUILDING' THEN total END) AS BIGINT) AS building FROM visits GROUP BY yw"""))
def d10(spark, sf):
    v = visits(spark, sf)
    a = pn.collapse_groups(v, "age", {"1-URGENT": "top", "2-HIGH": "top", "5-LOW": "low"}, "cases", "c_", ["top", "low", "other"])
    t = v.groupBy("yw", "visit_type").agg(F.sum("total").alias("total"))
    return a.join(pn.pivot_kind(t, ["yw"], "visit_type", "total", {"BUILDING": "building"}), "yw")


@query("d11_yearly_summary", chain(C_WIDE, f"""SELECT substr(yw, 1, 4) AS year, CAST(SUM(out_cases) AS DOUBLE) AS out_cases, CAST(SUM(severe) AS DOUBLE) AS severe, {R('AVG(100.0 * out_cases / NULLIF(out_total, 0))', 2)} AS out_rate FROM wide GROUP BY 1"""))
def d11(spark, sf):
    n = pn.add_ratios(_nat_wide(spark, sf), {"out_rate": ("out_cases", "out_total", 100)})
    return pn.yearly_summary(n, ["out_cases", "severe"], ["out_rate"])


@query("d12_composites", chain(C_WIDE, """SELECT yw, CAST(out_cases + er_cases AS DOUBLE) AS oe, CAST(out_total - out_cases AS DOUBLE) AS rest, CAST(CASE WHEN (SELECT COUNT(severe) FROM wide) > 10 THEN severe ELSE out_cases END AS DOUBLE) AS "primary" FROM wide"""))
def d12(spark, sf):
    n = pn.composite(_nat_wide(spark, sf), {"oe": "out_cases + er_cases", "rest": "out_total - out_cases"})
    return pn.primary_indicator(n, "severe", "out_cases").select("yw", "oe", "rest", "primary")


@query("d13_definition_change", chain(C_CPANEL, """f AS (SELECT county, MIN(week_idx) AS a FROM cpanel WHERE cases > 0 GROUP BY 1)""",
 "SELECT p.county, CAST(p.week_idx AS BIGINT) AS week_idx, CASE WHEN p.week_idx >= f.a THEN cases END AS cases FROM cpanel p LEFT JOIN f ON f.county = p.county"))
def d13(spark, sf):
    return pn.null_before_first_positive(county_panel(spark, sf), "cases", ["county"]).select("county", big("week_idx").alias("week_idx"), "cases")


C_OFF = "off AS (SELECT yw, out_total + er_total + 7 AS official FROM wide WHERE substr(yw, 6, 1) = '5' AND out_total + er_total IS NOT NULL), rec AS (SELECT o.yw, official, oe, ROUND(100.0 * (oe - official) / official, 1) + 0.0 AS d FROM off o JOIN (SELECT yw, out_total + er_total AS oe FROM wide) w ON w.yw = o.yw WHERE oe IS NOT NULL)"


def _official(spark, sf):
    """Published numbers of the weeks ending in 5: the composite plus 7."""
    n = pn.composite(_nat_wide(spark, sf), {"oe": "out_total + er_total"})
    off = n.where((F.substring("yw", 6, 1) == "5") & F.col("oe").isNotNull()).select("yw", (F.col("oe") + 7).alias("official"))
    return pn.reconcile(n, off, ["oe"])


@query("d14_reconcile", chain(C_WIDE, C_OFF, f"""SELECT COUNT(*) AS n, {R('AVG(d)', 1)} AS mean_diff_pct, CAST(MIN(d) AS DOUBLE) AS min_diff_pct, CAST(MAX(d) AS DOUBLE) AS max_diff_pct FROM rec"""))
def d14(spark, sf):
    return pn.reconcile_summary(_official(spark, sf), "oe")


def _snapshots(spark, sf):
    """Two fetches of the weekly table: the older one ends ten weeks earlier and has some other values."""
    n = national(spark, sf).select("week_idx", "yw", F.col("cases").alias("a"), F.col("total").alias("b"))
    last = n.agg(F.max("week_idx")).scalar()
    old = n.where(F.col("week_idx") <= last - 10).withColumn("a", F.when(F.substring("yw", 6, 1) == "3", F.col("a") + 1).otherwise(F.col("a")))
    new = n.where(F.col("week_idx") > last - 150)
    return old, new


C_TWO = C_NAT + f""",
 n2 AS (SELECT week_idx, {yw_idx_sql('week_idx')} AS yw, cases AS a, total AS b FROM nat), lastw AS (SELECT MAX(week_idx) AS m FROM n2),
 old AS (SELECT week_idx, yw, CASE WHEN substr(yw, 6, 1) = '3' THEN a + 1 ELSE a END AS a, b FROM n2, lastw WHERE week_idx <= m - 10), new AS (SELECT n2.* FROM n2, lastw WHERE week_idx > m - 150)"""


@query("d15_snapshot_diff", chain(C_TWO, """SELECT n.yw, CASE WHEN o.yw IS NULL THEN 'added' ELSE 'revised' END AS kind, CASE WHEN o.yw IS NULL THEN '' ELSE 'a:' || COALESCE(CAST(o.a AS VARCHAR), '') || '->' || COALESCE(CAST(n.a AS VARCHAR), '') END AS changes
 FROM new n LEFT JOIN old o ON o.yw = n.yw WHERE o.yw IS NULL OR o.a IS DISTINCT FROM n.a OR o.b IS DISTINCT FROM n.b"""))
def d15(spark, sf):
    old, new = _snapshots(spark, sf)
    d = sn.diff(old, new, "yw", ["a", "b"])
    flat = F.array_join(F.transform(F.map_entries("changes"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ";")
    return d.select("yw", "kind", flat.alias("changes"))


@query("d16_upsert", chain(C_TWO, "SELECT yw, a, b FROM new UNION ALL SELECT yw, a, b FROM old WHERE yw NOT IN (SELECT yw FROM new)"))
def d16(spark, sf):
    old, new = _snapshots(spark, sf)
    return sn.upsert(old, new, ["yw"]).select("yw", "a", "b")


@query("d17_replace_dates", chain(C_TWO, "SELECT f AS fetched_on, COUNT(*) AS n, CAST(SUM(a) AS BIGINT) AS a FROM (SELECT '2001-01-01' AS f, a FROM old UNION ALL SELECT '2001-01-02', a FROM new) GROUP BY 1"))
def d17(spark, sf):
    old, new = _snapshots(spark, sf)
    first = old.withColumn("fetched_on", F.lit("2001-01-01")).unionByName(old.withColumn("fetched_on", F.lit("2001-01-02")))
    h = sn.replace_dates(first, new.withColumn("fetched_on", F.lit("2001-01-02")))
    return h.groupBy("fetched_on").agg(F.count("*").alias("n"), F.sum("a").alias("a"))


@query("d18_slim_snapshot", chain(C_SNAP, "e AS (SELECT MAX(onset) AS d FROM ll), wk AS (SELECT DISTINCT date_trunc('month', date) AS m FROM snap ORDER BY 1 DESC LIMIT 8)", """SELECT 'latest' AS part, date_type, COUNT(*) AS n FROM snap, e WHERE confirmed > 0 OR pending > 0 OR date >= d - 90 GROUP BY 1, 2
 UNION ALL SELECT 'history', date_type, COUNT(*) FROM snap, e WHERE (confirmed > 0 OR pending > 0) AND date >= d - 180 GROUP BY 1, 2
 UNION ALL SELECT 'weeks', date_type, COUNT(*) FROM snap WHERE date_trunc('month', date) IN (SELECT m FROM wk) GROUP BY 1, 2"""))
def d18(spark, sf):
    s = snapshot(spark, sf)
    end = line_list(spark, sf).agg(F.max("onset")).scalar()
    m = s.withColumn("month", F.substring("date", 1, 7))
    parts = {"latest": sn.slim_latest(s, end), "history": sn.history_window(s, end), "weeks": sn.last_weeks(m, 8, "month")}
    out = None
    for k, d in parts.items():
        g = d.groupBy(F.lit(k).alias("part"), "date_type").agg(F.count("*").alias("n"))
        out = g if out is None else out.unionByName(g)
    return out


@query("d19_qa_report", chain(C_COV, f"""SELECT source, {yw_idx_sql('raw_first')} || '-' || {yw_idx_sql('raw_last')} AS raw_range, {yw_idx_sql('fi')} || '-' || {yw_idx_sql('la')} AS complete_range,
 CASE WHEN {_weeks_sql('raw_first', 'fi - 1')} = '' THEN '-' ELSE replace({_weeks_sql('raw_first', 'fi - 1')}, ',', ', ') END AS dropped_head,
 CASE WHEN {_weeks_sql('la + 1', 'raw_last')} = '' THEN '-' ELSE replace({_weeks_sql('la + 1', 'raw_last')}, ',', ', ') END AS dropped_tail,
 CASE WHEN fa IS NULL THEN '' ELSE {yw_idx_sql('fw')} || ' ' || fa END AS flag FROM cov"""))
def d19(spark, sf):
    return ql.qa_report(coverage_of(spark, sf))
