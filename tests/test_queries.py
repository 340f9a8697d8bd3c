"""Registered queries against their SQL in DuckDB. EPIVIGIL_ALL=1 runs every one, otherwise one of each kind."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of

Q, O = entry.queries(), entry.oracle_sql()
SOME = ["a19_chart_json", "b14_words", "c6_holiday_weeks", "d5_coverage", "d9_grouped_panel", "e6_gamma_poisson", "f9_live_forecasts", "g9_summary", "h3_outlook", "h7_period_wave", "i22_two_tier", "j8_hotspot_scores", "l1b_streaming_windows"]


def test_every_sql_has_its_query():
    assert set(O) <= set(Q) and len(Q) >= 130


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "wis" in df.columns


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(sf + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(O) if os.environ.get("EPIVIGIL_ALL") else SOME)
def test_query(spark, sf, con, name):
    df = Q[name](spark, sf)
    cur = con.execute(O[name])
    cols = [x[0] for x in cur.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("name", ["l3_stateful_cusum", "l3b_stateful_wave"])
def test_stream_equals_batch(spark, sf, name):
    rows = Q[name](spark, sf).collect()
    assert rows and all(r["same"] for r in rows)


def test_every_registered_source_is_loaded(spark, sf, con):
    from epivigil.sources.readers import RAW_FILES

    rows = Q["a14b_load_every_source"](spark, sf).collect()
    assert {r["source"] for r in rows} == set(RAW_FILES) and len(rows) == 9
    assert sorted(tuple(r) for r in rows) == sorted(con.execute(O["a14b_load_every_source"]).fetchall())


def test_every_suite_is_run(spark, sf):
    from epivigil.operators.forecaster import suite

    got = {(r["config"], r["h"]): (r["n"], r["wis"]) for r in Q["f13_config_suite"](spark, sf).collect()}
    names = [c.name for s in ("baselines", "windows", "covariates", "transforms") for c in suite(s, "total")]
    assert set(got) == {(c, h) for c in names for h in (1, 2, 3, 4)} and len({n for n, _ in got.values()}) == 1
    wis = lambda c: [got[c, h][1] for h in (1, 2, 3, 4)]
    assert wis("user") == wis("user_log0") != wis("user_log1") and len({tuple(wis(c)) for c in names if c.startswith("user") and "log" not in c}) == 5


def test_covariates_reach_the_forecast():
    import numpy as np

    from epivigil.plans.forecasting_queries import covariate_forecaster

    x = np.random.default_rng(1).random((2, 64))
    y = 9 + 3 * x[0] - 2 * x[1]
    q = covariate_forecaster([y[:60], y[10:60]], 4, {"cov_a": [x[0], x[0]], "cov_b": [x[1], x[1]]})
    assert q.shape == (2, 4, 9) and np.allclose(q, y[60:][None, :, None])
