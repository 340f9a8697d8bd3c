"""The user hook: joint targets, past-only covariates, transforms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epivigil.functions.quantiles import QCOLS
from epivigil.operators import forecaster as fc


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = [("g", i, float(rng.poisson(20)), float(rng.poisson(5)), float(i) if i > 3 else None) for i in range(60)]
    return spark.createDataFrame(rows, "s string, week_idx int, a double, b double, c double").cache()


def test_joint_targets_equal_single(spark, panel):
    cfg = fc.Config("j", model="user", target="a", targets=("a", "b"), warmup=30, horizon=3)
    j = fc.run_config(cfg, panel, ["s"], forecaster=fc.last_value_forecaster)
    for t in ("a", "b"):
        one = fc.run_config(fc.Config("o", model="naive", target=t, warmup=30, horizon=3), panel, ["s"])
        cols = ["origin", "h", *QCOLS]
        x = j.where(F.col("target") == t).select(cols).toPandas().sort_values(["origin", "h"]).to_numpy(float)
        y = one.select(cols).toPandas().sort_values(["origin", "h"]).to_numpy(float)
        assert x.shape == y.shape and np.allclose(x, y, atol=1e-6)


def test_past_covariates_and_log(spark, panel):
    seen = {}

    def fn(cs, horizon, extras):
        out = []
        for c, past in zip(cs, extras["past_c"]):
            assert len(c) == len(past)
            out.append(np.repeat(np.full(horizon, np.log1p(past[-1]))[:, None], 9, axis=1))
        seen["n"] = len(cs)
        return np.stack(out)

    cfg = fc.Config("p", model="user", target="a", past_covariates=("c",), past_lag=2, warmup=30, horizon=2, window=12, log1p=True)
    r = fc.run_config(cfg, panel, ["s"], forecaster=fn).collect()
    assert r and all(abs(x["median"] - (x["origin"] - 2)) < 1e-6 for x in r)
    with pytest.raises(ValueError):
        fc.run_config(fc.Config("x", model="naive", target="a", targets=("a", "b")), panel, ["s"])
