"""Window and cell forms against plain loops on random input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epivigil.operators import alerts as al
from epivigil.operators import baselines as bl
from epivigil.operators import calibration as cb
from epivigil.operators import detectors as dt
from epivigil.operators import linelist as ll
from epivigil.operators import nowcast as nc
from epivigil.operators import period
from epivigil.operators import quality as ql
from epivigil.operators import ranks
from epivigil.operators import spatial as sp

RNG = np.random.default_rng(7)
LEVELS = np.arange(1, 10) / 10


def frame(spark, series: dict, value="value", idx="week_idx"):
    rows = [(s, i, None if v != v else float(v)) for s, a in series.items() for i, v in enumerate(a)]
    return spark.createDataFrame(rows, f"s string, {idx} int, {value} double")


def test_edges(spark):
    series = {f"s{i}": RNG.poisson(RNG.choice([2, 20, 200]), RNG.integers(1, 40)).astype(float) * RNG.choice([0.2, 1, 1], 1) for i in range(60)}
    for a in series.values():
        a[: RNG.integers(0, 3)] *= 0.1
        a[len(a) - RNG.integers(0, 3) :] *= 0.1

    def loop(x, r=0.6, k=8):
        lo, hi = 0, len(x)
        while hi - lo > k + 1 and x[hi - 1] < r * np.median(x[hi - 1 - k : hi - 1]):
            hi -= 1
        while hi - lo > k + 1 and x[lo] < r * np.median(x[lo + 1 : lo + k + 1]):
            lo += 1
        return lo, hi - 1

    got = {r["s"]: (r["first_complete"], r["last_complete"]) for r in ql.detect_edges(frame(spark, series), ["s"]).collect()}
    assert got == {s: loop(a) for s, a in series.items()}


def test_fixed_threshold_period(spark):
    series = {f"s{i}": RNG.integers(0, 10, 30).astype(float) for i in range(40)}
    f = period.fixed_threshold_flags(frame(spark, series).withColumn("thr", F.lit(6.0)), ["s"], "value", "thr", "week_idx")
    got = {}
    for r in f.orderBy("s", "week_idx").collect():
        got.setdefault(r["s"], []).append((r["in_period"], r["entered"], r["exited"]))
    for s, a in series.items():
        inside, low, exp = False, 0, []
        for v in a:
            was = inside
            low = 0 if v >= 6 else low + 1
            inside = v >= 6 or (was and low < 2)
            exp.append((inside, inside and not was, was and not inside))
        assert got[s] == exp


def test_episodes_and_detectors(spark):
    T = 200
    series = {f"s{i}": RNG.poisson(1.5 + 6 * (RNG.random() > 0.7), T).astype(float) for i in range(8)}
    rows = [(s, i, float(v)) for s, a in series.items() for i, v in enumerate(a)]
    d = spark.createDataFrame(rows, "series string, i int, n double").withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")))
    s7 = ll.warning_threshold(ll.rolling_sum(d, "n"), "n")
    ep = {(r["series"], r["i"]) for r in dt.episodes(s7).collect()}
    ew = {(r["series"], r["i"]): (r["z"], r["alarm"]) for r in dt.ewma(d, ["series"], "n", "day").collect()}
    cu = {(r["series"], r["day"].toordinal() - pd.Timestamp("2020-01-01").toordinal()): (r["s"], r["alarm"]) for r in dt.cusum(d, ["series"], "n", "day").collect()}
    for s, x in series.items():
        last, z, c = None, x[0], 0.0
        for t in range(T):
            w = x[max(0, t - 6) : t + 1].sum()
            thr = max(2 * x[max(0, t - 20) : t + 1].sum() / 3, 3)
            if w >= thr - 1e-9:
                assert ((s, t) in ep) == (last is None or t - last > 14)
                last = t
            else:
                assert (s, t) not in ep
            z = z if t == 0 else 0.3 * x[t] + 0.7 * z
            assert abs(ew[s, t][0] - z) < 1e-9
            if t >= 63:
                b = x[t - 63 : t - 7]
                sd = max(b.std(), 0.5)
                assert ew[s, t][1] == (z > b.mean() + 3 * sd)
                c = max(0, c + (x[t] - b.mean()) / sd - 0.5)
                assert abs(cu[s, t][0] - c) < 1e-9 and cu[s, t][1] == (c > 4)
                c = 0.0 if c > 4 else c
            else:
                assert not ew[s, t][1] and not cu[s, t][1]


def direct_forecast(c, H, model, season=6):
    c = np.asarray(c, float)
    n = len(c)
    if model == "naive":
        point = np.repeat(c[-1], H)
        err = [np.array([c[k + h] - c[k] for k in range(n - H)]) for h in range(1, H + 1)]
    elif model == "snaive":
        point = np.array([c[n - season + h] for h in range(H)])
        err = [c[season:] - c[:-season]] * H
    else:
        def ahead(v):
            v = list(v)
            for _ in range(H):
                v.append(sum(v[-3:]) / 3)
            return np.array(v[-H:])

        point = ahead(c)
        e = np.array([c[k : k + H] - ahead(c[:k]) for k in range(3, n - H + 1)])
        err = [e[:, h] for h in range(H)]
    q = np.array([np.quantile(e, LEVELS) for e in err])
    return np.maximum(point[:, None] + q - q[:, 4:5], 0)


@pytest.mark.parametrize("window", [None, 20])
def test_baselines(spark, window):
    series = {f"s{i}": RNG.poisson(20, 40).astype(float) for i in range(3)}
    f = bl.forecasts(frame(spark, series), ["s"], "week_idx", "value", horizon=4, season=6, window=window, warmup=18)
    rows = f.collect()
    assert len(rows) == 3 * (40 - 18 - 4 + 1) * 4 * 3
    for r in rows:
        x = series[r["s"]]
        t = r["origin"] + 1
        c = x[: t] if window is None else x[max(0, t - window) : t]
        exp = direct_forecast(c, 4, r["model"])[r["h"] - 1]
        assert np.allclose([r[q] for q in bl.QCOLS], exp, atol=1e-6), r
        assert r["y"] == x[t + r["h"] - 1] and r["y_origin"] == x[t - 1]
        assert abs(r["mase_scale"] - np.mean(np.abs(x[6:t] - x[: t - 6]))) < 1e-9


def test_frame_deciles_with_gaps():
    x = RNG.normal(size=60)
    x[RNG.random(60) < 0.3] = np.nan
    for first, last in ((None, -2), (-15, -2), (-9, 0)):
        got = bl.frame_deciles(x, first, last, np.ones(60, bool))
        for r in range(60):
            lo = 0 if first is None else max(0, r + first)
            v = x[lo : max(r + last + 1, 0)]
            v = v[~np.isnan(v)]
            assert (got[r] is None) == (len(v) == 0)
            if len(v):
                assert np.allclose(got[r], np.quantile(v, LEVELS))


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(f"c{i % 3}|t", int(RNG.integers(0, 90)), int(RNG.integers(0, 12)), int(RNG.integers(1, 4))) for i in range(400)]
    d = spark.createDataFrame(rows, "series string, t int, delay int, n long")
    h = d.groupBy("series", "t", "delay").agg(F.sum("n").alias("n")).withColumn("onset", F.date_add(F.lit("2021-01-01").cast("date"), F.col("t")))
    hist = np.zeros((3, 90, 13))
    for s, t, k, n in rows:
        hist[int(s[1]), t, k] += n
    return h.cache(), hist


def test_known_completeness_nowcast(spark, cases):
    h, hist = cases
    o = spark.createDataFrame([(i,) for i in (50, 70, 89)], "i int").select(F.date_add(F.lit("2021-01-01").cast("date"), F.col("i")).alias("origin"))
    known = {(r["origin"].toordinal(), r["series"], r["k"]): r["n"] for r in nc.dense_known(h, o, 36).collect()}
    comp = ll.completeness(h, o, lookback=30, dmax=12)
    share = {(r["origin"].toordinal(), r["k"]): r["share"] for r in comp.collect()}
    gp = {(r["origin"].toordinal(), r["series"], r["k"]): r["n"] for r in nc.gamma_poisson(nc.dense_known(h, o, 36), comp, 5.0, passes=2, dmax=12).collect()}
    base = pd.Timestamp("2021-01-01").toordinal()
    for d in (50, 70, 89):
        k0 = [sum(hist[s, d - k, : min(k, 12) + 1].sum() for s in range(3)) for k in range(36)]
        assert sum(known[base + d, f"c{s}|t", k] for s in range(3) for k in range(36)) == sum(k0)
        w = hist[:, max(0, d - 42) : d - 12].sum(axis=(0, 1))
        c = np.maximum(np.cumsum(w) / w.sum(), 0.05)
        assert np.allclose([share[base + d, k] for k in range(13)], c)
        for s in range(3):
            r = np.array([hist[s, d - k, : min(k, 12) + 1].sum() for k in range(36)])
            ck = c[np.minimum(np.arange(36), 12)]
            lam = (r / ck)[8:36].mean()
            out = r + np.where(np.arange(36) <= 12, (5 * lam + r) * (1 - ck) / (5 + ck), 0)
            lam2 = out[2:35].mean()
            out2 = r + np.where(np.arange(36) <= 12, (5 * lam2 + r) * (1 - ck) / (5 + ck), 0)
            assert np.allclose([gp[base + d, f"c{s}|t", k] for k in range(36)], out2)


def test_window_sum_matches_known(spark, cases):
    h, hist = cases
    lo, hi = (F.lit(x).cast("date") for x in ("2021-01-01", "2021-03-31"))
    for r in ll.known_window_sum(h, 7, lo, hi).collect():
        d = r["day"].toordinal() - pd.Timestamp("2021-01-01").toordinal()
        s = int(r["series"][1])
        exp = sum(hist[s, t, : d - t + 1].sum() for t in range(max(0, d - 6), min(d, 89) + 1))
        assert r["n"] == exp


@pytest.mark.parametrize("parts", ["1", "8"])
def test_ranks(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        p = np.where(RNG.random(3000) < 0.4, 0.0, np.round(RNG.random(3000), 2))
        y = RNG.random(3000) < 0.2 + 0.5 * p
        g = np.where(RNG.random(3000) < 0.8, "hot", "cold")
        d = spark.createDataFrame(pd.DataFrame({"g": g, "prob": p, "event": y}))
        got = {r["g"]: r["auc"] for r in ranks.auc(d, ["g"]).collect()}
        q = {(r["g"], round(r["prob"], 3)): r["quantile"] for r in ranks.exact_quantiles(d, ["g"], "prob", [0.0, 0.25, 0.333, 0.75, 1.0]).collect()}
        for k in ("hot", "cold"):
            m = g == k
            rank = pd.Series(p[m]).rank().to_numpy()
            n1 = y[m].sum()
            exp = (rank[y[m]].sum() - n1 * (n1 + 1) / 2) / (n1 * (m.sum() - n1))
            assert abs(got[k] - exp) < 1e-12
            for a in (0.0, 0.25, 0.333, 0.75, 1.0):
                assert abs(q[k, a] - np.quantile(p[m], a)) < 1e-12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def pav(x, y, n):
    b = [[a * w, w, c] for a, c, w in zip(x, y, n)]
    i = 0
    while i < len(b) - 1:
        if b[i][2] / b[i][1] > b[i + 1][2] / b[i + 1][1]:
            b[i] = [u + v for u, v in zip(b[i], b.pop(i + 1))]
            i = max(i - 1, 0)
        else:
            i += 1
    return np.array([u[0] / u[1] for u in b]), np.array([u[2] / u[1] for u in b])


def test_calibration(spark):
    n = 4000
    p = np.round(RNG.random(n), 3)
    yr = RNG.integers(2001, 2005, n)
    y = RNG.random(n) < p**2
    pdf = pd.DataFrame({"prob": p, "event": y, "year": yr, "id": range(n)})
    d = spark.createDataFrame(pdf)
    iso = cb.loyo(d).toPandas().set_index("id")["prob_cal"].sort_index().to_numpy()
    pla = cb.loyo(d, method="platt").toPandas().set_index("id")["prob_cal"].sort_index().to_numpy()
    for f in range(2001, 2005):
        tr = pdf[pdf.year != f].groupby("prob").event.agg(["sum", "count"])
        x, v = pav(tr.index, tr["sum"], tr["count"])
        m = yr == f
        assert np.allclose(iso[m], np.clip(np.interp(p[m], x, v), 0, 1))
        z = np.log(np.clip(p, 1e-3, 0.999) / (1 - np.clip(p, 1e-3, 0.999)))
        a = np.array([1.0, 0.0])
        for _ in range(50):
            q = 1 / (1 + np.exp(-(a[0] * z[~m] + a[1])))
            w = q * (1 - q) + 1e-9
            g = np.array([((q - y[~m]) * z[~m]).sum(), (q - y[~m]).sum()])
            hm = np.array([[(w * z[~m] ** 2).sum(), (w * z[~m]).sum()], [(w * z[~m]).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            a = a - np.linalg.solve(hm, g)
        assert np.allclose(pla[m], 1 / (1 + np.exp(-(a[0] * z[m] + a[1]))), atol=1e-6)


@pytest.mark.parametrize("kind", ["in order", "noisy", "constant", "steps"])
def test_isotonic_fit_in_parts(spark, kind):
    """Groups of more blocks than one task pools give the knots of the plain method, in parts of bounded size."""
    m = 3000
    p = np.sort(RNG.random(m)).round(9)
    n = RNG.integers(1, 9, m).astype(float)
    share = {"in order": p, "noisy": np.clip(p + RNG.normal(0, 0.02, m), 0, 1), "constant": np.full(m, 0.5), "steps": np.floor(p * 5) / 5}[kind]
    n = n * (5000 if kind == "in order" else 200)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], m), "p": np.tile(p, 2), "n": np.tile(n, 2), "pos": np.tile(np.round(share * n), 2)}).drop_duplicates(["g", "p"])
    d = spark.createDataFrame(pdf)
    got = cb.isotonic_fit(d, ["g"], most=200).toPandas()
    one = pdf[pdf.g == "a"]
    stack = []
    for x, k, y in zip(one.p * one.n, one.n, one.pos):
        stack.append([x, k, y])
        while len(stack) > 1 and stack[-2][2] * stack[-1][1] > stack[-1][2] * stack[-2][1]:
            top = stack.pop()
            stack[-1] = [u + v for u, v in zip(stack[-1], top)]
    for g in ("a", "b"):
        mine = got[got.g == g].sort_values("x")
        assert len(mine) == len(stack)
        assert np.allclose(mine.x, [x / k for x, k, _ in stack]) and np.allclose(mine.y, [y / k for _, k, y in stack]) and (mine.n.to_numpy() == [k for _, k, _ in stack]).all()
    if kind in ("in order", "noisy"):
        keys = ["g"]
        blocks = d.select("g", (d.p * d.n).alias("sx"), "n", d.pos.alias("sy"))
        assert cb._apart(blocks, keys).groupBy("g", "_s").count().agg({"count": "max"}).first()[0] < m / 8


def test_neighbours_and_kernel(spark):
    xy = np.vstack([RNG.normal(0, 0.05, (150, 2)), RNG.normal(3, 2.0, (60, 2)), [[40.0, 40.0]]])
    pdf = pd.DataFrame({"origin": "a", "x": xy[:, 0], "y": xy[:, 1], "w": RNG.random(len(xy))})
    pdf = pd.concat([pdf, pdf.iloc[:3]])
    d = spark.createDataFrame(pdf)
    got = {(r["x"], r["y"]): r["rbar"] for r in sp.knn_mean_distance(d, 10).collect()}
    pts = pdf[["x", "y"]].to_numpy()
    for (x, y), v in got.items():
        dist = np.sort(np.hypot(pts[:, 0] - x, pts[:, 1] - y))[1:11]
        assert abs(v - dist.mean()) < 1e-9
    assert len(got) == len(xy)
    ev = pd.DataFrame({"village_code": [str(i) for i in range(30)], "x": RNG.uniform(-2, 6, 30), "y": RNG.uniform(-2, 6, 30)})
    s = sp.bandwidth(d, sp.Width(least=0.2, most=5.0)).toPandas()
    lam = sp.intensity(spark.createDataFrame(s), spark.createDataFrame(ev), "village_code", (0.2, 5.0)).toPandas().set_index("village_code")["lam"]
    for r in ev.itertuples():
        d2 = (s.x - r.x) ** 2 + (s.y - r.y) ** 2
        exp = (s.w / (2 * np.pi * s.sigma**2) * np.exp(-d2 / (2 * s.sigma**2))).sum()
        assert abs(lam.get(r.village_code, 0.0) - exp) < 1e-12


def test_neighbours_in_crowds_and_far_points(spark):
    """A dense crowd, a very dense one inside it, places of many copies, and two far points in one group; a small group beside it."""
    xy = np.vstack([RNG.normal(0, 1.0, (1500, 2)), RNG.normal(0, 1e-4, (900, 2)), np.repeat([[0.5, 0.5], [7.0, 7.0]], 40, 0), np.repeat([[-3.0, 1.0]], 5, 0), [[4e4, -4e4], [1e6, 3e5]]])
    pdf = pd.concat([pd.DataFrame({"origin": "a", "x": xy[:, 0], "y": xy[:, 1]}), pd.DataFrame({"origin": "b", "x": np.arange(6.0), "y": 0.0}), pd.DataFrame({"origin": "c", "x": np.zeros(3), "y": 0.0})])
    got = {(r["origin"], r["x"], r["y"]): r["rbar"] for r in sp.knn_mean_distance(spark.createDataFrame(pdf), 5).collect()}
    for g, part in pdf.groupby("origin"):
        pts = part[["x", "y"]].to_numpy()
        for x, y in np.unique(pts, axis=0):
            dist = np.sort(np.hypot(pts[:, 0] - x, pts[:, 1] - y))[1:6]
            if len(dist) < 5:
                assert (g, x, y) not in got
            else:
                assert got[g, x, y] == pytest.approx(dist.mean(), rel=1e-9, abs=1e-12)


def test_neighbours_across_leaves(spark, monkeypatch):
    """Leaves of few places, so circles cross many of them: a crowd beside sparse places, a line, copies, null and infinite coordinates."""
    monkeypatch.setattr(sp, "LEAF", 8, raising=False)
    xy = np.vstack([RNG.normal(0, 1.0, (300, 2)), RNG.normal([1.3, 0.2], 1e-3, (200, 2)), np.c_[np.arange(60.0), np.zeros(60)], np.repeat([[2.0, 2.0]], 9, 0), [[500.0, -800.0]]])
    rows = [("a", float(x), float(y)) for x, y in xy] + [("b", float(i % 4), float(i // 4)) for i in range(32)] + [(None, 0.0, 0.0)] * 9
    odd = [("a", None, 0.0), ("a", 1.0, None), ("b", float("nan"), 1.0), ("b", 0.5, float("inf"))]
    got = {(r["origin"], r["x"], r["y"]): r["rbar"] for r in sp.knn_mean_distance(spark.createDataFrame(rows + odd, "origin string, x double, y double"), 4).collect()}
    want = {}
    for g in "ab":
        pts = np.array([r[1:] for r in rows if r[0] == g])
        want |= {(g, x, y): np.sort(np.hypot(pts[:, 0] - x, pts[:, 1] - y))[1:5].mean() for x, y in pts.tolist()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(d, rel=1e-9, abs=1e-12) for p, d in want.items())


@pytest.mark.parametrize("kind, most", [("neighbours", 500), ("intensity", 900)])
def test_neighbours_shuffle_little(spark, kind, most):
    """A place goes to its leaf and to few others; cells around each place and pairs of places are not shuffled. Bytes for each place."""
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    d = spark.createDataFrame(pd.DataFrame({"origin": "a", "x": RNG.random(20000), "y": RNG.random(20000), "w": 1.0})).cache()
    assert d.count() == 20000
    ev = spark.createDataFrame([(str(i), i / 10, 0.5) for i in range(10)], "village_code string, x double, y double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        if kind == "neighbours":
            assert sp.knn_mean_distance(d, 10).count() == 20000
        else:
            width = sp.Width(least=0.2, most=5.0)
            assert sp.intensity(sp.bandwidth(d, width), ev, "village_code", width.range()).count() == 10
        assert shuffled() - before < 20000 * most
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        d.unpersist()


def test_polygons_of_many_edges(spark):
    """A ragged ring of 3,000 edges, a comb whose edges all span its height, a hole-like second ring, and a flat polygon."""
    m = 3000
    ang = np.linspace(0, 2 * np.pi, m, endpoint=False)
    rad = 5 + RNG.random(m)
    comb = [(i * 0.01, 0.0 if i % 2 else 3.0) for i in range(200)] + [(2.0, -1.0), (0.0, -1.0)]
    rings = {("star", 0): list(zip(rad * np.cos(ang), rad * np.sin(ang))), ("comb", 0): [(x + 10, y) for x, y in comb], ("two", 0): [(20, 0), (24, 0), (24, 4), (20, 4)], ("two", 1): [(26, 1), (27, 1), (27, 2)], ("flat", 0): [(30, 1), (31, 1), (32, 1)]}
    rows = [(v, r, k, float(x), float(y)) for (v, r), pts in rings.items() for k, (x, y) in enumerate(pts)]
    xy = np.vstack([RNG.uniform(-7, 7, (700, 2)), RNG.uniform([9, -2], [13, 4], (500, 2)), RNG.uniform([19, -1], [33, 5], (300, 2)), [[24.0, 4.0], [20.0, 0.0]]])
    got = {(r["x"], r["y"]): r["village_code"] for r in sp.assign_polygons(spark.createDataFrame(pd.DataFrame(xy, columns=["x", "y"])), spark.createDataFrame(rows, "village_code string, ring int, seq int, x double, y double")).collect()}
    for x, y in xy:
        inside = set()
        for (v, _), pts in rings.items():
            a = np.array(pts, float)
            b = np.roll(a, -1, axis=0)
            span = (a[:, 1] > y) != (b[:, 1] > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                cross = span & (x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0])
            if cross.sum() % 2:
                inside.add(v)
        assert got.get((x, y)) == (min(inside) if inside else None)


def test_sweep_against_rows(spark):
    p, y = RNG.random(2000), RNG.random(2000) < 0.3
    d = spark.createDataFrame(pd.DataFrame({"g": "a", "prob": p, "event": y}))
    for r in al.sweep(d, ["g"], [0.1, 0.5, 0.9]).collect():
        a = p >= r["p_star"]
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == ((a & y).sum(), (a & ~y).sum(), (~a & y).sum(), (~a & ~y).sum())
