"""Kernel intensities, nearest neighbours, polygons and hotspot scores.

Distances are searched through square cells joined by equality. Cell sizes go up by doubling, and every point or polygon
uses the size that fits it, so neither a wide kernel nor a large polygon makes the others search far. Nearest neighbours
are searched in cells of few places, and only where a circle leaves its cell in others too.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..session import spread, written
from . import linelist as ll

# exp(-38.7^2/2) is below the smallest double: a kernel term cut there is 0 anyway
REACH = 38.7


@dataclass(frozen=True)
class Choice:
    """Which cases feed a density, where they stand, and what each weighs."""

    place: str = "cases"  # "towns": daily town counts at the town's centre, "villages": spread over its villages
    days: int = 60
    half_life: float = 14.0
    earlier: float = 0.0  # weight of the same season of earlier years
    around: int = 21  # days on both sides of the same date
    years: int = 2
    least_share: float = 0.2


@dataclass(frozen=True)
class Width:
    """Kilometres of a kernel: ``fixed``, or by the distance to ``near`` neighbours, times ``factor``, within ``least`` and ``most``."""

    fixed: float | None = None
    near: int = 10
    factor: float = 1.0
    least: float = 0.5
    most: float = 10.0

    def range(self) -> tuple[float, float]:
        return (self.least, self.most) if self.fixed is None else (self.fixed, self.fixed)


@dataclass(frozen=True)
class Blend:
    """How shares become counts: weight of the place's own count, the regional trend, and the spread of the counts."""

    own: float = 0.0
    trend: bool = True
    pseudo: float = 5.0
    phi: float = 2.0


@dataclass(frozen=True)
class SpatialModel:
    choice: Choice = Choice()
    width: Width = Width()
    blend: Blend = Blend()


# The named forecasters as (points, kilometres, factor, least kilometres, own, earlier seasons).
SPATIAL_MODELS = {
    name: SpatialModel(Choice(place, earlier=earlier), Width(km, factor=factor, least=least), Blend(own))
    for name, place, km, factor, least, own, earlier in (
        ("kde_fix", "cases", 2.0, 1.0, 0.5, 0.0, 0.0),
        ("kde_rv", "cases", None, 1.0, 0.5, 0.0, 0.0),
        ("kde_mix", "cases", None, 1.0, 0.5, 0.5, 0.0),
        ("kde_rv_season", "cases", None, 1.0, 0.5, 0.0, 0.2),
        ("kde_rv_b2", "cases", None, 2.0, 1.0, 0.0, 0.0),
        ("kde_mix_fix", "cases", 2.0, 1.0, 0.5, 0.5, 0.0),
        ("kde_mix_fix_town", "towns", 2.0, 1.0, 0.5, 0.5, 0.0),
        ("kde_mix_fix_town3", "towns", 3.0, 1.0, 0.5, 0.5, 0.0),
        ("kde_mix_fix_vill", "villages", 2.0, 1.0, 0.5, 0.5, 0.0),
        ("kde_fix_vill", "villages", 2.0, 1.0, 0.5, 0.0, 0.0),
    )
}


# --------------------------------------------------------------------------- geometry from cases
def geometry(cases: DataFrame, x: str = "x", y: str = "y") -> tuple[DataFrame, DataFrame]:
    """(towns, villages) from local cases (series, village_code, x, y, n).

    Towns: case-weighted centre and cases. Villages: mean of the case coordinates, the first series by name, and the
    share of the town's cases; a town without any village gets its own mean as the one evaluation point.
    """
    c = cases.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    towns = c.groupBy("series").agg(
        (F.sum(F.col(x) * F.col("n")) / F.sum("n")).alias("x"), (F.sum(F.col(y) * F.col("n")) / F.sum("n")).alias("y"),
        F.avg(x).alias("mx"), F.avg(y).alias("my"), F.sum("n").alias("cases"),
    )
    v = c.where(F.col("village_code").isNotNull()).groupBy("village_code").agg(
        F.min("series").alias("series"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.sum("n").alias("cases")
    )
    alone = towns.join(v.select("series").distinct(), "series", "left_anti").select(
        F.concat(F.lit("town:"), "series").alias("village_code"), "series", F.col("mx").alias("x"), F.col("my").alias("y"), "cases"
    )
    villages = v.unionByName(alone)
    share = F.col("cases") / F.nullif(F.sum("cases").over(W.partitionBy("series")), F.lit(0))
    return towns.select("series", "x", "y", "cases"), villages.withColumn("share", F.coalesce(share, F.lit(0.0)))


# --------------------------------------------------------------------------- weighted points per origin
def _on_origins(rows: DataFrame, first: Column, last: Column, origins: DataFrame) -> DataFrame:
    d = rows.where(first <= last).withColumn("origin", F.explode(F.sequence(first, last)))
    return d.join(origins.select("origin").distinct(), "origin", "left_semi")


def weighted_points(cases: DataFrame, origins: DataFrame, mode: str, model: SpatialModel, comp: DataFrame | None = None,
                    dmax: int = ll.DMAX) -> DataFrame:
    """(origin, x, y, w, m) of the cases that feed the density at each origin; equal places are added up, m counts their case rows.

    Recency 0.5^(age/half life); in mode asof_adj divided by the completeness of the age; with a weight for earlier seasons also the
    same season of earlier years. A case is spread over the origins that may use it (at most ``days``).
    """
    seen = F.col("onset") if mode == "final" else F.greatest("onset", "report")
    rows = cases.groupBy("onset", "report", "x", "y").agg(F.sum("n").cast("double").alias("n"), F.count(F.lit(1)).alias("m"))
    p = _on_origins(rows, seen, F.date_add("onset", model.choice.days - 1), origins)
    age = F.datediff("origin", "onset")
    p = p.withColumn("w", F.col("n") * F.pow(F.lit(0.5), age / F.lit(model.choice.half_life)))
    if mode == "asof_adj":
        if comp is None:
            raise ValueError("mode asof_adj needs the completeness table")
        c = comp.select("origin", F.col("k").alias("_k"), F.greatest("share", F.lit(model.choice.least_share)).alias("_c"))
        p = p.withColumn("_k", F.least(age, F.lit(dmax))).join(c, ["origin", "_k"], "left").withColumn("w", F.col("w") / F.coalesce("_c", F.lit(1.0)))
    out = p.select("origin", "x", "y", "w", "m")
    if model.choice.earlier > 0:
        for yb in range(1, model.choice.years + 1):
            shift = 365 * yb - 7
            first = F.date_add("onset", shift - model.choice.around)
            first = first if mode == "final" else F.greatest(first, F.col("report"))
            s = _on_origins(rows, first, F.date_add("onset", shift + model.choice.around), origins)
            out = out.unionByName(s.select("origin", "x", "y", (F.lit(model.choice.earlier) * F.col("n")).alias("w"), "m"))
    return out.groupBy("origin", "x", "y").agg(F.sum("w").alias("w"), F.sum("m").alias("m"))


def town_points(context: DataFrame, places: DataFrame, model: SpatialModel) -> DataFrame:
    """Points from daily town counts known at the origin: decayed sums at the town centre, or spread by village share.

    ``context``: origin, series, k, n. ``places``: series, x, y, share (1 for centres).
    """
    w = context.where(F.col("k") < model.choice.days).groupBy("origin", "series").agg(
        F.sum(F.col("n") * F.pow(F.lit(0.5), F.col("k") / F.lit(model.choice.half_life))).alias("_w")
    )
    p = w.join(places.select("series", "x", "y", "share"), "series").withColumn("w", F.col("_w") * F.col("share")).where("w > 0")
    return p.groupBy("origin", "x", "y").agg(F.sum("w").alias("w"))


# --------------------------------------------------------------------------- cells
def _cell(c: str, size: Column) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def _level(size: Column) -> Column:
    """Smallest level whose cells (2^level wide) are at least ``size``."""
    return F.ceil(F.log2(size)).cast("int")


def _around(reach: int) -> Column:
    r = range(-reach, reach + 1)
    return F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in r for b in r])


def bandwidth(points: DataFrame, width: Width, by: Sequence[str] = ("origin",)) -> DataFrame:
    """Column sigma: fixed, or from the mean distance to the nearest points, between the least and the most.

    A column ``m`` says how many cases stand at a place; each is a point, so cases at one place are neighbours at distance 0.
    Groups with at most as many points as neighbours are asked for use the most.
    """
    if width.fixed is not None:
        return points.withColumn("sigma", F.lit(float(width.fixed)))
    r = knn_mean_distance(points, width.near, by, copies="m" if "m" in points.columns else None)
    s = F.lit(width.factor * math.sqrt(math.pi) / math.sqrt(width.near)) * F.col("rbar")
    clipped = F.greatest(F.lit(width.least), F.least(F.lit(width.most), s))
    return points.join(r, [*by, "x", "y"], "left").withColumn(
        "sigma", F.when(F.col("rbar").isNull(), F.lit(float(width.most))).otherwise(clipped)
    ).drop("rbar")


STEP = 4  # halvings of the cells in a round
DEPTH = 48  # halvings of the box at most: narrower cells part few doubles
LEAF = 1024  # places of a leaf at most
MOST_BANDS = 4096  # of a polygon


def _up(c: str | Column, level: str | Column) -> Column:
    """The cell of ``level`` that a cell ``c`` of level DEPTH lies in; level 0 is the whole box."""
    c, level = (F.col(v) if isinstance(v, str) else v for v in (c, level))
    return F.call_function("shiftright", c, (F.lit(DEPTH) - level).cast("int"))


def _fine(c: Column, low: float, width: float) -> Column:
    """Cell of level DEPTH, never falling with the coordinate; coordinates beyond the box are in its outermost cells."""
    return F.greatest(F.lit(0), F.least(F.lit(2**DEPTH - 1), F.floor((c - F.lit(low)) / F.lit(width) * F.lit(2.0**DEPTH)).cast("long")))


def _leaves(near: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    """``near`` (with gx, gy: cells of level DEPTH) with the leaf (j, cx, cy) of each place: the widest cell of at most ``most`` places.

    Cells are halved ``STEP`` times a round; a further round takes only the places of cells that still hold more.
    """
    out, base = None, 0
    while True:
        fine = min(base + STEP, DEPTH)
        pending = near.withColumns({"fx": _up("gx", F.lit(fine)), "fy": _up("gy", F.lit(fine))})
        cells = pending.groupBy(*by, "fx", "fy").agg(F.count("*").alias("c")).withColumn("j", F.explode(F.sequence(F.lit(base), F.lit(fine))))
        up = lambda c: F.call_function("shiftright", F.col(c), F.lit(fine) - F.col("j"))
        cells = cells.groupBy(*by, "j", up("fx").alias("cx"), up("fy").alias("cy")).agg(F.sum("c").alias("c"), F.collect_list(F.struct("fx", "fy")).alias("_f"))
        cells = cells.where((F.col("c") <= most) | (F.col("j") == fine)).withColumn("_f", F.explode("_f"))
        leaf = cells.groupBy(*by, F.col("_f.fx").alias("fx"), F.col("_f.fy").alias("fy")).agg(F.min(F.struct("j", "cx", "cy", "c")).alias("_l"))
        found = written(pending.join(leaf, [*by, "fx", "fy"]).select(*near.columns, "_l.j", "_l.cx", "_l.cy", "_l.c"), "knn-leaves")
        crowded = F.lit(fine < DEPTH) & (F.col("c") > most)
        done = found.where(~crowded).drop("c", "gx", "gy")
        out = done if out is None else out.unionByName(done)
        near = found.where(crowded).select(*near.columns)
        if near.isEmpty():
            return out
        base = fine + 1


def _k_nearest(x: np.ndarray, y: np.ndarray, m: np.ndarray, px: np.ndarray, py: np.ndarray, k: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each (px, py) the distances of its nearest places (x, y), rising, and how many of the m points there are among its k nearest.

    ``own``: the places ask for themselves, each is not its own neighbour but its copies are.
    """
    most = min(len(x), k + 1)
    d, c = np.empty((len(px), most)), np.empty((len(px), most), np.int64)
    rows = max(1, 2**20 // max(1, len(x)))
    for at in range(0, len(px) if most else 0, rows):
        s = slice(at, at + rows)
        all_ = np.sqrt((px[s, None] - x) ** 2 + (py[s, None] - y) ** 2)
        best = np.argpartition(all_, most - 1, axis=1)[:, :most]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_, best, 1), axis=1), 1)
        d[s], c[s] = np.take_along_axis(all_, best, 1), m[best]
        if own:
            c[s] -= best == np.arange(at, at + len(best))[:, None]
    return d, np.clip(k - (np.cumsum(c, axis=1) - c), 0, c)


def _with_lists(t: pa.Table, d: np.ndarray, c: np.ndarray, keep: np.ndarray) -> pa.Table:
    """``t`` with what a mask keeps of each row of distances and counts, as lists ds and ms."""
    ends = pa.array(np.concatenate([[0], np.cumsum(keep.sum(axis=1))]), pa.int32())
    return t.append_column("ds", pa.ListArray.from_arrays(ends, pa.array(d[keep]))).append_column("ms", pa.ListArray.from_arrays(ends, pa.array(c[keep])))


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(n).to_numpy() for n in names]


def _asked(points: DataFrame, by: Sequence[str], low: tuple[float, float], width: float) -> dict[str, Column]:
    """First and last cells of level DEPTH that the square around a place, ``r`` to each side, reaches."""
    return {f"{n}{c}": _fine(F.col(c) + sign * F.col("r"), at, width) for c, at in zip("xy", low) for n, sign in (("l", -1), ("h", 1))}


def knn_mean_distance(points: DataFrame, k: int, by: Sequence[str] = ("origin",), copies: str | None = None) -> DataFrame:
    """(by, x, y, rbar): mean distance to the k nearest other points, copies at one place counted one by one.

    A tree of square cells, as deep as the points are dense, whose leaves hold at most ``LEAF`` places. Each leaf searches among its own
    places first. That bounds the distance of the k-th neighbour, and only places whose circle leaves their leaf ask the other leaves
    it meets. A place moves once to its leaf and as an asking one to few others, and pairs do not move at all. A leaf of too few
    places has a parent of more than ``LEAF``, so the k-th neighbour is within 3 of its cells. Groups with at most k points give no row.
    """
    m = F.sum(copies) if copies else F.count("*")
    real = [F.col(c).isNotNull() for c in by] + [F.abs(c) < float("inf") for c in ("x", "y")]
    near = points.where(functools.reduce(Column.__and__, real)).groupBy(*by, "x", "y").agg(m.cast("long").alias("m"))
    near = written(near, "knn-places")
    box = near.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    low = (box["x0"] or 0.0, box["y0"] or 0.0)
    width = 1.0 if box["x0"] is None else max(box["x1"] - low[0], box["y1"] - low[1]) * (1 + 1e-6) or 1.0
    leaf = [*by, "j", "cx", "cy"]
    places = _leaves(near.withColumns({"gx": _fine(F.col("x"), low[0], width), "gy": _fine(F.col("y"), low[1], width)}), by, max(LEAF, 2 * k))

    def inside(t: pa.Table) -> pa.Table:
        x, y, n = _columns(t, "x", "y", "m")
        d, c = _k_nearest(x, y, n, x, y, k, True)
        more = {"got": c.sum(axis=1), "far": np.where(c > 0, d, 0).max(axis=1), "rbar": (c * d).sum(axis=1) / k}
        for name, v in more.items():
            t = t.append_column(name, pa.array(v))
        return _with_lists(t, d, c, c > 0)

    lists = "ds array<double>, ms array<long>"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema)
    own = spread(places, leaf).groupBy(*leaf).applyInArrow(inside, f"{kinds}, got long, far double, rbar double, {lists}")
    # more than the distance by what rounding may take from it
    own = own.withColumn("r", F.when(F.col("got") < k, F.lit(3 * width) * F.pow(F.lit(0.5), F.col("j"))).otherwise(F.col("far")) * (1 + 1e-9))
    asked = _asked(own, by, low, width)
    leaves = functools.reduce(Column.__or__, [_up(v, "j") != F.col(f"c{n[1]}") for n, v in asked.items()])
    own = own.withColumn("open", (F.col("j") > 0) & leaves).where(F.col("open") | (F.col("got") == k))
    own = written(own.withColumns({c: F.when(F.col("open"), F.col(c)) for c in ("ds", "ms", "r")}).drop("got", "far"), "knn-inside")
    done = own.where(~F.col("open")).select(*by, "x", "y", "rbar")
    asking = own.where("open").withColumns(_asked(own, by, low, width))

    # a place and another leaf meet once, at the wider of their two levels
    cells = asking.select(*by, "x", "y", "r", "j", "cx", "cy", "lx", "hx", "ly", "hy", F.explode(F.sequence(F.lit(1), F.col("j"))).alias("l"))
    cells = cells.withColumn("kx", F.explode(F.sequence(_up("lx", "l"), _up("hx", "l")))).withColumn("ky", F.explode(F.sequence(_up("ly", "l"), _up("hy", "l"))))
    above = lambda c: F.call_function("shiftright", F.col(c), F.col("j") - F.col("l"))
    cells = cells.where((F.col("kx") != above("cx")) | (F.col("ky") != above("cy"))).select(*by, "x", "y", "r", F.col("j").alias("pj"), "l", "kx", "ky")
    held = own.groupBy(*leaf).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    held = held.withColumn("l", F.explode(F.sequence(F.lit(1), F.col("j")))).withColumns({"kx": above("cx"), "ky": above("cy")})
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"))
    probes = cells.join(held, [*by, "l", "kx", "ky"]).where((F.col("l") == F.least("pj", "j")) & (F.hypot(gap("x"), gap("y")) <= F.col("r")))
    probes = probes.select(*leaf, F.col("x").alias("px"), F.col("y").alias("py"), "r").toDF(*leaf, "px", "py", "r")

    def beside(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y, n, px, py, r = *_columns(a, "x", "y", "m"), *_columns(b, "px", "py", "r")
        d, c = _k_nearest(x, y, n, px, py, k, False)
        keep = (d <= r[:, None]) & (c > 0)
        hit = keep.any(axis=1)
        return _with_lists(b.select([*by, "px", "py"]).filter(pa.array(hit)), d[hit], c[hit], keep[hit])

    keys = ", ".join(f"`{c}` {near.schema[c].dataType.simpleString()}" for c in by)
    here = spread(own.select(*leaf, "x", "y", "m"), leaf).groupBy(*leaf)
    other = here.cogroup(spread(probes, leaf).groupBy(*leaf)).applyInArrow(beside, f"{keys}{', ' if by else ''}px double, py double, {lists}")
    both = asking.select(*by, "x", "y", "ds", "ms").unionByName(other.withColumnsRenamed({"px": "x", "py": "y"}))
    first = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("ds", "ms"))))
    take = lambda a, v: F.least(a["left"], v["ms"])
    add = lambda a, v: F.struct((a["left"] - take(a, v)).alias("left"), (a["sum"] + take(a, v) * v["ds"]).alias("sum"))
    start = F.struct(F.lit(k).cast("long").alias("left"), F.lit(0.0).alias("sum"))
    return done.unionByName(both.groupBy(*by, "x", "y").agg(F.aggregate(first, start, add, lambda a: a["sum"] / k).alias("rbar")))


def intensity(points: DataFrame, evals: DataFrame, eval_id: str, sigma_range: tuple[float, float], by: Sequence[str] = ("origin",),
              reach: float = REACH) -> DataFrame:
    """(by, eval_id, lam): sum of w/(2 pi s^2) exp(-d^2/2 s^2) at each evaluation point.

    Terms beyond ``reach`` sigmas are left out; the default loses nothing a double can hold. A point lies in one cell of
    its own reach; evaluation points look at the 3x3 block of every size in use.
    """
    lo = math.ceil(math.log2(reach * sigma_range[0]))
    hi = math.ceil(math.log2(reach * sigma_range[1]))
    p = points.groupBy(*by, "x", "y", "sigma").agg(F.sum("w").alias("w")).withColumn("l", _level(F.col("sigma") * reach))
    size = F.pow(F.lit(2.0), F.col("l"))
    p = p.withColumns({"cx": _cell("x", size), "cy": _cell("y", size)})
    e = evals.select(eval_id, F.col("x").alias("ex"), F.col("y").alias("ey")).withColumn("l", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    e = e.withColumns({"cx": _cell("ex", size), "cy": _cell("ey", size)}).withColumn("_d", F.explode(_around(1)))
    e = e.select(eval_id, "ex", "ey", "l", (F.col("cx") + F.col("_d.dx")).alias("cx"), (F.col("cy") + F.col("_d.dy")).alias("cy"))
    d2 = F.pow(F.col("x") - F.col("ex"), 2) + F.pow(F.col("y") - F.col("ey"), 2)
    s2 = F.col("sigma") * F.col("sigma")
    j = spread(p, ["x", "y", *by]).join(e, ["l", "cx", "cy"]).where(d2 <= F.lit(reach * reach) * s2)
    return j.groupBy(*by, eval_id).agg(F.sum(F.col("w") / (F.lit(2 * math.pi) * s2) * F.exp(-d2 / (2 * s2))).alias("lam"))


# --------------------------------------------------------------------------- forecasts
def trend_factor(now: Column, before: Column, pseudo: float = 5.0) -> Column:
    return F.greatest(F.lit(0.5), F.least(F.lit(2.0), (now + pseudo) / (before + pseudo)))


def spatial_forecast(context: DataFrame, lam: DataFrame, villages: DataFrame, model: SpatialModel, hs: Sequence[int],
                     points: DataFrame | None = None) -> DataFrame:
    """(origin, series, h, mu): spatial share of the regional total times the trend, blended with the own persistence.

    ``context``: origin, series, k, n with zeros for k = 0..13. ``lam``: origin, village_code, lam. Without points
    (``points`` has the origins with any; else those with a lam row count) the share is the own share, without cases at all it is
    uniform, as it is where points are too far from every village for a double.
    """
    own = context.groupBy("origin", "series").agg(
        F.sum(F.when(F.col("k") < 7, F.col("n")).otherwise(0.0)).alias("own7"),
        F.sum(F.when(F.col("k").between(7, 13), F.col("n")).otherwise(0.0)).alias("prev7"),
    )
    town = lam.join(villages.select("village_code", "series"), "village_code").groupBy("origin", "series").agg(F.sum("lam").alias("lam"))
    d = own.join(town, ["origin", "series"], "left")
    tot = d.groupBy("origin").agg(F.sum("own7").alias("tot7"), F.sum("prev7").alias("p7"), F.sum("lam").alias("tlam"), F.count("*").alias("ns"))
    d = d.join(tot, "origin")
    if points is not None:
        some = points.where("w > 0").select("origin").distinct().withColumn("_some", F.lit(True))
        d = d.join(some, "origin", "left")
    seen = F.coalesce("_some", F.lit(False)) if points is not None else F.col("tlam").isNotNull()
    uniform = F.lit(1.0) / F.col("ns")
    share = (
        F.when(F.col("tlam") > 0, F.coalesce("lam", F.lit(0.0)) / F.nullif(F.col("tlam"), F.lit(0.0)))
        .when(seen, uniform)
        .when(F.col("tot7") > 0, F.col("own7") / F.nullif(F.col("tot7"), F.lit(0.0)))
        .otherwise(uniform)
    )
    g = trend_factor(F.col("tot7"), F.col("p7"), model.blend.pseudo) if model.blend.trend else F.lit(1.0)
    d = d.withColumns({"share": share, "g": g}).withColumn("h", F.explode(F.array(*[F.lit(h) for h in hs])))
    gh = F.pow("g", F.col("h") / F.lit(7.0))
    mu = (F.lit(1 - model.blend.own) * F.col("share") * F.col("tot7") + F.lit(model.blend.own) * F.col("own7")) * gh
    return d.select("origin", "series", "h", "own7", "tot7", "g", "share", mu.alias("mu"))


def add_deciles(mu: DataFrame, phi: float = 2.0) -> DataFrame:
    from ..functions.quantiles import spread

    d = mu.withColumn("_q", geo.nb_deciles(F.col("mu"), phi))
    return d.select("*", *spread(F.col("_q"))).drop("_q").withColumn("median", F.col("q50"))


# --------------------------------------------------------------------------- village hotspots
@dataclass(frozen=True)
class Hotspot:
    """What a village's expected count rests on: its own cases, its town's mean, or the density of this width, blended with the own cases."""

    name: str
    base: str | Width
    own: float = 0.0


# Kilometres by neighbours lie between these; the named village models as (kilometres, own).
NEAR_VILLAGES = Width(None, least=0.2, most=5.0)
HOTSPOTS = {"own": Hotspot("own", "own"), "town": Hotspot("town", "town")} | {
    name: Hotspot(name, NEAR_VILLAGES if km is None else Width(km), own)
    for name, km, own in (
        ("kde_05", 0.5, 0.0), ("kde_1", 1.0, 0.0), ("kde_2", 2.0, 0.0), ("kde_rv", None, 0.0), ("kde_05_mix", 0.5, 0.5), ("kde_1_mix", 1.0, 0.5), ("kde_rv_mix", None, 0.5),
    )
}


def village_known(cases: DataFrame, origins: DataFrame, mode: str, back: int = 60, comp: DataFrame | None = None,
                  c_floor: float = 0.2, dmax: int = ll.DMAX) -> DataFrame:
    """(origin, village_code, age, n, m, w) of the cases known at each origin with onset in its last ``back`` days."""
    seen = F.col("onset") if mode == "final" else F.greatest("onset", "report")
    rows = cases.groupBy("village_code", "onset", "report").agg(F.sum("n").cast("double").alias("n"), F.count(F.lit(1)).alias("m"))
    d = _on_origins(rows, seen, F.date_add("onset", back - 1), origins).withColumn("age", F.datediff("origin", "onset"))
    d = d.groupBy("origin", "village_code", "age").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    if mode != "asof_adj":
        return d.withColumn("w", F.col("n"))
    c = comp.select("origin", F.col("k").alias("_k"), F.greatest("share", F.lit(c_floor)).alias("_c"))
    return d.withColumn("_k", F.least("age", F.lit(dmax))).join(c, ["origin", "_k"], "left").withColumn(
        "w", F.col("n") / F.coalesce("_c", F.lit(1.0))
    ).drop("_k", "_c")


def village_truth(cases: DataFrame, origins: DataFrame, ahead: int = 14) -> DataFrame:
    """(origin, village_code, y): cases with onset in (origin, origin+ahead]."""
    rows = cases.groupBy("village_code", "onset").agg(F.sum("n").cast("double").alias("n"))
    d = _on_origins(rows, F.date_sub("onset", ahead), F.date_sub("onset", 1), origins)
    return d.groupBy("origin", "village_code").agg(F.sum("n").alias("y"))


def hotspot_scores(villages: DataFrame, cases: DataFrame, origins: DataFrame, mode: str, models: Sequence[Hotspot],
                   comp: DataFrame | None = None, events: Sequence[int] = (2,), choice: Choice = Choice(), blend: Blend = Blend()) -> DataFrame:
    """origin x village rows: truth y, own_raw, and per model P(>= that many cases in the next 14 days) for each of ``events``.

    A column has the model's name for the first of ``events`` and the name, ``_ge`` and the count for others. ``villages``:
    village_code, town, x, y. Origins (days) travel as one array, so the grid needs no cross join.
    """
    days = origins.agg(F.array_sort(F.collect_set("origin")).alias("v")).scalar()
    grid = villages.select("village_code", "town").withColumn("origin", F.explode(days))
    known = village_known(cases.join(villages.select("village_code"), "village_code", "left_semi"), origins, mode, choice.days, comp, choice.least_share)
    own = known.groupBy("origin", "village_code").agg(
        F.sum(F.when(F.col("age") < 14, F.col("w")).otherwise(0.0)).alias("own14"),
        F.sum(F.when(F.col("age") < 14, F.col("n")).otherwise(0.0)).alias("own_raw"),
        F.sum(F.when(F.col("age").between(14, 27), F.col("w")).otherwise(0.0)).alias("prev14"),
    )
    tot = own.groupBy("origin").agg(F.sum("own14").alias("tot14"), F.sum("prev14").alias("totp"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    d = grid.join(own, ["origin", "village_code"], "left").join(tot, "origin", "left")
    d = d.join(village_truth(cases, origins), ["origin", "village_code"], "left")
    d = d.withColumns({c: zero(c) for c in ("own14", "own_raw", "tot14", "totp", "y")}).drop("prev14")
    d = d.withColumn("g", trend_factor(F.col("tot14"), F.col("totp"), blend.pseudo))
    town = d.groupBy("origin", "town").agg((F.sum("own14") / F.count("*")).alias("town_mean"))
    d = d.join(town, ["origin", "town"])
    for width in dict.fromkeys(m.base for m in models if isinstance(m.base, Width)):
        pts = known.where(F.col("age") < choice.days).join(villages.select("village_code", "x", "y"), "village_code")
        pts = pts.withColumn("w", F.col("w") * F.pow(F.lit(0.5), F.col("age") / F.lit(choice.half_life)))
        lam = intensity(bandwidth(pts, width), villages, "village_code", width.range()).withColumnRenamed("lam", "_lam")
        total = lam.groupBy("origin").agg(F.sum("_lam").alias("_all"))
        d = d.join(lam, ["origin", "village_code"], "left").join(total, "origin", "left")
        share = zero("_lam") / F.nullif(F.col("_all"), F.lit(0.0))
        d = d.withColumn(_spatial(width), F.coalesce(share, F.lit(0.0)) * F.col("tot14") * F.col("g")).drop("_lam", "_all")
    out = {}
    for m in models:
        if m.base == "own":
            mu = F.col("own14")
        elif m.base == "town":
            mu = F.col("town_mean") * F.col("g")
        else:
            mu = F.lit(1 - m.own) * F.col(_spatial(m.base)) + F.lit(m.own) * F.col("own14")
        out |= {m.name + (f"_ge{n}" if i else ""): geo.nb_tail(mu, n, blend.phi) for i, n in enumerate(events)}
    return d.select("origin", "village_code", "town", "y", "own_raw", *[c.alias(n) for n, c in out.items()])


def _spatial(width: Width) -> str:
    return f"_near_{width.near}" if width.fixed is None else f"_km_{width.fixed}".replace(".", "_")


def topk_quality(scores: DataFrame, model: str, ks: Sequence[int], region: str = "region", event: str = "event", ident: str = "village_code") -> DataFrame:
    """Mean recall and precision of the k best villages per origin and region; origins without an event are skipped.

    A ranking holds the villages of one region on one day, a number fixed by the map.
    """
    w = W.partitionBy("origin", region).orderBy(F.desc(model), ident)
    d = scores.withColumn("_r", F.row_number().over(w))
    g = d.groupBy("origin", region).agg(
        F.count_if(F.col(event)).alias("ev"), *[F.count_if(F.col(event) & (F.col("_r") <= k)).alias(f"_h{k}") for k in ks]
    ).where("ev > 0")
    return g.groupBy(region).agg(
        F.count("*").alias("days_with_events"), *[F.avg(F.col(f"_h{k}") / F.col("ev")).alias(f"recall_{k}") for k in ks],
        *[F.avg(F.col(f"_h{k}") / F.lit(k)).alias(f"precision_{k}") for k in ks],
    )


# --------------------------------------------------------------------------- polygons
def ring_edges(vertices: DataFrame, keys: Sequence[str] = ("village_code", "ring")) -> DataFrame:
    """Vertex rows (keys, seq, x, y) -> edges (x, y, x2, y2); the last vertex connects to the first."""
    w = W.partitionBy(*keys).orderBy("seq")
    start = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return vertices.withColumns(
        {"x2": F.coalesce(F.lead("x").over(w), F.first("x").over(start)), "y2": F.coalesce(F.lead("y").over(w), F.first("y").over(start))}
    )


def areas(vertices: DataFrame) -> DataFrame:
    """(village_code, area, x, y): absolute ring areas added, centre weighted by them; degenerate rings left out."""
    e = ring_edges(vertices).withColumn("c", F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))
    r = e.groupBy("village_code", "ring").agg(
        F.count("*").alias("n"), (F.sum("c") / 2).alias("a"), F.sum((F.col("x") + F.col("x2")) * F.col("c")).alias("sx"),
        F.sum((F.col("y") + F.col("y2")) * F.col("c")).alias("sy"),
    ).where((F.col("n") >= 3) & (F.abs("a") >= 1e-9))
    wt = F.abs("a")
    return r.groupBy("village_code").agg(
        F.sum(wt).alias("area"), (F.sum(F.col("sx") / (6 * F.col("a")) * wt) / F.sum(wt)).alias("x"),
        (F.sum(F.col("sy") / (6 * F.col("a")) * wt) / F.sum(wt)).alias("y"),
    )


def assign_polygons(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """(x, y, village_code) for the distinct coordinates inside a polygon (even-odd test per ring, any ring counts).

    A polygon sits in the cells (at most 2x2) of the size that fits its box; a point looks into one cell of each size in
    use. The parity of edges crossed to the right decides; edges are cut into bands by y, and a point meets those of its band, so a
    polygon of many edges is neither one task's nor read whole for each point. Several polygons: the smallest code.
    """
    box = vertices.groupBy("village_code").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    box = box.withColumn("l", _level(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9))))
    sizes = box.agg(F.collect_set("l").alias("v")).scalar()
    size = F.pow(F.lit(2.0), F.col("l"))
    cells = box.withColumn("cx", F.explode(F.sequence(_cell("x0", size), _cell("x1", size)))).withColumn("cy", F.explode(F.sequence(_cell("y0", size), _cell("y1", size))))
    pts = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("x", "y").distinct()
    probe = pts.withColumn("l", F.explode(sizes)).withColumns({"cx": _cell("x", size), "cy": _cell("y", size)})
    cand = probe.join(cells, ["l", "cx", "cy"]).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    e = ring_edges(vertices).select("village_code", "ring", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by"))
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    # bands of one height in each polygon; so many that its edges, cut at them, are at most twice as many
    bands = e.groupBy("village_code").agg(F.min(low).alias("y0"), (F.max(high) - F.min(low)).alias("_h"), F.count("*").alias("_n"), F.sum(high - low).alias("_s"))
    number = F.greatest(F.lit(1), F.least(F.lit(MOST_BANDS), F.floor(F.col("_n") * F.col("_h") / F.nullif(F.col("_s"), F.lit(0.0))).cast("int")))
    bands = written(bands.select("village_code", "y0", "_h", F.coalesce(number, F.lit(1)).alias("_b")), "bands")
    band = lambda y: F.when(F.col("_h") > 0, F.least(F.col("_b") - 1, F.greatest(F.lit(0), F.floor((y - F.col("y0")) / F.col("_h") * F.col("_b")).cast("int")))).otherwise(0)
    cut = e.join(bands, "village_code").withColumn("_at", F.explode(F.sequence(band(low), band(high)))).drop("y0", "_h", "_b")
    t = cand.select("x", "y", "village_code").join(bands, "village_code").withColumn("_at", band(F.col("y"))).drop("y0", "_h", "_b").join(cut, ["village_code", "_at"])
    spans = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
    cross = spans & (F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)) + F.col("ax"))
    hit = t.groupBy("x", "y", "village_code", "ring").agg(F.count_if(F.when(spans, cross).otherwise(False)).alias("c")).where(F.col("c") % 2 == 1)
    return hit.groupBy("x", "y").agg(F.min("village_code").alias("village_code"))


def assign_villages(cases: DataFrame, vertices: DataFrame, names: DataFrame) -> DataFrame:
    """village_code and by_geometry per case: a known village name first, the polygon otherwise; unmatched cases go.

    ``cases``: vname, x, y and more. ``names``: vname, village_code.
    """
    byname = names.groupBy("vname").agg(F.max("village_code").alias("_n"))
    j = cases.join(byname, "vname", "left")
    # only the coordinates of cases without a known name meet the polygons
    geo_hit = assign_polygons(j.where(F.col("_n").isNull()), vertices).withColumnRenamed("village_code", "_g")
    return (
        j.join(geo_hit, ["x", "y"], "left")
        .withColumn("village_code", F.coalesce("_n", "_g"))
        .where(F.col("village_code").isNotNull())
        .withColumn("by_geometry", F.col("_n").isNull())
        .drop("_n", "_g")
    )
