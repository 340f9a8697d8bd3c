"""Column expressions over nine-decile forecasts: scores, hits and exceedance probabilities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = [k / 10 for k in range(1, 10)]
QCOLS = [f"q{k}" for k in range(10, 100, 10)]
# central interval -> (lower, upper) position among the deciles; its alpha is 1 - level/100
BOUNDS = {level: (i, 8 - i) for i, level in enumerate((80, 60, 40, 20))}


def qcols(names: Sequence[str] = QCOLS) -> list[Column]:
    return [F.col(c) for c in names]


def spread(arr: Column, names: Sequence[str] = QCOLS) -> list[Column]:
    """Array of nine deciles -> nine named columns."""
    return [arr[i].alias(n) for i, n in enumerate(names)]


def wis(y: Column, q: Sequence[Column]) -> Column:
    """Weighted interval score, four central intervals and the median."""
    terms = [F.abs(y - q[4]) / 2]
    for level, (i, j) in BOUNDS.items():
        half = F.lit((100 - level) / 200)
        miss = F.greatest(q[i] - y, y - q[j], F.lit(0.0))
        terms.append(half * (q[j] - q[i]) + miss)
    return reduce(add, terms) / F.lit(len(BOUNDS) + 0.5)


def covered(y: Column, q: Sequence[Column], level: int = 80) -> Column:
    i, j = BOUNDS[level]
    return (y >= q[i]) & (y <= q[j])


def abs_err(y: Column, median: Column) -> Column:
    return F.abs(y - median)


def ape(y: Column, median: Column, scale: float = 100.0) -> Column:
    """Absolute error in percent of |y|, null at y = 0."""
    return F.lit(scale) * F.abs(y - median) / F.nullif(F.abs(y), F.lit(0.0))


def direction_hit(origin: Column, y: Column, median: Column) -> Column:
    return (y > origin) == (median > origin)


def direction3_hit(origin: Column, y: Column, median: Column, band: float = 0.05) -> Column:
    from .labels import direction_class

    return direction_class(y, origin, band) == direction_class(median, origin, band)


def tolerance_hit(y: Column, median: Column, tol: float = 0.10) -> Column:
    return F.abs(median - y) <= F.lit(tol) * F.abs(y)


def confusion(event: Column, alarm: Column) -> dict[str, Column]:
    """Four aggregates tp, fp, fn, tn."""
    return {
        "tp": F.count_if(event & alarm),
        "fp": F.count_if(~event & alarm),
        "fn": F.count_if(event & ~alarm),
        "tn": F.count_if(~event & ~alarm),
    }


def confusion_rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    def over(a, b):
        return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))

    return {
        "thr_hit_rate": over(tp, tp + fn),
        "thr_false_alarm": over(fp, fp + tn),
        "thr_accuracy": (tp + tn).cast("double") / F.greatest(tp + fp + fn + tn, F.lit(1)),
    }


def prob_ge(q: Sequence[Column], thr: Column, cap: float = 0.05, ties: str = "first") -> Column:
    """P(value >= thr) by linear interpolation between deciles, held inside [cap, 1-cap] at the ends.

    With tied deciles two readings exist. ``ties="first"`` takes the first interval holding ``thr`` and answers
    1-cap when thr equals the lowest decile; ``ties="last"`` counts the deciles <= thr and starts from the last of them.
    """
    lo, hi = F.lit(cap), F.lit(1 - cap)

    def inside(i: int) -> Column:
        width = q[i + 1] - q[i]
        frac = F.when(width > 0, (thr - q[i]) / width).otherwise(0.0)
        return F.lit(1.0) - (F.lit(LEVELS[i]) + frac * F.lit(LEVELS[i + 1] - LEVELS[i]))

    if ties == "first":
        c = F.when(thr <= q[0], hi).when(thr >= q[8], lo)
        for i in range(8):
            c = c.when((q[i] <= thr) & (thr <= q[i + 1]), inside(i))
        return c.when(thr.isNotNull() & q[0].isNotNull(), F.lit(0.5))
    if ties != "last":
        raise ValueError("ties must be 'first' or 'last'")
    n = reduce(add, [(x <= thr).cast("int") for x in q])
    c = F.when(n == 0, hi).when(n == 9, lo)
    for i in range(8):
        c = c.when(n == i + 1, inside(i))
    return c


def path_probability(p_by_h: Column, above_now: Column) -> Column:
    """Struct (event, p, p_indep) for 'crosses the threshold within the horizon' from an array of weekly P(>= thr).

    p takes the errors of all weeks as moving together, p_indep as independent. When the last observation is already
    at the threshold the event is a drop below it.
    """
    comp = F.aggregate(p_by_h, F.lit(1.0), lambda a, x: a * (F.lit(1.0) - x))
    prod = F.aggregate(p_by_h, F.lit(1.0), lambda a, x: a * x)
    return F.when(
        above_now,
        F.struct(F.lit("drop").alias("event"), (1 - F.array_min(p_by_h)).alias("p"), (1 - prod).alias("p_indep")),
    ).otherwise(
        F.struct(F.lit("exceed").alias("event"), F.array_max(p_by_h).alias("p"), (1 - comp).alias("p_indep"))
    )


def deciles_from_intervals(median: Column, lower: dict[int, Column], upper: dict[int, Column]) -> Column:
    """80/60/40/20 % bounds of another model -> nine sorted deciles, none below 0."""
    parts: list[Column] = [None] * 9
    parts[4] = median
    for level, (i, j) in BOUNDS.items():
        parts[i], parts[j] = lower[level], upper[level]
    arr = F.array_sort(F.array(*[p.cast("double") for p in parts]))
    return F.transform(arr, lambda x: F.greatest(x, F.lit(0.0)))


def slope_pct(last: Column, medians: Sequence[Column]) -> Column:
    """Average weekly % change: least-squares slope of log values on steps 0..H."""
    v = [last.cast("double"), *[m.cast("double") for m in medians]]
    n = len(v)
    floor = F.greatest(F.greatest(*v) * 1e-3, F.lit(1e-9))
    mid = (n - 1) / 2
    ss = sum((i - mid) ** 2 for i in range(n))
    b = reduce(add, [F.lit((i - mid) / ss) * F.log(F.greatest(x, floor)) for i, x in enumerate(v)])
    return F.lit(100.0) * (F.exp(b) - 1)


def path_shape(last: Column, medians: Sequence[Column], flat: float = 2.0, fast: float = 5.0, turn: float = 5.0) -> Column:
    """peak, trough, up, slow_up, flat, slow_down or down for a forecast path of medians."""
    arr = F.array(*[m.cast("double") for m in medians])
    end = medians[-1]
    top, low = F.array_max(arr), F.array_min(arr)
    itop, ilow = F.array_position(arr, top) - 1, F.array_position(arr, low) - 1
    s = slope_pct(last, medians)
    interior = len(medians) - 1
    return (
        F.when((itop > 0) & (itop < interior) & (top >= F.greatest(last, end) * (1 + turn / 100)), "peak")
        .when((ilow > 0) & (ilow < interior) & (low <= F.least(last, end) * (1 - turn / 100)), "trough")
        .when(s >= fast, "up")
        .when(s >= flat, "slow_up")
        .when(s > -flat, "flat")
        .when(s > -fast, "slow_down")
        .otherwise("down")
    )
