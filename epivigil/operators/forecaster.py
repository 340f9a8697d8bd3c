"""Contexts handed to a user's forecaster, and the run of configured backtests.

A forecaster is ``fn(contexts, horizon, extras) -> (n, horizon, 9)`` deciles for a list of 1-D (or joint 2-D) arrays.
It runs inside ``mapInPandas`` on Arrow batches, one row per context, so memory is bounded by the batch size. A series is shuffled as one
row, whatever the number of its origins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import QCOLS
from . import baselines as bl
from .covariates import past_only

Forecaster = Callable[[list, int, dict], np.ndarray]


@dataclass(frozen=True)
class Config:
    """One backtest run. ``window`` None = expanding."""

    name: str
    model: str = "naive"
    target: str = "value"
    targets: tuple[str, ...] = ()
    window: int | None = None
    log1p: bool = False
    covariates: tuple[str, ...] = ()
    past_covariates: tuple[str, ...] = ()
    past_lag: int = 1
    start: str | None = None
    end: str | None = None
    warmup: int = 104
    horizon: int = 4
    origin_start: str | None = None

    def __post_init__(self):
        if self.targets and self.targets[0] != self.target:
            raise ValueError("target must be the first of targets")


def suite(name: str, target: str, horizon: int = 4) -> list[Config]:
    """Named grids: baselines, windows, covariates, transforms."""
    base = Config("", target=target, horizon=horizon)
    grids = {
        "baselines": [replace(base, name=m, model=m) for m in ("snaive", "naive", "ma3")],
        "windows": [replace(base, name=f"naive_{w or 'all'}", window=w) for w in (None, 104, 156, 260)],
        "covariates": [
            replace(base, name="_".join(("user", *k)), model="user", covariates=k)
            for k in ((), ("season",), ("cny",), ("cny", "holiday"), ("season", "cny", "holiday"))
        ],
        "transforms": [replace(base, name=f"user_log{int(b)}", model="user", log1p=b) for b in (False, True)],
    }
    if name not in grids:
        raise ValueError(f"unknown suite {name}; known: {sorted(grids)}")
    return grids[name]


OUT_VALUES = 1 << 20  # values of contexts in a batch


def _steps(df: DataFrame, by: Sequence[str], idx: str, values: Sequence[str], keep: Column | None, series: str | None = None) -> DataFrame:
    """One row for each group: its steps in order as arrays _i, _ok, _v0, _v1, ... (and _s, the series). Linear in the steps."""
    d = df.withColumn("_ok", F.lit(True) if keep is None else F.coalesce(keep, F.lit(False)))
    parts = {**({"_s": F.col(series).cast("string")} if series else {}), "_i": F.col(idx), "_ok": F.col("_ok"), **{f"_v{j}": F.col(c).cast("double") for j, c in enumerate(values)}}
    g = d.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*[c.alias(n) for n, c in parts.items()]))).alias("_steps"))
    return g.select(*by, *[F.col(f"_steps.{n}").alias(n) for n in parts])


class _Values:
    """Values of one column of a series, of which some may be null: the known ones, and how many of them stand before each step."""

    def __init__(self, values: pa.Array):
        known = pc.is_valid(values).to_numpy(zero_copy_only=False)
        self.known = pc.drop_null(values).to_numpy(zero_copy_only=False)
        self.before = np.concatenate([[0], np.cumsum(known)])

    def between(self, a: int, b: int) -> np.ndarray:
        """Known values of the steps a .. b - 1: a view, no copy."""
        return self.known[self.before[max(a, 0)] : self.before[min(max(b, 0), len(self.before) - 1)]]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0)))


def _groups(n: list[int]) -> list[tuple[int, int]]:
    """Runs of rows of at most about ``OUT_VALUES`` values."""
    out, a, total = [], 0, 0
    for i, size in enumerate(n):
        if i > a and total + size > OUT_VALUES:
            out.append((a, i))
            a, total = i, 0
        total += size
    return [*out, (a, len(n))] if len(n) > a else out


def contexts(
    df: DataFrame, by: Sequence[str], idx: str, value: str, warmup: int, horizon: int, window: int | None = None,
    keep: Column | None = None, with_truth: bool = True, past: Sequence[str] = (),
) -> DataFrame:
    """(by, origin, context array, truth array): the values before and after each origin.

    A series is shuffled once, as one row; its contexts are cut out of it in the tasks that use them. Columns named in ``past`` come
    along as arrays over the same steps (past_<name>).
    """
    wide = _steps(df, by, idx, [value, *past], keep)
    names = [*by, "origin", "context", "truth", *[f"past_{c}" for c in past]]
    kinds = [df.schema[c].dataType.simpleString() for c in (*by, idx)] + ["array<double>"] * (2 + len(past))
    heads = len(by)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                steps, ok = b.column(heads)[row].values, b.column(heads + 1)[row].values.to_numpy(zero_copy_only=False)
                cols = [_Values(b.column(heads + 2 + j)[row].values) for j in range(1 + len(past))]
                n = len(steps)
                at = [p for p in range(max(warmup, 1) - 1, n) if ok[p] and (not with_truth or len(cols[0].between(p + 1, p + 1 + horizon)) == horizon)]
                low = [0 if window is None else p - window + 1 for p in at]
                for x, y in _groups([p + 1 - max(a, 0) for p, a in zip(at, low)]):
                    spans = list(zip(low[x:y], at[x:y]))
                    found = [[c.between(a, p + 1) for a, p in spans] for c in cols]
                    truth = [cols[0].between(p + 1, p + 1 + horizon) for _, p in spans]
                    keys = [pa.repeat(b.column(k)[row], y - x) for k in range(heads)]
                    yield pa.RecordBatch.from_arrays([*keys, steps.take(pa.array(at[x:y])), _lists(found[0]), _lists(truth), *map(_lists, found[1:])], names=names)

    return wide.mapInArrow(cut, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def joint_contexts(
    long: DataFrame, series: str, by: Sequence[str], idx: str, value: str, order: Sequence[str], warmup: int, horizon: int, window: int | None = None,
    keep: Column | None = None, with_truth: bool = True,
) -> DataFrame:
    """Contexts of several series side by side per origin: ``context`` becomes array<array<double>> in ``order``.

    Only origins where every series is present stay. The series of a group are shuffled once, as one row.
    """
    wide = _steps(long.where(F.col(series).isin(list(order))), by, idx, [value], keep, series)
    names = [*by, "origin", "names", "context", "truth"]
    kinds = [long.schema[c].dataType.simpleString() for c in (*by, idx)] + ["array<string>", "array<array<double>>", "array<array<double>>"]
    heads = len(by)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                of, steps, ok, values = (b.column(heads + j)[row].values for j in range(4))
                parts = {}
                for name in order:
                    mine = pc.equal(of, name)
                    parts[name] = steps.filter(mine), ok.filter(mine).to_numpy(zero_copy_only=False), _Values(values.filter(mine))
                spans: dict = {}
                for i, (s, good, v) in enumerate(parts.values()):
                    here = {}
                    for p, step in enumerate(s.to_pylist()):
                        if p + 1 >= warmup and good[p] and (not with_truth or len(v.between(p + 1, p + 1 + horizon)) == horizon) and (i == 0 or step in spans):
                            here[step] = [*spans.get(step, []), (v.between(0 if window is None else p - window + 1, p + 1), v.between(p + 1, p + 1 + horizon))]
                    spans = here
                at = list(spans)
                for x, y in _groups([sum(len(c) for c, _ in spans[o]) for o in at]):
                    pairs = [spans[o] for o in at[x:y]]
                    nested = lambda k: pa.ListArray.from_arrays(pa.array(np.arange(len(pairs) + 1, dtype=np.int32) * len(order)), _lists([q[k] for p in pairs for q in p]))  # noqa: B023, E731
                    keys = [pa.repeat(b.column(k)[row], y - x) for k in range(heads)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(at[x:y], steps.type), pa.array([list(order)] * (y - x), pa.list_(pa.string())), nested(0), nested(1)], names=names)

    return wide.mapInArrow(cut, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def _finish(q: np.ndarray, log1p: bool, positive: bool) -> np.ndarray:
    q = np.asarray(q, dtype=float)
    if log1p:
        q = np.expm1(q)
    q = np.sort(q, axis=-1)
    return np.maximum(q, 0.0) if positive else q


def run_forecaster(
    ctx: DataFrame, forecaster: Forecaster, keys: Sequence[str], horizon: int, hs: Sequence[int] | None = None,
    log1p: bool = False, positive: bool = True, extras: Sequence[str] = (), batch: int = 256,
) -> DataFrame:
    """Deciles by (keys, origin, h) from context rows (array<double>). Joint rows (array of arrays) add ``series``."""
    hs = list(hs) if hs else list(range(1, horizon + 1))
    joint = dict(ctx.dtypes)["context"] == "array<array<double>>"
    fields = {f.name: f.dataType.simpleString() for f in ctx.schema}
    names = [*keys, "origin"] + (["series"] if joint else [])
    types = [fields[k] for k in keys] + [fields["origin"]] + (["string"] if joint else [])
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types)) + ", h int, y double, median double, " + ", ".join(f"{c} double" for c in QCOLS)

    def one_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        cs = [np.stack(list(c)).astype(float) if joint else np.asarray(c, dtype=float) for c in pdf["context"]]
        if log1p:
            cs = [np.log1p(np.maximum(c, 0.0)) for c in cs]
        q = _finish(forecaster(cs, horizon, {e: list(pdf[e]) for e in extras}), log1p, positive)
        out = []
        for pos in range(len(pdf)):
            head = [pdf[k].iloc[pos] for k in keys] + [pdf["origin"].iloc[pos]]
            tr = pdf["truth"].iloc[pos]
            rows = [(s, tr[i], q[pos][i]) for i, s in enumerate(pdf["names"].iloc[pos])] if joint else [(None, tr, q[pos])]
            for s, t, qq in rows:
                for h in hs:
                    y = float(t[h - 1]) if len(t) >= h else None
                    out.append([*head, *([s] if joint else []), h, y, qq[h - 1][4], *qq[h - 1]])
        return pd.DataFrame(out, columns=[*names, "h", "y", "median", *QCOLS])

    def run(it):
        for pdf in it:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                if len(part):
                    yield one_batch(part)

    cols = [*keys, "origin", "context", "truth", *(["names"] if joint else []), *extras]
    return ctx.select(*cols).mapInPandas(run, schema)


def last_value_forecaster(cs: list, horizon: int, extras: dict) -> np.ndarray:
    """Default callable: last value with its empirical h-step changes, vectorised per context."""
    levels = np.arange(1, 10) / 10
    out = []
    for c in cs:
        a = np.atleast_2d(c)
        n = a.shape[1] - horizon
        e = np.stack([a[:, h : h + n] - a[:, :n] for h in range(1, horizon + 1)], axis=1)
        q = np.moveaxis(np.quantile(e, levels, axis=2), 0, -1)
        q = np.maximum(a[:, -1][:, None, None] + q - q[..., 4:5], 0.0)
        out.append(q if np.ndim(c) == 2 else q[0])
    return np.stack(out)


def run_config(cfg: Config, panel: DataFrame, by: Sequence[str], idx: str = "week_idx", forecaster: Forecaster | None = None,
               covariate_fn: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None, keep: Column | None = None) -> DataFrame:
    """One configuration over a panel DataFrame (any source): baselines by window plans, ``model='user'`` by the hook.

    Several ``targets`` (panel columns) go to the callable side by side. Past-only covariates are panel columns, lagged
    and filled, over the steps of the context. ``panel``: by, idx, value[, yw, week_start]. ``covariate_fn(panel, kinds)`` answers idx + one column per covariate;
    its rows up to the origin travel with the context.
    """
    from . import calendar as cal

    p = panel
    if cfg.start:
        p = p.where(F.col(idx) >= cal.index_of_yw(F.lit(cfg.start)))
    if cfg.end:
        p = p.where(F.col(idx) <= cal.index_of_yw(F.lit(cfg.end)))
    warmup = cfg.warmup
    if cfg.origin_start:
        first = F.col(idx) + 1 >= cal.index_of_yw(F.lit(cfg.origin_start))
        keep = first if keep is None else keep & first
    targets = list(cfg.targets or (cfg.target,))
    for t in targets:
        p = bl.require_complete(p, by, idx, t)
    if len(targets) > 1 and cfg.model != "user":
        raise ValueError("baselines take one target")
    if cfg.model != "user":
        out = bl.forecasts(p, by, idx, cfg.target, [cfg.model], cfg.horizon, window=cfg.window, warmup=warmup, keep=keep)
        return out.withColumn("config", F.lit(cfg.name))
    if forecaster is None:
        raise ValueError("model='user' needs a forecaster")
    extras: list[str] = [f"past_{c}" for c in cfg.past_covariates]
    kw = {"warmup": warmup, "horizon": cfg.horizon, "window": cfg.window, "keep": keep}
    if len(targets) > 1:
        if cfg.past_covariates:
            raise ValueError("past covariates go with one target")
        long = p.select(*by, idx, *[F.col(t).cast("double").alias(t) for t in targets]).unpivot([*by, idx], targets, "series", "value")
        ctx = joint_contexts(long, "series", by, idx, "value", targets, **kw)
    else:
        q = past_only(p, cfg.past_covariates, cfg.past_lag, idx, by) if cfg.past_covariates else p
        ctx = contexts(q, by, idx, cfg.target, past=cfg.past_covariates, **kw)
    if cfg.covariates:
        if covariate_fn is None:
            raise ValueError("covariates need a covariate_fn")
        cov = covariate_fn(panel, cfg.covariates)
        names = [c for c in cov.columns if c not in (idx, "yw", "week_start")]
        # the calendar is one row for each step: it travels as one row of arrays, of which each origin takes its steps
        rows = cov.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), *[F.col(c).cast("double").alias(c) for c in names]))).alias("_c"))
        lo = F.lit(1) if cfg.window is None else F.greatest(F.lit(1), F.col("_at") - (cfg.window - 1))
        each = rows.select("_c", F.posexplode("_c.i").alias("_at", "origin")).withColumn("_at", F.col("_at") + 1)
        near = F.slice("_c", lo, F.col("_at") - lo + 1 + cfg.horizon)
        cov = each.withColumn("_c", near).select("origin", *[F.filter(F.col(f"_c.{c}"), lambda v: v.isNotNull()).alias(f"cov_{c}") for c in names])
        ctx = ctx.join(cov, "origin")
        extras += [f"cov_{c}" for c in names]
    f = run_forecaster(ctx, forecaster, list(by), cfg.horizon, log1p=cfg.log1p, extras=extras)
    if len(targets) > 1:
        scale = bl.mase_scale(long, [*by, "series"], idx, "value").select(
            *by, "series", F.col(idx).alias("origin"), F.col("value").alias("y_origin"), "mase_scale"
        )
        out = f.join(scale, [*by, "series", "origin"]).withColumnRenamed("series", "target")
    else:
        scale = bl.mase_scale(p, by, idx, cfg.target).select(
            *by, F.col(idx).alias("origin"), F.col(cfg.target).cast("double").alias("y_origin"), "mase_scale"
        )
        out = f.join(scale, [*by, "origin"]).withColumn("target", F.lit(cfg.target))
    return out.withColumns({"config": F.lit(cfg.name), "model": F.lit(cfg.model)})
