"""Alarms carried between micro-batches: CUSUM with reset and the trough/peak period, one state per series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.period import WAVE_SCHEMA, Wave


def _series_batches(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = [p for p in pdfs if len(p)]
    return pd.concat(parts).sort_values("day") if parts else pd.DataFrame(columns=["day", "value"])


class Cusum:
    """Running CUSUM of one series that can go back ``replay`` days: the last values, and the sum after each of them."""

    def __init__(self, k: float, h: float, baseline: int, min_sd: float, gap: int, replay: int):
        self.k, self.h, self.baseline, self.min_sd, self.keep, self.replay = k, h, baseline, min_sd, baseline + gap, replay
        self.first = self.last = None
        self.x: list[float] = []
        self.s: list[float] = []
        self.version = 0

    def _sum(self, day: int) -> float:
        """The sum after ``day`` from the one before it."""
        low = self.last - len(self.x) + 1
        i = day - low
        before = self.s[i - 1] if i else 0.0
        before = 0.0 if before > self.h else before
        if day - self.first < self.keep:
            return before
        b = np.array(self.x[i - self.keep : i - self.keep + self.baseline])
        return float(max(0.0, before + (self.x[i] - b.mean()) / max(b.std(), self.min_sd) - self.k))

    def add(self, day: int, value: float) -> list[tuple[int, float, float | None]]:
        """Days whose sum is new or changed, as (day, value, sum). A day too old to go back to gives itself without a sum."""
        start = day
        if self.first is None:
            self.first, self.last, self.x, self.s = day, day, [value], [0.0]
        elif day > self.last:
            start = self.last + 1
            for d in range(start, day + 1):
                self.last = d
                self.x.append(value if d == day else 0.0)
                self.s.append(0.0)
                self.s[-1] = self._sum(d)
        else:
            low = self.last - len(self.x) + 1
            if day < low and low == self.first:  # the series begins earlier than thought
                self.x = [value] + [0.0] * (self.first - day - 1) + self.x
                self.s = [0.0] * (self.first - day) + self.s
                self.first = day
            elif day < low or low > self.first and day - self.keep < low:
                return [(day, value, None)]
            else:
                self.x[day - low] = value
            low = self.last - len(self.x) + 1
            for d in range(day, self.last + 1):
                self.s[d - low] = self._sum(d)
        low = self.last - len(self.x) + 1
        out = [(d, self.x[d - low], self.s[d - low]) for d in range(start, self.last + 1)]
        kept = self.keep + self.replay + 1
        self.x, self.s = self.x[-kept:], self.s[-kept:]
        return out


def cusum_stream(daily: DataFrame, k: float = 0.5, h: float = 4.0, baseline: int = 56, min_sd: float = 0.5, gap: int = 7, replay: int = 120) -> DataFrame:
    """(series, day, value, s, alarm, version) from daily counts (series string, day date, value double), in any order.

    Days without a row count 0 until one comes. A day that comes late, or again with another value, takes the series back to that day:
    it and all days after it are given out anew with a higher ``version``; ``newest`` keeps the last word on each day. Days older than
    ``replay`` days (with the baseline in front of them) change no sum and are given out with a null ``s``, so none goes without trace.
    The state is bounded by these days, whatever the length of the stream. Equals the batch form on the same rows.
    """

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        pdf = _series_batches(pdfs)
        run = Cusum(k, h, baseline, min_sd, gap, replay)
        if state.exists:
            run.first, run.last, run.x, run.s, run.version = state.get[0], state.get[1], list(state.get[2]), list(state.get[3]), state.get[4]
        rows = []
        for day, value in zip(pd.to_datetime(pdf["day"]), pdf["value"]):
            run.version += 1
            for d, x, s in run.add(int(day.value // 86_400_000_000_000), float(value)):
                rows.append((key[0], pd.Timestamp(d, unit="D"), x, s, None if s is None else s > h, run.version))
        state.update((run.first, run.last, run.x, run.s, run.version))
        if rows:
            out = pd.DataFrame(rows, columns=["series", "day", "value", "s", "alarm", "version"])
            out["day"] = out["day"].dt.date
            yield out

    return daily.select("series", "day", F.col("value").cast("double").alias("value")).groupBy("series").applyInPandasWithState(
        step, "series string, day date, value double, s double, alarm boolean, version long",
        "first long, last long, x array<double>, s array<double>, version long", "append", GroupStateTimeout.NoTimeout,
    )


def newest(rows: DataFrame, keys: tuple[str, ...] = ("series", "day")) -> DataFrame:
    """The row of the highest version with a sum for each series and day."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.where("s is not null").groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_r"))
    return last.select(*keys, "_r.*")


def wave_stream(weekly: DataFrame, **rule) -> DataFrame:
    """Trough/peak flags from a stream of (series string, day date, value double); weeks must arrive in order per series."""
    names = [c.split()[0] for c in WAVE_SCHEMA.split(", ")]

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        pdf = _series_batches(pdfs)
        wave = Wave(**rule)
        if state.exists:
            wave.restore(state.get)
        rows = [(key[0], d, float(v), *wave.step(float(v))) for d, v in zip(pdf["day"], pdf["value"])]
        state.update(wave.state())
        if rows:
            yield pd.DataFrame(rows, columns=["series", "day", "value", *names])

    return weekly.select("series", "day", F.col("value").cast("double").alias("value")).groupBy("series").applyInPandasWithState(
        step, "series string, day date, value double, " + WAVE_SCHEMA,
        "inside boolean, low double, high double, rises int, falls int, prev double", "append", GroupStateTimeout.NoTimeout,
    )
