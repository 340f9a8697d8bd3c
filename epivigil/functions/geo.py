"""Planar coordinates and counts with a negative-binomial spread."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Centre of the plane and km per degree.
LAT0, LON0 = 23.0, 120.5
KM_PER_LAT = 111.0
KM_PER_LON = 111.32


def to_km(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in km from the centre point."""
    k = F.lit(KM_PER_LON) * F.cos(F.radians(F.lit(LAT0)))
    return (lon - LON0) * k, (lat - LAT0) * KM_PER_LAT


def nb_tail(mu: Column, k: int, phi: float = 2.0) -> Column:
    """P(N >= k) for a negative binomial with mean mu and variance mu + mu^2/phi."""
    p = F.lit(phi) / (F.lit(phi) + F.greatest(mu, F.lit(1e-12)))
    below = F.lit(0.0)
    for j in range(k):
        comb = math.exp(math.lgamma(j + phi) - math.lgamma(phi) - math.lgamma(j + 1))
        below = below + F.lit(comb) * F.pow(p, F.lit(phi)) * F.pow(1 - p, F.lit(float(j)))
    return F.lit(1.0) - below


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_cdf(a: float, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, in log space, for x in (0, 1)."""
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    front = np.exp(_lgamma(a + b) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    c, d = np.ones_like(y), 1 / (1 - (p + q) * y / (p + 1))
    h, live = d.copy(), np.ones(len(y), bool)
    m = 0
    while live.any():
        m += 1
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h = np.where(live, h * d * c, h)
        live &= np.abs(d * c - 1) > 1e-15
        if m > 100_000:
            break
    return np.where(flip, 1 - front * h, front * h)


def _nb_cdf(k: np.ndarray, p: np.ndarray, phi: float) -> np.ndarray:
    """P(N <= k), by the sum of a few binomial terms where phi is a small integer."""
    if phi == int(phi) and phi <= 32:
        n = k + phi
        below = np.zeros_like(p)
        for j in range(int(phi)):
            below += np.exp(_lgamma(n + 1) - math.lgamma(j + 1) - _lgamma(n - j + 1) + j * np.log(p) + (n - j) * np.log1p(-p))
        return 1 - below
    return _beta_cdf(phi, k + 1.0, p)


def _nb_quantiles(mu: np.ndarray, phi: float, levels: np.ndarray) -> np.ndarray:
    """Smallest k with CDF(k) >= level: an upper bound by doubling from the mean, then halving. Infinite means give infinity."""
    mu = np.where(np.isnan(mu), 0.0, np.maximum(mu, 0.0))
    out = np.zeros((len(mu), len(levels)))
    out[np.isinf(mu)] = np.inf
    rows = np.flatnonzero((mu > 1e-9) & np.isfinite(mu))
    if not len(rows):
        return out
    m, want = np.repeat(mu[rows], len(levels)), np.tile(levels, len(rows))
    p = phi / (phi + m)
    low, high = np.full(len(m), -1.0), np.ceil(m)
    while (short := _nb_cdf(high, p, phi) < want - 1e-13).any():
        low = np.where(short, high, low)
        high = np.where(short, 2 * high + 1, high)
    while (open_ := high - low > np.maximum(1.0, high * 1e-15)).any():
        mid = np.floor((low + high) / 2)
        enough = _nb_cdf(np.maximum(mid, 0), p, phi) >= want - 1e-13
        high, low = np.where(open_ & enough, mid, high), np.where(open_ & ~enough, mid, low)
    out[rows] = high.reshape(len(rows), len(levels))
    return out


def nb_deciles(mu: Column, phi: float = 2.0) -> Column:
    """Nine deciles of the negative binomial as array<double>; all 0 for mu <= 1e-9. Arrow batches, small per-row state."""
    levels = np.arange(1, 10) / 10

    @F.pandas_udf("array<double>")
    def run(m: pd.Series) -> pd.Series:
        q = _nb_quantiles(m.to_numpy(dtype=float), phi, levels)
        return pd.Series(list(q))

    return run(mu.cast("double"))
