"""Digamma and trigamma as Column expressions, normal and Beta quantiles."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arguments are shifted up by this much before the asymptotic series is used.
SHIFT = 8


def _total(terms) -> Column:
    return reduce(Column.__add__, terms)


def digamma(x: Column) -> Column:
    """Logarithmic derivative of the gamma function for x > 0; null elsewhere. Error below 1e-11."""
    x = F.when(x > 0, x.cast("double"))
    y = x + SHIFT
    z = 1 / (y * y)
    series = F.ln(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    return series - _total(1 / (x + k) for k in range(SHIFT))


def trigamma(x: Column) -> Column:
    """Derivative of digamma for x > 0; null elsewhere."""
    x = F.when(x > 0, x.cast("double"))
    y = x + SHIFT
    z = 1 / (y * y)
    series = 1 / y + z / 2 + z / y * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30)))
    return series + _total(1 / ((x + k) * (x + k)) for k in range(SHIFT))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _log_beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function by Lentz's method, vectorised."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, steps):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(abs(c) < tiny, tiny, c)
            out = out * d * c
        if np.all(abs(d * c - 1) < 1e-15):
            break
    return out


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    from math import lgamma

    lg = np.vectorize(lgamma, otypes=[float])
    x = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    direct = front * _log_beta_fraction(np.where(low, a, 1.0), np.where(low, b, 1.0), np.where(low, x, 0.5)) / np.where(low, a, 1.0)
    mirror = 1 - front * _log_beta_fraction(np.where(low, 1.0, b), np.where(low, 1.0, a), np.where(low, 0.5, 1 - x)) / np.where(low, 1.0, b)
    return np.where(low, direct, mirror)


def beta_quantile_values(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Quantile by bisection."""
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        mid = (low + high) / 2
        under = beta_cdf(a, b, mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def beta_quantile(a: Column, b: Column, p: float) -> Column:
    """Quantile of Beta(a, b) at p, by a vectorised pandas function; null arguments give null."""

    @F.pandas_udf("double")
    def quantile(x: pd.Series, y: pd.Series) -> pd.Series:
        ok = x.notna() & y.notna() & (x > 0) & (y > 0)
        out = pd.Series(np.nan, index=x.index)
        if ok.any():
            out[ok] = beta_quantile_values(x[ok].to_numpy(float), y[ok].to_numpy(float), p)
        return out.where(ok, None)

    return quantile(a.cast("double"), b.cast("double"))
