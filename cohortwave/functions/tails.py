"""Tail probabilities of the normal, t and F distributions in numpy, as vectorised columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LGAMMA = np.vectorize(math.lgamma, otypes=[float])
ERFC = np.vectorize(math.erfc, otypes=[float])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b) by its continued fraction (modified Lentz)."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    x = np.clip(x, 0, 1)
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(z), 1 / guard(1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, rounds):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / guard(1 + num * d), guard(1 + num / c)
            h = h * d * c
        if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-14:
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(LGAMMA(p + q) - LGAMMA(p) - LGAMMA(q) + p * np.log(z) + q * np.log1p(-z)) / p
    value = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(swap, 1 - value, value)


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """P(F > f)."""
    f = np.maximum(np.asarray(f, float), 0)
    return incomplete_beta(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * f))


def f_quantile(p: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """The value that F stays below with probability p, by bisection on its beta form."""
    p, d1, d2 = (np.asarray(v, float) for v in np.broadcast_arrays(p, d1, d2))
    lo, hi = np.zeros_like(p), np.ones_like(p)
    for _ in range(100):
        mid = (lo + hi) / 2
        below = incomplete_beta(d1 / 2, d2 / 2, mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    x = (lo + hi) / 2
    return d2 * x / (d1 * np.maximum(1 - x, 1e-300))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return ERFC(np.abs(np.asarray(z, float)) / math.sqrt(2))


def _column(compute, *columns: Column) -> Column:
    """NULL in, NULL out."""

    @F.pandas_udf("double")
    def run(*parts: pd.Series) -> pd.Series:
        values = [p.to_numpy(float, na_value=np.nan) for p in parts]
        good = np.all([np.isfinite(v) for v in values], axis=0)
        out = np.full(len(good), np.nan)
        if good.any():
            out[good] = compute(*[v[good] for v in values])
        return pd.Series(out).astype("Float64").mask(~good)

    return run(*[c.cast("double") for c in columns])


def t_p_value(t: Column, df: Column) -> Column:
    return _column(t_two_sided, t, df)


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_upper, f, d1, d2)


def f_quantile_column(p: Column, d1: Column, d2: Column) -> Column:
    return _column(f_quantile, p, d1, d2)


def normal_p_value(z: Column) -> Column:
    return _column(normal_two_sided, z)
