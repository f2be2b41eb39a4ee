"""P-values without SciPy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _continued_fraction(a: float, b: float, x: float) -> float:
    """Lentz's method for the incomplete beta function's continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _continued_fraction(a, b, x) / a
    return 1 - front * _continued_fraction(b, a, 1 - x) / b


def p_of_correlation(r: float, n: float) -> float:
    """Two-sided p of a correlation of n pairs, by Student's t with n - 2 degrees of freedom."""
    if r is None or math.isnan(r) or n < 3:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    freedom = n - 2
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + r * r * freedom / (1 - r * r)))


def correlation_p(r: str, n: str):
    """Column form; null where the correlation is null or there are fewer than three pairs. One value per group."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if math.isnan(v := p_of_correlation(float(a) if a is not None else math.nan, b)) else v for a, b in zip(r, n, strict=True)], dtype="float64")

    return F.nanvl(p(r, n), F.lit(None).cast("double"))


def mid_rank(x: np.ndarray) -> np.ndarray:
    """Average ranks from 1 along the last axis."""
    values, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    return (ends - (counts - 1) / 2)[inverse]


def correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson correlation of ``x`` with every row of ``y``."""
    a, b = x - x.mean(), y - y.mean(-1, keepdims=True)
    return b @ a / np.sqrt((a @ a) * np.square(b).sum(-1))
