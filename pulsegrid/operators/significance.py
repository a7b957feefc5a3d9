"""p-value of the linear trend."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: np.ndarray, b: float, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Continued fraction of the regularised incomplete beta function (modified Lentz)."""
    tiny = 1e-300

    def away_from_zero(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(x)
    d = 1.0 / away_from_zero(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, rounds + 1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / away_from_zero(1.0 + even * d)
        c = away_from_zero(1.0 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / away_from_zero(1.0 + odd * d)
        c = away_from_zero(1.0 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def student_t_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(|T| > t) for ``dof`` degrees of freedom: I_x(dof/2, 1/2) with x = dof / (dof + t^2)."""
    from math import lgamma

    a, b = dof / 2.0, 0.5
    x = dof / (dof + t * t)
    lg = np.array([lgamma(v + b) - lgamma(v) - lgamma(b) for v in a])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lg + a * np.log(x) + b * np.log1p(-x))
        direct = front * _beta_fraction(a, b, x) / a
        # Symmetric form, which converges where x is large.
        mirrored = 1.0 - front * _beta_fraction_b(a, b, 1.0 - x) / b
    p = np.where(x < (a + 1.0) / (a + b + 2.0), direct, mirrored)
    return np.where(x >= 1.0, 1.0, np.clip(p, 0.0, 1.0))


def _beta_fraction_b(a: np.ndarray, b: float, y: np.ndarray) -> np.ndarray:
    return _beta_fraction(np.full_like(y, b), a, y)


@F.pandas_udf(T.DoubleType())
def slope_p_value(n: pd.Series, r2: pd.Series) -> pd.Series:
    """Two-sided p-value of the slope from the sample size and r2; null below 3 rows."""
    count, r = n.to_numpy(dtype="float64"), r2.to_numpy(dtype="float64")
    dof = np.maximum(count - 2, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.sqrt(np.where(r >= 1, np.inf, r * dof / (1 - r)))
    p = np.where(np.isinf(t), 0.0, student_t_two_sided(np.where(np.isinf(t), 0.0, t), dof))
    return pd.Series(np.where(count >= 3, p, np.nan))


def with_p_value(trend: DataFrame) -> DataFrame:
    """Add ``p_value`` to trend rows (one per series)."""
    return trend.withColumn("p_value", slope_p_value(F.col("n"), F.col("r2")))
