"""Tail probabilities as column functions, on rows that aggregates have left over."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, element by element (continued fraction, on the side where it converges)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0.0, 1.0))
    turn = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1.0 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    inner = (z > 0) & (z < 1)
    zz = np.where(inner, z, 0.5)
    front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(zz) + q * np.log1p(-zz)) / p
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c = np.ones_like(zz)
    d = 1.0 / safe(1.0 - (p + q) * zz / (p + 1.0))
    h = d.copy()
    for m in range(1, 1000):
        for term in (
            m * (q - m) * zz / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * zz / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1.0 / safe(1.0 + term * d)
            c = safe(1.0 + term / c)
            h = h * d * c
        if (np.abs(d * c - 1.0) < 1e-15).all():
            break
    part = np.where(inner, front * h, np.where(z <= 0, 0.0, 1.0))
    return np.where(turn, 1.0 - part, part)


def student_two_sided(t: Column | str, dof: Column | str) -> Column:
    """Two-sided p-value of Student's t with (also fractional) degrees of freedom; null where either is unusable."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, dof: pd.Series) -> pd.Series:
        t, dof = t.to_numpy(dtype=float, na_value=np.nan), dof.to_numpy(dtype=float, na_value=np.nan)
        good = ~np.isnan(t) & (dof > 0)
        n, v = np.where(good, dof, 1.0), np.where(good, t, 0.0)
        p = np.where(np.isinf(v), 0.0, incomplete_beta(n / 2.0, np.full_like(n, 0.5), n / (n + np.where(np.isinf(v), 0.0, v) ** 2)))
        return pd.Series(np.where(good, p, np.nan)).astype("Float64").where(pd.Series(good))

    return tail(t, dof)


def spearman_two_sided(rho: Column | str, n: Column | str) -> Column:
    """Two-sided p-value of a rank correlation by Student's t with ``n - 2`` degrees of freedom; 0 for a perfect one."""
    rho, n = (F.col(c) if isinstance(c, str) else c for c in (rho, n))
    t = rho * F.sqrt((n - 2) / F.nullif(F.greatest(1 - rho * rho, F.lit(0.0)), F.lit(0.0)))
    return F.when(n < 3, F.lit(None)).when(F.abs(rho) >= 1, F.lit(0.0)).otherwise(student_two_sided(t, (n - 2).cast("double")))


def welch_dof(v1: Column, n1: Column, v0: Column, n0: Column) -> Column:
    """Degrees of freedom of Welch's t from sample variances and counts."""
    a, b = v1 / n1, v0 / n0
    return (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1))
