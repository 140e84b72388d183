"""Component analysis of the signal: shared PCA scores and artifact removal."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import linalg as la
from .series import zscored
from .spectral import fir, matrix_applied
from .stats import lagged_stats, map_rows, sum_vectors, total_stats, trial_stats


def _pooled(df: DataFrame, x: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, covariance and covariance of the first difference, pooled over all rows.

    One p x p result reaches the driver, however many rows there are.
    """
    pair = df.select("trial", "t", F.col(x).alias("x"), F.col(x).alias("y"))
    s = total_stats(lagged_stats(pair, ["trial"], "x", "y", [0], [1])).select("s", F.size("s").alias("n")).head()
    vec = np.asarray(s["s"])
    p = int((-2 + np.sqrt(4 + 12 * (len(vec) - 1))) / 6 + 0.5)
    _, mx, _, cxx, cyy, cxy = la.covariances(vec, p, p)
    return mx, cxx, cxx + cyy - cxy - cxy.T


def principal_scores(df: DataFrame, x: str, k: int, out: str = "scores") -> DataFrame:
    """Scores on the first ``k`` shared components of all frames (standardised columns, centred)."""
    mx, cxx, _ = _pooled(df, x)
    sd = np.sqrt(np.maximum(np.diag(cxx), 1e-30))
    _, v = la.spectrum(cxx / np.outer(sd, sd))
    load = v[:, :k] * np.sign(v[np.abs(v[:, :k]).argmax(0), range(k)])
    m = load / sd[:, None]
    scored = matrix_applied(df, x, m, out)
    shift = F.array(*[F.lit(float(c)) for c in mx @ m])
    return scored.withColumn(out, F.zip_with(out, shift, lambda a, b: a - b))


def visual_embedding(df: DataFrame, x: str, columns: list[int], k: int, taps: np.ndarray) -> DataFrame:
    """Chosen columns plus shared component scores, band-passed and z-scored per trial.

    Missing values become 0.  Result: ``(trial, t, feature, z)``.
    """
    scored = principal_scores(df.select("trial", "t", x), x, k)
    chosen = F.array(*[F.coalesce(F.nanvl(F.get(x, F.lit(c)), F.lit(0.0)), F.lit(0.0)) for c in columns])
    both = scored.select("trial", "t", F.concat(chosen, F.col("scores")).alias("x"))
    smooth = fir(both, ["trial"], "x", taps)
    long = smooth.select("trial", "t", F.posexplode("x").alias("feature", "v"))
    return zscored(long, ["trial", "feature"], "v").select("trial", "t", "feature", F.coalesce(F.nanvl("z", F.lit(0.0)), F.lit(0.0)).alias("z"))


def _tanh_sums(df: DataFrame, x: str, mx: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``E[g(y) y']`` and ``E[g'(y)]`` of ``y = (x - mx) m`` in one pass of partial sums."""
    k = m.shape[1]

    def task(batches):
        import pandas as pd

        for pdf in batches:
            y = (np.stack(pdf[x].to_list()) - mx) @ m
            g = np.tanh(y)
            vec = np.concatenate([[len(y)], (g.T @ y).ravel(), (1 - g**2).sum(0)])
            yield pd.DataFrame({"v": [vec]})

    s = np.asarray(sum_vectors(df.select(x).mapInPandas(task, "v array<double>"), [], "v").head()["s"])
    return s[1 : 1 + k * k].reshape(k, k) / s[0], s[1 + k * k :] / s[0]


def unmixing(df: DataFrame, x: str, k: int, rounds: int = 30, tol: float = 1e-5):
    """Symmetric FastICA: ``(mean, unmixing p x k, covariance, difference covariance)``.

    Each round is one distributed aggregate of k * k numbers; the data never moves.
    """
    mx, cxx, diff = _pooled(df, x)
    white = la.whitener(la.spectrum(cxx), k, 0.0, 1e-8)
    k = white.shape[1]
    b = np.linalg.qr(np.random.default_rng(7).standard_normal((k, k)))[0]
    for _ in range(rounds):
        gy, gp = _tanh_sums(df, x, mx, white @ b)
        # E[g(y) z'] with z = y b', then the Newton step and symmetric decorrelation
        new = (gy @ b.T - gp[:, None] * b.T).T
        u, _, vt = np.linalg.svd(new)
        new = u @ vt
        done = np.max(np.abs(np.abs((new * b).sum(0)) - 1.0))
        b = new
        if done < tol:
            break
    return mx, white @ b, cxx, diff


def without_artifacts(
    df: DataFrame, x: str, proxies: list[int], k: int, z_limit: float = 3.0, hf_limit: float = 3.0, rounds: int = 30
) -> tuple[DataFrame, list[dict]]:
    """Rebuild the signal without components that follow a proxy channel or are mostly fast.

    A component is flagged when its absolute correlation with a proxy has a robust z above
    ``z_limit``, or when the ratio of difference variance to variance has one above ``hf_limit``.
    Returns the cleaned rows and a ledger with one entry per component.
    """
    mx, m, cxx, diff = unmixing(df, x, k, rounds)
    var = np.einsum("ik,ij,jk->k", m, cxx, m)
    rough = np.einsum("ik,ij,jk->k", m, diff, m) / var

    def robust(v: np.ndarray) -> np.ndarray:
        mad = np.median(np.abs(v - np.median(v)))
        return 0.6745 * (v - np.median(v)) / max(mad, 2.220446049250313e-16)

    best = np.zeros(m.shape[1])
    flagged = robust(rough) > hf_limit
    for c in proxies:
        r = np.abs((cxx @ m)[c]) / np.sqrt(var * cxx[c, c])
        best = np.maximum(best, r)
        flagged |= robust(r) > z_limit
    back = np.linalg.pinv(m)
    keep = np.eye(len(cxx)) - m[:, flagged] @ back[flagged]
    cleaned = matrix_applied(df, x, keep)
    offset = F.array(*[F.lit(float(v)) for v in mx - mx @ keep])
    cleaned = cleaned.withColumn(x, F.zip_with(x, offset, lambda a, b: a + b))
    ledger = [
        {"component": i, "proxy_corr": float(best[i]), "roughness": float(rough[i]), "removed": bool(flagged[i])}
        for i in range(m.shape[1])
    ]
    return cleaned, ledger
