"""Dense algebra on aggregated statistics (p x p matrices), used inside Spark tasks.

A statistics vector is ``[n, sum x (p), sum y (q), sum xx' (p*p), sum yy' (q*q), sum xy' (p*q)]``.
"""

from __future__ import annotations

import math

import numpy as np


def gram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Statistics vector of the rows of two views."""
    return np.concatenate([
        [float(len(x))], x.sum(0), y.sum(0), (x.T @ x).ravel(), (y.T @ y).ravel(), (x.T @ y).ravel()
    ])


def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same without products inside a view: ``[n, sum x, sum y, sum x^2 (p), sum y^2 (q), sum xy' (p*q)]``."""
    return np.concatenate([[float(len(x))], x.sum(0), y.sum(0), (x * x).sum(0), (y * y).sum(0), (x.T @ y).ravel()])


def variances(s: np.ndarray, p: int, q: int):
    """``(var x, var y, Cxy)`` from ``moments``, with population scaling."""
    n = s[0]
    sx, sy, xx, yy, xy = np.split(s, np.cumsum([1, p, q, p, q]))[1:]
    mx, my = sx / n, sy / n
    return xx / n - mx * mx, yy / n - my * my, xy.reshape(p, q) / n - np.outer(mx, my)


def covariances(s: np.ndarray, p: int, q: int):
    """``(n, mx, my, Cxx, Cyy, Cxy)`` with population scaling."""
    n = s[0]
    cuts = np.cumsum([1, p, q, p * p, q * q])
    sx, sy, xx, yy, xy = np.split(s, cuts)[1:]
    mx, my = sx / n, sy / n
    return (
        n, mx, my,
        xx.reshape(p, p) / n - np.outer(mx, mx),
        yy.reshape(q, q) / n - np.outer(my, my),
        xy.reshape(p, q) / n - np.outer(mx, my),
    )


def spectrum(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from large to small, negatives set to 0, with their vectors."""
    w, v = np.linalg.eigh((c + c.T) / 2)
    return np.maximum(w[::-1], 0.0), v[:, ::-1]


def whitener(eig, keep: int | None = None, shrink: float = 0.0, rcond: float = 1e-6) -> np.ndarray:
    """Columns that map to unit variance, kept to the leading directions.

    Kept eigenvalues are pulled towards their mean by ``shrink``.
    """
    w, v = eig
    rank = int(np.sum(w > rcond * w[0])) if w.size and w[0] > 0 else 0
    rank = rank if keep is None else min(rank, int(keep))
    lead = w[:rank]
    lead = lead + shrink * (lead.mean() - lead) if rank else lead
    return v[:, :rank] / np.sqrt(lead)


def cca(eig_x, eig_y, cxy, k: int, keep_x=None, keep_y=None, shrink: float = 0.0, rcond: float = 1e-6):
    """Canonical weights ``(ax, ay, rho)`` from both spectra and the cross-covariance."""
    wx = whitener(eig_x, keep_x, shrink, rcond)
    wy = whitener(eig_y, keep_y, shrink, rcond)
    u, rho, vt = np.linalg.svd(wx.T @ cxy @ wy, full_matrices=False)
    k = min(k, rho.size)
    return wx @ u[:, :k], wy @ vt[:k].T, rho[:k]


def truncated_regression(eig_x, cxy, keep=None, rcond: float = 1e-6) -> np.ndarray:
    """Least squares through the leading directions of the predictors."""
    w = whitener(eig_x, keep, 0.0, rcond)
    return w @ (w.T @ cxy)


def ridge(cxx, cxy, alpha: float) -> np.ndarray:
    return np.linalg.solve(cxx + alpha * np.eye(len(cxx)), cxy)


def projected_correlation(s: np.ndarray, p: int, q: int, ax: np.ndarray, ay: np.ndarray) -> np.ndarray:
    """Correlation of ``x @ ax`` with ``y @ ay`` column by column, from statistics alone.

    The rows are centred by their own mean; a column without variance scores 0.
    """
    _, _, _, cxx, cyy, cxy = covariances(s, p, q)
    num = np.einsum("ik,ij,jk->k", ax, cxy, ay)
    vx = np.einsum("ik,ij,jk->k", ax, cxx, ax)
    vy = np.einsum("ik,ij,jk->k", ay, cyy, ay)
    den = np.sqrt(np.maximum(vx, 0.0) * np.maximum(vy, 0.0))
    return np.divide(num, den, out=np.zeros_like(num), where=den > 1e-15)


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance shrunk towards a scaled identity, after Ledoit and Wolf (2004)."""
    n, p = x.shape
    c = x - x.mean(0)
    emp = c.T @ c / n
    mu = np.trace(emp) / p
    delta = ((emp - mu * np.eye(p)) ** 2).sum() / p
    beta = ((c**2).T @ (c**2)).sum() / n - (emp**2).sum()
    beta = min(max(beta / (n * p), 0.0), delta)
    g = 0.0 if delta == 0 else beta / delta
    return (1 - g) * emp + g * mu * np.eye(p), g


def ledoit_wolf_of_sums(s: np.ndarray, p: int) -> tuple[np.ndarray, float]:
    """The same from the statistics of rows and their squared norms (``gram(x, |x|^2)``), without the rows.

    The fourth central moment is expanded in sums of x, xx', |x|^2, x|x|^2 and |x|^4.
    """
    n, m, _, emp, _, _ = covariances(s, p, 1)
    cuts = np.cumsum([1, p, 1, p * p, 1])
    sx, sq, xx, fourth, third = np.split(s, cuts)[1:]
    mm = m @ m
    centred = (
        fourth[0] + 4 * m @ xx.reshape(p, p) @ m + n * mm**2 - 4 * m @ third + 2 * mm * sq[0] - 4 * mm * (m @ sx)
    )
    mu = np.trace(emp) / p
    delta = ((emp - mu * np.eye(p)) ** 2).sum() / p
    beta = min(max((centred / n - (emp**2).sum()) / (n * p), 0.0), delta)
    g = 0.0 if delta == 0 else beta / delta
    return (1 - g) * emp + g * mu * np.eye(p), g


def oas(emp: np.ndarray, n: float) -> np.ndarray:
    """Oracle approximating shrinkage of a covariance matrix (Chen et al. 2010)."""
    p = len(emp)
    mu = np.trace(emp) / p
    alpha = (emp**2).mean()
    num = alpha + mu**2
    den = (n + 1.0) * (alpha - mu**2 / p)
    g = 1.0 if den == 0 else min(num / den, 1.0)
    return (1 - g) * emp + g * mu * np.eye(p)


def sym_fn(c: np.ndarray, fn) -> np.ndarray:
    """A scalar function of a symmetric matrix."""
    w, v = np.linalg.eigh((c + c.T) / 2)
    return (v * fn(np.maximum(w, 1e-12))) @ v.T


def sym_fn_raw(c: np.ndarray, fn) -> np.ndarray:
    """A scalar function of a symmetric matrix that may have negative eigenvalues."""
    w, v = np.linalg.eigh((c + c.T) / 2)
    return (v * fn(w)) @ v.T


def tangent_vector(c: np.ndarray, inv_root: np.ndarray) -> np.ndarray:
    """Upper triangle of the whitened matrix logarithm, off-diagonals times sqrt(2)."""
    t = sym_fn(inv_root @ c @ inv_root, np.log)
    iu = np.triu_indices(len(t))
    return t[iu] * np.where(iu[0] == iu[1], 1.0, math.sqrt(2.0))


def lda(x: np.ndarray, y: np.ndarray, shrink: str | float = "auto"):
    """Two-class discriminant ``(weights, bias)`` with shared, optionally shrunk covariance.

    The shared covariance is the prior-weighted mean of the class covariances; ``auto`` shrinks
    each class by Ledoit-Wolf on its own standardised columns.
    """
    means, cov, priors = [], np.zeros((x.shape[1], x.shape[1])), []
    for cls in (0, 1):
        xc = x[y == cls]
        means.append(xc.mean(0))
        priors.append(len(xc) / len(x))
        if shrink == "auto":
            scale = xc.std(0)
            scale = np.where(scale == 0, 1.0, scale)
            c, _ = ledoit_wolf((xc - xc.mean(0)) / scale)
            c = c * np.outer(scale, scale)
        else:
            c = np.cov(xc.T, bias=True).reshape(x.shape[1], -1)
            c = (1 - float(shrink)) * c + float(shrink) * np.trace(c) / len(c) * np.eye(len(c))
        cov += priors[-1] * c
    w = np.linalg.lstsq(cov, means[1] - means[0], rcond=None)[0]
    b = -0.5 * (means[0] + means[1]) @ w + math.log(priors[1] / priors[0])
    return w, float(b)


def standardiser(x: np.ndarray):
    """Column mean and scale (a zero scale counts as 1)."""
    s = x.std(0)
    return x.mean(0), np.where(s == 0, 1.0, s)


def clip8(x: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num(x, nan=0.0, posinf=8.0, neginf=-8.0), -8.0, 8.0)


def haufe(cov: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Unit-norm activation pattern of a linear filter."""
    a = cov @ w
    norm = np.linalg.norm(a, axis=0)
    return a / np.where(norm == 0, 1.0, norm)


def csp(c1: np.ndarray, c0: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` spatial filters whose class-power ratio is furthest from even."""
    root = sym_fn(c1 + c0, lambda w: 1.0 / np.sqrt(w))
    w, v = np.linalg.eigh(root @ c1 @ root)
    order = np.argsort(-np.abs(w - 0.5))[:n]
    return root @ v[:, order]
