"""Linear stimulus-response models fitted and scored on statistics tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import linalg as la
from .blocks import DEFAULT_WIDTH, with_halo
from .series import smoother_widths
from .stats import Lags, Smooth, _framed, _view, as_basis, map_rows


@dataclass(frozen=True)
class Spec:
    """A model: kind, the two bases, and how far each side is reduced."""

    kind: str
    x_lags: int = 1
    y_lags: int = 1
    smooth: bool = False
    pre_pca: int | None = None
    keep_x: int | None = None
    keep_y: int | None = None
    k: int = 1000
    shrink: float = 0.0
    rcond: float = 1e-8
    alpha: float = 0.0
    x_first: int = 0  # first delay of either side; below zero it reaches ahead
    y_first: int = 0

    def x_basis(self):
        return Smooth(smoother_widths(21, 2, 128)) if self.smooth else Lags(range(self.x_first, self.x_first + self.x_lags))

    def y_basis(self):
        return Smooth(smoother_widths(21, 2, 128)) if self.smooth else Lags(range(self.y_first, self.y_first + self.y_lags))


# Lag counts and reductions of the six named models.
PRESETS = {
    "forward": Spec("forward", y_lags=80),
    "backward": Spec("backward", keep_x=80),
    "cca1": Spec("cca", y_lags=40, keep_x=40, keep_y=40, k=40),
    "cca2": Spec("cca", x_lags=10, y_lags=40, pre_pca=80, keep_x=40, keep_y=40, k=40),
    "cca2plus": Spec("cca", x_lags=10, y_lags=80, pre_pca=80, keep_x=80, keep_y=80, k=80),
    "cca3": Spec("cca", smooth=True, pre_pca=60, keep_x=139, k=21),
}


def preset(name: str) -> Spec:
    if name not in PRESETS:
        raise KeyError(f"unknown model {name!r}; choose from {sorted(PRESETS)}")
    return PRESETS[name]


def weights(s: np.ndarray, channels: int, features: int, spec: Spec):
    """``(ax, ay, rho)``: paired weight columns of one model from its statistics.

    Every model is scored the same way, as the correlation of ``x @ ax`` with ``y @ ay`` per
    column: a backward model pairs its reconstruction with each stimulus feature, a forward
    model pairs each channel with its prediction.
    """
    nx, ny = spec.x_basis().size, spec.y_basis().size
    p, q = channels * nx, features * ny
    n, _, _, cxx, cyy, cxy = la.covariances(s, p, q)
    lift = np.eye(p)
    if spec.pre_pca is not None and spec.pre_pca < channels and spec.kind != "forward":
        _, v = la.spectrum(cxx[:channels, :channels])
        lift = np.kron(np.eye(nx), v[:, : spec.pre_pca])
        cxx, cxy = lift.T @ cxx @ lift, lift.T @ cxy
    if spec.kind == "cca":
        ax, ay, rho = la.cca(la.spectrum(cxx), la.spectrum(cyy), cxy, spec.k, spec.keep_x, spec.keep_y, spec.shrink, spec.rcond)
        return lift @ ax, ay, rho
    if spec.kind == "backward":
        coef = la.truncated_regression(la.spectrum(cxx), cxy[:, :features], spec.keep_x, spec.rcond)
        return lift @ coef, np.eye(q)[:, :features], np.zeros(features)
    if spec.kind == "forward":
        coef = la.truncated_regression(la.spectrum(cyy), cxy.T[:, :channels], spec.keep_y, spec.rcond)
        return np.eye(p)[:, :channels], coef, np.zeros(channels)
    if spec.kind == "ridge_forward":
        coef = la.ridge(n * cyy, n * cxy.T[:, :channels], spec.alpha)
        return np.eye(p)[:, :channels], coef, np.zeros(channels)
    if spec.kind == "ridge_backward":
        coef = la.ridge(n * cxx, n * cxy[:, :features], spec.alpha)
        return coef, np.eye(q)[:, :features], np.zeros(features)
    if spec.kind == "relative_ridge_forward":
        coef = la.ridge(cyy, cxy.T[:, :channels], 1e-3 * np.trace(cyy) / len(cyy))
        return np.eye(p)[:, :channels], coef, np.zeros(channels)
    raise ValueError(spec.kind)


def fit(train: DataFrame, keys: Sequence[str], channels: int, features: int, specs: dict[str, Spec]) -> DataFrame:
    """One model row per statistics row and named spec: ``(keys..., model, ax, ay, rho, k)``."""
    keys = list(keys)
    types = ", ".join(f"{c} {train.schema[c].dataType.simpleString()}" for c in keys)
    schema = (types + ", " if keys else "") + "model string, k int, ax array<double>, ay array<double>, rho array<double>"

    def one(row):
        s = np.asarray(row["s"], dtype="float64")
        for name, spec in specs.items():
            ax, ay, rho = weights(s, channels, features, spec)
            yield (*[row[c] for c in keys], name, ax.shape[1], ax.ravel(), ay.ravel(), rho)

    return map_rows(train.select(*keys, "s"), one, schema)


def score(models: DataFrame, stats: DataFrame, on: Sequence[str], keep: Sequence[str], p: int, q: int) -> DataFrame:
    """Held-out correlation per component: ``(on..., keep..., model, comp, r)``.

    ``stats`` rows are joined to the models of their fold; nothing is read again.
    """
    cols = [*on, *[c for c in keep if c not in on]]
    joined = stats.join(models, list(on))
    types = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in cols)

    def one(row):
        k = row["k"]
        ax = np.asarray(row["ax"]).reshape(-1, k)
        ay = np.asarray(row["ay"]).reshape(-1, k)
        r = la.projected_correlation(np.asarray(row["s"]), p, q, ax, ay)
        for c in range(k):
            yield (*[row[name] for name in cols], row["model"], c, float(r[c]))

    need = joined.select(*cols, "model", "k", "ax", "ay", "s")
    return map_rows(need, one, types + ", model string, comp int, r double")


def top_k_mean(scores: DataFrame, keys: Sequence[str], k: int, largest: bool = False) -> DataFrame:
    """Mean of the first ``k`` components, or of the ``k`` largest (biased upward)."""
    rs = F.sort_array(F.collect_list(F.struct("comp", "r")))
    vals = F.transform(rs, lambda c: c.r)
    vals = F.slice(F.sort_array(vals, False) if largest else vals, 1, k)
    mean = F.aggregate(vals, F.lit(0.0), lambda a, b: a + b) / F.size(vals)
    return scores.groupBy(*keys).agg(mean.alias("r"))


def variates(
    sig: DataFrame, stim: DataFrame, models: DataFrame, fold_of: DataFrame, x_basis, y_basis,
    edge: str = "causal", width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Projected series ``(trial, t, model, u, v)`` of every trial under its fold's model.

    Each block meets the one model row it needs in a cogroup, so models are neither collected
    nor copied to every sample.
    """
    xb, yb = as_basis(x_basis), as_basis(y_basis)
    before = max(xb.span()[0], yb.span()[0])
    after = max(xb.span()[1], yb.span()[1])
    rows = with_halo(_framed(sig.join(stim, ["trial", "t"]), ["trial"], "t", edge), "t", before, after, width)
    blocks = rows.where("core").select("trial", "blk").distinct().select(F.col("trial").alias("trial"), F.col("blk").alias("blk")).join(fold_of, "trial").join(models, "fold")
    schema = T.StructType([
        sig.schema["trial"], sig.schema["t"], T.StructField("model", T.StringType()),
        T.StructField("u", T.ArrayType(T.DoubleType())), T.StructField("v", T.ArrayType(T.DoubleType())),
    ])

    def task(pdf: pd.DataFrame, mdf: pd.DataFrame) -> pd.DataFrame:
        if not len(mdf) or not len(pdf) or not pdf["core"].any():
            return pd.DataFrame([], columns=schema.names)
        pdf = pdf.sort_values("t", kind="stable").reset_index(drop=True)
        xv, yv = _view(pdf, "x", "t", xb, edge), _view(pdf, "y", "t", yb, edge)
        core = pdf.loc[pdf["core"].to_numpy(dtype=bool), ["trial", "t"]]
        out = []
        for m in mdf.to_dict("records"):
            part = core.copy()
            part["model"] = m["model"]
            part["u"] = list(xv @ np.asarray(m["ax"]).reshape(-1, m["k"]))
            part["v"] = list(yv @ np.asarray(m["ay"]).reshape(-1, m["k"]))
            out.append(part)
        return pd.concat(out)

    blocks = blocks.withColumnsRenamed({"trial": "m_trial", "blk": "m_blk"})
    return rows.groupBy("trial", "blk").cogroup(blocks.groupBy("m_trial", "m_blk")).applyInPandas(task, schema)


def component_rows(var: DataFrame) -> DataFrame:
    """``(trial, t, model, comp, a, b)`` from variates."""
    return var.select("trial", "t", "model", F.posexplode(F.arrays_zip("u", "v")).alias("comp", "z")).select(
        "trial", "t", "model", "comp", F.col("z.u").alias("a"), F.col("z.v").alias("b")
    )


def grid_models(train: DataFrame, keys: Sequence[str], channels: int, features: int, spec: Spec, keeps: Sequence[int], shrinks: Sequence[float]) -> DataFrame:
    """Models of a (kept directions x shrinkage) grid; spectra are computed once per row."""
    keys = list(keys)
    types = "".join(f"{c} {train.schema[c].dataType.simpleString()}, " for c in keys)
    nx, ny = spec.x_basis().size, spec.y_basis().size

    def one(row):
        _, _, _, cxx, cyy, cxy = la.covariances(np.asarray(row["s"]), channels * nx, features * ny)
        ex, ey = la.spectrum(cxx), la.spectrum(cyy)
        cell = 0
        for keep in keeps:
            for g in shrinks:
                ax, ay, rho = la.cca(ex, ey, cxy, spec.k, keep, None, g, 1e-6)
                yield (*[row[c] for c in keys], f"{keep}|{g}", cell, int(keep), float(g), ax.shape[1], ax.ravel(), ay.ravel(), rho)
                cell += 1

    schema = types + "model string, cell int, keep int, shrink double, k int, ax array<double>, ay array<double>, rho array<double>"
    return map_rows(train.select(*keys, "s"), one, schema)


def patterns(models: DataFrame, stats: DataFrame, on: Sequence[str], p: int, q: int) -> DataFrame:
    """Forward patterns ``px = Cxx ax`` and ``py = Cyy ay`` (unit norm per component)."""
    joined = stats.join(models, list(on)) if on else stats.crossJoin(models)
    types = "".join(f"{c} {joined.schema[c].dataType.simpleString()}, " for c in on)

    def one(row):
        _, _, _, cxx, cyy, _ = la.covariances(np.asarray(row["s"]), p, q)
        k = row["k"]
        px = la.haufe(cxx, np.asarray(row["ax"]).reshape(-1, k))
        py = la.haufe(cyy, np.asarray(row["ay"]).reshape(-1, k))
        for c in range(k):
            yield (*[row[n] for n in on], row["model"], c, px[:, c], py[:, c])

    return map_rows(joined.select(*on, "model", "k", "ax", "ay", "s"), one, types + "model string, comp int, px array<double>, py array<double>")


def eigenspectrum(stats: DataFrame, p: int, q: int, cut: int) -> DataFrame:
    """Signal covariance eigenvalues over the largest, with the truncation mark."""

    def one(row):
        w, _ = la.spectrum(la.covariances(np.asarray(row["s"]), p, q)[3])
        for i, v in enumerate(w / w[0]):
            yield (i, float(v), i < cut)

    return map_rows(stats.select("s"), one, "rank int, share double, kept boolean")
