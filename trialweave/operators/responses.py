"""Impulse responses and transfer functions of fitted lag weights, and component maps."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import linalg as la
from .models import Spec, weights
from .stats import map_rows


def transfer_function(df: DataFrame, keys: Sequence[str], taps: str, rate: float, n: int = 256) -> DataFrame:
    """``(keys..., bin, hz, magnitude, phase)``: the discrete Fourier transform of an array of taps, zero-padded to ``n``.

    Plain array expressions: one row for each of the ``n / 2 + 1`` frequencies.
    """
    rows = df.select(*keys, F.col(taps).alias("_h"), F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("bin"))
    turn = F.col("bin") * (2.0 * math.pi / n)

    def part(wave) -> Column:
        return F.aggregate(
            F.transform("_h", lambda w, i: w * wave(turn * i)), F.lit(0.0), lambda a, v: a + v
        )

    re, im = part(F.cos), -part(F.sin)
    flat = lambda c: F.when(F.abs(c) < 1e-12, F.lit(0.0)).otherwise(c)  # noqa: E731 - no sign on a zero
    return rows.select(*keys, "bin", re.alias("_re"), im.alias("_im")).select(
        *keys, "bin", (F.col("bin") * (rate / n)).alias("hz"),
        F.sqrt(F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")).alias("magnitude"),
        F.atan2(flat(F.col("_im")), flat(F.col("_re"))).alias("phase"),
    )


def impulse_responses(stats: DataFrame, keys: Sequence[str], channels: int, lags: int, spec: Spec) -> DataFrame:
    """``(keys..., ch, taps)``: the forward model's weights over the stimulus lags for every channel."""
    keys = list(keys)
    types = "".join(f"{c} {stats.schema[c].dataType.simpleString()}, " for c in keys)

    def one(row):
        _, coef, _ = weights(np.asarray(row["s"]), channels, 1, spec)
        for ch in range(channels):
            yield (*[row[c] for c in keys], ch, coef[:lags, ch])

    return map_rows(stats.select(*keys, "s"), one, types + "ch int, taps array<double>")


def component_summary(stats: DataFrame, channels: int, features: int, spec: Spec) -> DataFrame:
    """``(comp, taps, topo)`` of a CCA on all data: stimulus-side taps and the component's correlation with each channel.

    The signs make the largest tap positive.  Correlations come from the covariance, no series is read again.
    """
    nx, ny = spec.x_basis().size, spec.y_basis().size

    def one(row):
        s = np.asarray(row["s"])
        ax, ay, rho = weights(s, channels, features, spec)
        _, _, _, cxx, _, _ = la.covariances(s, channels * nx, features * ny)
        for c in range(ax.shape[1]):
            sign = np.sign(ay[np.abs(ay[:, c]).argmax(), c]) or 1.0
            shown = cxx[:channels] @ ax[:, c]
            size = np.sqrt(np.maximum(np.diag(cxx)[:channels] * (ax[:, c] @ cxx @ ax[:, c]), 1e-300))
            yield (c, sign * ay[:, c], sign * shown / size, float(rho[c]))

    return map_rows(stats.select("s"), one, "comp int, taps array<double>, topo array<double>, rho double")
