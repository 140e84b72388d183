"""Filters, spectra and features of sampled signals.

Filters are symmetric FIR designs (windowed sinc), so a block needs only its halo.  A frame
reads a bounded number of samples; blocks of one long recording run independently.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .blocks import DEFAULT_WIDTH, map_blocks
from .stats import _key_fields

# Frequency bands in Hz.
BANDS = {"theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}


def _sinc_low(cut: float, m: int) -> np.ndarray:
    """Unit-gain low-pass taps of length ``2m + 1`` (Hamming window); ``cut`` in cycles per sample."""
    k = np.arange(-m, m + 1)
    taps = 2 * cut * np.sinc(2 * cut * k) * (0.54 + 0.46 * np.cos(math.pi * k / max(m, 1)))
    return taps / taps.sum()


def low_pass(cut_hz: float, rate: float, m: int) -> np.ndarray:
    return _sinc_low(cut_hz / rate, m)


def band_pass(lo_hz: float, hi_hz: float, rate: float, m: int) -> np.ndarray:
    """Difference of two low-pass designs; the upper edge stays below Nyquist."""
    hi = min(hi_hz, 0.499 * rate)
    high = _sinc_low(hi / rate, m)
    return high - _sinc_low(lo_hz / rate, m) if lo_hz > 0 else high


def band_stop(centres: Sequence[float], half: float, rate: float, m: int) -> np.ndarray:
    """Identity minus a narrow band around each centre below Nyquist."""
    taps = np.zeros(2 * m + 1)
    taps[m] = 1.0
    for c in centres:
        if c + half < rate / 2:
            taps = taps - band_pass(c - half, c + half, rate, m)
    return taps


def hilbert_taps(m: int) -> np.ndarray:
    """Odd-symmetric quadrature taps (Hamming window)."""
    k = np.arange(-m, m + 1)
    ideal = np.where(k % 2 != 0, 2.0 / (math.pi * np.where(k == 0, 1, k)), 0.0)
    return ideal * (0.54 + 0.46 * np.cos(math.pi * k / max(m, 1)))


def harmonics(mains: float, rate: float) -> list[float]:
    return [mains * i for i in range(1, int(rate / 2 // mains) + 1)]


def log_bands(lo: float, hi: float, n: int) -> list[tuple[float, float]]:
    """``n`` adjacent log-spaced bands."""
    edges = [lo * (hi / lo) ** (i / n) for i in range(n + 1)]
    return list(zip(edges[:-1], edges[1:]))


# Fixed values of the constant-Q bank: first and last centre and outermost edges as shares of
# the range's ends, half width in octaves.
FIRST_CENTRE, LAST_CENTRE, LOWEST_EDGE, HIGHEST_EDGE, HALF_WIDTH = 1.05, 0.95, 0.9, 1.02, 0.42


def constant_q_bands(lo: float, hi: float, n: int, half_width: float = HALF_WIDTH) -> list[tuple[float, float]]:
    """``n`` overlapping bands whose centres are equally spaced in octaves, cut at the outermost edges."""
    first, last = np.log2(lo * FIRST_CENTRE), np.log2(hi * LAST_CENTRE)
    centre = np.linspace(first, last, n) if n > 1 else np.array([first])
    edges = np.exp2(np.stack([centre - half_width, centre + half_width], axis=1))
    edges = np.clip(edges, lo * LOWEST_EDGE, hi * HIGHEST_EDGE)
    return [(float(low), float(high)) for low, high in edges]


def fir_bank(
    df: DataFrame, by: Sequence[str], x: str, banks: Sequence[np.ndarray], t: str = "t",
    out: str = "x", width: int = DEFAULT_WIDTH, carry: Sequence[str] = (),
) -> DataFrame:
    """Convolve each channel with each tap set (same odd length); filter outer, channel inner.

    Samples beyond the ends of a series count as zero.
    """
    taps = np.stack(banks)
    m = (taps.shape[1] - 1) // 2
    fields = [*_key_fields(df, [*by, t, *carry]), T.StructField(out, T.ArrayType(T.DoubleType()))]

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = pdf[t].to_numpy()
        base = ts - ts[0]
        v = np.stack(pdf[x].to_list())
        dense = np.zeros((base[-1] + 1 + 2 * m, v.shape[1]))
        dense[base + m] = v
        core = pdf["core"].to_numpy(dtype=bool)
        view = np.lib.stride_tricks.sliding_window_view(dense, 2 * m + 1, axis=0)[base[core]]
        y = np.einsum("nck,fk->nfc", view, taps[:, ::-1], optimize=True).reshape(core.sum(), -1)
        res = pdf.loc[core, [*by, t, *carry]].copy()
        res[out] = list(y)
        return res

    return map_blocks(df, by, task, T.StructType(fields), t, before=m, after=m, width=width)


def fir(df: DataFrame, by: Sequence[str], x: str, taps: np.ndarray, **kw) -> DataFrame:
    return fir_bank(df, by, x, [taps], **kw)


def resampled(df: DataFrame, by: Sequence[str], x: str, rate: float, target: float, m: int = 32, **kw) -> DataFrame:
    """Low-pass below the new Nyquist rate, then keep every k-th row (integer ratios).

    Other ratios average the rows of each output interval instead.
    """
    ratio = rate / target
    if abs(ratio - round(ratio)) < 1e-9:
        k = round(ratio)
        low = fir(df, by, x, low_pass(0.45 * target, rate, m), out=x, **kw)
        return low.where(F.col("t") % k == 0).withColumn("t", (F.col("t") / k).cast("bigint"))
    slot = F.floor(F.col("t") * (target / rate)).cast("bigint")
    long = df.select(*by, slot.alias("t"), F.posexplode(x).alias("_i", "_v"))
    mean = long.groupBy(*by, "t", "_i").agg(F.avg("_v").alias("_v"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda r: r._v)
    return mean.groupBy(*by, "t").agg(whole.alias(x))


def envelope(df: DataFrame, by: Sequence[str], x: str, m: int = 32, power: float = 0.3, **kw) -> DataFrame:
    """Compressed amplitude of the analytic signal (quadrature FIR pair)."""
    ident = np.zeros(2 * m + 1)
    ident[m] = 1.0
    both = fir_bank(df, by, x, [ident, hilbert_taps(m)], out="_q", **kw)
    half = F.expr("size(_q) div 2")
    amp = F.zip_with(
        F.slice("_q", 1, half), F.slice("_q", half + 1, half), lambda a, b: F.pow(F.greatest(F.hypot(a, b), F.lit(0.0)), F.lit(power))
    )
    return both.withColumn(x, amp).drop("_q")


def centred(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Remove the mean of every channel of a group, keeping relative sizes."""
    from .stats import sum_vectors

    mean = sum_vectors(df.withColumn("_one", F.concat(F.array(F.lit(1.0)), F.col(x))), by, "_one")
    joined = df.join(mean.withColumnRenamed("s", "_s"), list(by)) if by else df.crossJoin(F.broadcast(mean.withColumnRenamed("s", "_s")))
    n = F.col("_s")[0]
    avg = F.slice("_s", 2, F.size("_s") - 1)
    return joined.withColumn(x, F.zip_with(x, F.zip_with(avg, F.array_repeat(n, F.size(avg)), lambda a, k: a / k), lambda v, a: v - a)).drop("_s")


def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(n) / n)


def segment_power(v: np.ndarray, rate: float) -> np.ndarray:
    """Density-scaled one-sided periodograms of segments ``(..., n)``, mean removed, Hann taper."""
    n = v.shape[-1]
    w = _hann(n)
    p = np.abs(np.fft.rfft((v - v.mean(-1, keepdims=True)) * w, axis=-1)) ** 2 / (rate * (w**2).sum())
    last = None if n % 2 else -1
    p[..., 1:last] *= 2
    return p


def welch(
    df: DataFrame, by: Sequence[str], x: str, rate: float, nper: int, step: int | None = None,
    t: str = "t", width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Mean periodogram per group: ``(by..., ch, f, hz, psd)``.

    Segments start every ``step`` samples (half overlap by default) and must be complete.
    A block handles the segments that start in it; their sums are added across blocks.
    """
    step = step or nper // 2
    keys = _key_fields(df, by)
    schema = T.StructType([
        *keys, T.StructField("n_seg", T.LongType()), T.StructField("width", T.IntegerType()),
        T.StructField("p", T.ArrayType(T.DoubleType())),
    ])

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = pdf[t].to_numpy()
        v = np.stack(pdf[x].to_list())
        core = pdf["core"].to_numpy(dtype=bool)
        rows = []
        starts = np.flatnonzero(core & (ts % step == 0))
        starts = starts[starts + nper <= len(ts)]
        starts = starts[ts[starts + nper - 1] - ts[starts] == nper - 1]
        if len(starts):
            seg = np.stack([v[i : i + nper].T for i in starts])
            total = segment_power(seg, rate).sum(0)
            rows.append((*pdf.iloc[0][list(by)], len(starts), total.shape[1], total.ravel()))
        return pd.DataFrame(rows, columns=[*by, "n_seg", "width", "p"])

    part = map_blocks(df, by, task, schema, t, after=nper - 1, width=width)
    long = part.select(*by, "n_seg", "width", F.posexplode("p").alias("_i", "_p"))
    mean = long.groupBy(*by, "width", "_i").agg((F.sum("_p") / F.sum("n_seg")).alias("psd"))
    f = (F.col("_i") % F.col("width")).cast("int")
    return mean.select(*by, F.floor(F.col("_i") / F.col("width")).cast("int").alias("ch"), f.alias("f"), (f * (rate / nper)).alias("hz"), "psd")


def band_power(psd: DataFrame, by: Sequence[str], bands: dict[str, tuple[float, float]], closed: Collection[str] = (), floor: float = 1e-30) -> DataFrame:
    """Log mean power density per band; bounds half-open, closed on both sides for names in ``closed``."""
    cols = []
    for name, (lo, hi) in bands.items():
        inside = (F.col("hz") >= lo) & (F.col("hz") <= hi if name in closed else F.col("hz") < hi)
        cols.append(F.log(F.avg(F.when(inside, F.col("psd"))) + floor).alias(name))
    return psd.groupBy(*by).agg(*cols)


def decibel(v: Column) -> Column:
    return 10.0 * F.log10(v)


def frame_pitch(
    df: DataFrame, by: Sequence[str], v: str, rate: float, lo_hz: float, hi_hz: float, size: int, hop: int,
    voiced: float = 0.3, t: str = "t", width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Log fundamental frequency per frame from the normalised autocorrelation peak.

    Frames whose peak stays below ``voiced`` have a null value.
    """
    lags = np.arange(max(1, int(rate / hi_hz)), min(size - 1, int(rate / lo_hz)) + 1)
    schema = T.StructType([
        *_key_fields(df, by), T.StructField("frame", T.LongType()), T.StructField("log_f0", T.DoubleType()),
        T.StructField("strength", T.DoubleType()),
    ])

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        ts, x = pdf[t].to_numpy(), pdf[v].to_numpy(dtype=float)
        core = pdf["core"].to_numpy(dtype=bool)
        starts = np.flatnonzero(core & (ts % hop == 0))
        starts = starts[starts + size <= len(ts)]
        rows = []
        for i in starts:
            f = x[i : i + size] - x[i : i + size].mean()
            r = np.array([f[:-k] @ f[k:] / max(np.sqrt((f[:-k] @ f[:-k]) * (f[k:] @ f[k:])), 1e-20) for k in lags])
            j = int(r.argmax())
            rows.append((*pdf.iloc[0][list(by)], int(ts[i] // hop), float(np.log(rate / lags[j])) if r[j] >= voiced else None, float(r[j])))
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return map_blocks(df, by, task, schema, t, after=size - 1, width=width)


def area_pooled(pixels: DataFrame, by: Sequence[str], row: str, col: str, v: str, k: int) -> DataFrame:
    """Mean of every k x k tile of a frame grid."""
    return pixels.groupBy(*by, F.floor(F.col(row) / k).alias(row), F.floor(F.col(col) / k).alias(col)).agg(F.avg(v).alias(v))


def mel_weights(n_bins: int, rate: float, nper: int, lo: float, hi: float, n: int) -> np.ndarray:
    """Triangular weights ``(n, n_bins)`` equally spaced on the mel scale."""
    mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    inv = lambda m: 700.0 * (10.0 ** (m / 2595.0) - 1.0)
    edges = inv(np.linspace(mel(lo), mel(hi), n + 2))
    hz = np.arange(n_bins) * rate / nper
    up = (hz[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - hz[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0.0, np.minimum(up, down))


def mel_envelopes(
    df: DataFrame, by: Sequence[str], v: str, rate: float, size: int, hop: int, lo: float, hi: float, n: int,
    power: float = 0.15, t: str = "t", width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Compressed mel-band power per frame: ``(by..., t = frame, x)``."""
    weights = mel_weights(size // 2 + 1, rate, size, lo, hi, n)
    schema = T.StructType([*_key_fields(df, by), T.StructField("t", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        ts, sig = pdf[t].to_numpy(), pdf[v].to_numpy(dtype=float)
        core = pdf["core"].to_numpy(dtype=bool)
        starts = np.flatnonzero(core & (ts % hop == 0))
        starts = starts[starts + size <= len(ts)]
        if not len(starts):
            return pd.DataFrame([], columns=[f.name for f in schema.fields])
        frames = np.stack([sig[i : i + size] for i in starts]) * _hann(size)
        power_ = np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ weights.T
        out = pd.DataFrame({"t": ts[starts] // hop, "x": list(power_**power)})
        for c in by:
            out[c] = pdf.iloc[0][c]
        return out[[f.name for f in schema.fields]]

    return map_blocks(df, by, task, schema, t, after=size - 1, width=width)


def clock_corrected(stamps: DataFrame, by: Sequence[str], remote: str, local: str, first: str, n: str, rate: float) -> DataFrame:
    """Median clock difference per session, and corrected first and last sample times."""
    from .ordered import exact_quantiles

    diff = stamps.withColumn("_d", F.col(remote) - F.col(local))
    off = exact_quantiles(diff, by, "_d", {"clock_offset": 0.5})
    out = stamps.join(off, list(by))
    start = F.col(first) + F.col("clock_offset")
    return out.withColumn("ts_first", start).withColumn("ts_last", start + (F.col(n) - 1) / F.lit(rate))


def matrix_applied(df: DataFrame, x: str, matrix: np.ndarray, out: str | None = None) -> DataFrame:
    """Multiply every sample vector by a fixed channel matrix, in Arrow batches without a shuffle."""
    out = out or x
    fields = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    names = [f.name for f in fields]

    def task(batches):
        for pdf in batches:
            res = pdf[names].copy()
            res[out] = list(np.stack(pdf[x].to_list()) @ matrix) if len(pdf) else []
            yield res

    return df.mapInPandas(task, schema)
