"""Block + halo equals the unblocked result; filters and spectra against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions import linalg as la
from trialweave.operators.series import causal_lags, signed_lags, smoother_bank, smoother_widths
from trialweave.operators.spectral import band_pass, band_stop, fir, frame_pitch, mel_envelopes, welch
from trialweave.operators.stats import Smooth, lagged_stats


def series(spark, n=150, c=3, seed=1, trials=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(trials, n, c))
    rows = [(k, t, x[k, t].tolist()) for k in range(trials) for t in range(n)]
    return x, spark.createDataFrame(rows, "trial int, t bigint, x array<double>")


def back(df, col="x"):
    pdf = df.orderBy("trial", "t").toPandas()
    return np.stack([np.stack(p[col].to_list()) for _, p in pdf.groupby("trial")])


@pytest.mark.parametrize("width", [7, 64, 4096])
def test_lags_do_not_depend_on_blocks(spark, width):
    x, df = series(spark)
    got = back(causal_lags(df, ["trial"], "x", 10, width=width), "lagged")
    want = np.concatenate([np.concatenate([np.zeros((2, k, 3)), x[:, : 150 - k]], 1) for k in range(10)], 2)
    np.testing.assert_allclose(got, want)
    got = back(signed_lags(df, ["trial"], "x", [-3, 0, 5], width=width), "lagged")
    rolled = np.concatenate([np.roll(x, k, axis=1) for k in (-3, 0, 5)], 2)
    rolled[:, :5] = 0
    rolled[:, 145:] = 0
    np.testing.assert_allclose(got, rolled)


@pytest.mark.parametrize("width", [9, 4096])
def test_smoother_and_fir(spark, width):
    x, df = series(spark)
    widths = smoother_widths(5, 2, 20)
    one = df.withColumn("v", F.col("x")[0]).drop("x")
    got = smoother_bank(one, ["trial"], "v", widths, width=width).orderBy("trial", "t").toPandas()
    for w in widths:
        want = np.stack([[r[max(0, i - w + 1) : i + 1].mean() for i in range(150)] for r in x[:, :, 0]]).ravel()
        np.testing.assert_allclose(got[f"s_{w}"], want)
    taps = band_pass(4, 12, 64, 10)
    got = back(fir(df, ["trial"], "x", taps, width=width))
    want = np.stack([[np.convolve(x[k, :, c], taps, "same") for c in range(3)] for k in range(2)]).transpose(0, 2, 1)
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_filter_gains():
    f = np.fft.rfftfreq(2048, 1 / 64)
    gain = np.abs(np.fft.rfft(band_pass(8, 12, 64, 64), 2048))
    assert gain[np.argmin(abs(f - 10))] > 0.95 and gain[np.argmin(abs(f - 20))] < 0.01
    stop = np.abs(np.fft.rfft(band_stop([16.0], 1.0, 64, 128), 2048))
    assert stop[np.argmin(abs(f - 16))] < 0.05 and stop[np.argmin(abs(f - 5))] > 0.98


@pytest.mark.parametrize("width", [16, 4096])
def test_welch_equals_numpy(spark, width):
    x, df = series(spark)
    got = welch(df, ["trial"], "x", 64.0, 32, width=width).where("trial = 1 and ch = 2").orderBy("f").toPandas()["psd"]
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32)
    segs = [x[1, s : s + 32, 2] for s in range(0, 150 - 31, 16)]
    p = np.mean([np.abs(np.fft.rfft((s - s.mean()) * w)) ** 2 for s in segs], 0) / (64 * (w**2).sum())
    p[1:-1] *= 2
    np.testing.assert_allclose(got, p)


@pytest.mark.parametrize("width", [11, 4096])
def test_lagged_statistics(spark, width):
    x, df = series(spark)
    both = df.withColumn("y", F.array(F.col("x")[0] * 2 + 1))
    got = lagged_stats(both, ["trial"], "x", "y", [0, 1, 4], [0, 2], width=width, shifts=[-2, 0, 3]).toPandas()
    for k in range(2):
        y = x[k, :, :1] * 2 + 1

        def lag(m, lags):
            return np.hstack([np.vstack([np.zeros((j, m.shape[1])), m[: len(m) - j]]) for j in lags])

        for d in (-2, 0, 3):
            ys = np.zeros_like(y)
            if d >= 0:
                ys[d:] = y[: len(y) - d]
            else:
                ys[:d] = y[-d:]
            s = got[(got.trial == k) & (got["shift"] == d)]["s"].iloc[0]
            np.testing.assert_allclose(np.asarray(s), la.gram(lag(x[k], [0, 1, 4]), lag(ys, [0, 2])), atol=1e-9)
    sm = lagged_stats(both, ["trial"], "x", "y", Smooth([2, 5]), [0], width=width).where("trial = 0").head().s
    view = np.hstack([[x[0, max(0, i - w + 1) : i + 1].mean(0) for i in range(150)] for w in (2, 5)])
    np.testing.assert_allclose(np.asarray(sm), la.gram(view, x[0, :, :1] * 2 + 1), atol=1e-9)


def test_pitch_of_a_tone(spark):
    rate, n = 1000.0, 2000
    rows = [(0, t, float(np.sin(2 * np.pi * 125 * t / rate))) for t in range(n)]
    f0 = frame_pitch(spark.createDataFrame(rows, "g int, t bigint, v double"), ["g"], "v", rate, 80, 300, 100, 50, width=300)
    got = np.exp(f0.toPandas()["log_f0"].astype(float))
    assert len(got) == 39 and np.allclose(got, 125, rtol=0.01)


def test_mel_band_of_a_tone(spark):
    rows = [(0, t, float(np.sin(2 * np.pi * 20 * t / 128))) for t in range(512)]
    mel = mel_envelopes(spark.createDataFrame(rows, "g int, t bigint, v double"), ["g"], "v", 128.0, 64, 32, 2, 60, 6, width=100)
    x = np.stack(mel.toPandas()["x"].to_list())
    assert x.shape == (15, 6) and len(set(x.argmax(1))) == 1 and x.argmax(1)[0] in (1, 2)
