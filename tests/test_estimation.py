"""Estimators on summed statistics against direct NumPy: logistic steps, lag products, shrinkage, nested folds, draws."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F


def vectors(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- logistic regression ------------------------------------------------------------------------


def newton(x, y, penalty):
    z = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(z.shape[1]), np.r_[0.0, np.full(x.shape[1], penalty)]
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-12:
            return w
    raise AssertionError("no convergence")


def test_logistic_folds_equal_separate_fits(spark):
    from trialweave.operators.logistic import fit_logistic_folds, logistic_cross_validated

    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 5)) * [1, 2, 0.5, 1, 0] + [0, 1e6, 0, 3, 4]
    y = (x[:, 0] + 0.5 * (x[:, 1] - 1e6) + rng.normal(size=240) > 0).astype(int)
    fold, site = np.arange(240) % 3, np.where(np.arange(240) < 200, "a", "b")
    rows = vectors(spark, [(int(i), site[i], int(fold[i]), int(y[i]), x[i].tolist()) for i in range(240)], "id int, site string, fold int, y int, x array<double>")
    rows = rows.repartition(5)
    models = fit_logistic_folds(rows, ["site"], "fold", "y", "x", penalty=0.7)
    assert set(models) == {(s, f) for s in "ab" for f in range(3)}
    for (s, f), (m, sd, w) in models.items():
        used = (site == s) & (fold != f)
        xs = x[used]
        scale = np.where(xs.std(0) < 1e-9, 1.0, xs.std(0))
        assert np.allclose(m, xs.mean(0)) and np.allclose(sd[:4], scale[:4], rtol=1e-3)
        assert np.allclose(w, newton((xs - m) / sd, y[used], 0.7), atol=1e-6)
    sc = {r["id"]: r["score"] for r in logistic_cross_validated(rows, ["site"], "fold", "y", "x", penalty=0.7).collect()}
    i = 17
    m, sd, w = models[site[i], int(fold[i])]
    assert sc[i] == pytest.approx(w[0] + ((x[i] - m) / sd) @ w[1:], abs=1e-7)
    part = fit_logistic_folds(rows, ["site"], "fold", "y", "x", leave=[1])
    assert set(part) == {("a", 1), ("b", 1)}


def test_logistic_ends_on_separable_rows(spark):
    from trialweave.operators.logistic import fit_logistic_folds

    rows = vectors(spark, [(i % 2, int(i >= 20), [float(i - 20) * 50, 1.0]) for i in range(40)], "fold int, y int, x array<double>")
    for m, sd, w in fit_logistic_folds(rows, [], "fold", "y", "x", penalty=1e-3).values():
        assert np.isfinite(w).all() and w[1] > 0


# ---- lag products -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def trials(spark):
    rng = np.random.default_rng(0)
    rows = [(k % 2, k, t, rng.normal(size=3).tolist(), rng.normal(size=2).tolist()) for k, n in enumerate([13, 4, 9, 30, 2, 1]) for t in range(n)]
    return vectors(spark, rows, "fold int, trial long, t long, x array<double>, y array<double>").cache()


def folded(df):
    return {r["fold"]: np.array(r["s"]) for r in df.collect()}


@pytest.mark.parametrize("width", [7, 4096])
@pytest.mark.parametrize("use", [(4, 6), (2, 3), (1, 1)])
def test_lag_products_give_the_lagged_statistics(spark, trials, width, use):
    from trialweave.operators.lag_products import assemble, lag_products
    from trialweave.operators.stats import lagged_stats, sum_vectors

    want = folded(sum_vectors(lagged_stats(trials, ["fold", "trial"], "x", "y", range(use[0]), range(use[1]), width=width), ["fold"], "s"))
    got = folded(lag_products(trials.repartition(3), "trial", ["fold"], 4, 6, width=width))
    for f in want:
        assert np.allclose(assemble(got[f], 3, 2, 4, 6, *use), want[f], atol=1e-12)
    # far smaller than one product for each pair of lags, edges aside
    assert 1 + 5 + 4 * 9 + 6 * 4 + 9 * 6 < len(want[0]) or use != (4, 6)


def test_lagged_sums_equal_the_sum_over_trials(spark, trials):
    from trialweave.operators.lag_products import lagged_sums
    from trialweave.operators.stats import Smooth, lagged_stats, sum_vectors

    for basis, shifts in ((Smooth([2, 5]), None), ([0, 1, 2], [-3, 0, 4])):
        keys = ["fold"] if shifts is None else ["fold", "shift"]
        a = sum_vectors(lagged_stats(trials, ["fold", "trial"], "x", "y", basis, basis, width=7, shifts=shifts), keys, "s")
        b = lagged_sums(trials, ["trial"], ["fold"], "x", "y", basis, basis, width=7, shifts=shifts)
        a, b = ({tuple(r[k] for k in keys): np.array(r["s"]) for r in d.collect()} for d in (a, b))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_weighted_draws(spark):
    from trialweave.operators.stats import sum_vectors_by_draw

    rng = np.random.default_rng(2)
    v, w = rng.normal(size=(50, 20)), rng.integers(0, 4, (50, 6)).astype(float)
    rows = vectors(spark, [(v[i].tolist(), w[i].tolist()) for i in range(50)], "s array<double>, w array<double>").repartition(4)
    got = {r["draw"]: r["s"] for r in sum_vectors_by_draw(rows, "s", "w").collect()}
    assert all(np.allclose(got[b], w[:, b] @ v) for b in range(6))


# ---- moments far from zero ----------------------------------------------------------------------


def test_moments_keep_their_digits_far_from_zero(spark):
    from trialweave.functions import linalg as la
    from trialweave.operators.classify import _moments, leave_one_out_lda
    from trialweave.operators.stats import moved_by, pilot_mean, total_stats, trial_stats

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)) + 1e7
    y = (x[:, 0] - 1e7 > 0).astype(int)
    rows = vectors(spark, [(i % 8, int(y[i]), x[i].tolist(), [1.0]) for i in range(400)], "trial int, y int, x array<double>, q array<double>").repartition(5)
    exact = np.cov((x - 1e7).T, bias=True)
    pilot = pilot_mean(rows, "x")
    s = np.array(total_stats(trial_stats(moved_by(rows, "x", pilot), ["trial"], "x", "q")).first()["s"])
    assert np.allclose(la.covariances(s, 3, 1)[3], exact, rtol=1e-8)
    m = _moments(rows, [], "x", pilot).first()
    assert np.allclose(m["m"], x.mean(0), rtol=1e-14) and np.allclose(m["sd"], x.std(0), rtol=1e-8)
    far = leave_one_out_lda(rows, [], "trial", "y", "x").agg(F.sum("score")).first()[0]
    near = rows.withColumn("x", F.transform("x", lambda v: v - 1e7))
    assert far == pytest.approx(leave_one_out_lda(near, [], "trial", "y", "x").agg(F.sum("score")).first()[0], rel=1e-6)


def test_ledoit_wolf_follows_from_sums():
    from trialweave.functions import linalg as la

    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8)) @ rng.normal(size=(8, 8)) + rng.normal(size=8) * 3
    a, g = la.ledoit_wolf(x)
    b, h = la.ledoit_wolf_of_sums(la.gram(x, (x**2).sum(1, keepdims=True)), 8)
    assert 0 < g < 1 and g == pytest.approx(h, rel=1e-9) and np.allclose(a, b)


# ---- covariance classifiers ---------------------------------------------------------------------


def test_tangent_mean_is_the_riemannian_mean(spark):
    from trialweave.functions import linalg as la
    from trialweave.operators.classify import tangent_features, with_square_norm
    from trialweave.operators.stats import trial_stats

    rng = np.random.default_rng(7)
    mix = [rng.normal(size=(4, 4)) for _ in range(9)]
    rows = vectors(spark, [(k, t, (mix[k] @ rng.normal(size=4)).tolist()) for k in range(9) for t in range(80)], "trial int, t int, x array<double>")
    st = trial_stats(with_square_norm(rows), ["trial"], "x", "q").withColumn("model_fold", F.lit(0))
    got = np.array([r["x"] for r in tangent_features(st, st, ["model_fold"], ["trial"], 4, 1).collect()])
    assert got.shape == (9, 10) and np.abs(got.mean(0)).max() < 1e-5  # logarithms at the mean add up to zero
    covs = [la.oas(la.covariances(np.array(r["s"]), 4, 1)[3], r["s"][0]) for r in st.collect()]
    assert got.std() > 0.1 and len(covs) == 9


def test_components_of_each_training_part(spark):
    from trialweave.operators.principal import fold_components

    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 6)) @ rng.normal(size=(6, 6)) + 5
    rows = vectors(spark, [(i, i % 3, x[i].tolist()) for i in range(90)], "id int, fold int, x array<double>").repartition(4)
    got = {(r["id"], r["model_fold"]): (r["part"], np.array(r["x"])) for r in fold_components(rows, "fold", 3, "x", 2).collect()}
    assert len(got) == 270
    for f in range(3):
        train = x[np.arange(90) % 3 != f]
        z = (train - train.mean(0)) / train.std(0)
        _, _, v = np.linalg.svd(z, full_matrices=False)
        basis = v[:2].T * np.where(v[:2].T[np.abs(v[:2].T).argmax(0), range(2)] < 0, -1, 1)
        for i in (0, 1, 2, 44):
            part, values = got[i, f]
            assert part == ("test" if i % 3 == f else "train")
            assert np.allclose(values, (x[i] - train.mean(0)) / train.std(0) @ basis, atol=1e-8)


def test_permuted_curves_equal_direct_discriminants(spark):
    from trialweave.operators.decode_null import permuted_curves

    rng = np.random.default_rng(9)
    n, p, times = 24, 3, 2
    x, labels, fold = rng.normal(size=(n, times, p)), rng.integers(0, 2, (n, 4)), np.arange(n) % 2
    x[labels[:, 0] == 1, 1] += 1.0
    rows = vectors(spark, [(i, t, int(fold[i]), x[i, t].tolist()) for i in range(n) for t in range(times)], "trial int, t int, fold int, x array<double>")
    arrays = vectors(spark, [(i, labels[i].tolist()) for i in range(n)], "trial int, labels array<int>")
    got = {(r["t"], r["perm"]): r["v"] for r in permuted_curves(rows, ["t"], "fold", arrays, "trial", "x", p, 0.3).collect()}
    for t in range(times):
        for perm in range(4):
            score, y = np.zeros(n), labels[:, perm]
            for f in range(2):
                tr, te = fold != f, fold == f
                a, b = x[tr & (y == 1), t], x[tr & (y == 0), t]
                within = (np.cov(a.T, bias=True) * len(a) + np.cov(b.T, bias=True) * len(b)) / tr.sum()
                within = 0.7 * within + 0.3 * np.trace(within) / p * np.eye(p)
                w = np.linalg.solve(within, a.mean(0) - b.mean(0))
                score[te] = x[te, t] @ w - 0.5 * (a.mean(0) + b.mean(0)) @ w + np.log(len(a) / len(b))
            wins = np.mean([(score[i] > score[j]) + 0.5 * (score[i] == score[j]) for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0)])
            assert got[t, perm] == pytest.approx(wins, abs=1e-9)


# ---- nested folds -------------------------------------------------------------------------------


def test_partners_come_from_the_inner_training_part(spark):
    from trialweave.operators.nested import partners_outside, two_fold_train_stats

    rng = np.random.default_rng(10)
    fold = {i: int(rng.integers(0, 4)) for i in range(40)}
    trials = vectors(spark, [(i, i // 2, fold[i]) for i in range(40)], "trial long, stim long, fold int")
    rows = partners_outside(trials, 4, 3).collect()
    seen = {}
    for r in rows:
        assert fold[r["j"]] not in (r["outer"], fold[r["i"]]) and r["j"] // 2 != r["i"] // 2 and r["outer"] != fold[r["i"]]
        assert (r["lo"], r["hi"]) == tuple(sorted((r["outer"], fold[r["i"]])))
        seen.setdefault((r["i"], r["outer"]), set()).add(r["j"])
    assert set(seen) == {(i, o) for i in fold for o in range(4) if o != fold[i]} and all(len(v) == 3 for v in seen.values())
    stats = vectors(spark, [(i, fold[i], [1.0, float(i)]) for i in range(40)], "trial long, fold int, s array<double>")
    for r in two_fold_train_stats(stats).collect():
        left = [i for i in fold if fold[i] not in (r["lo"], r["hi"])]
        assert r["s"] == [float(len(left)), float(sum(left))]


# ---- windows, responses, tails ------------------------------------------------------------------


@pytest.mark.parametrize("width", [16, 4096])
def test_sliding_correlations(spark, width):
    from trialweave.operators.series import sliding_correlations

    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(2, 63, 2)) + 1e6, rng.normal(size=(2, 63, 1))
    x[0, :, 1] = 4.0
    rows = vectors(spark, [(k, t, x[k, t].tolist(), y[k, t].tolist()) for k in range(2) for t in range(63)], "trial long, t long, x array<double>, y array<double>")
    got = {(r["trial"], r["win"]): r["x"] for r in sliding_correlations(rows, "trial", "x", "y", 20, 6, width=width).collect()}
    assert set(got) == {(k, w) for k in range(2) for w in range(8)}
    for (k, w), r in got.items():
        a, b = x[k, 6 * w : 6 * w + 20], y[k, 6 * w : 6 * w + 20, 0]
        want = [np.corrcoef(a[:, c], b)[0, 1] if a[:, c].std() > 0 else 0.0 for c in range(2)]
        assert np.allclose(r, want, atol=1e-6)


def test_transfer_function(spark):
    from trialweave.operators.responses import transfer_function

    taps = [0.5, -0.2, 0.1]
    got = transfer_function(vectors(spark, [(1, taps)], "k int, h array<double>"), ["k"], "h", 64.0).orderBy("bin").collect()
    want = np.fft.rfft(taps, 256)
    assert [r["hz"] for r in got] == (np.arange(129) / 4).tolist()
    assert np.allclose([r["magnitude"] for r in got], np.abs(want)) and np.allclose([r["phase"] for r in got], np.angle(want), atol=1e-9)


def test_tail_probabilities(spark):
    from trialweave.functions.distributions import incomplete_beta, spearman_two_sided, student_two_sided

    assert incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248)
    assert np.allclose(incomplete_beta(np.array([1.0, 5.0, 500.0]), 1.0, 0.9), [0.9, 0.9**5, 0.9**500])
    rows = vectors(spark, [(2.228, 10.0), (0.0, 5.0), (-12.706, 1.0), (1.96, 1e7), (float("inf"), 3.0), (None, 3.0), (1.0, 0.0)], "t double, n double")
    p = [r[0] for r in rows.select(student_two_sided("t", "n")).collect()]
    assert p[:5] == [pytest.approx(v, abs=1e-4) for v in (0.05, 1.0, 0.05, 0.05, 0.0)] and p[5:] == [None, None]
    # one degree of freedom has a closed form
    one = vectors(spark, [(float(t),) for t in np.linspace(0.1, 30, 7)], "t double").select("t", student_two_sided("t", F.lit(1.0)).alias("p"))
    assert all(r["p"] == pytest.approx(1 - 2 * math.atan(r["t"]) / math.pi, abs=1e-12) for r in one.collect())
    rho = vectors(spark, [(-0.842, 20), (1.0, 9), (0.3, 2)], "rho double, n int").select(spearman_two_sided("rho", "n")).collect()
    assert rho[0][0] < 1e-4 and rho[1][0] == 0.0 and rho[2][0] is None


def test_recordings_round_trip_in_byte_ranges(spark, tmp_path):
    from trialweave.sources.multiplexed import scan_recordings, write_recordings

    rng = np.random.default_rng(12)
    x = {("a", 37): rng.normal(size=(37, 3)).astype("f4"), ("b", 8): rng.normal(size=(8, 3)).astype("f4"), ("c", 1): rng.normal(size=(1, 3)).astype("f4")}
    rows = [(name, t, [float(v) for v in m[t]]) for (name, n), m in x.items() for t in range(n)]
    path = f"file://{tmp_path}/rec"
    write_recordings(vectors(spark, rows[::-1], "recording string, t long, x array<double>").repartition(5), path)
    with open(tmp_path / "rec" / "b.eeg", "ab") as f:
        f.write(b"\0" * 7)  # a sample that was cut off
    back = scan_recordings(spark, path, 3, samples_per_split=8)
    assert back.rdd.getNumPartitions() == 5 + 1 + 1
    assert sorted((r["recording"], r["t"], r["x"]) for r in back.collect()) == sorted(rows)
