"""Models, classifiers and inference against NumPy on planted data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialweave.functions import linalg as la
from trialweave.operators.classify import cross_validated, csp_filters, fit_lda, train_rows, with_square_norm
from trialweave.operators.logistic import logistic_cross_validated
from trialweave.operators.components import unmixing, without_artifacts
from trialweave.operators.models import PRESETS, Spec, component_rows, fit, preset, score, variates
from trialweave.operators.ranks import auc, safe_corr
from trialweave.operators.resample import bootstrap_counts, mismatched_partners, permuted_labels, stratified_kfold
from trialweave.operators.stats import lagged_stats, mismatch_stats, sum_vectors, train_stats, trial_stats


def planted(spark, trials=6, n=200, c=5, delay=3, seed=5):
    """Channel 2 follows the stimulus ``delay`` samples later."""
    rng = np.random.default_rng(seed)
    y = rng.normal(size=(trials, n))
    x = rng.normal(size=(trials, n, c))
    x[:, delay:, 2] += 2 * y[:, : n - delay]
    rows = [(k, k % 3, t, x[k, t].tolist(), [float(y[k, t])]) for k in range(trials) for t in range(n)]
    return x, y, spark.createDataFrame(rows, "trial int, fold int, t bigint, x array<double>, y array<double>")


def lag(m, lags):
    return np.hstack([np.vstack([np.zeros((j, m.shape[1])), m[: len(m) - j]]) for j in lags])


def test_cca_and_scores_equal_direct_computation(spark):
    x, y, df = planted(spark)
    spec = Spec("cca", x_lags=2, y_lags=5, keep_x=8, k=2, shrink=0.1, rcond=1e-6)
    st = lagged_stats(df, ["trial", "fold"], "x", "y", [0, 1], range(5), width=64)
    models = fit(train_stats(st, "fold"), ["fold"], 5, 1, {"m": spec})
    got = score(models, st, ["fold"], ["trial"], 10, 5).where("comp = 0").toPandas().set_index("trial")["r"]
    for k in range(6):
        tr = [j for j in range(6) if j % 3 != k % 3]
        X = np.vstack([lag(x[j], [0, 1]) for j in tr])
        Y = np.vstack([lag(y[j][:, None], range(5)) for j in tr])
        cx, cy = np.cov(X.T, bias=True), np.cov(Y.T, bias=True)
        cxy = (X - X.mean(0)).T @ (Y - Y.mean(0)) / len(X)
        wx, vx = np.linalg.eigh(cx)
        wx, vx = wx[::-1][:8], vx[:, ::-1][:, :8]
        wx = 0.9 * wx + 0.1 * wx.mean()
        wy, vy = np.linalg.eigh(cy)
        wy = 0.9 * wy + 0.1 * wy.mean()
        u, _, vt = np.linalg.svd((vx / np.sqrt(wx)).T @ cxy @ (vy / np.sqrt(wy)))
        a, b = (vx / np.sqrt(wx)) @ u[:, 0], (vy / np.sqrt(wy)) @ vt[0]
        r = np.corrcoef(lag(x[k], [0, 1]) @ a, lag(y[k][:, None], range(5)) @ b)[0, 1]
        assert got[k] == pytest.approx(r, abs=1e-8)
    assert got.min() > 0.7  # the planted lag is found on trials that were not used


def test_held_out_trials_never_enter_training(spark):
    x, y, df = planted(spark)
    st = trial_stats(df, ["trial", "fold"], "x", "y")
    s = np.asarray(train_stats(st, "fold").where("fold = 1").head().s)
    X = np.vstack([x[j] for j in range(6) if j % 3 != 1])
    np.testing.assert_allclose(s, la.gram(X, np.concatenate([y[j] for j in range(6) if j % 3 != 1])[:, None]), atol=1e-8)


def test_variates_agree_with_statistics(spark):
    _, _, df = planted(spark)
    spec = Spec("cca", x_lags=2, y_lags=4, k=2, shrink=0.1, rcond=1e-6)
    st = lagged_stats(df, ["trial", "fold"], "x", "y", [0, 1], range(4), width=50)
    models = fit(train_stats(st, "fold"), ["fold"], 5, 1, {"m": spec})
    folds = df.select("trial", "fold").distinct()
    var = variates(df.select("trial", "t", "x"), df.select("trial", "t", "y"), models, folds, [0, 1], range(4), width=50)
    direct = component_rows(var).groupBy("trial", "comp").agg(safe_corr("a", "b").alias("d"))
    both = score(models, st, ["fold"], ["trial"], 10, 4).join(direct, ["trial", "comp"]).toPandas()
    assert len(both) == 12
    np.testing.assert_allclose(both["r"], both["d"], atol=1e-9)


def test_mismatch_statistics(spark):
    x, y, df = planted(spark)
    st = lagged_stats(df, ["trial"], "x", "y", [0, 1], [0, 2], width=60)
    pairs = spark.createDataFrame([(0, 3), (0, 5), (4, 1)], "i int, j int")
    got = mismatch_stats(df.select("trial", "t", "x"), df.select("trial", "t", "y"), pairs, [0, 1], [0, 2], width=60).collect()
    assert len(got) == 3
    for r in got:
        want = la.gram(lag(x[r.i], [0, 1]), lag(y[r.j][:, None], [0, 2]))
        np.testing.assert_allclose(np.asarray(r.s), want, atol=1e-9)


@pytest.mark.parametrize("edge", ["causal", "both"])
def test_mismatch_statistics_of_unequal_trials(spark, edge):
    """Lengths differ and one stimulus starts late: all parts are over the common samples."""
    rng = np.random.default_rng(5)
    lengths = [50, 30, 50, 40]
    x, y = [rng.normal(size=(n, 3)) for n in lengths], [rng.normal(size=n) for n in lengths]
    sig = spark.createDataFrame([(k, t, x[k][t].tolist()) for k in range(4) for t in range(lengths[k])], "trial int, t bigint, x array<double>")
    late = {3: 20}
    stim = spark.createDataFrame([(k, t, [float(y[k][t])]) for k in range(4) for t in range(late.get(k, 0), lengths[k])], "trial int, t bigint, y array<double>")
    pairs = [(0, 1), (0, 2), (0, 3), (1, 0), (2, 3), (3, 0), (1, 3)]
    got = mismatch_stats(sig, stim, spark.createDataFrame(pairs, "i int, j int"), [0, 1], [0, 2], edge=edge, width=16)
    got = {(r.i, r.j): np.asarray(r.s) for r in got.collect()}
    assert set(got) == set(pairs)
    for i, j in pairs:
        a, n = late.get(j, 0), min(lengths[i], lengths[j])
        u, v = lag(x[i][a:n], [0, 1]), lag(y[j][a:n, None], [0, 2])
        if edge == "both":
            t = np.arange(a, n)
            u[(t < 1) | (t >= n - 1)] = 0
            v[(t < 2) | (t >= n - 2)] = 0
        np.testing.assert_allclose(got[i, j], la.gram(u, v), atol=1e-9)


def test_presets_and_regressions(spark):
    x, y, df = planted(spark)
    assert preset("cca2").pre_pca == 80 and len(PRESETS) == 6
    with pytest.raises(KeyError):
        preset("nope")
    st = lagged_stats(df, ["trial", "fold"], "x", "y", [0], range(6), width=64)
    total = sum_vectors(st, [], "s")
    m = fit(total, [], 5, 1, {"forward": Spec("forward", y_lags=6)}).head()
    coef = np.asarray(m.ay).reshape(6, 5)
    Y = np.vstack([lag(v[:, None], range(6)) for v in y])
    X = x.reshape(-1, 5)
    want = np.linalg.lstsq(Y - Y.mean(0), X - X.mean(0), rcond=None)[0]
    np.testing.assert_allclose(coef, want, atol=1e-8)
    assert np.unravel_index(np.abs(coef).argmax(), coef.shape) == (3, 2)


def two_classes(spark, n=300, p=6, gap=1.2, seed=2):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + np.outer(y, np.r_[gap * 3, np.zeros(p - 1)])
    return x, y, spark.createDataFrame([(i, i % 4, int(y[i]), x[i].tolist()) for i in range(n)], "id int, fold int, y int, x array<double>")


@pytest.mark.parametrize("shrink", ["auto", 0.0])
def test_discriminant_equals_numpy(spark, shrink):
    x, y, df = two_classes(spark)
    m = fit_lda(df, [], "y", "x", shrink).head()
    mu, sd = la.standardiser(x)
    w, b = la.lda(la.clip8((x - mu) / sd), y, shrink)
    np.testing.assert_allclose(np.asarray(m.w), w, rtol=1e-6, atol=1e-9)
    assert m.b == pytest.approx(b, abs=1e-8)


def test_cross_validation_finds_classes_and_null_does_not(spark):
    _, _, df = two_classes(spark)
    good = auc(cross_validated(df, [], "fold", 4, "y", "x"), [], "y", "score").head().auc
    null = permuted_labels(df, "id", "y", 6).where("perm > 0")
    chance = auc(cross_validated(null, ["perm"], "fold", 4, "y", "x"), ["perm"], "y", "score").agg(F.avg("auc")).head()[0]
    logit = auc(logistic_cross_validated(df, [], "fold", "y", "x"), [], "y", "score").head().auc
    assert good > 0.8 and logit > 0.8 and abs(chance - 0.5) < 0.08


@pytest.mark.parametrize("n, ones, shrink", [(60, 25, "auto"), (12, 1, 0.1)])
def test_label_arrays_give_the_scores_of_a_fit_per_permutation(spark, n, ones, shrink):
    from trialweave.operators.decode_null import label_rows

    _, _, df = two_classes(spark, n, 5)
    df = df.withColumn("y", (F.col("id") % 12 < ones / n * 12).cast("int"))
    df = df.unionByName(df.where("id < 3")).unionByName(df.where("id < 1"))  # ids may repeat
    direct = cross_validated(permuted_labels(df, "id", "y", 40), ["perm"], "fold", 4, "y", "x", shrink)
    labels = label_rows(permuted_labels(df.select("id", "y"), "id", "y", 40), "id", 40)
    rows = labels.join(df.select("id", "fold", "x").dropDuplicates(["id"]), "id").repartition(5)
    packed = cross_validated(rows, [], "fold", 4, "labels", "x", shrink)
    listed = lambda d: sorted((r["perm"], r["model_fold"], r["y"], r["score"]) for r in d.collect())
    got, want = listed(packed), listed(direct)
    assert [r[:3] for r in got] == [r[:3] for r in want] and {r[0] for r in want} == set(range(41))
    np.testing.assert_allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-7, atol=1e-7)
    assert len(want) == 41 * df.count() or ones == 1  # no model where the training rows are of one class


def test_whole_window_decoder_draws_a_thousand_permutations(spark, sf):
    from trialweave.plans import model_plans as m

    got = m.whole_window_decoder(spark, sf).collect()
    n = m.trial_condition(spark, sf).count()
    assert len(got) == 1 and got[0].n_perm == 1000 and 0 <= got[0].n_ge <= 1000
    assert got[0].p == pytest.approx((got[0].n_ge + 1) / 1001, abs=1e-6)
    assert got[0].c00 + got[0].c01 + got[0].c10 + got[0].c11 == n


def test_permuted_labels_keep_counts(spark):
    _, y, df = two_classes(spark)
    got = permuted_labels(df.drop("x"), "id", "y", 5).groupBy("perm").agg(F.sum("y").alias("s"), F.count("*").alias("n")).collect()
    assert {(r.s, r.n) for r in got} == {(int(y.sum()), 300)} and len(got) == 6


def test_spatial_filters_separate_power(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        x = rng.normal(size=(200, 4))
        x[:, k % 2] *= 4
        rows += [(k, k % 2, r.tolist(), [0.0]) for r in x]
    st = trial_stats(with_square_norm(spark.createDataFrame(rows, "trial int, y int, x array<double>, z array<double>")), ["trial", "y"], "x", "q")
    f = csp_filters(st.withColumn("m", F.lit(0)), ["m"], "y", 4, 2).head().filters
    assert set(np.abs(np.asarray(f).reshape(4, 2)).argmax(0)) == {0, 1}


def test_artifact_component_is_removed(spark):
    rng = np.random.default_rng(9)
    n = 3000
    blink = np.where(rng.random(n) < 0.02, rng.normal(12, 1, n), 0.0)
    brain = rng.laplace(size=(n, 4))
    mix = rng.normal(size=(5, 6))
    x = np.column_stack([blink, brain]) @ mix + 0.01 * rng.normal(size=(n, 6))
    x = np.column_stack([blink + 0.05 * rng.normal(size=n), x])
    df = spark.createDataFrame([(0, t, x[t].tolist()) for t in range(n)], "trial int, t bigint, x array<double>")
    cleaned, ledger = without_artifacts(df, "x", [0], 5, z_limit=10.0, hf_limit=1e9)
    assert sum(r["removed"] for r in ledger) == 1
    out = np.stack(cleaned.orderBy("t").toPandas()["x"].to_list())
    for c in range(1, 7):
        assert abs(np.corrcoef(out[:, c], blink)[0, 1]) < 0.1


def test_partners_never_share_the_stimulus(spark):
    df = spark.range(40).select(F.col("id").alias("trial"), F.when(F.col("id") < 14, 0).otherwise(F.col("id") % 9).alias("stim"))
    got = mismatched_partners(df, "trial", "stim", 4)
    stim = {r.trial: r.stim for r in df.collect()}
    rows = got.collect()
    assert len(rows) == 160 and len({(r.i, r.j) for r in rows}) == 160
    assert all(stim[r.i] != stim[r.j] for r in rows)


def test_bootstrap_counts_add_up(spark):
    df = spark.range(57).select(F.col("id"), (F.col("id") % 2).alias("g"))
    got = bootstrap_counts(df, ["g"], "id", 20).groupBy("boot", "g").agg(F.sum("mult").alias("m")).collect()
    assert {r.m for r in got} == {28, 29} and len(got) == 40


def test_stratified_folds_are_even(spark):
    df = spark.range(103).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    c = stratified_kfold(df, "id", "y", 5).groupBy("y", "fold").count().toPandas()
    assert c.groupby("y")["count"].agg(lambda s: s.max() - s.min()).max() <= 1



def test_tangent_space_separates_covariances(spark):
    from trialweave.operators.classify import lda_scores, tangent_features

    rng = np.random.default_rng(11)
    rows = []
    for k in range(16):
        mix = np.eye(3) + (0.9 if k % 2 else 0.0) * np.array([[0, 1, 0], [0, 0, 0], [0, 0, 0]])
        rows += [(k, k % 2, r.tolist(), [0.0]) for r in rng.normal(size=(150, 3)) @ mix]
    st = trial_stats(spark.createDataFrame(rows, "trial int, y int, x array<double>, z array<double>"), ["trial", "y"], "x", "z")
    st = st.withColumn("mf", F.lit(0))
    feats = tangent_features(st, st, ["mf"], ["trial", "y"], 3, 1, rounds=4)
    mean = np.stack(feats.toPandas()["x"].to_list()).mean(0)
    np.testing.assert_allclose(mean, 0, atol=1e-3)  # the fixed point is the mean of the tangent vectors
    sc = lda_scores(feats, fit_lda(feats, ["mf"], "y", "x"), ["mf"], "x")
    assert auc(sc, [], "y", "score").head().auc > 0.95


def test_visual_embedding_fills_missing_values(spark):
    from trialweave.operators.components import visual_embedding
    from trialweave.operators.spectral import band_pass

    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 4))
    df = spark.createDataFrame([(0, t, x[t].tolist()) for t in range(120)], "trial int, t bigint, x array<double>")
    out = visual_embedding(df, "x", [0], 2, band_pass(2.0, 10.0, 64.0, 8)).toPandas()
    assert len(out) == 360 and np.isfinite(out["z"]).all()
    assert out.groupby("feature")["z"].std(ddof=0).between(0.999, 1.001).all()


def test_estimator_matches_functions(spark):
    from trialweave.operators.estimators import StimulusResponse

    x, y, df = planted(spark)
    got = StimulusResponse(Spec("cca", y_lags=5, k=1, shrink=0.1, rcond=1e-6), 5, 1, width=64).fit(df).transform(df).toPandas()
    assert len(got) == 6 and got["r"].min() > 0.7


def test_sums_in_parts_equal_direct_sums(spark):
    x, y, df = planted(spark)
    st = lagged_stats(df.repartition(8), ["trial"], "x", "y", [0, 1], [0], width=16)
    s = np.asarray(sum_vectors(st, [], "s").head().s)
    X = np.vstack([lag(v, [0, 1]) for v in x])
    np.testing.assert_allclose(s, la.gram(X, y.reshape(-1, 1)), atol=1e-8)
