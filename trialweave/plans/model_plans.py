"""Statistics, linear models, classifiers and their cross-validated scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.blocks import DEFAULT_WIDTH
from ..operators.classify import (
    cross_validated, csp_filters, fit_lda, lda_scores, log_power, probability, tangent_features, test_rows,
    train_rows, with_square_norm,
)
from ..operators.decode_null import label_rows
from ..operators.logistic import fit_logistic_folds, logistic_cross_validated, logistic_scores
from ..operators.models import (
    PRESETS, Spec, component_rows, eigenspectrum, fit, grid_models, patterns, score, top_k_mean, variates,
)
from ..operators.lag_products import fold_scores, lag_products, lagged_sums
from ..operators.ordered import ntile_of
from ..operators.ranks import auc, cohens_d, confusion, safe_corr
from ..operators.resample import kfold, mismatched_partners, permutation_p, permuted_labels, stratified_kfold
from ..operators.selection import decimated
from ..operators.series import equal_windows, lengths
from ..operators.spectral import log_bands, band_pass, fir_bank
from ..operators.stats import lagged_stats, mismatch_stats, moved_by, pilot_mean, sum_vectors, total_stats, train_stats, trial_stats
from .adapters import COND, LONG, SIG, STIM, md5_sql, signal, signal_long, stimulus, trial_condition
from ..session import written
from .registry import query
from .signal_plans import _psd, window_features

P = 64
FOLDS = 4
BLOCK = DEFAULT_WIDTH
FOLD_SQL = f"fo AS (SELECT trial, CAST(ntile({FOLDS}) OVER (ORDER BY {md5_sql('fold', 'trial')}, trial) - 1 AS INTEGER) AS fold FROM (SELECT DISTINCT trial FROM sig))"


def _views(spark, sf):
    sig = signal(spark, sf).select("trial", "t", "x")
    stim = stimulus(spark, sf).select("trial", "t", F.array("s").alias("y"))
    return sig, stim, sig.join(stim, ["trial", "t"])


def _folds(spark, sf, k: int = FOLDS):
    return written(kfold(signal(spark, sf).select("trial").distinct(), "trial", k), "folds")


def _fold_stats(spark, sf, spec: Spec, shifts=None):
    """Trial statistics with their fold, and the number of columns of both views."""
    _, _, both = _views(spark, sf)
    st = lagged_stats(both, ["trial"], "x", "y", spec.x_basis(), spec.y_basis(), width=BLOCK, shifts=shifts)
    # the statistics table is read by training sums, held-out scores and nulls: write it once
    return written(st.join(_folds(spark, sf), "trial"), "trial-stats"), P * spec.x_basis().size, spec.y_basis().size


@query(
    "pooled_covariance", "A15 A16 G5 Q15",
    f"""WITH {LONG}, m AS (SELECT ch, avg(v) AS m FROM long GROUP BY ch) SELECT a.ch AS i, b.ch AS j, round(avg(a.v * b.v) - any_value(ma.m) * any_value(mb.m), 8) AS cov
    FROM long a JOIN long b ON a.trial = b.trial AND a.t = b.t JOIN m ma ON ma.ch = a.ch JOIN m mb ON mb.ch = b.ch GROUP BY a.ch, b.ch""",
)
def pooled_covariance(spark: SparkSession, sf: str) -> DataFrame:
    """Population covariance of all channels from sums about a pilot mean."""
    _, _, both = _views(spark, sf)
    both = moved_by(both, "x", pilot_mean(both, "x"))
    s = total_stats(trial_stats(both, ["trial"], "x", "y", "t"))
    return s.select("s", F.posexplode(F.slice("s", 1 + P + 2, P * P)).alias("i", "xx")).select(
        F.floor(F.col("i") / P).cast("int").alias("i"), (F.col("i") % P).cast("int").alias("j"),
        F.round(
            F.col("xx") / F.col("s")[0]
            - F.get("s", 1 + F.floor(F.col("i") / P).cast("int")) / F.col("s")[0] * F.get("s", 1 + (F.col("i") % P).cast("int")) / F.col("s")[0], 8
        ).alias("cov"),
    )


@query(
    "channel_correlation", "A7",
    f"""WITH {LONG}, r AS (SELECT a.ch, b.ch AS other, corr(a.v, b.v) AS r FROM long a JOIN long b ON a.trial = b.trial AND a.t = b.t WHERE a.ch <> b.ch GROUP BY ALL) SELECT ch, round(avg(abs(r)), 6) AS mean_abs_r FROM r GROUP BY ch""",
)
def channel_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return mean_abs_correlation(spark, sf).withColumn("mean_abs_r", F.round("mean_abs_r", 6))


def mean_abs_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Mean absolute correlation of each channel with the others, from pooled statistics."""
    import numpy as np

    from ..functions.linalg import covariances
    from ..operators.stats import map_rows

    def one(row):
        c = covariances(np.asarray(row["s"]), P, 1)[3]
        sd = np.sqrt(np.diag(c))
        r = np.abs(c / np.outer(sd, sd))
        for ch, v in enumerate((r.sum(1) - 1.0) / (P - 1)):
            yield (ch, float(v))

    _, _, both = _views(spark, sf)
    both = moved_by(both, "x", pilot_mean(both, "x"))
    s = total_stats(trial_stats(both, ["trial"], "x", "y", "t"))
    return map_rows(s, one, "ch int, mean_abs_r double")


@query(
    "fold_training_sums", "A17 O9",
    f"""WITH {LONG}, {STIM}, {FOLD_SQL}, j AS (SELECT fo.fold, ch, v, s FROM long JOIN stim USING (trial, t) JOIN fo USING (trial)), k AS (SELECT CAST(f AS INTEGER) AS fold FROM range({FOLDS}) r(f))
    SELECT k.fold, ch, count(*) AS n, round(sum(v * s), 6) AS xy FROM k JOIN j ON j.fold <> k.fold GROUP BY ALL""",
)
def fold_training_sums(spark: SparkSession, sf: str) -> DataFrame:
    _, _, both = _views(spark, sf)
    st = trial_stats(both, ["trial"], "x", "y", "t").join(_folds(spark, sf), "trial")
    tr = train_stats(st, "fold")
    xy = F.slice("s", 1 + P + 1 + P * P + 1 + 1, P)
    return tr.select("fold", F.col("s")[0].cast("bigint").alias("n"), F.posexplode(xy).alias("ch", "xy")).select("fold", "ch", "n", F.round("xy", 6).alias("xy"))


ALPHAS = (0.01, 1.0, 100.0)


@query(
    "ridge_response", "M14 M15 M13 K4 J13",
    f"""WITH {LONG}, {STIM}, {FOLD_SQL}, l AS (SELECT trial, t, s AS a, coalesce(lag(s) OVER (PARTITION BY trial ORDER BY t), 0.0) AS b FROM stim),
    j AS (SELECT fo.fold, ch, a, b, v FROM long JOIN l USING (trial, t) JOIN fo USING (trial)), k AS (SELECT CAST(f AS INTEGER) AS fold FROM range({FOLDS}) r(f)),
    tr AS (SELECT k.fold, ch, count(*) * var_pop(a) AS aa, count(*) * var_pop(b) AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, v) AS av, count(*) * covar_pop(b, v) AS bv FROM k JOIN j ON j.fold <> k.fold GROUP BY ALL),
    w AS (SELECT fold, ch, al, ((bb + al) * av - ab * bv) / ((aa + al) * (bb + al) - ab * ab) AS wa, ((aa + al) * bv - ab * av) / ((aa + al) * (bb + al) - ab * ab) AS wb FROM tr, (VALUES {', '.join(f'({a}::DOUBLE)' for a in ALPHAS)}) g(al)),
    sc AS (SELECT w.fold, w.al, w.ch, corr(wa * a + wb * b, v) AS r FROM w JOIN j ON j.fold = w.fold AND j.ch = w.ch GROUP BY ALL)
    SELECT al AS alpha, ch, round(avg(r), 5) AS r, al = (SELECT al FROM (SELECT al, avg(r) AS m FROM sc GROUP BY al) ORDER BY round(m, 9) DESC, al LIMIT 1) AS selected FROM sc GROUP BY al, ch""",
)
def ridge_response(spark: SparkSession, sf: str) -> DataFrame:
    """Temporal response with two delays, ridge strength chosen by held-out correlation."""
    spec = Spec("ridge_forward", y_lags=2)
    st, p, q = _fold_stats(spark, sf, spec)
    grid = {str(a): Spec("ridge_forward", y_lags=2, alpha=a) for a in ALPHAS}
    models = fit(train_stats(st, "fold"), ["fold"], P, 1, grid)
    held = sum_vectors(st, ["fold"], "s")
    sc = score(models, held, ["fold"], [], p, q)
    best = sc.groupBy("model").agg(F.avg("r").alias("m")).agg(
        F.max_by("model", F.struct(F.round("m", 9), -F.col("model").cast("double"))).alias("best")
    )
    out = sc.groupBy("model", "comp").agg(F.round(F.avg("r"), 5).alias("r")).crossJoin(F.broadcast(best))
    return out.select(F.col("model").cast("double").alias("alpha"), F.col("comp").alias("ch"), "r", (F.col("model") == F.col("best")).alias("selected"))


@query("cca_tracking", "M4 M5 M6 M8 M1 M2 D12")
def cca_tracking(spark: SparkSession, sf: str) -> DataFrame:
    """Regularised CCA over lagged signal and stimulus: held-out score of every trial."""
    spec = Spec("cca", x_lags=4, y_lags=4, keep_x=30, k=3, shrink=0.15, rcond=1e-6)
    st, p, q = _fold_stats(spark, sf, spec)
    models = written(fit(train_stats(st, "fold"), ["fold"], P, 1, {"rcca": spec}), "models")
    sc = score(models, st, ["fold"], ["trial"], p, q)
    return top_k_mean(sc, ["fold", "trial", "model"], 3).withColumn("r", F.round("r", 6))


@query("model_presets", "M11 M12 M13 M3 G2 Q1")
def model_presets(spark: SparkSession, sf: str) -> DataFrame:
    """All six named models side by side: best component (or best channel) on held-out folds.

    One scan makes the lag products that five of them share; the sixth has moving averages on both sides.
    """
    _, _, both = _views(spark, sf)
    rows = both.join(F.broadcast(_folds(spark, sf)), "trial")
    lagged = {n: s for n, s in PRESETS.items() if not s.smooth}
    lags = max(s.x_lags for s in lagged.values()), max(s.y_lags for s in lagged.values())
    sc = fold_scores(lag_products(rows, "trial", ["fold"], *lags, width=BLOCK), P, 1, lagged, lags=lags)
    for name, spec in PRESETS.items():
        if spec.smooth:
            table = lagged_sums(rows, ["trial"], ["fold"], "x", "y", spec.x_basis(), spec.y_basis(), width=BLOCK)
            sc = sc.unionByName(fold_scores(table, P, 1, {name: spec}))
    out = sc.groupBy("model", "fold").agg(F.max("r").alias("best_in_test"))
    sizes = spark.createDataFrame([(n, s.kind, s.x_basis().size, s.y_basis().size) for n, s in PRESETS.items()], "model string, kind string, x_lags int, y_lags int")
    return out.join(F.broadcast(sizes), "model").select("model", "kind", "x_lags", "y_lags", "fold", F.round("best_in_test", 6).alias("best_in_test"))


@query("smoother_model", "M18 W5 G1")
def smoother_model(spark: SparkSession, sf: str) -> DataFrame:
    """The filter-bank CCA: moving averages of all widths on both sides, mean held-out score of each component."""
    spec = PRESETS["cca3"]
    _, _, both = _views(spark, sf)
    rows = both.join(F.broadcast(_folds(spark, sf)), "trial")
    table = lagged_sums(rows, ["trial"], ["fold"], "x", "y", spec.x_basis(), spec.y_basis(), width=BLOCK)
    return fold_scores(table, P, 1, {"smooth": spec}).groupBy("model", "comp").agg(F.round(F.avg("r"), 6).alias("r"))


def _mismatch(spark, sf, spec, st, p, q, m: int = 3):
    sig, stim, _ = _views(spark, sf)
    trials = sig.select("trial").distinct().withColumn("stim", F.col("trial"))
    pairs = mismatched_partners(trials, "trial", "stim", m)
    cross = mismatch_stats(sig, stim, pairs, spec.x_basis(), spec.y_basis(), width=BLOCK)
    return cross.join(st.select(F.col("trial").alias("i"), "fold"), "i")


@query("null_corrected_tracking", "M9 J10")
def null_corrected_tracking(spark: SparkSession, sf: str) -> DataFrame:
    """Matched score minus the mean score against other trials' stimuli."""
    spec = Spec("cca", x_lags=2, y_lags=4, keep_x=20, k=3, shrink=0.15, rcond=1e-6)
    st, p, q = _fold_stats(spark, sf, spec)
    models = written(fit(train_stats(st, "fold"), ["fold"], P, 1, {"rcca": spec}), "models")
    matched = top_k_mean(score(models, st, ["fold"], ["trial"], p, q), ["trial"], 3).withColumnRenamed("r", "matched")
    null = score(models, _mismatch(spark, sf, spec, st, p, q), ["fold"], ["i", "j"], p, q)
    null = top_k_mean(null, ["i", "j"], 3).groupBy(F.col("i").alias("trial")).agg(F.avg("r").alias("null_mean"))
    return matched.join(null, "trial").select(
        "trial", F.round("matched", 6).alias("matched"), F.round("null_mean", 6).alias("null_mean"), F.round(F.col("matched") - F.col("null_mean"), 6).alias("tracking")
    )


@query("nested_selection", "M9 J13 K4 O6")
def nested_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Kept directions and shrinkage chosen by null-corrected cross-validation over all folds.

    The score of the chosen cell is biased upward; ``nested_tracking`` chooses inside every training part.
    """
    spec = Spec("cca", x_lags=2, y_lags=2, k=2, rcond=1e-6)
    st, p, q = _fold_stats(spark, sf, spec)
    models = written(grid_models(train_stats(st, "fold"), ["fold"], P, 1, spec, [10, 20, 40], [0.05, 0.3]), "grid-models")
    cells = models.select("model", "cell", "keep", "shrink").distinct()
    matched = top_k_mean(score(models, st, ["fold"], ["trial"], p, q), ["model", "trial"], 2)
    null = top_k_mean(score(models, _mismatch(spark, sf, spec, st, p, q), ["fold"], ["i", "j"], p, q), ["model", "i", "j"], 2)
    null = null.groupBy("model", F.col("i").alias("trial")).agg(F.avg("r").alias("n"))
    cv = matched.join(null, ["model", "trial"]).groupBy("model").agg(F.avg(F.col("r") - F.col("n")).alias("cv"))
    best = cv.join(cells, "model").agg(F.max_by("cell", F.struct("cv", -F.col("cell"))).alias("best"))
    return cv.join(cells, "model").crossJoin(F.broadcast(best)).select(
        "cell", "keep", "shrink", F.round("cv", 6).alias("cv"), (F.col("cell") == F.col("best")).alias("selected")
    )


SHIFTS = list(range(-4, 9, 2))


@query("shift_curves", "M16 M17 M18 J14 O7 Q5")
def shift_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out correlation over the global shift for backward, forward and CCA models, one scan."""
    spec = Spec("cca", y_lags=3, keep_x=30, k=1, shrink=0.1, rcond=1e-6)
    st, p, q = _fold_stats(spark, sf, spec, SHIFTS)
    models = fit(train_stats(st, "fold", ["shift"]), ["shift", "fold"], P, 1, {
        "backward": Spec("backward", y_lags=3, keep_x=30, rcond=1e-6), "forward": Spec("relative_ridge_forward", y_lags=3), "cca": spec,
    })
    held = sum_vectors(st, ["shift", "fold"], "s")
    sc = score(models, held, ["shift", "fold"], [], p, q)
    mean = sc.groupBy("model", "shift", "comp").agg(F.avg("r").alias("r"))
    curve = mean.groupBy("model", "shift").agg(F.max_by("comp", F.struct("r", -F.col("comp"))).alias("best_comp"), F.max("r").alias("r"))
    top = curve.groupBy("model").agg(F.max_by("shift", F.struct("r", -F.col("shift"))).alias("best_shift"))
    return curve.join(top, "model").select("model", "shift", "best_comp", F.round("r", 6).alias("r"), (F.col("shift") == F.col("best_shift")).alias("peak"))


@query("component_patterns", "M19 M27 W26 A19")
def component_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Activation patterns of the all-data CCA, signed so the largest weight is positive."""
    from ..operators.series import sign_fixed

    spec = Spec("cca", y_lags=4, keep_x=30, k=3, shrink=0.1, rcond=1e-6)
    _, _, both = _views(spark, sf)
    total = total_stats(lagged_stats(both, ["trial"], "x", "y", spec.x_basis(), spec.y_basis(), width=BLOCK))
    pt = patterns(fit(total, [], P, 1, {"rcca": spec}), total, [], P, 4)
    long = pt.select("comp", F.posexplode("px").alias("ch", "weight"))
    return sign_fixed(long, ["comp"], "ch", "weight").select("comp", "ch", F.round("weight", 6).alias("weight"))


@query("condition_patterns", "M20 M21")
def condition_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Ridge response per attended condition, and the common filter seen through each covariance."""
    spec = Spec("ridge_forward", y_lags=4, alpha=1.0)
    st, p, q = _fold_stats(spark, sf, spec)
    by_label = sum_vectors(st.join(trial_condition(spark, sf), "trial"), ["y"], "s")
    common = fit(total_stats(st), [], P, 1, {"cca": Spec("cca", y_lags=4, keep_x=20, k=1, shrink=0.1, rcond=1e-6)})
    pt = _patterns_by_label(common, by_label, p, q)
    trf = fit(by_label, ["y"], P, 1, {"response": spec}).select(F.col("y"), F.posexplode("ay").alias("i", "w"))
    trf = trf.select("y", F.lit("response").alias("kind"), "i", "w")
    return trf.unionByName(pt).select("y", "kind", "i", F.round("w", 6).alias("w"))


def _patterns_by_label(common: DataFrame, by_label: DataFrame, p: int, q: int) -> DataFrame:
    tagged = by_label.crossJoin(F.broadcast(common))
    models = tagged.select("y", "model", "k", "ax", "ay")
    pt = patterns(models, by_label, ["y"], p, q)
    return pt.select("y", F.lit("pattern").alias("kind"), F.posexplode("px").alias("i", "w"))


@query("variates", "M7")
def variates_query(spark: SparkSession, sf: str) -> DataFrame:
    var = _variates(spark, sf)
    return component_rows(var).groupBy("trial", "comp").agg(F.round(safe_corr("a", "b"), 6).alias("r"), F.count(F.lit(1)).alias("n"))


def _variates(spark, sf):
    spec = Spec("cca", x_lags=2, y_lags=4, keep_x=20, k=3, shrink=0.15, rcond=1e-6)
    st, p, q = _fold_stats(spark, sf, spec)
    models = written(fit(train_stats(st, "fold"), ["fold"], P, 1, {"rcca": spec}), "models")
    sig, stim, _ = _views(spark, sf)
    out = variates(sig, stim, models, _folds(spark, sf), spec.x_basis(), spec.y_basis(), width=BLOCK)
    return written(out, "variates")


@query("tracking_features", "M36 M35 W13 A32 K1")
def tracking_features(spark: SparkSession, sf: str) -> DataFrame:
    """Per-trial tracking: engagement, mean, first component, early, late, slope and spread over six windows.

    Engagement is the mean less that against three other trials' stimuli.
    """
    var = _variates(spark, sf)
    rows = component_rows(var)
    rows = rows.join(lengths(rows, ["trial"]), "trial").withColumn("win", equal_windows(F.col("t"), F.col("_len"), 6))
    whole = rows.groupBy("trial", "comp").agg(safe_corr("a", "b").alias("r")).groupBy("trial").agg(
        F.avg("r").alias("mean_r"), F.max(F.when(F.col("comp") == 0, F.col("r"))).alias("first_r")
    )
    win = rows.groupBy("trial", "win", "comp").agg(safe_corr("a", "b").alias("r")).groupBy("trial", "win").agg(F.avg("r").alias("r"))
    shape = win.groupBy("trial").agg(
        F.avg(F.when(F.col("win") < 3, F.col("r"))).alias("early"), F.avg(F.when(F.col("win") >= 3, F.col("r"))).alias("late"),
        F.regr_slope("r", F.col("win").cast("double")).alias("slope"), F.stddev_pop("r").alias("spread"),
    )
    out = whole.join(shape, "trial").join(mismatch_mean(var, 3), "trial").withColumn("engagement", F.col("mean_r") - F.col("null_r")).drop("null_r")
    return out.select("trial", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def mismatch_mean(var: DataFrame, m: int) -> DataFrame:
    """``(trial, null_r)``: mean correlation of a trial's signal variates with those of ``m`` other trials' stimuli."""
    trials = var.select("trial").distinct().withColumn("stim", F.col("trial"))
    pairs = mismatched_partners(trials, "trial", "stim", m)
    u = var.select(F.col("trial").alias("i"), "t", "u")
    v = var.select(F.col("trial").alias("j"), "t", "v")
    z = pairs.join(u, "i").join(v, ["j", "t"]).select("i", "j", F.posexplode(F.arrays_zip("u", "v")).alias("comp", "z"))
    r = z.groupBy("i", "j", "comp").agg(safe_corr("z.u", "z.v").alias("r"))
    return r.groupBy(F.col("i").alias("trial")).agg(F.avg("r").alias("null_r"))


@query("attention_decision", "M32 W18")
def attention_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Audio or visual by the sign of the difference of standardised tracking scores."""
    spec = Spec("ridge_backward", x_lags=2, alpha=1.0)
    st, p, q = _fold_stats(spark, sf, spec)
    models = fit(train_stats(st, "fold"), ["fold"], P, 1, {"a": spec, "b": Spec("backward", x_lags=2, keep_x=10)})
    sc = score(models, st, ["fold"], ["trial"], p, q).groupBy("trial", "model").agg(F.avg("r").alias("r"))
    stat = sc.groupBy("model").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    z = sc.join(F.broadcast(stat), "model").withColumn("z", (F.col("r") - F.col("m")) / F.coalesce(F.nullif("s", F.lit(0.0)), F.lit(1.0)))
    d = z.groupBy("trial").agg(F.sum(F.when(F.col("model") == "a", F.col("z")).otherwise(-F.col("z"))).alias("d"))
    return d.join(trial_condition(spark, sf), "trial").select("trial", "y", F.round("d", 6).alias("d"), F.when(F.col("d") > 0, 1).otherwise(0).alias("pred"))


@query("match_accuracy_by_window", "M34 W11")
def match_accuracy_by_window(spark: SparkSession, sf: str) -> DataFrame:
    """Share of windows in which the own stimulus beats the mean of three others, by length."""
    var = _variates(spark, sf)
    trials = var.select("trial").distinct().withColumn("stim", F.col("trial"))
    pairs = mismatched_partners(trials, "trial", "stim", 3)
    own = pairs.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(True).alias("match"))
    every = own.unionByName(pairs.withColumn("match", F.lit(False)))
    u = var.select(F.col("trial").alias("i"), "t", "u")
    v = var.select(F.col("trial").alias("j"), "t", "v")
    rows = every.join(u, "i").join(v, ["j", "t"]).withColumn("size", F.explode(F.array(*[F.lit(w) for w in (10, 16, 25)])))
    rows = rows.select("i", "j", "match", "size", F.floor(F.col("t") / F.col("size")).alias("win"), F.posexplode(F.arrays_zip("u", "v")).alias("comp", "z"))
    r = rows.groupBy("i", "j", "match", "size", "win", "comp").agg(safe_corr("z.u", "z.v").alias("r"), F.count(F.lit(1)).alias("n"))
    r = r.where(F.col("n") == F.col("size")).groupBy("i", "j", "match", "size", "win").agg(F.avg("r").alias("r"))
    w = r.groupBy("i", "size", "win").agg(F.avg(F.when(F.col("match"), F.col("r"))).alias("sm"), F.avg(F.when(~F.col("match"), F.col("r"))).alias("sc"))
    return w.groupBy("size").agg(F.round(F.avg((F.col("sm") > F.col("sc")).cast("double")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n_windows"))


@query("hierarchy_tracking", "M37 A29")
def hierarchy_tracking(spark: SparkSession, sf: str) -> DataFrame:
    """Tracking of several stimulus levels (sub-bands) and its effect between conditions."""
    bands = [band_pass(lo, hi, 64.0, 8) for lo, hi in log_bands(1.0, 16.0, 3)]
    sig, stim, _ = _views(spark, sf)
    lev = fir_bank(stim.withColumnRenamed("y", "x"), ["trial"], "x", bands, out="y", width=BLOCK)
    lev = lev.select("trial", "t", F.posexplode("y").alias("level", "v")).select("trial", "t", "level", F.array("v").alias("y"))
    spec = Spec("cca", y_lags=4, keep_x=20, k=3, shrink=0.15, rcond=1e-6)
    st = lagged_stats(sig.join(lev, ["trial", "t"]), ["level", "trial"], "x", "y", spec.x_basis(), spec.y_basis(), width=BLOCK).join(_folds(spark, sf), "trial")
    models = fit(train_stats(st, "fold", ["level"]), ["level", "fold"], P, 1, {"rcca": spec})
    r = top_k_mean(score(models, st, ["level", "fold"], ["trial"], P, 4), ["level", "trial"], 2).join(trial_condition(spark, sf), "trial")
    y = F.col("y")
    return r.groupBy("level").agg(
        F.round(F.avg(F.when(y == 1, F.col("r"))), 6).alias("audio"), F.round(F.avg(F.when(y == 0, F.col("r"))), 6).alias("visual"), F.round(cohens_d(y, F.col("r")), 6).alias("d")
    )


@query("covariance_spectrum", "M40")
def covariance_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    _, _, both = _views(spark, sf)
    both = moved_by(both, "x", pilot_mean(both, "x"))
    return eigenspectrum(total_stats(trial_stats(both, ["trial"], "x", "y", "t")), P, 1, 30).withColumn("share", F.round("share", 8))


def _window_rows(spark, sf):
    """Labelled window vectors: the group is the trial, so windows of a trial share a fold."""
    rows = signal(spark, sf).select("trial", "t", "x", F.when(F.col("label") < 5, 1).otherwise(0).alias("y"))
    return rows.join(_folds(spark, sf), "trial")


@query("window_probe", "M22 R4 G4 P12")
def window_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Shrinkage discriminant on window vectors with grouped folds; trial score is the mean probability."""
    sc = cross_validated(_window_rows(spark, sf), [], "fold", FOLDS, "y", "x")
    a = auc(sc.withColumn("score", F.round("score", 9)), ["model_fold"], "y", "score")
    t = sc.groupBy("model_fold", "trial").agg(F.avg(probability(F.col("score"))).alias("p"))
    t = t.groupBy("model_fold").agg(F.avg("p").alias("mean_p"), F.count(F.lit(1)).alias("n_trials"))
    return a.join(t, "model_fold").select("model_fold", F.round("auc", 6).alias("auc"), F.round("mean_p", 6).alias("mean_p"), "n_trials")


@query("plain_discriminant", "M23 A27")
def plain_discriminant(spark: SparkSession, sf: str) -> DataFrame:
    sc = cross_validated(_window_rows(spark, sf), [], "fold", FOLDS, "y", "x", shrink=0.0)
    out = confusion(sc.withColumn("pred", F.when(F.col("score") > 0, 1).otherwise(0)), ["model_fold"], "y", "pred")
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("logistic_probe", "M24")
def logistic_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic regression of all folds at once on window vectors."""
    sc = logistic_cross_validated(_window_rows(spark, sf), [], "fold", "y", "x")
    return auc(sc.withColumn("score", F.round("score", 6)), ["fold"], "y", "score").select("fold", "n_pos", "n_neg", F.round("auc", 4).alias("auc"))


def _strat(spark, sf, k: int = 2):
    return written(stratified_kfold(trial_condition(spark, sf), "trial", "y", k), "folds")


@query("time_resolved_auc", "M28 O14")
def time_resolved_auc(spark: SparkSession, sf: str) -> DataFrame:
    """A discriminant per time point, cross-validated over trials."""
    rows = signal(spark, sf).select("trial", "t", "x").join(_strat(spark, sf), "trial")
    sc = cross_validated(rows, ["t"], "fold", 2, "y", "x")
    return auc(sc.withColumn("score", F.round("score", 9)), ["t"], "y", "score").select("t", F.round("auc", 6).alias("auc"))


@query("temporal_generalisation", "M29")
def temporal_generalisation(spark: SparkSession, sf: str) -> DataFrame:
    """Models of one time scored at every other time, on a decimated copy of the series."""
    rows = decimated(signal(spark, sf), "t", 64.0, 12.8).select("trial", "t", "x").join(_strat(spark, sf), "trial")
    models = fit_lda(train_rows(rows, "fold", 2), ["t", "model_fold"], "y", "x").withColumnRenamed("t", "t_train")
    sc = lda_scores(test_rows(rows, "fold").withColumnRenamed("t", "t_test"), models, ["model_fold"], "x")
    return auc(sc.withColumn("score", F.round("score", 9)), ["t_train", "t_test"], "y", "score").select("t_train", "t_test", F.round("auc", 6).alias("auc"))


#: Label permutations of the whole-window score.
N_PERM = 1000


@query("whole_window_decoder", "M30 R5 X12")
def whole_window_decoder(spark: SparkSession, sf: str) -> DataFrame:
    """One discriminant on the window features of all channels, its confusion counts and a label-permutation p-value."""
    cols = ["bin0", "bin1", "bin2", "bin3", "log_var", "log_alpha"]
    per = window_features(spark, sf)
    x = per.groupBy("trial").agg(F.sort_array(F.collect_list(F.struct("ch", F.array(*cols).alias("v")))).alias("s"))
    x = x.select("trial", F.flatten(F.transform("s", lambda r: r.v)).alias("x"))
    labels = label_rows(permuted_labels(trial_condition(spark, sf), "trial", "y", N_PERM), "trial", N_PERM)
    folds = _strat(spark, sf).select("trial", "fold")
    rows = labels.join(x, "trial").join(folds, "trial")
    sc = written(cross_validated(written(rows, "features"), [], "fold", 2, "labels", "x").select("perm", "y", F.round("score", 9).alias("score")), "scores")
    st = auc(sc, ["perm"], "y", "score").withColumnRenamed("auc", "stat")
    cells = confusion(sc.where("perm = 0").withColumn("pred", (F.col("score") > 0).cast("int")), ["perm"], "y", "pred").drop("perm", "accuracy")
    p = permutation_p(st, [], "stat").select(F.round("observed", 6).alias("auc"), "n_perm", "n_ge", F.round("p", 6).alias("p"))
    return p.crossJoin(F.broadcast(cells))


@query("feature_set_comparison", "M31 M39 X10")
def feature_set_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Alpha power and mean amplitude through the same folds."""
    vec = lambda d, c: d.groupBy("trial").agg(F.transform(F.sort_array(F.collect_list(F.struct("ch", c))), lambda r: r[c]).alias("x"))
    alpha = _psd(spark, sf).where((F.col("hz") >= 8) & (F.col("hz") <= 14)).groupBy("trial", "ch").agg(F.log(F.avg("psd") + 1e-30).alias("f"))
    mean = signal_long(spark, sf).groupBy("trial", "ch").agg(F.avg("v").alias("f"))
    sets = vec(alpha, "f").withColumn("features", F.lit("alpha")).unionByName(vec(mean, "f").withColumn("features", F.lit("mean")))
    rows = written(sets.join(_strat(spark, sf), "trial"), "features")
    sc = cross_validated(rows, ["features"], "fold", 2, "y", "x")
    return auc(sc.withColumn("score", F.round("score", 9)), ["features"], "y", "score").select("features", F.round("auc", 6).alias("auc"))


def _cov_rows(spark, sf):
    sig, _, _ = _views(spark, sf)
    st = written(trial_stats(with_square_norm(sig), ["trial"], "x", "q", "t").join(_strat(spark, sf), "trial"), "trial-stats")
    return st, train_rows(st, "fold", 2), test_rows(st, "fold")


@query("spatial_filter_decoder", "M26")
def spatial_filter_decoder(spark: SparkSession, sf: str) -> DataFrame:
    """Six common spatial patterns per fold, log power, discriminant."""
    _, train, test = _cov_rows(spark, sf)
    filters = csp_filters(train, ["model_fold"], "y", P, 6)
    filters = written(filters, "filters")
    xtr = log_power(train, filters, ["model_fold"], ["trial", "y"], P, 1)
    xte = log_power(test, filters, ["model_fold"], ["trial", "y"], P, 1)
    sc = lda_scores(xte, fit_lda(xtr, ["model_fold"], "y", "x"), ["model_fold"], "x")
    return sc.select("model_fold", "trial", "y", F.round("score", 4).alias("score"))


@query("tangent_space_decoder", "M25")
def tangent_space_decoder(spark: SparkSession, sf: str) -> DataFrame:
    """Trial covariances of all channels in the tangent space of their training mean, then logistic regression."""
    _, train, test = _cov_rows(spark, sf)
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    feats = written(tangent_features(parts, train, ["model_fold"], ["trial", "y", "part"], P, 1), "tangent")
    # a model's vectors lie at its own mean, so each model is a key of its own and its held-out rows a fold of it
    held = feats.withColumn("fold", F.when(F.col("part") == "test", 1).otherwise(0)).withColumnRenamed("model_fold", "model")
    models = fit_logistic_folds(held, ["model"], "fold", "y", "x", tol=1e-6, leave=[1])
    sc = logistic_scores(held.where("fold = 1"), models, ["model"], "fold", "x")
    return sc.select(F.col("model").alias("model_fold"), "trial", "y", F.round("score", 3).alias("score"))
