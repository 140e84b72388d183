"""Models on two regional means: small enough that every step has a closed form in SQL.

The same operators as in ``model_plans`` run here; only the signal is first averaged over
two channel regions, so 2 x 2 systems can be solved by hand in the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.linalg import moments
from ..operators.classify import (
    cross_validated, csp_filters, fit_lda, lda_scores, leave_one_out_lda, log_power, match_discriminant, probability,
    test_rows, train_rows, with_square_norm,
)
from ..operators.logistic import logistic_cross_validated
from ..operators.models import Spec, component_rows, eigenspectrum, fit, grid_models, patterns, score, variates
from ..operators.ranks import auc, cohens_d, safe_corr
from ..operators.resample import mismatched_partners, stratified_kfold
from ..operators.series import equal_windows, lengths, sign_fixed
from ..operators.stats import correlation_vector, lagged_stats, mismatch_stats, sum_vectors, total_stats, train_stats, trial_stats
from ..session import written
from .adapters import COND, LONG, SIG, STIM, md5_sql, signal, stimulus, trial_condition
from .model_plans import BLOCK, FOLD_SQL, FOLDS, _folds, _strat, mismatch_mean
from .registry import query
from .signal_plans import WELCH, _psd

G = 0.15
ROI = "roi AS (SELECT trial, t, avg(v) FILTER (ch < 32) AS a, avg(v) FILTER (ch >= 32) AS b FROM long GROUP BY ALL)"
KF = f"k AS (SELECT CAST(f AS INTEGER) AS fold FROM range({FOLDS}) r(f))"
J = f"WITH {LONG}, {STIM}, {ROI}, {FOLD_SQL}, {KF}, j AS (SELECT roi.trial, roi.t, fold, a, b, s FROM roi JOIN stim USING (trial, t) JOIN fo USING (trial))"


def solve_sql(keys: str, source: str, gamma: str, where: str = "") -> str:
    """Weights of a shrunk two-channel regression per key, from training rows ``source``."""
    outer = ", ".join(c.split(" AS ")[-1].split(".")[-1] for c in keys.split(", "))
    return (
        f"SELECT {outer}, ((1-g)*vb + g*(va+vb)/2) * ca - (1-g)*ab * cb AS wa, ((1-g)*va + g*(va+vb)/2) * cb - (1-g)*ab * ca AS wb FROM "
        f"(SELECT {keys}, {gamma} AS g, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab, covar_pop(a, s) AS ca, covar_pop(b, s) AS cb FROM {source} {where} GROUP BY ALL)"
    )


W = f"w AS ({solve_sql('k.fold', 'k JOIN j ON j.fold <> k.fold', str(G) + '::DOUBLE')})"


def _roi_mean(x: str = "x"):
    """Mean of the lower and of the upper half of the channels."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    return F.array(mean(F.slice(x, 1, 32)), mean(F.slice(x, 33, 32)))


def _roi(spark, sf):
    sig = signal(spark, sf).select("trial", "t", _roi_mean().alias("x"))
    stim = stimulus(spark, sf).select("trial", "t", F.array("s").alias("y"))
    return sig, stim, sig.join(stim, ["trial", "t"])


def _stats(spark, sf, shifts=None):
    _, _, both = _roi(spark, sf)
    st = lagged_stats(both, ["trial"], "x", "y", [0], [0], width=BLOCK, shifts=shifts)
    return written(st.join(_folds(spark, sf), "trial"), "trial-stats")


SPEC = Spec("cca", k=1, shrink=G, rcond=1e-12)


@query(
    "roi_cca_tracking", "M1 M2 M4 M5 M6 M8 D12",
    f"{J}, {W} SELECT j.trial, j.fold, round(corr(wa * a + wb * b, s), 6) AS r FROM j JOIN w ON w.fold = j.fold GROUP BY ALL",
)
def roi_cca_tracking(spark: SparkSession, sf: str) -> DataFrame:
    st = _stats(spark, sf)
    models = fit(train_stats(st, "fold"), ["fold"], 2, 1, {"rcca": SPEC})
    # with one stimulus column the pair's sign is free, so both weights are read as positive on the stimulus
    sc = score(_positive(models), st, ["fold"], ["trial"], 2, 1)
    return sc.select("trial", "fold", F.round("r", 6).alias("r"))


def _positive(models: DataFrame) -> DataFrame:
    """Flip both weight vectors of a pair so the stimulus weight is positive."""
    flip = F.col("ay")[0] < 0
    neg = lambda c: F.when(flip, F.transform(c, lambda v: -v)).otherwise(F.col(c)).alias(c)
    return models.select(*[neg(c) if c in ("ax", "ay") else F.col(c) for c in models.columns])


MATES = f"""tr AS (SELECT DISTINCT trial, trial AS stim FROM sig), st AS (SELECT stim, min(trial) AS j, row_number() OVER (ORDER BY {md5_sql('mismatch', 'stim')}, stim) - 1 AS pos FROM tr GROUP BY stim), nn AS (SELECT count(*) AS n FROM st),
pr AS (SELECT tr.trial AS i, y.j FROM tr JOIN st x ON x.stim = tr.stim CROSS JOIN nn CROSS JOIN range(3) r(kk) JOIN st y ON y.pos = (x.pos + 1 + (CAST('0x' || substr({md5_sql('mismatch-start', 'tr.trial')}, 1, 8) AS BIGINT) % (n - 1) + kk) % (n - 1)) % n)"""
GRID = (0.05, 0.5, 0.95)


@query(
    "roi_nested_selection", "M9 J10 J13 K4",
    f"""{J}, {MATES}, gr AS (SELECT * FROM (VALUES {', '.join(f'({i}, {g}::DOUBLE)' for i, g in enumerate(GRID))}) v(cell, shrink)),
    w AS ({solve_sql('k.fold, gr.cell', 'k JOIN j ON j.fold <> k.fold CROSS JOIN gr', 'any_value(gr.shrink)')}),
    m AS (SELECT cell, j.trial AS i, corr(wa * a + wb * b, s) AS r FROM j JOIN w ON w.fold = j.fold GROUP BY ALL),
    x AS (SELECT cell, pr.i, pr.j, corr(wa * a + wb * b, z.s) AS r FROM pr JOIN j ON j.trial = pr.i JOIN w ON w.fold = j.fold JOIN stim z ON z.trial = pr.j AND z.t = j.t GROUP BY ALL),
    c AS (SELECT m.cell, avg(m.r - n.r) AS cv FROM m JOIN (SELECT cell, i, avg(r) AS r FROM x GROUP BY ALL) n ON n.cell = m.cell AND n.i = m.i GROUP BY m.cell)
    SELECT gr.cell, shrink, round(cv, 6) AS cv, gr.cell = (SELECT cell FROM c ORDER BY round(cv, 9) DESC, cell LIMIT 1) AS selected FROM c JOIN gr ON gr.cell = c.cell""",
)
def roi_nested_selection(spark: SparkSession, sf: str) -> DataFrame:
    sig, stim, _ = _roi(spark, sf)
    st = _stats(spark, sf)
    models = written(_positive(grid_models(train_stats(st, "fold"), ["fold"], 2, 1, SPEC, [2], GRID)), "grid-models")
    cells = models.select("model", "cell", "shrink").distinct()
    matched = score(models, st, ["fold"], ["trial"], 2, 1)
    pairs = mismatched_partners(sig.select("trial").distinct().withColumn("stim", F.col("trial")), "trial", "stim", 3)
    cross = mismatch_stats(sig, stim, pairs, [0], [0], width=BLOCK)
    cross = cross.join(st.select(F.col("trial").alias("i"), "fold"), "i")
    null = score(models, cross, ["fold"], ["i", "j"], 2, 1).groupBy("model", F.col("i").alias("trial")).agg(F.avg("r").alias("n"))
    cv = matched.join(null, ["model", "trial"]).groupBy("model").agg(F.avg(F.col("r") - F.col("n")).alias("cv")).join(cells, "model")
    best = cv.agg(F.max_by("cell", F.struct(F.round("cv", 9), -F.col("cell"))).alias("best"))
    return cv.crossJoin(F.broadcast(best)).select("cell", "shrink", F.round("cv", 6).alias("cv"), (F.col("cell") == F.col("best")).alias("selected"))


SHIFTS = [-4, -2, 0, 2, 4, 6]
SH = f"""sh AS (SELECT j.trial, j.t, j.fold, d AS shift, a, b, coalesce(z.s, 0.0) AS s FROM j CROSS JOIN (VALUES {', '.join(f'({d})' for d in SHIFTS)}) v(d) LEFT JOIN stim z ON z.trial = j.trial AND z.t = j.t - d)"""


@query(
    "roi_shift_curves", "M16 M17 M18 J14 K2 K3 W25",
    f"""{J}, {SH}, w AS ({solve_sql('k.fold, sh.shift', 'k JOIN sh ON sh.fold <> k.fold', '0.0::DOUBLE')}),
    f AS (SELECT k.fold, sh.shift, sign(covar_pop(a, s)) AS fa, sign(covar_pop(b, s)) AS fb FROM k JOIN sh ON sh.fold <> k.fold GROUP BY ALL),
    h AS (SELECT sh.shift, sh.fold, corr(wa * a + wb * b, s) AS back, any_value(fa) * corr(a, s) AS ra, any_value(fb) * corr(b, s) AS rb FROM sh JOIN w ON w.fold = sh.fold AND w.shift = sh.shift JOIN f ON f.fold = sh.fold AND f.shift = sh.shift GROUP BY ALL),
    c AS (SELECT 'backward' AS model, shift, 0 AS best_comp, avg(back) AS r FROM h GROUP BY shift UNION ALL SELECT 'forward', shift, CASE WHEN avg(rb) > avg(ra) THEN 1 ELSE 0 END, greatest(avg(ra), avg(rb)) FROM h GROUP BY shift)
    SELECT model, shift, best_comp, round(r, 6) AS r, row_number() OVER (PARTITION BY model ORDER BY round(r, 9) DESC, shift) = 1 AS peak FROM c""",
)
def roi_shift_curves(spark: SparkSession, sf: str) -> DataFrame:
    st = _stats(spark, sf, SHIFTS)
    models = fit(train_stats(st, "fold", ["shift"]), ["shift", "fold"], 2, 1, {"backward": Spec("backward", rcond=1e-12), "forward": Spec("relative_ridge_forward")})
    sc = score(models, sum_vectors(st, ["shift", "fold"], "s"), ["shift", "fold"], [], 2, 1)
    mean = sc.groupBy("model", "shift", "comp").agg(F.avg("r").alias("r"))
    curve = mean.groupBy("model", "shift").agg(F.max_by("comp", F.struct("r", -F.col("comp"))).alias("best_comp"), F.max("r").alias("r"))
    top = curve.groupBy("model").agg(F.max_by("shift", F.struct(F.round("r", 9), -F.col("shift"))).alias("best"))
    return curve.join(top, "model").select("model", "shift", "best_comp", F.round("r", 6).alias("r"), (F.col("shift") == F.col("best")).alias("peak"))


@query(
    "regression_pattern", "M12 M19 M27 W26",
    f"""WITH {LONG}, {STIM}, c AS (SELECT ch, covar_pop(v, s) AS c FROM long JOIN stim USING (trial, t) GROUP BY ch), n AS (SELECT sqrt(sum(c * c)) AS n FROM c), g AS (SELECT arg_max(sign(c), (abs(c), -ch)) AS sg FROM c)
    SELECT ch, round(c / n * sg, 6) AS weight FROM c, n, g""",
)
def regression_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Activation pattern of the full-rank reconstruction filter over all 64 channels."""
    sig = signal(spark, sf).select("trial", "t", "x").join(stimulus(spark, sf), ["trial", "t"]).withColumn("y", F.array("s"))
    total = written(total_stats(trial_stats(sig, ["trial"], "x", "y", "t")), "total")
    pt = patterns(fit(total, [], 64, 1, {"backward": Spec("backward", rcond=1e-12)}), total, [], 64, 1)
    long = pt.select("comp", F.posexplode("px").alias("ch", "weight"))
    return sign_fixed(long, ["comp"], "ch", "weight").select("ch", F.round("weight", 6).alias("weight"))


@query(
    "roi_condition_patterns", "M20 M21",
    f"""{J}, {COND}, jj AS (SELECT j.*, y FROM j JOIN cond ON cond.trial = j.trial), w AS ({solve_sql("'all' AS one", 'jj', str(G) + '::DOUBLE')}),
    p AS (SELECT y, var_pop(a) * any_value(wa) + covar_pop(a, b) * any_value(wb) AS pa, covar_pop(a, b) * any_value(wa) + var_pop(b) * any_value(wb) AS pb FROM jj, w GROUP BY y)
    SELECT y, round(pa / sqrt(pa * pa + pb * pb), 6) AS lower, round(pb / sqrt(pa * pa + pb * pb), 6) AS upper FROM p""",
)
def roi_condition_patterns(spark: SparkSession, sf: str) -> DataFrame:
    st = _stats(spark, sf)
    by_label = sum_vectors(st.join(trial_condition(spark, sf), "trial"), ["y"], "s")
    common = _positive(fit(total_stats(st), [], 2, 1, {"cca": SPEC}))
    models = by_label.select("y").crossJoin(F.broadcast(common))
    pt = patterns(models, by_label, ["y"], 2, 1)
    return pt.select("y", F.round(F.col("px")[0], 6).alias("lower"), F.round(F.col("px")[1], 6).alias("upper"))


@query(
    "roi_covariance_spectrum", "M40 M3",
    f"""{J}, v AS (SELECT var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab FROM j), e AS (SELECT (va + vb) / 2 + sqrt((va - vb) ** 2 / 4 + ab * ab) AS l1, (va + vb) / 2 - sqrt((va - vb) ** 2 / 4 + ab * ab) AS l2 FROM v)
    SELECT 0 AS rank, 1.0::DOUBLE AS share, true AS kept FROM e UNION ALL SELECT 1, round(l2 / l1, 6), false FROM e""",
)
def roi_covariance_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return eigenspectrum(total_stats(_stats(spark, sf)), 2, 1, 1).withColumn("share", F.round("share", 6))


@query(
    "roi_tracking_features", "M7 M36 W13 A32",
    f"""{J}, {W}, {MATES}, u AS (SELECT j.trial, t, t * 6 // 50 AS w0, wa * a + wb * b AS u, s FROM j JOIN w ON w.fold = j.fold), wn AS (SELECT trial, win, corr(u, s) AS r FROM u JOIN range(6) q(win) ON t >= win * 50 // 6 AND t < (win + 1) * 50 // 6 GROUP BY ALL),
    f AS (SELECT trial, avg(r) FILTER (win < 3) AS early, avg(r) FILTER (win >= 3) AS late, regr_slope(r, win) AS slope, stddev_pop(r) AS spread FROM wn GROUP BY trial), g AS (SELECT trial, corr(u, s) AS mean_r FROM u GROUP BY trial),
    nu AS (SELECT trial, avg(r) AS null_r FROM (SELECT pr.i AS trial, pr.j, corr(u.u, z.s) AS r FROM pr JOIN u ON u.trial = pr.i JOIN stim z ON z.trial = pr.j AND z.t = u.t GROUP BY ALL) GROUP BY trial)
    SELECT trial, round(mean_r - null_r, 6) AS engagement, round(mean_r, 6) AS mean_r, round(early, 6) AS early, round(late, 6) AS late, round(slope, 6) AS slope, round(spread, 6) AS spread FROM f JOIN g USING (trial) JOIN nu USING (trial)""",
)
def roi_tracking_features(spark: SparkSession, sf: str) -> DataFrame:
    sig, stim, _ = _roi(spark, sf)
    st = _stats(spark, sf)
    models = _positive(fit(train_stats(st, "fold"), ["fold"], 2, 1, {"rcca": SPEC}))
    var = written(variates(sig, stim, models, _folds(spark, sf), [0], [0], width=BLOCK), "variates")
    rows = component_rows(var)
    whole = rows.groupBy("trial").agg(safe_corr("a", "b").alias("mean_r")).join(mismatch_mean(var, 3), "trial")
    whole = whole.withColumn("engagement", F.col("mean_r") - F.col("null_r"))
    win = rows.join(lengths(rows, ["trial"]), "trial").withColumn("win", equal_windows(F.col("t"), F.col("_len"), 6))
    win = win.groupBy("trial", "win").agg(safe_corr("a", "b").alias("r"))
    shape = win.groupBy("trial").agg(
        F.avg(F.when(F.col("win") < 3, F.col("r"))).alias("early"), F.avg(F.when(F.col("win") >= 3, F.col("r"))).alias("late"),
        F.regr_slope("r", F.col("win").cast("double")).alias("slope"), F.stddev_pop("r").alias("spread"),
    )
    return whole.join(shape, "trial").select("trial", *[F.round(c, 6).alias(c) for c in ("engagement", "mean_r", "early", "late", "slope", "spread")])


@query(
    "roi_attention_decision", "M32 W18",
    f"""{J}, {COND}, {SH}, w AS ({solve_sql('k.fold, sh.shift', 'k JOIN sh ON sh.fold <> k.fold', '0.0::DOUBLE', 'WHERE sh.shift IN (0, 4)')}),
    r AS (SELECT sh.trial, sh.shift, corr(wa * a + wb * b, s) AS r FROM sh JOIN w ON w.fold = sh.fold AND w.shift = sh.shift GROUP BY ALL),
    z AS (SELECT trial, shift, (r - avg(r) OVER (PARTITION BY shift)) / stddev_pop(r) OVER (PARTITION BY shift) AS z FROM r), d AS (SELECT trial, sum(CASE WHEN shift = 0 THEN z ELSE -z END) AS d FROM z GROUP BY trial)
    SELECT d.trial, y, round(d, 5) AS d, CASE WHEN d > 0 THEN 1 ELSE 0 END AS pred FROM d JOIN cond ON cond.trial = d.trial""",
)
def roi_attention_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Decision between two streams (the stimulus and its copy four samples later)."""
    st = _stats(spark, sf, [0, 4])
    models = fit(train_stats(st, "fold", ["shift"]), ["shift", "fold"], 2, 1, {"backward": Spec("backward", rcond=1e-12)})
    sc = score(models, st, ["shift", "fold"], ["trial"], 2, 1)
    stat = sc.groupBy("shift").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    z = sc.join(F.broadcast(stat), "shift").withColumn("z", (F.col("r") - F.col("m")) / F.coalesce(F.nullif("s", F.lit(0.0)), F.lit(1.0)))
    d = z.groupBy("trial").agg(F.sum(F.when(F.col("shift") == 0, F.col("z")).otherwise(-F.col("z"))).alias("d"))
    return d.join(trial_condition(spark, sf), "trial").select("trial", "y", F.round("d", 5).alias("d"), F.when(F.col("d") > 0, 1).otherwise(0).alias("pred"))


@query(
    "roi_match_accuracy", "M34 W11",
    f"""{J}, {W}, {MATES}, u AS (SELECT j.trial, t, wa * a + wb * b AS u FROM j JOIN w ON w.fold = j.fold), ap AS (SELECT i, j, false AS own FROM pr UNION ALL SELECT DISTINCT i, i, true FROM pr),
    r AS (SELECT ap.i, own, ap.j, size, u.t // size AS win, corr(u.u, z.s) AS r FROM ap JOIN u ON u.trial = ap.i JOIN stim z ON z.trial = ap.j AND z.t = u.t CROSS JOIN (VALUES (10), (16), (25)) v(size) GROUP BY ALL HAVING count(*) = size),
    m AS (SELECT i, size, win, avg(r) FILTER (own) > avg(r) FILTER (NOT own) AS hit FROM r GROUP BY ALL) SELECT size, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, count(*) AS n_windows FROM m GROUP BY size""",
)
def roi_match_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Share of windows in which the own stimulus beats the mean of three others, by length."""
    sig, stim, _ = _roi(spark, sf)
    st = _stats(spark, sf)
    models = _positive(fit(train_stats(st, "fold"), ["fold"], 2, 1, {"rcca": SPEC}))
    var = written(variates(sig, stim, models, _folds(spark, sf), [0], [0], width=BLOCK), "variates")
    return match_by_window(var, (10, 16, 25))


def match_by_window(var: DataFrame, sizes: tuple[int, ...], m: int = 3) -> DataFrame:
    trials = var.select("trial").distinct().withColumn("stim", F.col("trial"))
    pairs = mismatched_partners(trials, "trial", "stim", m)
    own = pairs.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(True).alias("match"))
    every = own.unionByName(pairs.withColumn("match", F.lit(False)))
    u = var.select(F.col("trial").alias("i"), "t", "u")
    v = var.select(F.col("trial").alias("j"), "t", "v")
    rows = every.join(u, "i").join(v, ["j", "t"]).withColumn("size", F.explode(F.array(*[F.lit(w) for w in sizes])))
    rows = rows.select("i", "j", "match", "size", F.floor(F.col("t") / F.col("size")).alias("win"), F.posexplode(F.arrays_zip("u", "v")).alias("comp", "z"))
    r = rows.groupBy("i", "j", "match", "size", "win", "comp").agg(safe_corr("z.u", "z.v").alias("r"), F.count(F.lit(1)).alias("n"))
    r = r.where(F.col("n") == F.col("size")).groupBy("i", "j", "match", "size", "win").agg(F.avg("r").alias("r"))
    w = r.groupBy("i", "size", "win").agg(F.avg(F.when(F.col("match"), F.col("r"))).alias("sm"), F.avg(F.when(~F.col("match"), F.col("r"))).alias("sc"))
    return w.groupBy("size").agg(F.round(F.avg((F.col("sm") > F.col("sc")).cast("double")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n_windows"))


@query(
    "roi_hierarchy", "M37 A29",
    f"""{J}, {COND}, {SH}, w AS ({solve_sql('k.fold, sh.shift', 'k JOIN sh ON sh.fold <> k.fold', str(G) + '::DOUBLE', 'WHERE sh.shift >= 0')}),
    r AS (SELECT sh.shift AS level, sh.trial, y, corr(wa * a + wb * b, s) AS r FROM sh JOIN w ON w.fold = sh.fold AND w.shift = sh.shift JOIN cond ON cond.trial = sh.trial GROUP BY ALL),
    q AS (SELECT level, avg(r) FILTER (y = 1) AS m1, avg(r) FILTER (y = 0) AS m0, sqrt(((count(*) FILTER (y = 1) - 1) * var_samp(r) FILTER (y = 1) + (count(*) FILTER (y = 0) - 1) * var_samp(r) FILTER (y = 0)) / (count(*) - 2)) AS sd FROM r GROUP BY level)
    SELECT level, round(m1, 6) AS audio, round(m0, 6) AS visual, round((m1 - m0) / (sd + 1e-12), 5) AS d FROM q""",
)
def roi_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Tracking of several stimulus levels and its effect between the two conditions."""
    levels = [d for d in SHIFTS if d >= 0]
    st = _stats(spark, sf, levels).withColumnRenamed("shift", "level")
    models = _positive(fit(train_stats(st, "fold", ["level"]), ["level", "fold"], 2, 1, {"rcca": SPEC}))
    r = score(models, st, ["level", "fold"], ["trial"], 2, 1).join(trial_condition(spark, sf), "trial")
    y = F.col("y")
    return r.groupBy("level").agg(
        F.round(F.avg(F.when(y == 1, F.col("r"))), 6).alias("audio"), F.round(F.avg(F.when(y == 0, F.col("r"))), 6).alias("visual"), F.round(cohens_d(y, F.col("r")), 5).alias("d")
    )


def lda_sql(keys: str, train: str, shrink: bool) -> str:
    """Two-feature discriminant per key from rows ``(keys, y, a, b)`` as CTEs ending in ``ld``."""
    on = " AND ".join(f"r.{k} = m.{k}" for k in keys.split(", "))
    k = ", ".join(f"r.{c}" for c in keys.split(", "))
    join = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in keys.split(", "))
    g = "CASE WHEN r = 0 THEN 0 ELSE least(greatest((q4 - (2 + 2 * r * r)) / (n * 2), 0), r * r) / (r * r) END" if shrink else "0"
    return f"""tr0 AS ({train}), sm AS (SELECT {keys}, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM tr0 GROUP BY ALL),
    zz AS (SELECT {k}, r.y, (r.a - ma) / sa AS a, (r.b - mb) / sb AS b FROM tr0 r JOIN sm m ON {on}),
    cm AS (SELECT {keys}, y, count(*) AS n, avg(a) AS ca, avg(b) AS cb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS r FROM zz GROUP BY ALL),
    q4 AS (SELECT {k}, r.y, avg((((a - ca) / sa) ** 2 + ((b - cb) / sb) ** 2) ** 2) AS q4 FROM zz r JOIN cm m ON {on} AND r.y = m.y GROUP BY ALL),
    cg AS (SELECT cm.*, (1 - {g}) * r * sa * sb AS ab FROM cm JOIN q4 ON {join('cm', 'q4')} AND cm.y = q4.y),
    pp AS (SELECT {', '.join('x.' + c for c in keys.split(', '))}, (x.n * x.sa ** 2 + w.n * w.sa ** 2) / (x.n + w.n) AS va, (x.n * x.sb ** 2 + w.n * w.sb ** 2) / (x.n + w.n) AS vb, (x.n * x.ab + w.n * w.ab) / (x.n + w.n) AS ab,
       w.ca - x.ca AS da, w.cb - x.cb AS db, w.ca + x.ca AS ua, w.cb + x.cb AS ub, ln(w.n / x.n) AS pr FROM cg x JOIN cg w ON {join('x', 'w')} AND x.y = 0 AND w.y = 1),
    ld AS (SELECT r.*, (vb * da - ab * db) / (va * vb - ab * ab) AS wa, (va * db - ab * da) / (va * vb - ab * ab) AS wb, m.ma, m.mb, m.sa, m.sb FROM pp r JOIN sm m ON {on})"""


DEC = "(-0.5 * (wa * ua + wb * ub) + pr + wa * (e.a - ma) / sa + wb * (e.b - mb) / sb)"
ROWS = f"WITH {LONG}, {ROI}, {FOLD_SQL}, {KF}, e AS (SELECT roi.trial, roi.t, fold, a, b, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM roi JOIN sig USING (trial, t) JOIN fo USING (trial))"
TRAIN = "SELECT k.fold, e.y, e.a, e.b FROM k JOIN e ON e.fold <> k.fold"


def _roi_rows(spark, sf):
    rows = signal(spark, sf).select("trial", "t", _roi_mean().alias("x"), F.when(F.col("label") < 5, 1).otherwise(0).alias("y"))
    return rows.join(_folds(spark, sf), "trial")


@query(
    "roi_window_probe", "M22 M38 R4 G4",
    f"{ROWS}, {lda_sql('fold', TRAIN, True)} SELECT e.trial, e.fold AS model_fold, count(*) AS n, round(avg({DEC}), 5) AS mean_score, round(avg(1 / (1 + exp(-{DEC}))), 5) AS p FROM e JOIN ld ON ld.fold = e.fold GROUP BY ALL",
)
def roi_window_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Shrinkage discriminant on windows with grouped folds; mean probability per trial."""
    sc = cross_validated(_roi_rows(spark, sf), [], "fold", FOLDS, "y", "x")
    return sc.groupBy("trial", "model_fold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 5).alias("mean_score"), F.round(F.avg(probability(F.col("score"))), 5).alias("p")
    )


@query(
    "roi_plain_discriminant", "M23 A27",
    f"{ROWS}, {lda_sql('fold', TRAIN, False)} SELECT e.fold AS model_fold, count(*) FILTER (y = 0 AND {DEC} <= 0) AS c00, count(*) FILTER (y = 0 AND {DEC} > 0) AS c01, count(*) FILTER (y = 1 AND {DEC} <= 0) AS c10, count(*) FILTER (y = 1 AND {DEC} > 0) AS c11, round(avg({DEC}), 5) AS mean_score FROM e JOIN ld ON ld.fold = e.fold GROUP BY ALL",
)
def roi_plain_discriminant(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.ranks import confusion

    sc = cross_validated(_roi_rows(spark, sf), [], "fold", FOLDS, "y", "x", shrink=0.0)
    out = confusion(sc.withColumn("pred", F.when(F.col("score") > 0, 1).otherwise(0)), ["model_fold"], "y", "pred").drop("accuracy")
    return out.join(sc.groupBy("model_fold").agg(F.round(F.avg("score"), 5).alias("mean_score")), "model_fold")


SF2 = f"sfo AS (SELECT trial, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {md5_sql('fold', 'y', 'trial')}, trial) - 1) % 2 AS INTEGER) AS fold FROM cond)"
TG = f"WITH {LONG}, {ROI}, {COND}, {SF2}, k AS (SELECT CAST(f AS INTEGER) AS fold FROM range(2) r(f)), e AS (SELECT roi.trial, roi.t // 10 AS bin, roi.t, fold, a, b, y FROM roi JOIN sfo USING (trial))"
AUC_SQL = "round(sum(CASE WHEN p.s > n.s THEN 1.0::DOUBLE WHEN p.s = n.s THEN 0.5 ELSE 0 END) / count(*), 5) AS auc"


@query(
    "roi_time_generalisation", "M28 M29 R3 A26",
    f"""{TG}, {lda_sql('bin, fold', 'SELECT e.bin, k.fold, e.y, e.a, e.b FROM k JOIN e ON e.fold <> k.fold', True)},
    sc AS (SELECT ld.bin AS t_train, e.bin AS t_test, e.y, round({DEC}, 9) AS s FROM e JOIN ld ON ld.fold = e.fold)
    SELECT p.t_train, p.t_test, {AUC_SQL} FROM sc p JOIN sc n ON p.t_train = n.t_train AND p.t_test = n.t_test AND p.y = 1 AND n.y = 0 GROUP BY ALL""",
)
def roi_time_generalisation(spark: SparkSession, sf: str) -> DataFrame:
    """Discriminants of one time bin scored in every other bin; the diagonal is the resolved curve."""
    rows = signal(spark, sf).select("trial", F.floor(F.col("t") / 10).alias("bin"), _roi_mean().alias("x")).join(_strat(spark, sf), "trial")
    models = fit_lda(train_rows(rows, "fold", 2), ["bin", "model_fold"], "y", "x").withColumnRenamed("bin", "t_train")
    sc = lda_scores(test_rows(rows, "fold").withColumnRenamed("bin", "t_test"), models, ["model_fold"], "x")
    return auc(sc.withColumn("score", F.round("score", 9)), ["t_train", "t_test"], "y", "score").select("t_train", "t_test", F.round("auc", 5).alias("auc"))


@query(
    "estimator_scores", "G2 M13 M18",
    f"{J}, w AS ({solve_sql(chr(39) + 'all' + chr(39) + ' AS one', 'j', '0.0::DOUBLE')}) SELECT trial, 0 AS comp, round(corr(wa * a + wb * b, s), 6) AS r FROM j, w GROUP BY trial",
)
def estimator_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The reconstruction model as an estimator: fit on all trials, transform to trial scores."""
    from ..operators.estimators import StimulusResponse

    _, _, both = _roi(spark, sf)
    model = StimulusResponse(Spec("backward", rcond=1e-12), 2, 1, width=BLOCK).fit(both)
    return model.transform(both).withColumn("r", F.round("r", 6))


N_PERM = 8
PERM_LAB = f"""nn AS (SELECT sum(y) AS n1 FROM cond), lab AS (SELECT 0 AS perm, trial, y FROM cond UNION ALL SELECT perm, trial, CASE WHEN row_number() OVER (PARTITION BY perm ORDER BY {md5_sql('perm', 'perm', 'trial')}, trial) <= n1 THEN 1 ELSE 0 END FROM cond, nn, range(1, {N_PERM + 1}) r(perm))"""


@query(
    "roi_permutation_decoder", "M30 R5",
    f"""WITH {LONG}, {ROI}, {COND}, {SF2}, {PERM_LAB}, k AS (SELECT CAST(f AS INTEGER) AS fold FROM range(2) r(f)), e AS (SELECT perm, roi.trial, sfo.fold, a, b, lab.y FROM roi JOIN sfo USING (trial) JOIN lab USING (trial)),
    {lda_sql('perm, fold', 'SELECT e.perm, k.fold, e.y, e.a, e.b FROM k JOIN e ON e.fold <> k.fold', True)}, sc AS (SELECT e.perm, e.y, round({DEC}, 9) AS s FROM e JOIN ld ON ld.fold = e.fold AND ld.perm = e.perm),
    st AS (SELECT p.perm, sum(CASE WHEN p.s > n.s THEN 1.0::DOUBLE WHEN p.s = n.s THEN 0.5 ELSE 0 END) / count(*) AS stat FROM sc p JOIN sc n ON p.perm = n.perm AND p.y = 1 AND n.y = 0 GROUP BY p.perm)
    SELECT round(o.stat, 5) AS auc, count(*) AS n_perm, count(*) FILTER (s.stat >= o.stat) AS n_ge, round((count(*) FILTER (s.stat >= o.stat) + 1) / (count(*) + 1), 6) AS p FROM st s, (SELECT stat FROM st WHERE perm = 0) o WHERE s.perm > 0 GROUP BY o.stat""",
)
def roi_permutation_decoder(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-validated AUC against shuffled trial labels; all permutations are fitted together."""
    from ..operators.resample import permutation_p, permuted_labels

    labels = permuted_labels(trial_condition(spark, sf), "trial", "y", N_PERM)
    rows = signal(spark, sf).select("trial", _roi_mean().alias("x")).join(labels, "trial").join(_strat(spark, sf).select("trial", "fold"), "trial")
    sc = cross_validated(rows, ["perm"], "fold", 2, "y", "x")
    st = auc(sc.withColumn("score", F.round("score", 9)), ["perm"], "y", "score").withColumnRenamed("auc", "stat")
    return permutation_p(st, [], "stat").select(F.round("observed", 5).alias("auc"), "n_perm", "n_ge", F.round("p", 6).alias("p"))


@query(
    "roi_feature_sets", "M31 M39 X10",
    f"""WITH {LONG}, {WELCH}, {COND}, {SF2}, k AS (SELECT CAST(f AS INTEGER) AS fold FROM range(2) r(f)),
    pw AS (SELECT trial, f, avg(psd) FILTER (ch < 32) AS a, avg(psd) FILTER (ch >= 32) AS b FROM psd WHERE hz >= 4 AND hz < 30 GROUP BY ALL),
    e AS (SELECT fs AS features, pw.trial, fold, y, CASE WHEN fs = 'log' THEN ln(a) ELSE a END AS a, CASE WHEN fs = 'log' THEN ln(b) ELSE b END AS b FROM pw JOIN sfo USING (trial), (VALUES ('log'), ('power')) v(fs)),
    {lda_sql('features, fold', 'SELECT e.features, k.fold, e.y, e.a, e.b FROM k JOIN e ON e.fold <> k.fold', True)}, sc AS (SELECT e.features, e.y, round({DEC}, 9) AS s FROM e JOIN ld ON ld.fold = e.fold AND ld.features = e.features)
    SELECT p.features, {AUC_SQL} FROM sc p JOIN sc n ON p.features = n.features AND p.y = 1 AND n.y = 0 GROUP BY p.features""",
)
def roi_feature_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Band power and its logarithm through the same folds (one row per trial and frequency)."""
    psd = _psd(spark, sf).where((F.col("hz") >= 4) & (F.col("hz") < 30))
    half = lambda low: F.avg(F.when((F.col("ch") < 32) == F.lit(low), F.col("psd")))
    pw = psd.groupBy("trial", "f").agg(half(True).alias("a"), half(False).alias("b"))
    sets = F.explode(F.array(
        F.struct(F.lit("log").alias("features"), F.array(F.log("a"), F.log("b")).alias("x")), F.struct(F.lit("power").alias("features"), F.array("a", "b").alias("x"))
    ))
    rows = pw.select("trial", sets.alias("z")).select("trial", "z.features", "z.x").join(_strat(spark, sf), "trial")
    sc = cross_validated(written(rows, "features"), ["features"], "fold", 2, "y", "x")
    return auc(sc.withColumn("score", F.round("score", 9)), ["features"], "y", "score").select("features", F.round("auc", 5).alias("auc"))


@query(
    "roi_match_discriminant", "M33 J10",
    f"""{J}, {MATES}, ap AS (SELECT i, j, 0 AS y FROM pr UNION ALL SELECT DISTINCT i, i, 1 FROM pr),
    e AS (SELECT ap.i, ap.j, ap.y, any_value(j.fold) AS fold, any_value(o.fold) AS other, corr(j.a, z.s) AS a, corr(j.b, z.s) AS b FROM ap JOIN j ON j.trial = ap.i JOIN stim z ON z.trial = ap.j AND z.t = j.t JOIN fo o ON o.trial = ap.j GROUP BY ALL),
    {lda_sql('fold', 'SELECT k.fold, e.y, e.a, e.b FROM k JOIN e ON e.fold <> k.fold AND e.other <> k.fold', False)}
    SELECT e.i, e.j, e.y AS own, round({DEC}, 4) AS score FROM e JOIN ld ON ld.fold = e.fold""",
)
def roi_match_discriminant(spark: SparkSession, sf: str) -> DataFrame:
    """Decision value of every trial with its own and three other stimuli, models without either trial's fold."""
    sig, stim, _ = _roi(spark, sf)
    folds = _folds(spark, sf)
    pairs = mismatched_partners(sig.select("trial").distinct().withColumn("stim", F.col("trial")), "trial", "stim", 3)
    same = pairs.select("i").distinct().withColumn("j", F.col("i"))
    cross = mismatch_stats(sig, stim, written(pairs.select("i", "j").unionByName(same), "pairs"), [0], [0], width=BLOCK, sums=moments)
    rows = correlation_vector(cross, ["i", "j"], 2, 1).withColumn("own", (F.col("i") == F.col("j")).cast("int"))
    rows = rows.join(folds.select(F.col("trial").alias("i"), "fold"), "i").join(folds.select(F.col("trial").alias("j"), F.col("fold").alias("other")), "j")
    sc = match_discriminant(written(rows, "match-rows"), "fold", "other", FOLDS)
    return sc.select("i", "j", "own", F.round("score", 4).alias("score"))


@query(
    "roi_window_decoder", "M35 R2",
    f"""WITH {LONG}, {ROI}, {STIM}, {COND}, e AS (SELECT roi.trial, size, t // size AS win, any_value(y) AS y, corr(a, s) AS a, corr(b, s) AS b FROM roi JOIN stim USING (trial, t) JOIN cond USING (trial) CROSS JOIN (VALUES (10), (16), (25)) v(size) GROUP BY roi.trial, size, t // size HAVING count(*) = size),
    {lda_sql('size, held', 'SELECT e.size, g.held, e.y, e.a, e.b FROM (SELECT DISTINCT trial AS held FROM e) g JOIN e ON e.trial <> g.held', False)}
    SELECT e.size, count(*) AS n_windows, count(*) FILTER (({DEC} > 0) = (e.y = 1)) AS n_right, round(avg({DEC}), 4) AS mean_score FROM e JOIN ld ON ld.size = e.size AND ld.held = e.trial GROUP BY e.size""",
)
def roi_window_decoder(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy over window lengths: correlations of a window, discriminants without the window's trial."""
    _, _, both = _roi(spark, sf)
    rows = both.withColumn("size", F.explode(F.array(*[F.lit(w) for w in (10, 16, 25)])))
    rows = rows.groupBy("trial", "size", F.floor(F.col("t") / F.col("size")).alias("win")).agg(
        F.count(F.lit(1)).alias("n"), *[safe_corr(F.col("x")[c], F.col("y")[0]).alias(f"r{c}") for c in (0, 1)]
    )
    rows = rows.where(F.col("n") == F.col("size")).select("trial", "size", "win", F.array("r0", "r1").alias("x"))
    rows = written(rows.join(trial_condition(spark, sf), "trial"), "window-features")
    sc = leave_one_out_lda(rows, ["size"], "trial", "y", "x").where("score is not null")
    return sc.groupBy("size").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count(F.when((F.col("score") > 0) == (F.col("y") == 1), 1)).alias("n_right"),
        F.round(F.avg("score"), 4).alias("mean_score"),
    )


NEWTON = 3


def newton_sql(steps: int, penalty: float = 1.0) -> str:
    """Weights of a two-feature logistic regression after some Newton steps from zero, as CTEs ending in ``n{steps}``."""
    out = ["n0 AS (SELECT fold, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM k)"]
    for i in range(1, steps + 1):
        out.append(
            f"g{i} AS (SELECT z.fold, any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, sum(p - y) AS g0, sum((p - y) * a) + any_value(w1) * {penalty} AS ga, sum((p - y) * b) + any_value(w2) * {penalty} AS gb, "
            f"sum(p * (1 - p)) AS h00, sum(p * (1 - p) * a) AS h01, sum(p * (1 - p) * b) AS h02, sum(p * (1 - p) * a * a) + {penalty} AS h11, sum(p * (1 - p) * a * b) AS h12, sum(p * (1 - p) * b * b) + {penalty} AS h22 "
            f"FROM (SELECT z.*, w0, w1, w2, 1 / (1 + exp(-(w0 + w1 * a + w2 * b))) AS p FROM z JOIN n{i - 1} m ON m.fold = z.fold) z GROUP BY z.fold)"
        )
        out.append(
            f"d{i} AS (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM g{i}), "
            f"n{i} AS (SELECT fold, w0 - (g0 * (h11 * h22 - h12 * h12) - ga * (h01 * h22 - h02 * h12) + gb * (h01 * h12 - h02 * h11)) / det AS w0, "
            f"w1 - (-g0 * (h01 * h22 - h12 * h02) + ga * (h00 * h22 - h02 * h02) - gb * (h00 * h12 - h02 * h01)) / det AS w1, "
            f"w2 - (g0 * (h01 * h12 - h11 * h02) - ga * (h00 * h12 - h01 * h02) + gb * (h00 * h11 - h01 * h01)) / det AS w2 FROM d{i})"
        )
    return ", ".join(out)


@query(
    "roi_logistic_probe", "M24 R4",
    f"""{ROWS}, sm AS (SELECT k.fold, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM k JOIN e ON e.fold <> k.fold GROUP BY k.fold),
    z AS (SELECT sm.fold, y, (a - ma) / sa AS a, (b - mb) / sb AS b FROM sm JOIN e ON e.fold <> sm.fold), {newton_sql(NEWTON)}
    SELECT e.trial, e.fold, count(*) AS n, round(avg(w0 + w1 * (a - ma) / sa + w2 * (b - mb) / sb), 6) AS mean_score, round(avg(1 / (1 + exp(-(w0 + w1 * (a - ma) / sa + w2 * (b - mb) / sb)))), 6) AS p
    FROM e JOIN n{NEWTON} m ON m.fold = e.fold JOIN sm ON sm.fold = e.fold GROUP BY ALL""",
)
def roi_logistic_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic regression of all folds on two regional means, three Newton steps; mean probability per trial."""
    rows = _roi_rows(spark, sf)
    sc = logistic_cross_validated(rows, [], "fold", "y", "x", max_steps=NEWTON, halving=False)
    return sc.groupBy("trial", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(probability(F.col("score"))), 6).alias("p")
    )


@query(
    "roi_spatial_filters", "M26",
    f"""{TG}, cv AS (SELECT k.fold, y, count(*) AS n, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab, avg(a) AS ma, avg(b) AS mb FROM k JOIN e ON e.fold <> k.fold GROUP BY ALL),
    q4 AS (SELECT cv.fold, cv.y, avg(((a - ma) ** 2 + (b - mb) ** 2) ** 2) AS q4 FROM cv JOIN e ON e.fold <> cv.fold AND e.y = cv.y GROUP BY ALL),
    lw AS (SELECT *, (va + vb) / 2 AS mu, ((va - vb) ** 2 / 2 + 2 * ab * ab) / 2 AS delta FROM cv JOIN q4 USING (fold, y)),
    ls AS (SELECT *, CASE WHEN delta = 0 THEN 0 ELSE least(greatest((q4 - (va * va + vb * vb + 2 * ab * ab)) / (n * 2), 0), delta) / delta END AS g FROM lw),
    sh AS (SELECT fold, y, (1 - g) * va + g * mu AS va, (1 - g) * vb + g * mu AS vb, (1 - g) * ab AS ab FROM ls),
    pa AS (SELECT o.fold, o.va AS b11, o.vb AS b22, o.ab AS b12, o.va + z.va AS a11, o.vb + z.vb AS a22, o.ab + z.ab AS a12 FROM sh o JOIN sh z ON o.fold = z.fold AND o.y = 1 AND z.y = 0),
    ro AS (SELECT *, abs(b12) + abs(a12) < 1e-14 * (a11 + a22) AS flat, a11 * a22 - a12 * a12 AS qa, -(b11 * a22 + b22 * a11 - 2 * b12 * a12) AS qb, b11 * b22 - b12 * b12 AS qc FROM pa),
    ev AS (SELECT *, CASE WHEN flat THEN CASE WHEN ax = 0 THEN b11 / a11 ELSE b22 / a22 END ELSE (-qb + (1 - 2 * ax) * sqrt(greatest(qb * qb - 4 * qa * qc, 0))) / (2 * qa) END AS l FROM ro, range(2) r(ax)),
    fl AS (SELECT fold, l, ax, CASE WHEN flat THEN 1 - ax ELSE b12 - l * a12 END AS va, CASE WHEN flat THEN ax ELSE l * a11 - b11 END AS vb, a11, a12, a22 FROM ev),
    fn AS (SELECT fold, round(abs(l - 0.5), 12) AS far, ax, va / sqrt(va * va * a11 + 2 * va * vb * a12 + vb * vb * a22) AS fa, vb / sqrt(va * va * a11 + 2 * va * vb * a12 + vb * vb * a22) AS fb FROM fl),
    tc AS (SELECT trial, any_value(y) AS y, any_value(fold) AS fold, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab FROM e GROUP BY trial)
    SELECT tc.trial, y, fn.fold AS model_fold, CAST(row_number() OVER (PARTITION BY fn.fold, tc.trial ORDER BY far DESC, ax) - 1 AS INTEGER) AS comp, round(ln(fa * fa * va + 2 * fa * fb * ab + fb * fb * vb + 1e-30), 5) AS log_power FROM fn JOIN tc ON tc.fold = fn.fold""",
)
def roi_spatial_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Log power of held-out trials under common spatial patterns of two regional means, Ledoit-Wolf class covariances."""
    rows = signal(spark, sf).select("trial", "t", _roi_mean().alias("x"))
    st = written(trial_stats(with_square_norm(rows), ["trial"], "x", "q", "t").join(_strat(spark, sf), "trial"), "trial-stats")
    filters = written(csp_filters(train_rows(st, "fold", 2), ["model_fold"], "y", 2, 2), "filters")
    power = log_power(test_rows(st, "fold"), filters, ["model_fold"], ["trial", "y"], 2, 1)
    return power.select("trial", "y", "model_fold", F.posexplode("x").alias("comp", "v")).select(
        "trial", "y", "model_fold", "comp", F.round("v", 5).alias("log_power")
    )
