"""Inference on decoders and models: cluster tests, principal components inside folds, bootstrap, p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.distributions import spearman_two_sided, student_two_sided, welch_dof
from ..operators.classify import fit_lda, lda_scores, leave_one_out_lda, probability
from ..operators.decode_null import label_arrays, permuted_curves
from ..operators.models import Spec, fit, patterns
from ..operators.ordered import exact_quantiles
from ..operators.principal import fold_components
from ..operators.ranks import spearman
from ..operators.resample import bootstrap_counts, cluster_mass, permuted_labels
from ..operators.series import sign_agreed, sign_fixed, sliding_correlations
from ..operators.stats import sum_vectors_by_draw, trial_stats
from ..session import written
from .adapters import COND, LONG, STIM, md5_sql, signal, table, trial_condition
from .aggregate_plans import TIER
from .model_plans import BLOCK, FOLDS, P, _strat, _views, _window_rows
from .registry import query
from .roi_plans import DEC, N_PERM, PERM_LAB, ROI, ROWS, SF2, _roi, _roi_mean, _roi_rows, lda_sql

SHRINK = 0.2


def _clusters(spark, sf, rows: DataFrame, p: int, shrink, n_perm: int) -> DataFrame:
    labels = label_arrays(permuted_labels(trial_condition(spark, sf), "trial", "y", n_perm), "trial", n_perm)
    curves = written(permuted_curves(rows.join(_strat(spark, sf).drop("y"), "trial"), ["t"], "fold", labels, "trial", "x", p, shrink), "curves")
    # written as rounded numbers, so that ties with the threshold do not depend on the order of sums
    curves = curves.withColumn("v", F.round("v", 9))
    return cluster_mass(curves, "t", "v").select("start", "end", F.round("mass", 5).alias("mass"), F.round("p", 6).alias("p"))


@query("decoder_cluster_test", "R8 M28 W9 W10")
def decoder_cluster_test(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of the cross-validated curve of a 64-channel discriminant against 40 relabelled curves."""
    return _clusters(spark, sf, signal(spark, sf).select("trial", "t", "x"), P, "auto", 40)


PD = f"""WITH {LONG}, {ROI}, {COND}, {SF2}, {PERM_LAB}, k AS (SELECT CAST(f AS INTEGER) AS fold FROM range(2) r(f)), e AS (SELECT perm, t, roi.trial, sfo.fold, a, b, lab.y FROM roi JOIN sfo USING (trial) JOIN lab USING (trial)),
    cm AS (SELECT perm, t, k.fold, y, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab FROM k JOIN e ON e.fold <> k.fold GROUP BY ALL),
    pw AS (SELECT o.perm, o.t, o.fold, o.ma - z.ma AS da, o.mb - z.mb AS db, o.ma + z.ma AS ua, o.mb + z.mb AS ub, ln(o.n / z.n) AS pr, (o.n * o.va + z.n * z.va) / (o.n + z.n) AS va, (o.n * o.vb + z.n * z.vb) / (o.n + z.n) AS vb, (o.n * o.ab + z.n * z.ab) / (o.n + z.n) AS ab FROM cm o JOIN cm z USING (perm, t, fold) WHERE o.y = 1 AND z.y = 0),
    ps AS (SELECT perm, t, fold, da, db, ua, ub, pr, {1 - SHRINK} * va + {SHRINK} * (va + vb) / 2 AS va, {1 - SHRINK} * vb + {SHRINK} * (va + vb) / 2 AS vb, {1 - SHRINK} * ab AS ab FROM pw),
    ld AS (SELECT *, (vb * da - ab * db) / (va * vb - ab * ab) AS wa, (va * db - ab * da) / (va * vb - ab * ab) AS wb FROM ps),
    sc AS (SELECT e.perm, e.t, y, round(wa * a + wb * b - 0.5 * (wa * ua + wb * ub) + pr, 9) AS s FROM e JOIN ld ON ld.perm = e.perm AND ld.t = e.t AND ld.fold = e.fold),
    cu AS (SELECT p.perm, p.t, round(sum(CASE WHEN p.s > n.s THEN 1.0::DOUBLE WHEN p.s = n.s THEN 0.5 ELSE 0 END) / count(*), 9) AS v FROM sc p JOIN sc n ON p.perm = n.perm AND p.t = n.t AND p.y = 1 AND n.y = 0 GROUP BY ALL)"""


@query(
    "roi_decoder_cluster_test", "R8 M28",
    f"""{PD}, th AS (SELECT t, quantile_cont(v, 0.95) AS thr FROM cu WHERE perm > 0 GROUP BY t), up AS (SELECT perm, t, v FROM cu JOIN th USING (t) WHERE v > thr),
    ru AS (SELECT perm, min(t) AS start, max(t) + 1 AS "end", sum(v - 0.5) AS mass FROM (SELECT *, t - row_number() OVER (PARTITION BY perm ORDER BY t) AS g FROM up) GROUP BY perm, g),
    mx AS (SELECT r.perm, coalesce(max(mass), 0) AS m FROM range(1, {N_PERM + 1}) r(perm) LEFT JOIN ru ON ru.perm = r.perm GROUP BY r.perm)
    SELECT start, "end", round(mass, 5) AS mass, round((1 + count(*) FILTER (round(m, 9) >= round(mass, 9))) / ({N_PERM} + 1), 6) AS p FROM ru, mx WHERE ru.perm = 0 GROUP BY start, "end", mass""",
)
def roi_decoder_cluster_test(spark: SparkSession, sf: str) -> DataFrame:
    """The same on two regional means."""
    return _clusters(spark, sf, signal(spark, sf).select("trial", "t", _roi_mean().alias("x")), 2, SHRINK, N_PERM)


@query(
    "roi_decoder_curve", "M28 R5", f"{PD} SELECT perm, t, round(v, 6) AS auc FROM cu",
)
def roi_decoder_curve(spark: SparkSession, sf: str) -> DataFrame:
    """The curves themselves: cross-validated AUC by time for the data and every relabelling."""
    labels = label_arrays(permuted_labels(trial_condition(spark, sf), "trial", "y", N_PERM), "trial", N_PERM)
    rows = signal(spark, sf).select("trial", "t", _roi_mean().alias("x")).join(_strat(spark, sf).drop("y"), "trial")
    curves = permuted_curves(rows, ["t"], "fold", labels, "trial", "x", 2, SHRINK)
    return curves.select("perm", "t", F.round("v", 6).alias("auc"))


def _probe(rows: DataFrame, k: int) -> DataFrame:
    """Trial probabilities of a shrinkage discriminant on the leading ``k`` components of every training part."""
    rows = written(rows, "probe-rows")
    shown = written(fold_components(rows, "fold", FOLDS, "x", k), "components")
    models = written(fit_lda(shown.where("part = 'train'"), ["model_fold"], "y", "x"), "discriminants")
    sc = lda_scores(shown.where("part = 'test'"), models, ["model_fold"], "x")
    return sc.groupBy("trial", "model_fold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 5).alias("mean_score"), F.round(F.avg(probability(F.col("score"))), 5).alias("p")
    )


@query("component_probe", "M38 M3 M22")
def component_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Window vectors of 64 channels, 20 principal components of the training rows, discriminant, trial means."""
    return _probe(_window_rows(spark, sf), 20)


@query(
    "roi_component_probe", "M38 M3",
    f"""{ROWS}, st AS (SELECT k.fold, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, sign(covar_pop(a, b)) AS sg FROM k JOIN e ON e.fold <> k.fold GROUP BY k.fold),
    pc AS (SELECT st.fold AS model_fold, e.fold, e.trial, e.y, ((a - ma) / sa + sg * (b - mb) / sb) / sqrt(2) AS c FROM st CROSS JOIN e),
    m0 AS (SELECT model_fold, avg(c) AS m, stddev_pop(c) AS s FROM pc WHERE fold <> model_fold GROUP BY model_fold),
    z AS (SELECT pc.model_fold, fold, trial, y, greatest(-8, least(8, (c - m) / s)) AS z FROM pc JOIN m0 USING (model_fold)),
    cl AS (SELECT model_fold, y, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z WHERE fold <> model_fold GROUP BY ALL),
    ld AS (SELECT o.model_fold, (o.m - q.m) / ((o.n * o.v + q.n * q.v) / (o.n + q.n)) AS w, o.m + q.m AS u, ln(o.n / q.n) AS pr FROM cl o JOIN cl q ON o.model_fold = q.model_fold AND o.y = 1 AND q.y = 0),
    sc AS (SELECT z.model_fold, trial, w * z - 0.5 * w * u + pr AS s FROM z JOIN ld USING (model_fold) WHERE z.fold = z.model_fold)
    SELECT trial, model_fold, count(*) AS n, round(avg(s), 5) AS mean_score, round(avg(1 / (1 + exp(-s))), 5) AS p FROM sc GROUP BY trial, model_fold""",
)
def roi_component_probe(spark: SparkSession, sf: str) -> DataFrame:
    """One component of two standardised regional means, which is their signed sum."""
    return _probe(_roi_rows(spark, sf), 1)


SIZE, STEP = 20, 5


def _sliding(spark, sf, both: DataFrame) -> DataFrame:
    rows = sliding_correlations(both, "trial", "x", "y", SIZE, STEP, width=BLOCK).join(trial_condition(spark, sf), "trial")
    sc = leave_one_out_lda(written(rows, "window-features"), ["win"], "trial", "y", "x").where("score is not null")
    return sc.groupBy("win").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when((F.col("score") > 0) == (F.col("y") == 1), 1)).alias("n_right"), F.round(F.avg("score"), 4).alias("mean_score")
    )


@query("sliding_decoder", "M35 W12")
def sliding_decoder(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy along the trial: 64 correlations per overlapping window, discriminants without the window's trial."""
    return _sliding(spark, sf, _views(spark, sf)[2])


@query(
    "roi_sliding_decoder", "M35 W12 R2",
    f"""WITH {LONG}, {ROI}, {STIM}, {COND}, e AS (SELECT roi.trial, win, any_value(y) AS y, corr(a, s) AS a, corr(b, s) AS b FROM roi JOIN stim USING (trial, t) JOIN cond USING (trial) JOIN range(1000) r(win) ON t >= win * {STEP} AND t < win * {STEP} + {SIZE} GROUP BY roi.trial, win HAVING count(*) = {SIZE}),
    {lda_sql('win, held', 'SELECT e.win, g.held, e.y, e.a, e.b FROM (SELECT DISTINCT trial AS held FROM e) g JOIN e ON e.trial <> g.held', False)}
    SELECT e.win, count(*) AS n, count(*) FILTER (({DEC} > 0) = (e.y = 1)) AS n_right, round(avg({DEC}), 4) AS mean_score FROM e JOIN ld ON ld.win = e.win AND ld.held = e.trial GROUP BY e.win""",
)
def roi_sliding_decoder(spark: SparkSession, sf: str) -> DataFrame:
    """The same on two regional means."""
    return _sliding(spark, sf, _roi(spark, sf)[2])


BOOTS = 30


@query(
    "bootstrap_model_map", "R9 M27 A17",
    f"""WITH {LONG}, {STIM}, ids AS (SELECT trial, row_number() OVER (ORDER BY trial) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT trial FROM sig)),
    d AS (SELECT boot, CAST('0x' || substr({md5_sql('boot', 'boot', 'pos')}, 1, 8) AS BIGINT) % n AS pos FROM ids, range(1, {BOOTS + 1}) r(boot)),
    w AS (SELECT boot, trial, count(*) AS m FROM d JOIN ids USING (pos) GROUP BY ALL), j AS (SELECT trial, t, ch, v, s FROM long JOIN stim USING (trial, t)),
    tr AS (SELECT trial, ch, count(*) AS n, sum(v) AS v, sum(s) AS s, sum(v * s) AS vs FROM j GROUP BY ALL),
    bc AS (SELECT boot, ch, sum(m * vs) / sum(m * n) - sum(m * v) / sum(m * n) * sum(m * s) / sum(m * n) AS c FROM w JOIN tr USING (trial) GROUP BY ALL),
    fc AS (SELECT ch, covar_pop(v, s) AS c FROM j GROUP BY ch), fs AS (SELECT ch, c / sqrt(sum(c * c) OVER ()) * first_value(sign(c)) OVER (ORDER BY abs(c) DESC, ch) AS f FROM fc),
    bn AS (SELECT boot, ch, c / sqrt(sum(c * c) OVER (PARTITION BY boot)) AS p FROM bc), rr AS (SELECT boot, corr(p, f) AS r FROM bn JOIN fs USING (ch) GROUP BY boot),
    al AS (SELECT boot, ch, CASE WHEN r < 0 THEN -p ELSE p END AS p, abs(r) AS r FROM bn JOIN rr USING (boot))
    SELECT al.ch, round(any_value(f), 6) AS weight, round(avg(p), 5) AS boot_mean, round(stddev_pop(p), 5) AS boot_sd, round(avg(p) / (stddev_pop(p) + 1e-12), 3) AS z, round(avg(r), 5) AS reliability FROM al JOIN fs USING (ch) GROUP BY al.ch""",
)
def bootstrap_model_map(spark: SparkSession, sf: str) -> DataFrame:
    """Bootstrap over trials of a 64-channel model: every draw is refitted from weighted trial statistics.

    Patterns are signed to agree with the one of all data; reliability is their mean correlation with it.
    """
    _, _, both = _views(spark, sf)
    st = written(trial_stats(both, ["trial"], "x", "y", "t"), "trial-stats")
    drawn = bootstrap_counts(st.select("trial"), [], "trial", BOOTS).groupBy("trial").agg(F.map_from_entries(F.collect_list(F.struct("boot", "mult"))).alias("m"))
    times = F.transform(F.sequence(F.lit(0), F.lit(BOOTS)), lambda b: F.when(b == 0, F.lit(1.0)).otherwise(F.coalesce(F.try_element_at("m", b), F.lit(0)).cast("double")))
    weighted = st.join(drawn, "trial", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,bigint>"))).select("s", times.alias("w"))
    sums = written(sum_vectors_by_draw(weighted, "s", "w"), "draw-sums")  # draw 0 is the data
    pt = patterns(fit(sums, ["draw"], P, 1, {"backward": Spec("backward", rcond=1e-12)}), sums, ["draw"], P, 1)
    long = written(pt.where("comp = 0").select("draw", F.posexplode("px").alias("ch", "weight")), "draw-patterns")
    full = written(sign_fixed(long.where("draw = 0"), ["draw"], "ch", "weight").select("ch", "weight"), "full-pattern")
    agreed = sign_agreed(long.where("draw > 0"), full, ["draw"], "ch", "weight").select("draw", "ch", "weight")
    joined = written(agreed.join(F.broadcast(full.withColumnRenamed("weight", "f")), "ch"), "agreed")
    reliability = joined.groupBy("draw").agg(F.corr("weight", "f").alias("r")).agg(F.round(F.avg("r"), 5).alias("reliability"))
    out = joined.groupBy("ch").agg(F.first("f").alias("f"), F.avg("weight").alias("a"), F.stddev_pop("weight").alias("d"))
    return out.crossJoin(F.broadcast(reliability)).select(
        "ch", F.round("f", 6).alias("weight"), F.round("a", 5).alias("boot_mean"), F.round("d", 5).alias("boot_sd"), F.round(F.col("a") / (F.col("d") + 1e-12), 3).alias("z"), "reliability"
    )


SLOPES = 20


@query(
    "stratified_bootstrap_slope", "R10 A32 A30",
    f"""WITH o AS (SELECT o_orderkey, {TIER} AS tier, o_totalprice AS v FROM orders), ids AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY tier) AS n FROM o),
    d AS (SELECT boot, tier, CAST('0x' || substr({md5_sql('boot', 'boot', 'tier', 'pos')}, 1, 8) AS BIGINT) % n AS pos FROM ids, range(1, {SLOPES + 1}) r(boot)),
    s AS (SELECT boot, regr_slope(v, tier) AS slope FROM d JOIN ids USING (tier, pos) GROUP BY boot)
    SELECT round(avg(slope), 3) AS slope_mean, round(quantile_cont(slope, 0.025), 3) AS slope_lo, round(quantile_cont(slope, 0.975), 3) AS slope_hi FROM s""",
)
def stratified_bootstrap_slope(spark: SparkSession, sf: str) -> DataFrame:
    """Slope over ordered levels with its percentile interval, drawn anew inside every level."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("tier"), F.col("o_totalprice").cast("double").alias("v"))
    carry = {"c": F.count(F.lit(1)), "sv": F.sum("v")}
    draws = bootstrap_counts(o, ["tier"], "o_orderkey", SLOPES, carry=carry).where("o_orderkey is not null")
    m, x, v = F.col("mult") * F.col("c"), F.col("tier"), F.col("mult") * F.col("sv")
    # weighted moments per draw: a drawn copy is a weight, never a copied row
    g = draws.groupBy("boot").agg(F.sum(m).alias("n"), F.sum(m * x).alias("sx"), F.sum(v).alias("sv"), F.sum(m * x * x).alias("sxx"), F.sum(x * v).alias("sxv"))
    slope = (F.col("sxv") - F.col("sx") * F.col("sv") / F.col("n")) / (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
    g = written(g.select(slope.alias("slope")), "slopes")  # read by the mean and by both quantiles
    ci = exact_quantiles(g, [], "slope", {"slope_lo": 0.025, "slope_hi": 0.975})
    return g.agg(F.round(F.avg("slope"), 3).alias("slope_mean")).crossJoin(F.broadcast(ci)).select("slope_mean", F.round("slope_lo", 3).alias("slope_lo"), F.round("slope_hi", 3).alias("slope_hi"))


def student_sql(source: str, keys: str, tests: dict[str, tuple[str, str]], points: int = 2000) -> str:
    """``keys`` and a two-sided p per named ``(t, dof)``: the integral of cos^(dof-1) by Simpson's rule."""
    angles = ", ".join(f"least(atan(abs({t}) / sqrt({dof})), least(pi() / 2, 40 / sqrt({dof}))) AS th_{n}, least(pi() / 2, 40 / sqrt({dof})) AS en_{n}, {dof} AS df_{n}" for n, (t, dof) in tests.items())
    coef = f"CASE WHEN k = 0 OR k = {points} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    sums = ", ".join(
        f"1 - sum({coef} * cos(th_{n} * k / {points}) ** (df_{n} - 1)) * any_value(th_{n}) / (sum({coef} * cos(en_{n} * k / {points}) ** (df_{n} - 1)) * any_value(en_{n})) AS {n}" for n in tests
    )
    return f"SELECT {keys}, {sums} FROM (SELECT *, {angles} FROM {source}), range({points + 1}) r(k) GROUP BY {keys}"


@query(
    "spearman_p_values", "A33",
    f"""WITH o AS (SELECT o_custkey % 40 AS grp, {TIER} AS tier, o_totalprice AS v FROM orders), r AS (SELECT grp,
     rank() OVER (PARTITION BY grp ORDER BY tier) + (count(*) OVER (PARTITION BY grp, tier) - 1) / 2.0::DOUBLE AS rx,
     rank() OVER (PARTITION BY grp ORDER BY v) + (count(*) OVER (PARTITION BY grp, v) - 1) / 2.0::DOUBLE AS ry FROM o),
    s AS (SELECT grp, corr(rx, ry) AS rho, count(*) AS n FROM r GROUP BY grp), t AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, n - 2.0::DOUBLE AS dof FROM s),
    p AS ({student_sql('t', 'grp', {'p': ('t', 'dof')})})
    SELECT s.grp, round(rho, 6) AS rho, n, round(p, 6) AS p FROM s JOIN p ON p.grp = s.grp""",
)
def spearman_p_values(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation of priority and price in 40 groups of customers, with two-sided p."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("grp"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("tier"), F.col("o_totalprice").alias("v"))
    r = spearman(o, ["grp"], "tier", "v")
    return r.select("grp", F.round("rho", 6).alias("rho"), "n", F.round(spearman_two_sided("rho", "n"), 6).alias("p"))


PRICE = 150000.0


@query(
    "t_test_p_values", "A34",
    f"""WITH q AS (SELECT o_custkey % 40 AS grp, o_orderstatus AS st, CAST(o_totalprice AS DOUBLE) AS v FROM orders WHERE o_orderstatus IN ('F', 'O')),
    s AS (SELECT grp, avg(v) FILTER (st = 'F') - avg(v) FILTER (st = 'O') AS diff, var_samp(v) FILTER (st = 'F') / count(*) FILTER (st = 'F') AS a, var_samp(v) FILTER (st = 'O') / count(*) FILTER (st = 'O') AS b,
     count(*) FILTER (st = 'F') AS n1, count(*) FILTER (st = 'O') AS n0, (avg(v) - {PRICE}) / (stddev_samp(v) / sqrt(count(*))) AS one_t, count(*) - 1.0::DOUBLE AS one_dof FROM q GROUP BY grp),
    t AS (SELECT *, diff / sqrt(a + b) AS welch_t, (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n0 - 1)) AS welch_dof FROM s),
    p AS ({student_sql('t', 'grp', {'one_p': ('one_t', 'one_dof'), 'welch_p': ('welch_t', 'welch_dof')})})
    SELECT t.grp, round(one_t, 6) AS one_t, round(one_p, 6) AS one_p, round(welch_t, 6) AS welch_t, round(welch_dof, 4) AS welch_dof, round(welch_p, 6) AS welch_p FROM t JOIN p ON p.grp = t.grp""",
)
def t_test_p_values(spark: SparkSession, sf: str) -> DataFrame:
    """One-sample t against a given price and Welch's t between two order states, with p, in 40 groups of customers."""
    v = F.col("o_totalprice").cast("double")
    q = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O")).select((F.col("o_custkey") % 40).alias("grp"), "o_orderstatus", v.alias("v"))
    a, b = (F.when(F.col("o_orderstatus") == s, F.col("v")) for s in ("F", "O"))
    s = q.groupBy("grp").agg(
        F.avg(a).alias("m1"), F.avg(b).alias("m0"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v0"), F.count(a).alias("n1"), F.count(b).alias("n0"),
        ((F.avg("v") - PRICE) / (F.stddev_samp("v") / F.sqrt(F.count("v")))).alias("one_t"), (F.count("v") - 1).cast("double").alias("one_dof"),
    )
    c = F.col
    s = s.withColumn("welch_t", (c("m1") - c("m0")) / F.sqrt(c("v1") / c("n1") + c("v0") / c("n0"))).withColumn("welch_dof", welch_dof(c("v1"), c("n1"), c("v0"), c("n0")))
    return s.select(
        "grp", F.round("one_t", 6).alias("one_t"), F.round(student_two_sided("one_t", "one_dof"), 6).alias("one_p"),
        F.round("welch_t", 6).alias("welch_t"), F.round("welch_dof", 4).alias("welch_dof"), F.round(student_two_sided("welch_t", "welch_dof"), 6).alias("welch_p"),
    )
