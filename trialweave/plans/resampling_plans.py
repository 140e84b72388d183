"""Permutation, cluster and bootstrap inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.linalg import moments
from ..operators.ordered import exact_quantiles
from ..operators.ranks import auc, safe_corr
from ..operators.resample import (
    bootstrap_counts, cluster_mass, mean_difference, pairing_permutations, permutation_p, permuted_labels,
)
from ..operators.stats import correlation_vector, mismatch_stats
from ..session import written
from .adapters import COND, LONG, SIG, STIM, md5_sql, signal, stimulus, table, trial_condition
from .aggregate_plans import LAB, _labels
from .registry import query

N_PERM = 100
PERM = f"""n1 AS (SELECT sum(quality) AS n1 FROM q), pr AS (SELECT 0 AS perm, doc_id, score, quality AS y FROM q UNION ALL
 SELECT perm, doc_id, score, CASE WHEN row_number() OVER (PARTITION BY perm ORDER BY {md5_sql('perm', 'perm', 'doc_id')}, doc_id) <= n1 THEN 1 ELSE 0 END FROM q, n1, range(1, {N_PERM + 1}) r(perm))"""


def _p_sql(stat: str, add: int) -> str:
    return (
        f"SELECT round(o.stat, 6) AS observed, count(*) AS n_perm, count(*) FILTER (s.stat >= o.stat) AS n_ge, round((count(*) FILTER (s.stat >= o.stat) + {add}) / (count(*) + {add}), 6) AS p "
        "FROM st s, (SELECT stat FROM st WHERE perm = 0) o WHERE s.perm > 0 GROUP BY o.stat"
    )


def _p(df: DataFrame) -> DataFrame:
    return df.select(F.round("observed", 6).alias("observed"), "n_perm", "n_ge", F.round("p", 6).alias("p"))


@query(
    "mean_difference_permutation", "R6 R5 G3",
    f"WITH {LAB}, {PERM}, st AS (SELECT perm, avg(CASE WHEN y = 1 THEN score END) - avg(CASE WHEN y = 0 THEN score END) AS stat FROM pr GROUP BY perm) " + _p_sql("stat", 0),
)
def mean_difference_permutation(spark: SparkSession, sf: str) -> DataFrame:
    q = _labels(spark, sf).select("doc_id", "quality", F.col("score").cast("double").alias("score"))
    stats = mean_difference(permuted_labels(q, "doc_id", "quality", N_PERM), ["perm"], "y", "score")
    return _p(permutation_p(stats, [], "stat", add_one=False))


@query(
    "auc_permutation", "R5 Q3",
    f"""WITH {LAB}, {PERM}, c AS (SELECT perm, score, sum(y) AS p, count(*) - sum(y) AS n FROM pr GROUP BY ALL),
    b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY perm ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
    st AS (SELECT perm, sum(p * (below + n / 2.0::DOUBLE)) / (sum(p) * sum(n)) AS stat FROM b GROUP BY perm) """ + _p_sql("stat", 1),
)
def auc_permutation(spark: SparkSession, sf: str) -> DataFrame:
    q = _labels(spark, sf).select("doc_id", "quality", "score")
    stats = auc(permuted_labels(q, "doc_id", "quality", N_PERM), ["perm"], "y", "score").withColumnRenamed("auc", "stat")
    return _p(permutation_p(stats, [], "stat", add_one=True))


@query(
    "pairing_permutation", "R7 J11 O8",
    f"""WITH {LONG}, {STIM}, ids AS (SELECT trial, row_number() OVER (ORDER BY trial) - 1 AS pos FROM (SELECT DISTINCT trial FROM sig)),
    pp AS (SELECT 0 AS perm, trial AS i, trial AS j FROM ids UNION ALL SELECT perm, a.trial, b.trial FROM (SELECT perm, trial, row_number() OVER (PARTITION BY perm ORDER BY {md5_sql('pair', 'perm', 'trial')}, trial) - 1 AS pos FROM ids, range(1, {N_PERM + 1}) r(perm)) a JOIN ids b ON a.pos = b.pos),
    m AS (SELECT i, j, avg(abs(r)) AS r FROM (SELECT a.trial AS i, b.trial AS j, ch, corr(a.v, b.s) AS r FROM long a JOIN stim b ON a.t = b.t GROUP BY ALL) GROUP BY i, j),
    st AS (SELECT perm, avg(r) AS stat FROM pp JOIN m USING (i, j) GROUP BY perm)
    SELECT round(o.stat, 6) AS observed, round((o.stat - avg(s.stat)) / (stddev_pop(s.stat) + 1e-12), 4) AS z, count(*) AS n_perm, count(*) FILTER (s.stat >= o.stat) AS n_ge, round(count(*) FILTER (s.stat >= o.stat) / count(*), 6) AS p
    FROM st s, (SELECT stat FROM st WHERE perm = 0) o WHERE s.perm > 0 GROUP BY o.stat""",
)
def pairing_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """Matched pairing against shuffled pairings: mean absolute correlation over all channels, with z and p.

    Every pair that some permutation uses is scored once; the signal is read once for all its partners.
    """
    sig = signal(spark, sf).select("trial", "t", "x")
    stim = stimulus(spark, sf).select("trial", "t", F.array("s").alias("y"))
    pairs = written(pairing_permutations(sig.select("trial").distinct(), "trial", N_PERM), "pairs")
    cross = mismatch_stats(sig, stim, pairs.select("i", "j").distinct(), [0], [0], sums=moments)
    r = correlation_vector(cross, ["i", "j"], 64, 1)
    scored = r.select("i", "j", (F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v)) / F.size("x")).alias("r"))
    stats = pairs.join(written(scored, "scored-pairs"), ["i", "j"]).groupBy("perm").agg(F.avg("r").alias("stat"))
    out = permutation_p(stats, [], "stat", add_one=False)
    z = (F.col("observed") - F.col("null_mean")) / (F.col("null_sd") + 1e-12)
    return out.select(F.round("observed", 6).alias("observed"), F.round(z, 4).alias("z"), "n_perm", "n_ge", F.round("p", 6).alias("p"))


NP = 40
CURVE = f"""sc AS (SELECT sig.trial, t, CAST(x[6] AS DOUBLE) AS s, y FROM sig JOIN cond ON sig.trial = cond.trial), nn AS (SELECT sum(y) AS n1 FROM cond),
lab AS (SELECT 0 AS perm, trial, y FROM cond UNION ALL SELECT perm, trial, CASE WHEN row_number() OVER (PARTITION BY perm ORDER BY {md5_sql('perm', 'perm', 'trial')}, trial) <= n1 THEN 1 ELSE 0 END FROM cond, nn, range(1, {NP + 1}) r(perm)),
cu AS (SELECT a.perm, s1.t, sum(CASE WHEN s1.s > s0.s THEN 1.0::DOUBLE WHEN s1.s = s0.s THEN 0.5 ELSE 0 END) / count(*) AS v
 FROM lab a JOIN lab b ON a.perm = b.perm AND a.y = 1 AND b.y = 0 JOIN sc s1 ON s1.trial = a.trial JOIN sc s0 ON s0.trial = b.trial AND s0.t = s1.t GROUP BY ALL),
th AS (SELECT t, quantile_cont(v, 0.95) AS thr FROM cu WHERE perm > 0 GROUP BY t), up AS (SELECT perm, t, v FROM cu JOIN th USING (t) WHERE v > thr),
ru AS (SELECT perm, min(t) AS start, max(t) + 1 AS "end", sum(v - 0.5) AS mass FROM (SELECT *, t - row_number() OVER (PARTITION BY perm ORDER BY t) AS g FROM up) GROUP BY perm, g),
mx AS (SELECT r.perm, coalesce(max(mass), 0) AS m FROM range(1, {NP + 1}) r(perm) LEFT JOIN ru ON ru.perm = r.perm GROUP BY r.perm)"""


@query(
    "cluster_mass_test", "R8 M28 Q6",
    f'WITH {SIG}, {COND}, {CURVE} SELECT start, "end", round(mass, 6) AS mass, round((1 + count(*) FILTER (m >= mass)) / ({NP} + 1), 6) AS p FROM ru, mx WHERE ru.perm = 0 GROUP BY ALL',
)
def cluster_mass_test(spark: SparkSession, sf: str) -> DataFrame:
    labels = permuted_labels(trial_condition(spark, sf), "trial", "y", NP)
    s = signal(spark, sf).select("trial", "t", F.col("x")[5].alias("s"))
    curves = auc(s.join(labels, "trial"), ["perm", "t"], "y", "s").select("perm", "t", F.col("auc").alias("v"))
    return cluster_mass(curves, "t", "v").select("start", "end", F.round("mass", 6).alias("mass"), F.round("p", 6).alias("p"))


NB = 50


@query(
    "bootstrap_mean_map", "R9 A17",
    f"""WITH {LONG}, w AS (SELECT trial, ch, avg(v) AS w FROM long GROUP BY ALL), ids AS (SELECT trial, row_number() OVER (ORDER BY trial) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT trial FROM w)),
    d AS (SELECT boot, CAST('0x' || substr({md5_sql('boot', 'boot', 'pos')}, 1, 8) AS BIGINT) % n AS pos FROM ids, range(1, {NB + 1}) r(boot)),
    b AS (SELECT boot, ch, avg(w) AS m FROM d JOIN ids USING (pos) JOIN w ON w.trial = ids.trial GROUP BY ALL)
    SELECT ch, round(avg(m), 6) AS boot_mean, round(stddev_pop(m), 6) AS boot_sd, round(avg(m) / stddev_pop(m), 4) AS z FROM b GROUP BY ch""",
)
def bootstrap_mean_map(spark: SparkSession, sf: str) -> DataFrame:
    w = signal(spark, sf).select("trial", F.posexplode("x").alias("ch", "v")).groupBy("trial", "ch").agg(F.avg("v").alias("w"))
    draws = bootstrap_counts(w.select("trial").distinct(), [], "trial", NB)
    m = draws.join(w, "trial").groupBy("boot", "ch").agg((F.sum(F.col("mult") * F.col("w")) / F.sum("mult")).alias("m"))
    return m.groupBy("ch").agg(F.avg("m").alias("a"), F.stddev_pop("m").alias("s")).select(
        "ch", F.round("a", 6).alias("boot_mean"), F.round("s", 6).alias("boot_sd"), F.round(F.col("a") / F.col("s"), 4).alias("z")
    )


@query(
    "stratified_bootstrap_effect", "R10 A29 A30",
    f"""WITH {LAB}, ids AS (SELECT quality, doc_id, score, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY quality) AS n FROM q),
    d AS (SELECT boot, quality, CAST('0x' || substr({md5_sql('boot', 'boot', 'quality', 'pos')}, 1, 8) AS BIGINT) % n AS pos FROM ids, range(1, {NB + 1}) r(boot)),
    s AS (SELECT boot, quality, score FROM d JOIN ids USING (quality, pos)),
    e AS (SELECT boot, avg(score) FILTER (quality = 1) - avg(score) FILTER (quality = 0) AS diff, sqrt(((count(*) FILTER (quality = 1) - 1) * var_samp(score) FILTER (quality = 1) + (count(*) FILTER (quality = 0) - 1) * var_samp(score) FILTER (quality = 0)) / (count(*) - 2)) AS sd FROM s GROUP BY boot)
    SELECT round(avg(diff / (sd + 1e-12)), 6) AS d_mean, round(quantile_cont(diff / (sd + 1e-12), 0.025), 6) AS d_lo, round(quantile_cont(diff / (sd + 1e-12), 0.975), 6) AS d_hi FROM e""",
)
def stratified_bootstrap_effect(spark: SparkSession, sf: str) -> DataFrame:
    q = _labels(spark, sf).select("doc_id", "quality", F.col("score").cast("double").alias("score"))
    carry = {"c": F.count(F.lit(1)), "s": F.sum("score"), "ss": F.sum(F.col("score") * F.col("score"))}
    draws = bootstrap_counts(q, ["quality"], "doc_id", NB, carry=carry).where("doc_id is not null")
    # weighted moments per (bootstrap, label): a drawn copy is a weight, never a copied row
    m = F.col("mult")
    g = written(draws.groupBy("boot", "quality").agg(*[F.sum(m * F.col(a)).alias(b) for a, b in (("c", "n"), ("s", "s"), ("ss", "ss"))]), "moments")
    pick = lambda c, y: F.max(F.when(F.col("quality") == y, F.col(c)))
    e = g.groupBy("boot").agg(*[pick(c, y).alias(f"{c}{y}") for c in ("n", "s", "ss") for y in (0, 1)])
    ss = lambda y: F.col(f"ss{y}") - F.col(f"s{y}") * F.col(f"s{y}") / F.col(f"n{y}")
    diff = F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")
    d = e.select((diff / (F.sqrt((ss(0) + ss(1)) / (F.col("n0") + F.col("n1") - 2)) + 1e-12)).alias("d"))
    ci = exact_quantiles(d, [], "d", {"d_lo": 0.025, "d_hi": 0.975})
    return d.agg(F.round(F.avg("d"), 6).alias("d_mean")).crossJoin(F.broadcast(ci)).select("d_mean", F.round("d_lo", 6).alias("d_lo"), F.round("d_hi", 6).alias("d_hi"))


@query(
    "fold_mean_curve", "R11",
    f"""WITH {LONG}, {STIM}, c AS (SELECT l.trial % 4 AS fold, ch, d AS shift, corr(v, stim.s) AS r FROM long l, range(5) q(d) JOIN stim ON stim.trial = l.trial AND stim.t = l.t - d GROUP BY ALL)
    SELECT ch, shift, round(avg(r), 6) AS r FROM c GROUP BY ch, shift""",
)
def fold_mean_curve(spark: SparkSession, sf: str) -> DataFrame:
    sig = signal(spark, sf).select("trial", "t", "x")
    st = stimulus(spark, sf).withColumn("shift", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))))
    st = st.select("trial", (F.col("t") + F.col("shift")).alias("t"), "shift", "s")
    j = sig.join(st, ["trial", "t"]).select("trial", "shift", "s", F.posexplode("x").alias("ch", "v"))
    c = j.groupBy((F.col("trial") % 4).alias("fold"), "ch", "shift").agg(safe_corr("v", "s").alias("r"))
    return c.groupBy("ch", "shift").agg(F.round(F.avg("r"), 6).alias("r"))
