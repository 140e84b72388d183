"""Quality ledgers, descriptive statistics, rank statistics and effect sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordered import exact_quantiles
from ..operators.quality import (
    channel_stats, common_correlation, nearest_channels, neighbour_coherence, pooled_correlations, reasons,
    repair_from_neighbours, robust_z, scheduled_bad, sparse_repair, with_sources,
)
from ..operators.ranks import auc, cohens_d, confusion, mid_ranks, one_sample_t, roc_points, safe_corr, spearman, welch_t
from ..operators.stats import trial_stats
from ..session import written
from .adapters import COND, EV, LONG, SIG, STIM, events, signal, signal_long, stimulus, table, trial_condition
from .join_plans import EPO, HOUR, _epochs
from .registry import query

QS = "WITH " + LONG + ", s AS (SELECT ch, max(v) - min(v) AS p2p, stddev_pop(v) AS sd, var_pop(v) AS var FROM long GROUP BY ch)"


@query("channel_descriptors", "A1", QS + " SELECT ch, round(p2p, 6) AS p2p, round(sd, 6) AS sd, true AS finite FROM s")
def channel_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    s = channel_stats(signal_long(spark, sf), ["ch"])
    return s.select("ch", F.round("p2p", 6).alias("p2p"), F.round("sd", 6).alias("sd"), "finite")


def _rz(expr: str, div: str) -> str:
    return (
        f", x AS (SELECT ch, p2p, sd, var, {expr} AS x FROM s), m AS (SELECT median(x) AS med FROM x), "
        f"d AS (SELECT median(abs(x - med)) AS mad FROM x, m), z AS (SELECT ch, p2p, 0.6745 * (x - med) / {div} AS z FROM x, m, d) "
    )


@query("robust_z_log_std", "A2", QS + _rz("ln(greatest(sd, 1e-12))", "greatest(mad, 2.220446049250313e-16)") + "SELECT ch, round(z, 6) AS z FROM z")
def robust_z_log_std(spark: SparkSession, sf: str) -> DataFrame:
    s = channel_stats(signal_long(spark, sf), ["ch"]).withColumn("x", F.log(F.greatest("sd", F.lit(1e-12))))
    return robust_z(s, [], "x", "z").select("ch", F.round("z", 6).alias("z"))


@query(
    "bad_channels_by_variance", "A3 A13",
    QS + _rz("ln(var + 1e-30)", "(mad + 1e-30)") + ", f AS (SELECT ch, 'auto' AS src FROM z WHERE abs(z) > 1.5 OR p2p < 0.2 UNION ALL SELECT ch, 'manual' FROM s WHERE ch IN (3, 5)) "
    "SELECT ch, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM f GROUP BY ch",
)
def bad_channels_by_variance(spark: SparkSession, sf: str) -> DataFrame:
    s = channel_stats(signal_long(spark, sf), ["ch"]).withColumn("x", F.log(F.col("var") + 1e-30))
    z = robust_z(s, [], "x", "z", add=1e-30)
    auto = z.where((F.abs("z") > 1.5) | (F.col("p2p") < 0.2))
    manual = s.where(F.col("ch").isin(3, 5))
    return with_sources({"auto": auto, "manual": manual}, "ch").select("ch", F.concat_ws(",", "sources").alias("sources"))


def channel_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations of all channel pairs over the whole signal."""
    sig = signal(spark, sf).select("x", F.array(F.lit(0.0)).alias("y"))
    return pooled_correlations(trial_stats(sig, [], "x", "y"), 64, 1)


@query(
    "common_correlation", "A5",
    f"WITH {LONG}, c AS (SELECT trial, t, avg(v) AS c FROM long GROUP BY ALL) SELECT ch, round(corr(v, c), 6) AS common_corr FROM long JOIN c USING (trial, t) GROUP BY ch",
)
def common_correlation_query(spark: SparkSession, sf: str) -> DataFrame:
    c = common_correlation(channel_pairs(spark, sf))
    return c.select("ch", F.round("common_corr", 6).alias("common_corr"))


POS = "pos AS (SELECT CAST(ch AS INTEGER) AS ch, cos(ch * 0.09817477) AS px, sin(ch * 0.09817477) AS py, (ch % 8) * 0.125 AS pz FROM range(64) r(ch))"
KNN = POS + """, kn AS (SELECT * FROM (SELECT a.ch, b.ch AS nbr, sqrt((a.px-b.px)**2 + (a.py-b.py)**2 + (a.pz-b.pz)**2) AS dist,
 row_number() OVER (PARTITION BY a.ch ORDER BY (0.0 + (b.px-a.px)**2) + (b.py-a.py)**2 + (b.pz-a.pz)**2, b.ch) AS rank FROM pos a JOIN pos b ON a.ch <> b.ch) WHERE rank <= 4)"""


def montage(long: DataFrame) -> DataFrame:
    """Electrode positions on a helix, from the channel numbers that occur."""
    a = F.col("ch") * 0.09817477
    return long.select("ch").distinct().select("ch", F.cos(a).alias("px"), F.sin(a).alias("py"), ((F.col("ch") % 8) * 0.125).alias("pz"))


def edges_of(long: DataFrame, k: int = 4) -> DataFrame:
    return nearest_channels(montage(long), [], "ch", ["px", "py", "pz"], k)


@query("nearest_channels", "J12", f"WITH {KNN} SELECT ch, count(*) AS n, round(sum(dist), 6) AS sum_dist, round(max(dist), 6) AS max_dist FROM kn GROUP BY ch")
def nearest_channels_query(spark: SparkSession, sf: str) -> DataFrame:
    e = edges_of(signal_long(spark, sf))
    return e.groupBy("ch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("dist"), 6).alias("sum_dist"), F.round(F.max("dist"), 6).alias("max_dist"))


# Distances on the helix tie between the two directions, so coherence uses an untied ring.
RING = "kr AS (SELECT CAST(a AS INTEGER) AS ch, CAST((a + o) % 64 AS INTEGER) AS nbr, CAST(o AS DOUBLE) AS dist FROM range(64) r(a), range(1, 5) q(o))"


def ring_edges(long: DataFrame, step: int = 1) -> DataFrame:
    ch = long.select("ch").distinct()
    return ch.select("ch", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("o")).select(
        "ch", ((F.col("ch") + F.col("o") * step) % 64).cast("int").alias("nbr"), F.col("o").cast("double").alias("dist")
    )


@query(
    "neighbour_coherence", "A8",
    f"WITH {LONG}, {RING}, r AS (SELECT a.ch, b.ch AS nbr, corr(a.v, b.v) AS r FROM long a JOIN kr ON a.ch = kr.ch JOIN long b ON b.ch = kr.nbr AND a.trial = b.trial AND a.t = b.t GROUP BY ALL) SELECT ch, round(avg(r), 6) AS coherence, avg(r) < 0.2 AS outlier FROM r GROUP BY ch",
)
def neighbour_coherence_query(spark: SparkSession, sf: str) -> DataFrame:
    pairs = channel_pairs(spark, sf)
    c = neighbour_coherence(pairs, ring_edges(pairs))
    return c.select("ch", F.round("coherence", 6).alias("coherence"), (F.col("coherence") < 0.2).alias("outlier"))


@query(
    "map_comparison", "A9",
    f"""WITH {LONG}, kr AS (SELECT s AS map_step, CAST(a AS INTEGER) AS ch, CAST((a + o * s) % 64 AS INTEGER) AS nbr FROM range(64) r(a), range(1, 5) q(o), (VALUES (1), (7), (13)) m(s)),
    r AS (SELECT map_step, a.ch, kr.nbr, corr(a.v, b.v) AS r FROM long a JOIN kr ON a.ch = kr.ch JOIN long b ON b.ch = kr.nbr AND a.trial = b.trial AND a.t = b.t GROUP BY ALL),
    c AS (SELECT map_step, avg(m) AS coherence FROM (SELECT map_step, ch, avg(r) AS m FROM r GROUP BY ALL) GROUP BY map_step)
    SELECT map_step, round(coherence, 6) AS coherence, coherence = (SELECT max(coherence) FROM c) AS best FROM c""",
)
def map_comparison(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    pairs = written(channel_pairs(spark, sf), "channel-pairs")  # one pass serves every candidate map
    out = None
    for step in (1, 7, 13):
        c = neighbour_coherence(pairs, ring_edges(pairs, step)).agg(F.avg("coherence").alias("coherence"))
        c = c.select(F.lit(step).alias("map_step"), "coherence")
        out = c if out is None else out.unionByName(c)
    best = F.max("coherence").over(Window.partitionBy(F.lit(1)))  # one row per candidate map
    return out.select("map_step", F.round("coherence", 6).alias("coherence"), (F.col("coherence") == best).alias("best"))


@query(
    "channel_reasons", "A10",
    QS + _rz("ln(greatest(sd, 1e-12))", "greatest(mad, 2.220446049250313e-16)")
    + ", c AS (SELECT trial, t, avg(v) AS c FROM long GROUP BY ALL), k AS (SELECT ch, corr(v, c) AS r FROM long JOIN c USING (trial, t) GROUP BY ch) "
    "SELECT z.ch, concat_ws(',', CASE WHEN p2p < 0.6 THEN 'flat' END, CASE WHEN abs(z) > 1.5 THEN 'variance' END, CASE WHEN r < 0.1 THEN 'weak_common_corr' END) AS reasons FROM z JOIN k ON z.ch = k.ch "
    "WHERE p2p < 0.6 OR abs(z) > 1.5 OR r < 0.1",
)
def channel_reasons(spark: SparkSession, sf: str) -> DataFrame:
    long = signal_long(spark, sf)
    s = channel_stats(long, ["ch"]).withColumn("x", F.log(F.greatest("sd", F.lit(1e-12))))
    all_ = robust_z(s, [], "x", "z").join(common_correlation(channel_pairs(spark, sf)), "ch")
    r = reasons(
        nonfinite=~F.col("finite"), flat=F.col("p2p") < 0.6, variance=F.abs("z") > 1.5,
        weak_common_corr=F.col("common_corr") < 0.1,
    )
    return all_.withColumn("reasons", r).where(F.size("reasons") > 0).select("ch", F.concat_ws(",", "reasons").alias("reasons"))


@query(
    "scheduled_bad_channels", "A11 F3",
    """WITH s AS (SELECT CAST(s_suppkey AS INTEGER) AS lo, CAST(s_suppkey + s_nationkey AS INTEGER) AS hi, s_nationkey % 6 AS ch FROM supplier),
    x AS (SELECT DISTINCT ch, unnest(range(lo, hi + 1)) AS trial FROM s), c AS (SELECT ch, count(*) AS n_trials FROM x GROUP BY ch)
    SELECT ch, n_trials, round(n_trials / (SELECT max(hi) FROM s), 6) AS share FROM c WHERE n_trials / (SELECT max(hi) FROM s) >= 0.3""",
)
def scheduled_bad_channels(spark: SparkSession, sf: str) -> DataFrame:
    sup = table(spark, sf, "supplier")
    span = F.when(F.col("s_nationkey") == 0, F.col("s_suppkey").cast("string")).otherwise(
        F.concat_ws("-", F.col("s_suppkey"), F.col("s_suppkey") + F.col("s_nationkey"))
    )
    sched = sup.select(span.alias("span"), F.array(F.col("s_nationkey") % 6).alias("chs"))
    return scheduled_bad(sched, "span", "chs", 0.3).select("ch", "n_trials", F.round("share", 6).alias("share"))


@query(
    "impedance_gate", "A12",
    "SELECT l_suppkey, round(median(l_extendedprice), 4) AS median_kohm FROM lineitem GROUP BY l_suppkey HAVING median(l_extendedprice) >= 25000",
)
def impedance_gate(spark: SparkSession, sf: str) -> DataFrame:
    m = exact_quantiles(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", {"median_kohm": 0.5})
    return m.where("median_kohm >= 25000").select("l_suppkey", F.round("median_kohm", 4).alias("median_kohm"))


@query(
    "stimulus_correlation_map", "A18 A19",
    f"""WITH {LONG}, {STIM}, j AS (SELECT l.trial, ch, v, s FROM long l JOIN stim ON l.trial = stim.trial AND l.t = stim.t),
    p AS (SELECT ch, corr(v, s) AS pooled FROM j GROUP BY ch), a AS (SELECT ch, avg(r) AS averaged FROM (SELECT trial, ch, corr(v, s) AS r FROM j GROUP BY ALL) GROUP BY ch)
    SELECT ch, round(pooled, 6) AS pooled, round(averaged, 6) AS averaged FROM p JOIN a USING (ch)""",
)
def stimulus_correlation_map(spark: SparkSession, sf: str) -> DataFrame:
    j = signal_long(spark, sf).join(stimulus(spark, sf), ["trial", "t"])
    pooled = j.groupBy("ch").agg(safe_corr("v", "s").alias("pooled"))
    per = j.groupBy("trial", "ch").agg(safe_corr("v", "s").alias("r")).groupBy("ch").agg(F.avg("r").alias("averaged"))
    return pooled.join(per, "ch").select("ch", F.round("pooled", 6).alias("pooled"), F.round("averaged", 6).alias("averaged"))


@query(
    "condition_means", "A20 P13",
    f"""WITH {LONG}, {COND}, m AS (SELECT ch, avg(CASE WHEN y = 1 THEN v * v END) AS audio, avg(CASE WHEN y = 0 THEN v * v END) AS visual FROM long JOIN cond ON long.trial = cond.trial GROUP BY ch)
    SELECT ch, round(audio, 6) AS audio, round(visual, 6) AS visual, round(audio - visual, 6) AS diff FROM m""",
)
def condition_means(spark: SparkSession, sf: str) -> DataFrame:
    j = signal_long(spark, sf).join(trial_condition(spark, sf), "trial")
    p = j.groupBy("ch").pivot("y", [0, 1]).agg(F.avg(F.col("v") * F.col("v")))
    return p.select("ch", F.round("1", 6).alias("audio"), F.round("0", 6).alias("visual"), F.round(F.col("1") - F.col("0"), 6).alias("diff"))


@query(
    "event_locked_average", "A21 J7",
    f"""WITH {EPO}, b AS (SELECT rel // {6 * HOUR} AS bin, ch, avg(value) AS m FROM ep WHERE rel >= 0 GROUP BY ALL)
    SELECT bin, round(max(CASE WHEN ch = 'click' THEN m END), 6) AS standard, round(max(CASE WHEN ch = 'error' THEN m END), 6) AS deviant,
    round(max(CASE WHEN ch = 'error' THEN m END) - max(CASE WHEN ch = 'click' THEN m END), 6) AS difference FROM b GROUP BY bin""",
)
def event_locked_average(spark: SparkSession, sf: str) -> DataFrame:
    ep = _epochs(spark, sf).where("rel >= 0").withColumn("bin", F.floor(F.col("rel") / (6 * HOUR)))
    w = ep.groupBy("bin").pivot("ch", ["click", "error"]).agg(F.avg("value"))
    return w.select("bin", F.round("click", 6).alias("standard"), F.round("error", 6).alias("deviant"), F.round(F.col("error") - F.col("click"), 6).alias("difference"))


@query(
    "global_field_power", "A22",
    f"""WITH {LONG}, a AS (SELECT t, ch, avg(v) AS m FROM long GROUP BY ALL) SELECT t, round(stddev_pop(m), 6) AS gfp, round(sqrt(avg(m * m)), 6) AS rms FROM a GROUP BY t""",
)
def global_field_power(spark: SparkSession, sf: str) -> DataFrame:
    a = signal_long(spark, sf).groupBy("t", "ch").agg(F.avg("v").alias("m"))
    return a.groupBy("t").agg(F.round(F.stddev_pop("m"), 6).alias("gfp"), F.round(F.sqrt(F.avg(F.col("m") * F.col("m"))), 6).alias("rms"))


TIER = "CAST(o_orderpriority[1] AS INTEGER) - 1"


@query(
    "tier_means", "A23",
    f"SELECT {TIER} AS tier, count(*) AS n, round(avg(o_totalprice), 4) AS mean_v, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS sem FROM orders GROUP BY 1",
)
def tier_means(spark: SparkSession, sf: str) -> DataFrame:
    tier = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return table(spark, sf, "orders").groupBy(tier.alias("tier")).agg(
        F.count("o_totalprice").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_v"),
        F.round(F.stddev_samp("o_totalprice") / F.sqrt(F.count("o_totalprice")), 4).alias("sem"),
    )


@query(
    "marker_pivot", "A25 F4",
    f"""WITH {EV}, e AS (SELECT *, user_id * 100 + us // 86400000000 % 100 AS trial FROM ev)
    SELECT trial, coalesce(arg_max(us, (us, event_id)) FILTER (event_type = 'click'), arg_min(us, (us, event_id)) FILTER (event_type = 'view')) AS onset,
    arg_max(value, (us, event_id)) FILTER (event_type = 'error') AS block_dur, arg_max(k, (us, event_id)) FILTER (event_type = 'purchase') AS resets FROM e GROUP BY trial
    HAVING coalesce(arg_max(value, (us, event_id)) FILTER (event_type = 'error'), 0) > 5 AND coalesce(arg_max(us, (us, event_id)) FILTER (event_type = 'click'), arg_min(us, (us, event_id)) FILTER (event_type = 'view')) IS NOT NULL""",
)
def marker_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Trial table from markers: the last audio onset wins over the first av onset."""
    ev = events(spark, sf).withColumn("trial", F.col("user_id") * 100 + F.floor(F.col("us") / 86_400_000_000) % 100)
    order = F.struct("us", "event_id")
    last = lambda v, kind: F.max_by(v, F.when(F.col("event_type") == kind, order))
    first = F.min_by("us", F.when(F.col("event_type") == "view", order))
    t = ev.groupBy("trial").agg(
        F.coalesce(last("us", "click"), first).alias("onset"), last("value", "error").alias("block_dur"), last("k", "purchase").alias("resets")
    )
    return t.where((F.coalesce("block_dur", F.lit(0.0)) > 5) & F.col("onset").isNotNull())


@query(
    "channel_auc", "A26",
    f"""WITH {LONG}, {COND}, m AS (SELECT long.trial, y, ch, round(avg(v), 2) AS s FROM long JOIN cond ON long.trial = cond.trial GROUP BY ALL)
    SELECT a.ch, round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*), 6) AS auc FROM m a JOIN m b ON a.ch = b.ch AND a.y = 1 AND b.y = 0 GROUP BY a.ch""",
)
def channel_auc(spark: SparkSession, sf: str) -> DataFrame:
    m = signal_long(spark, sf).groupBy("trial", "ch").agg(F.round(F.avg("v"), 2).alias("s")).join(trial_condition(spark, sf), "trial")
    return auc(m, ["ch"], "y", "s").select("ch", F.round("auc", 6).alias("auc"))


LAB = "q AS (SELECT l.doc_id, quality, toxic, n_chars // 200 AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.floor(F.col("n_chars") / 200).alias("score"))
    return table(spark, sf, "labels").join(docs, "doc_id")


@query("document_auc", "A26", f"WITH {LAB} SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*), 6) AS auc FROM q a JOIN q b ON a.quality = 1 AND b.quality = 0")
def document_auc(spark: SparkSession, sf: str) -> DataFrame:
    return auc(_labels(spark, sf), [], "quality", "score").select(F.round("auc", 6).alias("auc"))


@query(
    "confusion_matrix", "A27",
    f"WITH {LAB} SELECT count(*) FILTER (quality = 0 AND score < 5) AS c00, count(*) FILTER (quality = 0 AND score >= 5) AS c01, count(*) FILTER (quality = 1 AND score < 5) AS c10, count(*) FILTER (quality = 1 AND score >= 5) AS c11, round(avg(CASE WHEN (score >= 5) = (quality = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM q",
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    q = _labels(spark, sf).withColumn("pred", F.when(F.col("score") >= 5, 1).otherwise(0))
    return confusion(q, [], "quality", "pred").withColumn("accuracy", F.round("accuracy", 6))


@query(
    "roc_curve", "A28",
    f"""WITH {LAB}, c AS (SELECT score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM q GROUP BY score)
    SELECT score AS threshold, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER w / sum(n) OVER (), 6) AS fpr FROM c WINDOW w AS (ORDER BY score DESC)""",
)
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    r = roc_points(_labels(spark, sf), [], "quality", "score")
    return r.select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(
    "effect_sizes", "A29 A34",
    f"""WITH {LAB}, s AS (SELECT avg(score) FILTER (quality = 1) AS m1, avg(score) FILTER (quality = 0) AS m0, var_samp(score) FILTER (quality = 1) AS v1, var_samp(score) FILTER (quality = 0) AS v0,
     count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0, avg(score) / (stddev_samp(score) / sqrt(count(*))) AS t1 FROM q)
    SELECT round((m1 - m0) / (sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) + 1e-12), 6) AS d, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS welch_t, round(t1, 6) AS one_t FROM s""",
)
def effect_sizes(spark: SparkSession, sf: str) -> DataFrame:
    q = _labels(spark, sf)
    y, v = F.col("quality"), F.col("score").cast("double")
    return q.agg(F.round(cohens_d(y, v), 6).alias("d"), F.round(welch_t(y, v), 6).alias("welch_t"), F.round(one_sample_t(v), 6).alias("one_t"))


@query(
    "null_percentiles", "A30",
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 4) AS p2_5, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.975), 4) AS p97_5 FROM lineitem GROUP BY 1",
)
def null_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    q = exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p2_5": 0.025, "p95": 0.95, "p97_5": 0.975})
    return q.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("p2_5", "p95", "p97_5")])


@query("tier_slope", "A32", f"SELECT o_orderstatus, round(regr_slope(o_totalprice, {TIER}), 4) AS slope FROM orders GROUP BY 1")
def tier_slope(spark: SparkSession, sf: str) -> DataFrame:
    tier = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.round(F.regr_slope("o_totalprice", tier), 4).alias("slope"))


@query(
    "spearman_by_group", "A33",
    f"""WITH o AS (SELECT o_orderstatus, {TIER} AS tier, o_totalprice AS v FROM orders), r AS (SELECT o_orderstatus,
     rank() OVER (PARTITION BY o_orderstatus ORDER BY tier) + (count(*) OVER (PARTITION BY o_orderstatus, tier) - 1) / 2.0::DOUBLE AS rx,
     rank() OVER (PARTITION BY o_orderstatus ORDER BY v) + (count(*) OVER (PARTITION BY o_orderstatus, v) - 1) / 2.0::DOUBLE AS ry FROM o)
    SELECT o_orderstatus, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY 1""",
)
def spearman_by_group(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderstatus", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("tier"), F.col("o_totalprice").alias("v"))
    return spearman(o, ["o_orderstatus"], "tier", "v").select("o_orderstatus", F.round("rho", 6).alias("rho"), "n")


@query(
    "label_counts", "A35",
    "SELECT event_type AS label, count(*) AS n, count(*) FILTER (value > 10) AS usable, count(*) FILTER (NOT value > 10) AS dropped FROM events GROUP BY 1",
)
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy(F.col("event_type").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") > 10, 1)).alias("usable"), F.count(F.when(~(F.col("value") > 10), 1)).alias("dropped")
    )


@query(
    "match_audit", "A36",
    f"""WITH {EV}, m AS (SELECT min(abs(e.us - v.us)) AS err FROM ev e JOIN ev v ON e.user_id = v.user_id AND v.event_type = 'view' WHERE e.event_type = 'purchase' GROUP BY e.event_id)
    SELECT max(err) AS max_err, round(median(err), 1) AS median_err FROM m""",
)
def match_audit(spark: SparkSession, sf: str) -> DataFrame:
    from .join_plans import nearest_frame

    m = nearest_frame(spark, sf)
    med = exact_quantiles(m, [], "err", {"median_err": 0.5})
    return m.agg(F.max("err").alias("max_err")).crossJoin(F.broadcast(med)).select("max_err", F.round("median_err", 1).alias("median_err"))


@query(
    "sparse_repair", "X23 A37",
    f"""WITH {LONG}, {RING}, p AS (SELECT a.trial, a.t, a.ch, any_value(a.v) AS v, avg(b.v) AS p FROM long a JOIN kr ON a.ch = kr.ch JOIN long b ON b.ch = kr.nbr AND a.trial = b.trial AND a.t = b.t GROUP BY ALL),
    s AS (SELECT ch, stddev_pop(v - p) AS sd FROM p GROUP BY ch), o AS (SELECT p.*, abs(v - p) > 2 * sd AS hit FROM p JOIN s USING (ch))
    SELECT ch, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share, round(sum(CASE WHEN hit THEN p ELSE v END), 6) AS total FROM o GROUP BY ch""",
)
def sparse_repair_query(spark: SparkSession, sf: str) -> DataFrame:
    sig = signal(spark, sf).select("trial", "t", "x")
    edges = ring_edges(signal_long(spark, sf))
    out = sparse_repair(sig, "x", 64, edges, 2.0)
    out = out.select(F.posexplode(F.arrays_zip(F.col("x").alias("v"), "repaired")).alias("ch", "z")).select("ch", "z.v", "z.repaired")
    return out.groupBy("ch").agg(F.round(F.avg(F.col("repaired").cast("double")), 6).alias("share"), F.round(F.sum("v"), 6).alias("total"))


@query(
    "neighbour_repair", "X22",
    f"""WITH {SIG} SELECT trial, t, CAST(ch AS INTEGER) AS ch, CASE WHEN ch IN (3, 9) THEN round((CAST(x[ch + 2] AS DOUBLE) + CAST(x[ch + 3] AS DOUBLE) / 2 + CAST(x[ch + 4] AS DOUBLE) / 3 + CAST(x[ch + 5] AS DOUBLE) / 4) / (1.0::DOUBLE + 1.0::DOUBLE / 2 + 1.0::DOUBLE / 3 + 1.0::DOUBLE / 4), 6)
    ELSE round(CAST(x[ch + 1] AS DOUBLE), 6) END AS v, ch IN (3, 9) AS repaired FROM sig, range(64) r(ch)""",
)
def neighbour_repair(spark: SparkSession, sf: str) -> DataFrame:
    long = signal_long(spark, sf)
    bad = long.select("ch").distinct().where(F.col("ch").isin(3, 9))
    out = repair_from_neighbours(signal(spark, sf).select("trial", "t", "x"), "x", 64, bad, ring_edges(long))
    out = out.select("trial", "t", F.posexplode("x").alias("ch", "v"))
    return out.select("trial", "t", "ch", F.round("v", 6).alias("v"), F.col("ch").isin(3, 9).alias("repaired"))


@query(
    "stage_variance", "A38",
    f"""WITH {LONG}, m AS (SELECT trial, t, avg(v) AS m FROM long GROUP BY ALL), s AS (SELECT 'raw' AS stage, ch, v FROM long UNION ALL SELECT 'referenced', ch, v - m FROM long JOIN m USING (trial, t)),
    l AS (SELECT stage, ch, ln(var_pop(v) + 1e-30) AS lv FROM s GROUP BY ALL) SELECT stage, count(*) AS n, round(avg(lv), 6) AS mean_lv, round(quantile_cont(lv, 0.25), 6) AS q25, round(quantile_cont(lv, 0.75), 6) AS q75 FROM l GROUP BY stage""",
)
def stage_variance(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.series import average_reference

    sig = signal(spark, sf)
    both = sig.select(F.lit("raw").alias("stage"), "x").unionByName(sig.select(F.lit("referenced").alias("stage"), average_reference(F.col("x")).alias("x")))
    lv = both.select("stage", F.posexplode("x").alias("ch", "v")).groupBy("stage", "ch").agg(F.log(F.var_pop("v") + 1e-30).alias("lv"))
    q = exact_quantiles(lv, ["stage"], "lv", {"q25": 0.25, "q75": 0.75})
    m = lv.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lv"), 6).alias("mean_lv"))
    return m.join(q, "stage").select("stage", "n", "mean_lv", F.round("q25", 6).alias("q25"), F.round("q75", 6).alias("q75"))


@query(
    "events_inside_block", "A39",
    "SELECT o_orderkey, count(*) FILTER (l_linenumber <= o_totalprice / 100000) AS n_inside FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def events_inside_block(spark: SparkSession, sf: str) -> DataFrame:
    od = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 100000).alias("dur"))
    j = od.join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderkey").agg(F.count(F.when(F.col("l_linenumber") <= F.col("dur"), 1)).alias("n_inside"))


@query(
    "windowed_tracking_means", "A41",
    f"""WITH {LONG}, {STIM}, {COND}, r AS (SELECT l.trial, ch, l.t // 10 AS win, corr(v, stim.s) AS r FROM long l JOIN stim ON l.trial = stim.trial AND l.t = stim.t GROUP BY ALL)
    SELECT y, ch, win, count(*) AS n, round(avg(r), 6) AS mean_r, round(stddev_samp(r) / sqrt(count(*)), 6) AS sem FROM r JOIN cond ON r.trial = cond.trial GROUP BY ALL""",
)
def windowed_tracking_means(spark: SparkSession, sf: str) -> DataFrame:
    j = signal(spark, sf).select("trial", "t", "x").join(stimulus(spark, sf), ["trial", "t"]).select("trial", "t", "s", F.posexplode("x").alias("ch", "v"))
    r = j.groupBy("trial", "ch", F.floor(F.col("t") / 10).alias("win")).agg(safe_corr("v", "s").alias("r"))
    return r.join(trial_condition(spark, sf), "trial").groupBy("y", "ch", "win").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("mean_r"), F.round(F.stddev_samp("r") / F.sqrt(F.count("r")), 6).alias("sem")
    )


@query(
    "robust_bads", "A4",
    QS + """, rr AS (SELECT a.ch, avg(abs(r)) AS mr FROM (SELECT a.ch, b.ch AS o, corr(a.v, b.v) AS r FROM long a JOIN long b ON a.trial = b.trial AND a.t = b.t AND a.ch <> b.ch GROUP BY ALL) a GROUP BY a.ch),
    x AS (SELECT s.ch, mr, ln(var) AS lv FROM s JOIN rr ON rr.ch = s.ch), m AS (SELECT median(mr) AS m1, median(lv) AS m2 FROM x), d AS (SELECT median(abs(mr - m1)) AS d1, median(abs(lv - m2)) AS d2 FROM x, m)
    SELECT ch, round(0.6745 * (mr - m1) / (d1 + 1e-12), 5) AS z_corr, round(0.6745 * (lv - m2) / (d2 + 1e-12), 5) AS z_var, 0.6745 * (mr - m1) / (d1 + 1e-12) < -1.5 OR 0.6745 * (lv - m2) / (d2 + 1e-12) > 1.5 AS bad FROM x, m, d""",
)
def robust_bads(spark: SparkSession, sf: str) -> DataFrame:
    """Channels whose mean absolute correlation is far too low, or whose log variance is far too high."""
    from .model_plans import mean_abs_correlation

    r = mean_abs_correlation(spark, sf)
    s = channel_stats(signal_long(spark, sf), ["ch"]).select("ch", F.log("var").alias("lv"))
    z = robust_z(robust_z(r.join(s, "ch"), [], "mean_abs_r", "z1", add=1e-12), [], "lv", "z2", add=1e-12)
    return z.select("ch", F.round("z1", 5).alias("z_corr"), F.round("z2", 5).alias("z_var"), ((F.col("z1") < -1.5) | (F.col("z2") > 1.5)).alias("bad"))
