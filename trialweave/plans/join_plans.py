"""Nearest, interval, pairing and set-like joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import md5_key, unit
from ..operators.intervals import (
    baseline_corrected, block_gate, epochs, interval_join, marker_segments, reject_peak_to_peak,
)
from ..operators.nearest import (
    clock_offset, closest_per_match, drop_twins, nearest, pair_edges, recover_missing,
)
from .adapters import EV, LONG, SIG, STIM, events, md5_sql, signal, signal_long, stimulus, table, unit_sql
from .registry import query

HOUR = 3_600_000_000
NEAR = f"""{EV}, m AS (SELECT e.user_id, e.event_id AS edge, e.us AS edge_us, v.event_id AS view_id, v.us AS view_us, abs(e.us - v.us) AS err,
 row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.us - v.us), v.us, v.event_id) AS rn
 FROM ev e JOIN ev v ON e.user_id = v.user_id AND v.event_type = 'view' WHERE e.event_type = 'purchase')"""


def _split(spark, sf):
    ev = events(spark, sf)
    edges = ev.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("edge"), F.col("us").alias("edge_us"))
    views = ev.where("event_type = 'view'").select("user_id", F.col("event_id").alias("vid"), F.col("us").alias("vus"))
    return ev, edges, views


@query(
    "nearest_match", "J1 A36",
    f"""WITH {NEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, view_id ORDER BY err, edge_us, edge) AS r2 FROM m WHERE rn = 1 AND err <= {6 * HOUR})
    SELECT user_id, view_id, edge, err FROM k WHERE r2 = 1""",
)
def nearest_match(spark: SparkSession, sf: str) -> DataFrame:
    _, edges, views = _split(spark, sf)
    m = nearest(edges, views, ["user_id"], "edge_us", "edge", "vus", "vid", 6 * HOUR).withColumnRenamed("match_id", "view_id")
    return closest_per_match(m, ["user_id", "view_id"], "edge_us", "edge").select("user_id", "view_id", "edge", "err")


@query("nearest_frame", "J16", f"WITH {NEAR} SELECT user_id, edge, view_id AS frame, err FROM m WHERE rn = 1")
def nearest_frame(spark: SparkSession, sf: str) -> DataFrame:
    _, edges, views = _split(spark, sf)
    m = nearest(edges, views, ["user_id"], "edge_us", "edge", "vus", "vid")
    return m.select("user_id", "edge", F.col("match_id").alias("frame"), "err")


SHIFT = 49_458_000_000
JIT = f"CAST(floor({unit_sql(md5_sql('jit', 'event_id'))} * 60000000) AS BIGINT)"
EDGES = f"""edges AS (SELECT user_id, event_id AS id, us + {SHIFT} + {JIT} AS us FROM ev WHERE event_type = 'view'),
logs AS (SELECT user_id, event_id AS id, us FROM ev WHERE event_type = 'view'),
first AS (SELECT e.user_id, min(e.us) - any_value(l.l0) AS coarse FROM edges e JOIN (SELECT user_id, min(us) AS l0 FROM logs GROUP BY 1) l USING (user_id) GROUP BY 1)"""
SEARCH, STEP, TOL = 3 * HOUR, 120_000_000, 216_000_000


@query(
    "clock_offset_search", "J2",
    f"""WITH {EV}, {EDGES},
    grid AS (SELECT f.user_id, k, f.coarse + k * {STEP} AS off FROM first f, range({-(SEARCH // STEP)}, {SEARCH // STEP}) r(k)),
    hits AS (SELECT g.user_id, g.k, g.off, count(DISTINCT e.id) AS n FROM grid g JOIN edges e USING (user_id) JOIN logs l ON l.user_id = e.user_id AND abs(e.us - g.off - l.us) < {TOL} GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, k) AS rn FROM hits) WHERE rn = 1),
    nn AS (SELECT b.user_id, e.id, e.us - b.off - l.us AS r, row_number() OVER (PARTITION BY e.id ORDER BY abs(e.us - b.off - l.us), l.us, l.id) AS rn
      FROM best b JOIN edges e USING (user_id) JOIN logs l ON l.user_id = e.user_id)
    SELECT b.user_id, b.k AS bin, b.n AS n_inliers, b.off AS "offset", round(quantile_cont(nn.r, 0.5), 3) AS median_resid
    FROM best b JOIN nn ON nn.user_id = b.user_id AND nn.rn = 1 AND abs(nn.r) < {TOL} GROUP BY ALL""",
)
def clock_offset_search(spark: SparkSession, sf: str) -> DataFrame:
    _, _, views = _split(spark, sf)
    logs = views.select("user_id", F.col("vid").alias("id"), F.col("vus").alias("us"))
    jitter = F.floor(unit(md5_key("jit", "id")) * 60_000_000)
    edges = logs.withColumn("us", F.col("us") + SHIFT + jitter)
    out = clock_offset(edges, logs, ["user_id"], "us", "id", SEARCH, STEP, TOL)
    return out.select("user_id", "bin", "n_inliers", "offset", F.round("median_resid", 3).alias("median_resid"))


KEPT = f"""{NEAR}, k1 AS (SELECT user_id, view_id, min_by(edge_us, (err, edge_us, edge)) AS gap_us FROM m WHERE rn = 1 AND err <= {6 * HOUR} GROUP BY ALL),
e2 AS (SELECT e.user_id, e.us, v.event_id AS view_id, abs(e.us - (v.us + 7200000000)) AS err, e.event_id AS edge,
  row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.us - (v.us + 7200000000)), v.us, v.event_id) AS rn FROM ev e JOIN ev v ON e.user_id = v.user_id AND v.event_type = 'view' WHERE e.event_type = 'purchase'),
k2 AS (SELECT user_id, view_id, min_by(us, (err, us, edge)) AS av_us FROM e2 WHERE rn = 1 AND err <= {6 * HOUR} GROUP BY ALL)"""


def _aligned(spark, sf):
    """Gap edges near a view, av edges near the same view two hours later."""
    _, edges, views = _split(spark, sf)
    later = views.withColumn("vus", F.col("vus") + 7_200_000_000)

    def side(v, kind):
        m = nearest(edges, v, ["user_id"], "edge_us", "edge", "vus", "vid", 6 * HOUR).withColumnRenamed("match_id", "trial")
        return closest_per_match(m, ["user_id", "trial"], "edge_us", "edge").select(
            "user_id", "trial", F.lit(kind).alias("kind"), F.col("edge_us").alias("sample")
        )

    both = side(views, "gap").unionByName(side(later, "av"))
    return edges, views, pair_edges(both, ["user_id", "trial"], "kind", "sample", 0, 12 * HOUR)


@query(
    "two_edge_pairing", "J3",
    f"""WITH {KEPT} SELECT k1.user_id, view_id AS trial, gap_us AS gap_sample, av_us AS av_sample, round(abs((av_us - gap_us) / 1e6 - 7200), 4) AS dur_err_s
    FROM k1 JOIN k2 USING (user_id, view_id) WHERE av_us - gap_us BETWEEN 0 AND {12 * HOUR}""",
)
def two_edge_pairing(spark: SparkSession, sf: str) -> DataFrame:
    _, _, pairs = _aligned(spark, sf)
    return pairs.select("user_id", "trial", "gap_sample", "av_sample", F.round(F.abs(F.col("gap_dur") / 1e6 - 7200), 4).alias("dur_err_s"))


@query(
    "missing_edge_recovery", "J4 J17 Q14",
    f"""WITH {KEPT}, al AS (SELECT k1.user_id, view_id AS trial, gap_us, av_us FROM k1 JOIN k2 USING (user_id, view_id) WHERE av_us - gap_us BETWEEN 0 AND {12 * HOUR}),
    c AS (SELECT v.user_id, v.event_id AS trial, e.us AS gap_us, row_number() OVER (PARTITION BY v.event_id ORDER BY abs(e.us - v.us), e.us, e.event_id) AS rn, abs(e.us - v.us) AS err
      FROM ev v JOIN ev e ON e.user_id = v.user_id AND e.event_type = 'purchase' WHERE v.event_type = 'view' AND v.event_id NOT IN (SELECT trial FROM al))
    SELECT user_id, trial, gap_us AS gap_sample, av_us AS av_sample, false AS av_reconstructed FROM al
    UNION ALL SELECT user_id, trial, gap_us, gap_us + 7200000000, true FROM c WHERE rn = 1 AND err <= {2 * HOUR}""",
)
def missing_edge_recovery(spark: SparkSession, sf: str) -> DataFrame:
    edges, views, pairs = _aligned(spark, sf)
    logged = views.select("user_id", F.col("vid").alias("trial"), F.col("vus").alias("gap_t"), F.lit(7_200_000_000).alias("delay"))
    return recover_missing(pairs, logged, edges, ["user_id"], "trial", "gap_t", "delay", "edge_us", "edge", 2 * HOUR)


DAY = 24 * HOUR
EPO = f"""{EV}, ep AS (SELECT o.user_id, o.event_id AS epoch, x.event_type AS ch, x.us - o.us AS rel, x.value FROM ev o
 JOIN ev x ON x.user_id = o.user_id AND x.us BETWEEN o.us - {DAY} AND o.us + {2 * DAY} AND x.event_type <> 'signup' WHERE o.event_type = 'signup')"""


def _epochs(spark, sf):
    ev = events(spark, sf)
    on = ev.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("epoch"), F.col("us").alias("onset"))
    smp = ev.where("event_type <> 'signup'").select("user_id", "event_id", F.col("event_type").alias("ch"), "us", "value")
    return epochs(smp, on, ["user_id"], "us", "onset", -DAY, 2 * DAY)


@query(
    "event_epochs", "J5 J7",
    f"WITH {EPO} SELECT user_id, epoch, ch, count(*) AS n, min(rel) AS first_rel, round(avg(value), 6) AS mean_v FROM ep WHERE ch IN ('click', 'view', 'error') GROUP BY ALL",
)
def event_epochs(spark: SparkSession, sf: str) -> DataFrame:
    ep = _epochs(spark, sf).where(F.col("ch").isin("click", "view", "error"))
    return ep.groupBy("user_id", "epoch", "ch").agg(
        F.count(F.lit(1)).alias("n"), F.min("rel").alias("first_rel"), F.round(F.avg("value"), 6).alias("mean_v")
    )


@query(
    "baseline_correction", "W16",
    f"""WITH {EPO}, b AS (SELECT epoch, ch, avg(value) AS m FROM ep WHERE rel BETWEEN {-DAY} AND 0 GROUP BY ALL)
    SELECT ep.epoch, ep.ch, rel, round(value - m, 6) AS corrected FROM ep LEFT JOIN b ON ep.epoch = b.epoch AND ep.ch = b.ch""",
)
def baseline_correction(spark: SparkSession, sf: str) -> DataFrame:
    out = baseline_corrected(_epochs(spark, sf), ["epoch", "ch"], "rel", "value", -DAY, 0)
    return out.select("epoch", "ch", "rel", F.round("corrected", 6).alias("corrected"))


@query(
    "epoch_rejection", "W17",
    f"""WITH {EPO}, p AS (SELECT epoch, ch, max(value) - min(value) AS p2p FROM ep GROUP BY ALL)
    SELECT epoch, count(*) AS n FROM ep WHERE epoch NOT IN (SELECT epoch FROM p WHERE p2p > 40) GROUP BY epoch""",
)
def epoch_rejection(spark: SparkSession, sf: str) -> DataFrame:
    return reject_peak_to_peak(_epochs(spark, sf), ["epoch"], "ch", "value", 40).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))


@query(
    "locked_blocks", "J6",
    f"""WITH {EV}, o AS (SELECT user_id, event_id AS block, us + {2 * HOUR} AS s FROM ev WHERE event_type = 'purchase')
    SELECT block, count(*) AS n, round(sum(value), 4) AS total FROM o JOIN ev x ON x.user_id = o.user_id AND x.us >= s AND x.us < s + {25 * HOUR} GROUP BY block""",
)
def locked_blocks(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    on = ev.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("block"), F.col("us").alias("onset"))
    ep = epochs(ev.select("user_id", "event_id", "us", "value"), on, ["user_id"], "us", "onset", 2 * HOUR, 27 * HOUR, closed="left")
    return ep.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "marker_segment", "J8",
    f"""WITH {EV}, s AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN us END) AS lo, min(CASE WHEN event_type = 'purchase' THEN us END) AS hi FROM ev GROUP BY user_id)
    SELECT s.user_id, count(*) AS n, round(avg(value), 6) AS mean_v FROM s JOIN ev x ON x.user_id = s.user_id AND x.us BETWEEN lo AND hi WHERE lo < hi GROUP BY s.user_id""",
)
def marker_segment(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    seg = marker_segments(ev, ["user_id"], "event_type", "us", "signup", "purchase")
    # one segment per key: an equi-join with the exact test is enough
    inside = ev.join(seg, "user_id").where(F.col("us").between(F.col("seg_lo"), F.col("seg_hi")))
    return inside.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_v"))


@query(
    "trial_stimulus_join", "J9",
    f"""WITH {LONG}, {STIM} SELECT l.trial, ch, count(*) AS n, round(sum(v * s), 6) AS xy
    FROM long l JOIN stim ON stim.trial = l.trial AND stim.t = l.t GROUP BY l.trial, ch""",
)
def trial_stimulus_join(spark: SparkSession, sf: str) -> DataFrame:
    j = signal(spark, sf).join(stimulus(spark, sf), ["trial", "t"], "inner")
    j = j.select("trial", "s", F.posexplode("x").alias("ch", "v"))
    return j.groupBy("trial", "ch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("v") * F.col("s")), 6).alias("xy"))


@query(
    "capture_audit", "J15 O1",
    f"""WITH {NEAR}, g AS (SELECT DISTINCT view_id FROM m WHERE rn = 1 AND err <= {HOUR}),
    a AS (SELECT DISTINCT v.event_id AS view_id FROM ev v JOIN ev e ON e.user_id = v.user_id AND e.event_type = 'error' AND abs(e.us - v.us) <= {HOUR} WHERE v.event_type = 'view')
    SELECT count(CASE WHEN g.view_id IS NOT NULL AND a.view_id IS NOT NULL THEN 1 END) AS both_edges, count(CASE WHEN g.view_id IS NOT NULL AND a.view_id IS NULL THEN 1 END) AS only_gap,
     count(CASE WHEN g.view_id IS NULL AND a.view_id IS NOT NULL THEN 1 END) AS only_av, count(CASE WHEN g.view_id IS NULL AND a.view_id IS NULL THEN 1 END) AS neither
    FROM (SELECT event_id FROM ev WHERE event_type = 'view') v LEFT JOIN g ON g.view_id = v.event_id LEFT JOIN a ON a.view_id = v.event_id""",
)
def capture_audit(spark: SparkSession, sf: str) -> DataFrame:
    ev, edges, views = _split(spark, sf)
    near = nearest(edges, views, ["user_id"], "edge_us", "edge", "vus", "vid", HOUR)
    gap = near.select(F.col("match_id").alias("vid")).distinct().withColumn("g", F.lit(1))
    errs = ev.where("event_type = 'error'").select("user_id", F.col("event_id").alias("eid"), F.col("us").alias("eus"))
    av = nearest(views, errs, ["user_id"], "vus", "vid", "eus", "eid", HOUR).select("vid").withColumn("a", F.lit(1))
    flags = gap.join(av, "vid", "full_outer")
    every = views.select("vid").join(flags, "vid", "left")
    g, a = F.col("g").isNotNull(), F.col("a").isNotNull()
    return every.agg(
        F.count(F.when(g & a, 1)).alias("both_edges"), F.count(F.when(g & ~a, 1)).alias("only_gap"),
        F.count(F.when(~g & a, 1)).alias("only_av"), F.count(F.when(~g & ~a, 1)).alias("neither"),
    )


@query(
    "twin_trigger_removal", "W27 W8",
    f"""WITH {EV}, p AS (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS prev FROM ev)
    SELECT user_id, event_id, us - prev AS interval_us FROM p WHERE prev IS NULL OR us - prev >= {HOUR}""",
)
def twin_trigger_removal(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.ordered import Run, ordered_scan

    ev = events(spark, sf).select("user_id", "event_id", "us")
    gaps = ordered_scan(ev, ["user_id"], ["us", "event_id"], [Run("prev", "last", F.col("us"), strict=True)])
    return gaps.where(F.col("prev").isNull() | (F.col("us") - F.col("prev") >= HOUR)).select(
        "user_id", "event_id", (F.col("us") - F.col("prev")).alias("interval_us")
    )


@query(
    "block_gate_ledger", "A14",
    f"""WITH {LONG}, c AS (SELECT trial, ch, max(v) - min(v) AS p2p, stddev_pop(v) AS sd FROM long GROUP BY ALL),
    b AS (SELECT trial, count(*) AS n_channels, CAST(sum(CASE WHEN p2p > 0.62 OR sd < 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad_channels, max(p2p) AS max_p2p FROM c GROUP BY trial)
    SELECT trial, n_bad_channels, round(max_p2p, 6) AS max_p2p, n_bad_channels / n_channels <= 0.1 AS keep,
    CASE WHEN n_bad_channels / n_channels <= 0.1 THEN 'ok' ELSE 'block_artifact' END AS reason FROM b""",
)
def block_gate_ledger(spark: SparkSession, sf: str) -> DataFrame:
    led = block_gate(signal_long(spark, sf), ["trial"], "ch", "v", 0.62, 0.1)
    return led.select("trial", "n_bad_channels", F.round("max_p2p", 6).alias("max_p2p"), "keep", "reason")


@query(
    "stop_word_exclusion", "J18",
    """WITH w AS (SELECT lower(trim(unnest(str_split(text, ' ')), '.,!?;:"''()')) AS word FROM documents)
    SELECT word, count(*) AS n FROM w WHERE word <> '' AND word NOT IN (SELECT lower(n_name) FROM nation) AND word NOT IN ('the', 'and', 'that', 'with', 'de', 'la', 'le') GROUP BY word""",
)
def stop_word_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.text import clean_token

    stop = spark.createDataFrame([(w,) for w in ("the", "and", "that", "with", "de", "la", "le")], "word string")
    stop = stop.unionByName(table(spark, sf, "nation").select(F.lower("n_name").alias("word")))
    counts = (
        table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("w"))
        .select(clean_token(F.col("w")).alias("word")).where("word <> ''")
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.join(stop, "word", "left_anti")
