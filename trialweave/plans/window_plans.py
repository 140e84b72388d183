"""Lags, smoothing, runs, windows and other order-dependent operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.hashing import md5_key, unit
from ..operators.blocks import DEFAULT_WIDTH
from ..operators.ordered import Run, ntile_of, ordered_scan, positions
from ..operators.series import (
    average_reference, causal_lags, concatenated, counter_impulses, edge_ramp, equal_windows, first_peak,
    frame_change, full_windows, greedy_fill, interpolated, largest_mass, lengths, peak_normalised, shifted,
    sign_agreed, sign_fixed, signed_lags, sliding_windows, smoother_bank, smoother_widths, spread_windows,
    true_runs, with_flat_reference, zscored,
)
from .adapters import EV, LONG, SIG, STIM, events, md5_sql, signal, signal_long, stimulus, table, unit_sql
from .registry import query

V0 = "v AS (SELECT trial, t, CAST(x[1] AS DOUBLE) AS v, CAST(x[2] AS DOUBLE) AS w FROM sig)"
VC = LONG + ", v AS (SELECT trial, t, ch, v FROM long)"
BLOCK = DEFAULT_WIDTH


def _weighted(values):
    """Sum of all values of an array times their place, which shows every column of a wide view in one number."""
    return F.aggregate(F.transform(values, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)


@query(
    "causal_lag_matrix", "W1 G1 G6",
    f"""WITH {LONG}, c AS (SELECT a.trial, a.t, round(sum(z.v * (k * 64 + z.ch + 1)), 4) AS weighted FROM (SELECT DISTINCT trial, t FROM sig) a CROSS JOIN range(8) r(k) JOIN long z ON z.trial = a.trial AND z.t = a.t - k GROUP BY ALL),
    {V0} SELECT v.trial, v.t, round(v, 6) AS l0_c0, round(coalesce(lag(v, 3) OVER (PARTITION BY v.trial ORDER BY v.t), 0.0), 6) AS l3_c0,
    round(coalesce(lag(w, 7) OVER (PARTITION BY v.trial ORDER BY v.t), 0.0), 6) AS l7_c1, weighted, 512 AS width FROM v JOIN c ON c.trial = v.trial AND c.t = v.t""",
)
def causal_lag_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = causal_lags(signal(spark, sf), ["trial"], "x", 8, width=BLOCK)
    at = lambda lag, ch: F.round(F.get("lagged", F.lit(lag * 64 + ch)), 6)
    return m.select("trial", "t", at(0, 0).alias("l0_c0"), at(3, 0).alias("l3_c0"), at(7, 1).alias("l7_c1"), F.round(_weighted(F.col("lagged")), 4).alias("weighted"), F.size("lagged").alias("width"))


@query(
    "signed_lag_matrix", "W2 Q2",
    f"""WITH {LONG}, {V0}, n AS (SELECT trial, count(*) AS n FROM v GROUP BY 1),
    c AS (SELECT a.trial, a.t, round(sum(z.v * (i * 64 + z.ch + 1)), 4) AS weighted FROM (SELECT DISTINCT trial, t FROM sig) a JOIN n ON n.trial = a.trial AND a.t >= 4 AND a.t < n - 4 CROSS JOIN (VALUES (0, 2), (1, -4), (2, 0)) r(i, k) JOIN long z ON z.trial = a.trial AND z.t = a.t - k GROUP BY ALL), l AS (SELECT v.trial, t, n, lag(v, 2) OVER w AS a, lead(v, 4) OVER w AS b, v AS c FROM v JOIN n ON v.trial = n.trial WINDOW w AS (PARTITION BY v.trial ORDER BY t))
    SELECT l.trial, l.t, round(CASE WHEN l.t >= 4 AND l.t < n - 4 THEN a ELSE 0 END, 6) AS lag_2, round(CASE WHEN l.t >= 4 AND l.t < n - 4 THEN b ELSE 0 END, 6) AS lead_4, round(CASE WHEN l.t >= 4 AND l.t < n - 4 THEN l.c ELSE 0 END, 6) AS lag_0, coalesce(weighted, 0.0) AS weighted FROM l LEFT JOIN c ON c.trial = l.trial AND c.t = l.t""",
)
def signed_lag_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = signed_lags(signal(spark, sf), ["trial"], "x", [2, -4, 0], width=BLOCK)
    at = lambda i: F.round(F.get("lagged", F.lit(i * 64)), 6)
    return m.select("trial", "t", at(0).alias("lag_2"), at(1).alias("lead_4"), at(2).alias("lag_0"), F.round(_weighted(F.col("lagged")), 4).alias("weighted"))


@query(
    "global_shift", "W3",
    f"""WITH {SIG}, {STIM} SELECT trial, t, round(coalesce(lag(s, 5) OVER (PARTITION BY trial ORDER BY t), 0.0), 6) AS later, round(coalesce(lead(s, 5) OVER (PARTITION BY trial ORDER BY t), 0.0), 6) AS sooner FROM stim""",
)
def global_shift(spark: SparkSession, sf: str) -> DataFrame:
    st = stimulus(spark, sf)
    out = shifted(shifted(st, ["trial"], "s", 5, out="later"), ["trial"], "s", -5, out="sooner")
    return out.select("trial", "t", F.round("later", 6).alias("later"), F.round("sooner", 6).alias("sooner"))


WIDTHS = smoother_widths(6, 2, 32)


@query(
    "smoother_bank", "W4 W5 W28 F13",
    f"WITH {VC} SELECT trial, t, ch, "
    + ", ".join(f"round(avg(v) OVER (PARTITION BY trial, ch ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS s_{n}" for n in WIDTHS)
    + " FROM v",
)
def smoother_bank_query(spark: SparkSession, sf: str) -> DataFrame:
    out = smoother_bank(signal_long(spark, sf), ["trial", "ch"], "v", WIDTHS, width=BLOCK)
    return out.select("trial", "t", "ch", *[F.round(f"s_{n}", 6).alias(f"s_{n}") for n in WIDTHS])


@query(
    "frame_change", "W6 X19",
    f"""WITH {LONG}, d AS (SELECT trial, t, ch, v, abs(v - lag(v) OVER (PARTITION BY trial, ch ORDER BY t)) AS d FROM long)
    SELECT trial, t, round(avg(v), 6) AS level, round(coalesce(avg(d), 0.0), 6) AS change FROM d GROUP BY ALL""",
)
def frame_change_query(spark: SparkSession, sf: str) -> DataFrame:
    out = frame_change(signal(spark, sf), ["trial"], "x", width=BLOCK)
    return out.select("trial", "t", F.round("level", 6).alias("level"), F.round("change", 6).alias("change"))


@query(
    "counter_impulses", "W7",
    f"""WITH {EV}, m AS (SELECT *, max(k) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ev)
    SELECT event_id, CASE WHEN k > coalesce(top, 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS impulse FROM m""",
)
def counter_impulses_query(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf).select("user_id", "event_id", "us", "k")
    return counter_impulses(ev, ["user_id"], ["us", "event_id"], "k").select("event_id", "impulse")


RUNS = f"""{VC}, f AS (SELECT trial, t, ch, v, v > 0 AS m FROM v), g AS (SELECT *, t - row_number() OVER (PARTITION BY trial, ch, m ORDER BY t) AS island FROM f),
r AS (SELECT trial, ch, min(t) AS start, max(t) + 1 AS "end", sum(v - 0.05) AS mass FROM g WHERE m GROUP BY trial, ch, island)"""


def _runs(spark, sf):
    v = signal_long(spark, sf)
    return v, true_runs(v, ["trial", "ch"], "t", F.col("v") > 0, F.col("v") - 0.05)


@query("true_runs", "W9", f'WITH {RUNS} SELECT trial, ch, start, "end", round(mass, 6) AS mass FROM r')
def true_runs_query(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf)[1].select("trial", "ch", "start", "end", F.round("mass", 6).alias("mass"))


@query("largest_run_mass", "W10", f"WITH {RUNS} SELECT v.trial, v.ch, round(coalesce(max(mass), 0.0), 6) AS max_mass FROM (SELECT DISTINCT trial, ch FROM v) v LEFT JOIN r ON r.trial = v.trial AND r.ch = v.ch GROUP BY v.trial, v.ch")
def largest_run_mass(spark: SparkSession, sf: str) -> DataFrame:
    v, runs = _runs(spark, sf)
    return largest_mass(runs, v.select("trial", "ch").distinct(), ["trial", "ch"]).select("trial", "ch", F.round("max_mass", 6).alias("max_mass"))


@query(
    "non_overlapping_windows", "W11",
    f"""WITH {VC} SELECT trial, ch, t // 16 AS win, count(*) AS n, round(avg(v), 6) AS mean_v FROM v WHERE (t // 16 + 1) * 16 <= 50 GROUP BY ALL""",
)
def non_overlapping_windows(spark: SparkSession, sf: str) -> DataFrame:
    v = signal_long(spark, sf)
    return full_windows(v, ["trial"], "t", 16, lengths(v, ["trial"])).groupBy("trial", "ch", "win").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean_v")
    )


@query(
    "sliding_windows", "W12",
    f"""WITH {VC} SELECT trial, ch, win, round((2 * win * 5 + 20) / 2.0 / 64.0, 6) AS centre_s, count(*) AS n, round(avg(v), 6) AS mean_v
    FROM v JOIN range(7) r(win) ON t >= win * 5 AND t < win * 5 + 20 AND win * 5 + 20 <= 50 GROUP BY ALL""",
)
def sliding_windows_query(spark: SparkSession, sf: str) -> DataFrame:
    v = signal_long(spark, sf)
    w = sliding_windows(v, ["trial"], "t", 20, 5, lengths(v, ["trial"]))
    return w.groupBy("trial", "ch", "win").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean_v")).select(
        "trial", "ch", "win", F.round((2 * F.col("win") * 5 + 20) / 2.0 / 64.0, 6).alias("centre_s"), "n", "mean_v"
    )


@query(
    "equal_windows", "W13",
    f"""WITH {VC} SELECT trial, ch, win, count(*) AS n, round(avg(v), 6) AS mean_v FROM v JOIN range(6) r(win) ON t >= win * 50 // 6 AND t < (win + 1) * 50 // 6 GROUP BY ALL""",
)
def equal_windows_query(spark: SparkSession, sf: str) -> DataFrame:
    v = signal_long(spark, sf)
    w = v.join(lengths(v, ["trial"]), "trial").withColumn("win", equal_windows(F.col("t"), F.col("_len"), 6))
    return w.groupBy("trial", "ch", "win").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean_v"))


@query(
    "spread_windows", "W14",
    f"""WITH {VC} SELECT trial, ch, CAST(round_even(27 * i / 3.0, 0) AS BIGINT) AS start, count(*) AS n, round(avg(v), 6) AS mean_v
    FROM v JOIN range(4) r(i) ON t >= round_even(27 * i / 3.0, 0) AND t < round_even(27 * i / 3.0, 0) + 23 GROUP BY ALL""",
)
def spread_windows_query(spark: SparkSession, sf: str) -> DataFrame:
    v = signal_long(spark, sf)
    return spread_windows(v, ["trial"], "t", 23, 4, lengths(v, ["trial"])).groupBy("trial", "ch", "start").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean_v")
    )


@query(
    "equal_bins", "W15",
    f"""WITH {VC}, b AS (SELECT *, ntile(7) OVER (PARTITION BY trial, ch ORDER BY t) - 1 AS bin FROM v) SELECT trial, ch, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(v), 6) AS mean_v FROM b GROUP BY ALL""",
)
def equal_bins(spark: SparkSession, sf: str) -> DataFrame:
    v = signal_long(spark, sf)
    b = v.join(lengths(v, ["trial"]), "trial").withColumn("bin", ntile_of(F.col("t"), F.col("_len"), 7))
    return b.groupBy("trial", "ch", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean_v"))


@query(
    "zscore_columns", "W18",
    f"""WITH {LONG} SELECT trial, t, ch, round((v - avg(v) OVER w) / coalesce(nullif(stddev_pop(v) OVER w, 0), 1), 6) AS z FROM long WINDOW w AS (PARTITION BY trial, ch)""",
)
def zscore_columns(spark: SparkSession, sf: str) -> DataFrame:
    return zscored(signal_long(spark, sf), ["trial", "ch"], "v").select("trial", "t", "ch", F.round("z", 6).alias("z"))


@query(
    "average_reference", "W19 W20",
    f"""WITH {LONG}, m AS (SELECT trial, t, avg(v) AS m, sum(v) / 65 AS m65 FROM long GROUP BY ALL)
    SELECT long.trial, long.t, ch, round(v - m, 6) AS referenced, round(v - m65, 6) AS with_flat FROM long JOIN m ON long.trial = m.trial AND long.t = m.t""",
)
def average_reference_query(spark: SparkSession, sf: str) -> DataFrame:
    both = signal(spark, sf).select(
        "trial", "t", F.arrays_zip(average_reference(F.col("x")).alias("a"), with_flat_reference(F.col("x"), range(64)).alias("b")).alias("z")
    )
    return both.select("trial", "t", F.posexplode("z").alias("ch", "r")).select(
        "trial", "t", "ch", F.round("r.a", 6).alias("referenced"), F.round("r.b", 6).alias("with_flat")
    )


@query(
    "gap_interpolation", "W21",
    f"""WITH {LONG}, g AS (SELECT trial, t, ch, CASE WHEN t % 7 IN (0, 3, 4) THEN NULL ELSE v END AS v FROM long),
    p AS (SELECT trial, t, ch, v, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY trial, ch ORDER BY t) AS ta, last_value(v IGNORE NULLS) OVER (PARTITION BY trial, ch ORDER BY t) AS va,
      first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY trial, ch ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tb,
      first_value(v IGNORE NULLS) OVER (PARTITION BY trial, ch ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM g)
    SELECT trial, t, ch, round(CASE WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va WHEN ta = tb THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END, 6) AS filled FROM p""",
)
def gap_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    v = signal_long(spark, sf).withColumn("v", F.when(~(F.col("t") % 7).isin(0, 3, 4), F.col("v")))
    return interpolated(v, ["trial", "ch"], "t", "v").select("trial", "t", "ch", F.round("filled", 6).alias("filled"))


CLIP = """it AS (SELECT source, doc_id, n_chars / 15.0 AS dur FROM documents), o AS (SELECT *, coalesce(sum(dur + 0.5) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM it)"""


@query(
    "concatenated_clips", "W22",
    f"WITH {CLIP} SELECT source, doc_id, round(off, 3) AS start_s, CAST(round(round(off, 3) * 1000) AS BIGINT) AS start_ms FROM o WHERE off + dur <= 30000",
)
def concatenated_clips(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "documents").select("source", "doc_id", (F.col("n_chars") / 15.0).alias("dur"))
    c = concatenated(items, ["source"], "doc_id", "dur", 0.5).where(F.col("offset") + F.col("dur") <= 30000)
    start = F.round("offset", 3)
    return c.select("source", "doc_id", start.alias("start_s"), F.round(start * 1000).cast("bigint").alias("start_ms"))


@query(
    "greedy_speaker_fill", "W23 K7",
    """WITH it AS (SELECT source, doc_id, n_chars / 15.0 AS dur, sum(n_chars / 15.0) OVER (PARTITION BY source ORDER BY doc_id) AS cum FROM documents),
    d AS (SELECT source, min(doc_id) AS done FROM it WHERE cum >= 500 GROUP BY source), r AS (SELECT source, done, CAST(row_number() OVER (ORDER BY done, source) AS INTEGER) AS clip FROM d)
    SELECT it.source, it.doc_id, clip FROM it JOIN r ON it.source = r.source WHERE doc_id <= done AND clip <= 12""",
)
def greedy_speaker_fill(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "documents").select("source", "doc_id", (F.col("n_chars") / 15.0).alias("dur"))
    return greedy_fill(items, "source", "doc_id", "dur", 500, 12).select("source", "doc_id", "clip")


@query(
    "random_switch_times", "W24",
    f"""WITH {EV}, u AS (SELECT user_id, event_id, us, 2 + 6 * {unit_sql(md5_sql('switch', 'event_id'))} AS gap FROM ev),
    c AS (SELECT user_id, event_id, sum(gap) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM u) SELECT user_id, event_id, round(s, 6) AS switch_s FROM c WHERE s < 120""",
)
def random_switch_times(spark: SparkSession, sf: str) -> DataFrame:
    u = events(spark, sf).select("user_id", "event_id", "us", (2 + 6 * unit(md5_key("switch", "event_id"))).alias("gap"))
    s = ordered_scan(u, ["user_id"], ["us", "event_id"], [Run("s", "sum", F.col("gap"))]).where("s < 120")
    return s.select("user_id", "event_id", F.round("s", 6).alias("switch_s"))


@query(
    "first_peak", "W25",
    f"""WITH {LONG} SELECT trial, ch, arg_max(t, (abs(v), -t)) AS peak, round(max(abs(v)), 6) AS peak_value FROM long GROUP BY ALL""",
)
def first_peak_query(spark: SparkSession, sf: str) -> DataFrame:
    return first_peak(signal_long(spark, sf), ["trial", "ch"], "t", F.abs("v")).select(
        "trial", "ch", "peak", F.round("peak_value", 6).alias("peak_value")
    )


@query(
    "sign_alignment", "W26",
    f"""WITH {LONG}, w AS (SELECT trial, ch, avg(v) AS w FROM long GROUP BY ALL), s AS (SELECT trial, arg_max(sign(w), (abs(w), -ch)) AS sg FROM w GROUP BY trial),
    f AS (SELECT ch, avg(v) AS f FROM long GROUP BY ch), c AS (SELECT trial, corr(w, f) AS r FROM w JOIN f USING (ch) GROUP BY trial)
    SELECT trial, ch, round(w * sg, 6) AS fixed, round(CASE WHEN r < 0 THEN -w ELSE w END, 6) AS agreed FROM w JOIN s USING (trial) JOIN c USING (trial)""",
)
def sign_alignment(spark: SparkSession, sf: str) -> DataFrame:
    long = signal_long(spark, sf)
    w = long.groupBy("trial", "ch").agg(F.avg("v").alias("w"))
    full = long.groupBy("ch").agg(F.avg("v").alias("w"))
    fixed = sign_fixed(w, ["trial"], "ch", "w").select("trial", "ch", F.round("w", 6).alias("fixed"))
    agreed = sign_agreed(w, full, ["trial"], "ch", "w").select("trial", "ch", F.round("w", 6).alias("agreed"))
    return fixed.join(agreed, ["trial", "ch"])


@query(
    "clip_levels", "F14 F15 F16",
    f"""WITH {SIG}, {V0}, m AS (SELECT trial, t, (v + w) / 2 AS mono FROM v), p AS (SELECT *, max(abs(mono)) OVER (PARTITION BY trial) AS pk FROM m)
    SELECT trial, t, round(mono, 6) AS mono, round(CASE WHEN pk > 0 THEN mono / pk * 0.95 ELSE mono END, 6) AS norm, round(least(1.0, t / 4.0, (49 - t) / 4.0), 6) AS gain FROM p""",
)
def clip_levels(spark: SparkSession, sf: str) -> DataFrame:
    mono = (F.col("x")[0] + F.col("x")[1]) / 2
    v = signal(spark, sf).select("trial", "t", mono.alias("mono"))
    n = peak_normalised(v, ["trial"], "mono").join(lengths(v, ["trial"]), "trial")
    gain = edge_ramp(F.col("t"), F.col("_len"), 1000.0, 5.0)
    return n.select("trial", "t", F.round("mono", 6).alias("mono"), F.round("norm", 6).alias("norm"), F.round(gain, 6).alias("gain"))
