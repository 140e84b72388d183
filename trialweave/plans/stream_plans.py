"""Streaming operators, drained over marker files that Spark writes from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from ..streaming.markers import (
    assemble_trials, bursts, counter_steps, drain, drain_updates, drain_with_late_counts, marker_stream,
    responses, running_accuracy, trial_table, window_features, without_twins, write_marker_feed, write_markers,
)
from .adapters import EV, events
from .registry import query

LABEL = {"click": "audio_onset", "view": "av_onset", "error": "block_end", "purchase": "probe_response", "signup": "trial_start"}
MAX_US = "(SELECT max(us) - 3600000000 FROM ev)"


def _markers(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    label = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in LABEL.items()])
    body = F.struct(
        label.alias("label"), (F.floor(F.col("us") / 86_400_000_000)).alias("trial"), F.col("event_id").alias("marker_id"), "value", "k"
    )
    return ev.select(F.col("user_id").alias("session"), F.timestamp_micros("us").alias("ts"), F.to_json(body).alias("payload"))


def _stream(spark: SparkSession, sf: str, delay: str = "1 hour") -> DataFrame:
    """The events as four or more overlapping batches of markers, two files each."""
    return marker_stream(spark, write_marker_feed(_markers(spark, sf), scratch_path(spark, "live")), delay)


@query("stream_ingest", "T1 S26", f"WITH {EV} SELECT user_id AS session, event_id AS marker_id, us, value FROM ev")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    out = drain(_stream(spark, sf), "json")
    return out.select("session", "marker_id", F.unix_micros("ts").alias("us"), "value")


ASSEMBLY_SQL = f"""WITH {EV}, g AS (SELECT user_id AS session, us // 86400000000 AS trial,
    coalesce(max(us) FILTER (event_type = 'click'), min(us) FILTER (event_type = 'view')) AS onset, arg_max(value, us) FILTER (event_type = 'error') AS block_dur_s, arg_max(k, us) FILTER (event_type = 'purchase') AS probe FROM ev GROUP BY ALL)
    SELECT session, trial, round(onset / 1e6 - 1704067200, 4) AS onset_s, block_dur_s, probe FROM g WHERE onset IS NOT NULL AND block_dur_s IS NOT NULL AND probe IS NOT NULL"""


@query("stream_trial_assembly", "T2", ASSEMBLY_SQL)
def stream_trial_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Trials as a built-in streaming aggregate over day-long windows."""
    out = drain_updates(trial_table(_stream(spark, sf), "1 day"), ["session", "trial"]).where("complete")
    onset = F.unix_micros("onset") / 1e6
    return out.select("session", "trial", F.round(onset - 1704067200, 4).alias("onset_s"), "block_dur_s", "probe")


@query("stream_trial_state", "T2", ASSEMBLY_SQL.replace("GROUP BY ALL)", f"GROUP BY ALL HAVING max(us) + 86400000000 < {MAX_US})"))
def stream_trial_state(spark: SparkSession, sf: str) -> DataFrame:
    """Trials by a state function that emits a trial once the watermark is a day past it."""
    out = drain(assemble_trials(_stream(spark, sf), 86400.0)).where("complete")
    return out.select("session", "trial", F.round(F.col("onset_s") - 1704067200, 4).alias("onset_s"), "block_dur_s", "probe")


@query("stream_twin_suppression", "T3", f"WITH {EV} SELECT event_type AS kind, count(*) AS n FROM ev GROUP BY ALL")
def stream_twin_suppression(spark: SparkSession, sf: str) -> DataFrame:
    """Every marker is sent twice, 11 ms apart; one of each pair remains."""
    path = scratch_path(spark, "twins")
    m = _markers(spark, sf)
    feed = write_marker_feed(m.unionByName(m.withColumn("ts", F.col("ts") + F.expr("interval 11 milliseconds"))), path)
    once = drain(without_twins(marker_stream(spark, feed), ["session", "marker_id"]))
    back = F.coalesce(*[F.when(F.col("label") == v, F.lit(k)) for k, v in LABEL.items()])
    return once.groupBy(back.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_reaction_time", "T4",
    f"""WITH {EV} SELECT b.event_id AS beep, round(min(a.us - b.us) / 1e6, 6) AS rt_s FROM ev b LEFT JOIN ev a ON a.user_id = b.user_id AND a.event_type = 'view' AND a.us > b.us AND a.us <= b.us + 21600000000
    WHERE b.event_type = 'click' AND b.us + 86400000000 < {MAX_US} GROUP BY b.event_id""",
)
def stream_reaction_time(spark: SparkSession, sf: str) -> DataFrame:
    """Time from a beep to the first answer within six hours, null without one, of beeps that the watermark has passed by a day."""
    path = scratch_path(spark, "beeps")
    feed = write_marker_feed(_markers(spark, sf), path)
    beeps = marker_stream(spark, feed).where("label = 'audio_onset'")
    answers = marker_stream(spark, feed).where("label = 'av_onset'")
    out = drain(responses(beeps, answers, "6 hours"))
    rt = (F.unix_micros("answer_ts") - F.unix_micros("beep_ts")) / 1e6
    last = events(spark, sf).agg((F.max("us") - 3_600_000_000).alias("_last"))
    passed = out.crossJoin(F.broadcast(last)).where(F.unix_micros("beep_ts") + 86_400_000_000 < F.col("_last"))
    return passed.groupBy("beep").agg(F.round(F.min(rt), 6).alias("rt_s"))


def _win_sql(size_h: int, slide_h: int) -> str:
    n = size_h // slide_h
    return (
        f"WITH {EV}, w AS (SELECT user_id AS session, (us // {slide_h * 3600000000} - o) * {slide_h * 3600000000} AS w_us, value FROM ev, range({n}) r(o)) "
        f"SELECT session, w_us, count(*) AS n, round(avg(value), 5) AS mean_v, round(max(value) - min(value), 5) AS p2p FROM w WHERE w_us + {size_h * 3600000000} <= {MAX_US} GROUP BY ALL"
    )


def _win(df: DataFrame) -> DataFrame:
    return df.select("session", F.unix_micros("w_start").alias("w_us"), "n", F.round("mean_v", 5).alias("mean_v"), F.round("p2p", 5).alias("p2p"))


@query("stream_tumbling_windows", "T5", _win_sql(6, 6))
def stream_tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _win(drain(window_features(_stream(spark, sf), "6 hours")))


@query("stream_sliding_windows", "T5 W12", _win_sql(12, 6))
def stream_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _win(drain(window_features(_stream(spark, sf), "12 hours", "6 hours")))


@query(
    "stream_bursts", "T6",
    f"""WITH {EV}, p AS (SELECT user_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 7200000000 THEN 0 ELSE 1 END AS s FROM ev), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY us) AS b FROM p)
    SELECT user_id AS session, min(us) AS w_us, count(*) AS n FROM g GROUP BY user_id, b HAVING max(us) + 7200000000 <= {MAX_US}""",
)
def stream_bursts(spark: SparkSession, sf: str) -> DataFrame:
    return drain(bursts(_stream(spark, sf), "2 hours")).select("session", F.unix_micros("w_start").alias("w_us"), "n")


@query("stream_running_accuracy", "T7", f"WITH {EV} SELECT user_id AS session, count(*) AS n_scored, round(avg(CASE WHEN k > 50 THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM ev WHERE event_type = 'purchase' GROUP BY 1")
def stream_running_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return drain_updates(running_accuracy(_stream(spark, sf)), ["session"]).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "stream_counter_steps", "T8",
    f"""WITH {EV}, m AS (SELECT *, us // 86400000000 AS trial, coalesce(max(k) OVER (PARTITION BY user_id, us // 86400000000 ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM ev)
    SELECT user_id AS session, trial, CAST(count(*) FILTER (k > top) AS INTEGER) AS rises, greatest(max(k), 0) AS top FROM m WHERE (us // 86400000000 + 1) * 86400000000 <= {MAX_US} GROUP BY ALL""",
)
def stream_counter_steps(spark: SparkSession, sf: str) -> DataFrame:
    return drain(counter_steps(_stream(spark, sf), "1 day"))


@query(
    "stream_late_markers", "T9",
    f"""WITH {EV}, mid AS (SELECT 1704067200000000 + 10 * 86400000000 AS us) SELECT us // 86400000000 * 86400000000 AS w_us, count(*) AS n, (SELECT count(*) FROM ev WHERE us < (SELECT us FROM mid)) AS late FROM ev WHERE us >= (SELECT us FROM mid) GROUP BY 1""",
)
def stream_late_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Markers of the first ten days arrive after all later ones: they are dropped and counted."""
    m = _markers(spark, sf)
    mid = F.timestamp_micros(F.lit(1_704_067_200_000_000 + 10 * 86_400_000_000))
    windows, late = drain_with_late_counts([m.where(F.col("ts") >= mid), m.where(F.col("ts") < mid)], "1 hour", "1 day")
    return windows.select(F.unix_micros("w_start").alias("w_us"), "n", F.lit(late).cast("bigint").alias("late"))
