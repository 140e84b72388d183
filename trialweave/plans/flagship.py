"""Flagship: usable trials per session and the mean signal by condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.intervals import interval_join
from ..operators.nearest import closest_per_match, following, nearest
from .adapters import EV, events
from .registry import query

HOUR = 3_600_000_000
MATCH_TOL = 6 * HOUR
PAIR_LO, PAIR_HI = HOUR, 48 * HOUR
P2P_LIMIT = 150.0

SQL = f"""
WITH {EV},
m AS (
  SELECT e.user_id, e.event_id AS edge, e.us AS edge_us, v.event_id AS view_id, v.us AS view_us,
         abs(e.us - v.us) AS err,
         row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.us - v.us), v.us, v.event_id) AS rn
  FROM ev e JOIN ev v ON e.user_id = v.user_id AND v.event_type = 'view'
  WHERE e.event_type = 'purchase'),
best AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, view_id ORDER BY err, edge_us, edge) AS r2
  FROM m WHERE rn = 1 AND err <= {MATCH_TOL}),
paired AS (
  SELECT b.user_id, b.view_id, b.view_us, min(s.us) AS sign_us
  FROM best b JOIN ev s ON s.user_id = b.user_id AND s.event_type = 'signup' AND s.us > b.view_us
  WHERE b.r2 = 1 GROUP BY ALL),
trial AS (SELECT * FROM paired WHERE sign_us - view_us BETWEEN {PAIR_LO} AND {PAIR_HI}),
sig AS (
  SELECT t.user_id, t.view_id, x.event_type, x.value
  FROM trial t JOIN ev x ON x.user_id = t.user_id AND x.us BETWEEN t.view_us AND t.sign_us
   AND x.event_type IN ('click', 'error')),
gate AS (SELECT user_id, view_id FROM sig GROUP BY ALL
  HAVING count(*) >= 2 AND max(value) - min(value) <= {P2P_LIMIT})
SELECT s.user_id, count(DISTINCT s.view_id) AS n_trials,
  round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS mean_click,
  round(avg(CASE WHEN event_type = 'error' THEN value END), 6) AS mean_error,
  round(avg(CASE WHEN event_type = 'click' THEN value END) - avg(CASE WHEN event_type = 'error' THEN value END), 6) AS diff
FROM sig s JOIN gate g ON s.user_id = g.user_id AND s.view_id = g.view_id
GROUP BY s.user_id
"""


@query("session_condition_means", "S7 J1 J3 J5 A14 A20", SQL)
def session_condition_means(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    kind = F.col("event_type")
    edges = ev.where(kind == "purchase").select("user_id", F.col("event_id").alias("edge"), F.col("us").alias("edge_us"))
    views = ev.where(kind == "view").select("user_id", F.col("event_id").alias("vid"), F.col("us").alias("vus"))
    signups = ev.where(kind == "signup").select("user_id", F.col("event_id").alias("sid"), F.col("us").alias("sus"))
    matched = nearest(edges, views, ["user_id"], "edge_us", "edge", "vus", "vid", MATCH_TOL)
    matched = matched.withColumnRenamed("match_id", "view_id").withColumnRenamed("match_time", "view_us")
    kept = closest_per_match(matched, ["user_id", "view_id"], "edge_us", "edge").select("user_id", "view_id", "view_us")
    trials = (
        following(kept, signups, ["user_id"], "view_us", "view_id", "sus", "sid")
        .withColumnRenamed("match_time", "sign_us")
        .where((F.col("sign_us") - F.col("view_us")).between(PAIR_LO, PAIR_HI))
        .drop("match_id")
    )
    points = ev.where(kind.isin("click", "error")).select("user_id", "event_id", "us", "event_type", "value")
    inside = interval_join(points, trials, ["user_id"], "us", "view_us", "sign_us", 24 * HOUR)
    # one row per trial and condition; every later figure comes from these partial sums
    per = inside.groupBy("user_id", "view_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("value") - F.min("value")).alias("p2p"),
        *[
            f(F.when(F.col("event_type") == c, F.col("value"))).alias(f"{p}_{c}")
            for c in ("click", "error")
            for p, f in (("s", F.sum), ("c", F.count))
        ],
    )
    usable = per.where((F.col("n") >= 2) & (F.col("p2p") <= P2P_LIMIT))
    mean = {c: F.sum(f"s_{c}") / F.nullif(F.sum(f"c_{c}"), F.lit(0)) for c in ("click", "error")}
    return usable.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.round(mean["click"], 6).alias("mean_click"),
        F.round(mean["error"], 6).alias("mean_error"),
        F.round(mean["click"] - mean["error"], 6).alias("diff"),
    )
