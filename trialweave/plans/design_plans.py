"""Folds and design tables in reproducible md5 order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import md5_key
from ..operators.resample import (
    balanced_plan, frame_count, grouped_folds, jittered, kfold, mismatched_partners, offset_in_ranges,
    stratified_kfold, two_level_plan,
)
from .adapters import COND, EV, SIG, events, md5_sql, signal, table, trial_condition, unit_sql
from .registry import query


@query("kfold_ids", "R1", f"SELECT doc_id, CAST(ntile(5) OVER (ORDER BY {md5_sql('fold', 'doc_id')}, doc_id) - 1 AS INTEGER) AS fold FROM documents")
def kfold_ids(spark: SparkSession, sf: str) -> DataFrame:
    return kfold(table(spark, sf, "documents").select("doc_id"), "doc_id", 5).select("doc_id", "fold")


@query("leave_one_out_folds", "R2", f"WITH {SIG}, {COND} SELECT trial, trial AS fold, y FROM cond")
def leave_one_out_folds(spark: SparkSession, sf: str) -> DataFrame:
    return trial_condition(spark, sf).select("trial", F.col("trial").alias("fold"), "y")


@query(
    "stratified_folds", "R3",
    f"SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY {md5_sql('fold', 'quality', 'doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels",
)
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_kfold(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality", 5).select("doc_id", "quality", "fold")


@query(
    "grouped_folds", "R4",
    f"""WITH g AS (SELECT conv_id, CAST(ntile(4) OVER (ORDER BY {md5_sql('fold', 'conv_id')}, conv_id) - 1 AS INTEGER) AS fold FROM (SELECT DISTINCT conv_id FROM conversations))
    SELECT conv_id, turn, fold FROM conversations JOIN g USING (conv_id)""",
)
def grouped_folds_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    return grouped_folds(rows, "conv_id", 4).select("conv_id", "turn", "fold")


@query(
    "balanced_item_plan", "R12",
    f"""WITH n AS (SELECT count(*) AS n FROM supplier), r AS (SELECT s_suppkey, rep, n, row_number() OVER (PARTITION BY rep ORDER BY {md5_sql('plan', 'rep', 's_suppkey')}, s_suppkey) - 1 AS p FROM supplier, n, range(4000) q(rep) WHERE rep <= (3550 - 1) // n)
    SELECT rep * n + p AS pos, s_suppkey FROM r WHERE rep * n + p < 3550""",
)
def balanced_item_plan(spark: SparkSession, sf: str) -> DataFrame:
    return balanced_plan(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 3550)


@query(
    "two_level_plan", "R13",
    f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {md5_sql('focus', 'o_orderkey')}, o_orderkey) <= count(*) OVER () // 2 THEN 'Audio' ELSE 'Visual' END AS focus FROM orders",
)
def two_level_plan_query(spark: SparkSession, sf: str) -> DataFrame:
    return two_level_plan(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "Audio", "Visual")


D = md5_sql("jitter", "event_id")
G = f"(sqrt(-2.0 * ln((CAST('0x' || substr({D}, 1, 8) AS BIGINT) + 1) / 4294967297.0)) * cos(6.283185307179586 * {unit_sql(D, 9)}))"
DELAY = f"greatest(0.0, 2.0 + greatest(-0.3, least(0.3, {G} * 0.15)))"


@query("jittered_delays", "R14 F7", f"SELECT event_id, round({DELAY}, 6) AS delay_s, CAST(greatest(1, round_even({DELAY} * 60.0, 0)) AS INTEGER) AS frames FROM events")
def jittered_delays(spark: SparkSession, sf: str) -> DataFrame:
    delay = jittered(2.0, 0.15, 0.3, md5_key("jitter", "event_id"))
    return table(spark, sf, "events").select("event_id", F.round(delay, 6).alias("delay_s"), frame_count(delay, 60.0).alias("frames"))


@query(
    "offset_over_ranges", "R15",
    f"""WITH r AS (SELECT l_orderkey AS g, l_quantity + 100 * l_linenumber AS lo, l_quantity + 100 * l_linenumber + 20 AS hi FROM lineitem), c AS (SELECT *, sum(hi - lo) OVER (PARTITION BY g ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS cum, sum(hi - lo) OVER (PARTITION BY g) AS tot FROM r),
    t AS (SELECT o_orderkey AS g, {unit_sql(md5_sql('cut', 'o_orderkey'))} AS u FROM orders)
    SELECT t.g, round(lo + u * tot - (cum - (hi - lo)), 5) AS "offset" FROM t JOIN c ON t.g = c.g AND u * tot >= cum - (hi - lo) AND u * tot < cum""",
)
def offset_over_ranges(spark: SparkSession, sf: str) -> DataFrame:
    lo = F.col("l_quantity") + 100 * F.col("l_linenumber")
    # line numbers repeat within an order, so ranges carry a tiny rank-free tie through (lo, hi)
    ranges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), lo.alias("lo"), (lo + 20).alias("hi"))
    trials = table(spark, sf, "orders").select(F.col("o_orderkey").alias("g"))
    out = offset_in_ranges(trials, ["g"], ranges, "lo", "hi", md5_key("cut", "g"))
    return out.select("g", F.round("offset", 5).alias("offset"))


@query(
    "mismatched_partners", "J10 R17 Q13",
    f"""WITH {SIG}, tr AS (SELECT DISTINCT trial, trial // 2 AS stim FROM sig), st AS (SELECT stim, min(trial) AS j, row_number() OVER (ORDER BY {md5_sql('mismatch', 'stim')}, stim) - 1 AS pos FROM tr GROUP BY stim),
    n AS (SELECT count(*) AS n FROM st)
    SELECT tr.trial AS i, b.j FROM tr JOIN st a ON a.stim = tr.stim CROSS JOIN n CROSS JOIN range(3) r(k)
    JOIN st b ON b.pos = (a.pos + 1 + (CAST('0x' || substr({md5_sql('mismatch-start', 'tr.trial')}, 1, 8) AS BIGINT) % (n - 1) + k) % (n - 1)) % n""",
)
def mismatched_partners_query(spark: SparkSession, sf: str) -> DataFrame:
    trials = signal(spark, sf).select("trial").distinct().withColumn("stim", F.floor(F.col("trial") / 2))
    return mismatched_partners(trials, "trial", "stim", 3)
