"""Views that bind the shared test tables to the library's data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import md5_key, unit

TRIAL_LEN = 50
CHANNELS = 64
STIM_DELAY = 3


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """``(trial, t, x)``: 64-channel samples, 50 per trial."""
    return table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / TRIAL_LEN).cast("bigint").alias("trial"),
        (F.col("vec_id") % TRIAL_LEN).cast("bigint").alias("t"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.col("label").cast("int").alias("label"),
    )


def signal_long(spark: SparkSession, sf: str) -> DataFrame:
    """``(trial, t, ch, v)``."""
    return signal(spark, sf).select("trial", "t", F.posexplode("x").alias("ch", "v"))


def trial_condition(spark: SparkSession, sf: str) -> DataFrame:
    """``(trial, y)``: 1 for attend-audio, 0 for attend-visual."""
    return (
        signal(spark, sf)
        .where(F.col("t") == 0)
        .select("trial", F.when(F.col("label") < 5, 1).otherwise(0).cast("int").alias("y"))
    )


def stimulus(spark: SparkSession, sf: str) -> DataFrame:
    """``(trial, t, s)``: channel 0 delayed by three samples plus md5 noise."""
    base = signal(spark, sf).select("trial", "t", F.col("x")[0].alias("x0"))
    delayed = base.select("trial", (F.col("t") + STIM_DELAY).alias("t"), F.col("x0").alias("d"))
    noise = (unit(md5_key("stim", "trial", "t")) - 0.5) * 0.1
    return (
        base.join(delayed, ["trial", "t"], "left")
        .select("trial", "t", (F.coalesce("d", F.lit(0.0)) + noise).alias("s"))
    )


def wall_micros(col: str = "ts") -> Column:
    """Microseconds of a zone-less wall clock, whatever the session time zone is."""
    instant = F.col(col).cast("timestamp")
    return F.unix_micros(F.from_utc_timestamp(instant, F.current_timezone()))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """``(event_id, user_id, event_type, us, value, k)`` with integer microseconds."""
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "event_type",
        wall_micros().alias("us"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def words(spark: SparkSession, sf: str) -> DataFrame:
    """``(clip, pos, word)``: words of each conversation in spoken order, pos from 0 per turn."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("clip"),
        "turn",
        F.posexplode(F.split("text", " ")).alias("pos", "word"),
    )


# The same views as SQL text for the oracle queries.
SIG = "sig AS (SELECT vec_id // 50 AS trial, vec_id % 50 AS t, embedding AS x, label FROM embeddings)"
LONG = (
    SIG
    + ", long AS (SELECT trial, t, CAST(ch AS INTEGER) AS ch, CAST(x[ch + 1] AS DOUBLE) AS v FROM sig, range(64) r(ch))"
)
COND = "cond AS (SELECT trial, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM sig WHERE t = 0)"
STIM = (
    "x0 AS (SELECT trial, t, CAST(x[1] AS DOUBLE) AS v FROM sig), "
    "stim AS (SELECT a.trial, a.t, coalesce(b.v, 0.0) + "
    "(CAST('0x' || substr(md5(concat_ws('|', 'stim', a.trial, a.t)), 1, 8) AS BIGINT) / 4294967296.0 - 0.5) * 0.1 AS s "
    "FROM x0 a LEFT JOIN x0 b ON a.trial = b.trial AND b.t = a.t - 3)"
)
EV = (
    "ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, value, "
    "CAST(props ->> '$.k' AS INTEGER) AS k FROM events)"
)


def md5_sql(seed: str, *cols: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(cols)}))"


def unit_sql(digest: str, start: int = 1) -> str:
    return f"(CAST('0x' || substr({digest}, {start}, 8) AS BIGINT) / 4294967296.0)"
