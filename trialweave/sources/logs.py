"""Scans and sinks of behaviour logs, word tables, manifests and cached features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from ..operators.intervals import interval_join
from ..operators.ordered import positions

TRIAL_FIELDS = (
    "trial int, label string, gap_onset double, av_onset double, delay double, "
    "aborted boolean, correct boolean, audio_stim string"
)
SESSION_SCHEMA = f"session string, started bigint, trials array<struct<{TRIAL_FIELDS.replace(' int', ':int').replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean')}>>"


def read_sessions(spark: SparkSession, path: str, schema: str = SESSION_SCHEMA) -> DataFrame:
    """Session documents, one JSON document per line or per file."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)


def scored_trials(sessions: DataFrame) -> DataFrame:
    """Exploded trials that ran to the end and carry both onsets."""
    rows = sessions.select("session", F.posexplode("trials").alias("pos", "r")).select("session", "pos", "r.*")
    return rows.where(
        ~F.coalesce(F.col("aborted"), F.lit(False)) & F.col("gap_onset").isNotNull() & F.col("av_onset").isNotNull()
    )


def last_by_id(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keyed dictionary in which the last row of a key wins."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r")).select(*keys, "_r.*")


def discover_log(
    recordings: DataFrame, logs: DataFrame, by: Sequence[str], rec_id: str, start: str,
    log_id: str, log_start: str, n_trials: str, tol: int,
) -> DataFrame:
    """The log of each recording: within ``tol`` of its start and not empty; most trials
    first, then the closest, then the smaller id."""
    spans = recordings.withColumn("_lo", F.col(start) - tol).withColumn("_hi", F.col(start) + tol)
    near = interval_join(logs.where(F.col(n_trials) >= 1), spans, by, log_start, "_lo", "_hi", 2 * tol)
    dist = F.abs(F.col(log_start) - F.col(start))
    return near.groupBy(*by, rec_id).agg(
        F.min_by(F.struct(F.col(log_id), F.col(n_trials), dist.alias("dist")),
                 F.struct(-F.col(n_trials), dist, F.col(log_id))).alias("_m")
    ).select(*by, rec_id, "_m.*")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON manifest, or an empty table of the same schema where none exists yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def write_stamped(df: DataFrame, path: str, created: Column | None = None) -> None:
    """Write a manifest with ``created`` kept and ``updated`` set to now."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    first = now if created is None else F.coalesce(created, now)
    df.withColumn("created", first).withColumn("updated", now).write.mode("overwrite").json(path)


def merge_new(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows plus the new rows whose key is not there yet."""
    return old.unionByName(new.join(old.select(*key), list(key), "left_anti"))


def next_ids(existing: DataFrame, ident: str, new: DataFrame, order: Sequence[str], prefix: str) -> DataFrame:
    """Number new rows after the largest numeric tail among the existing ids."""
    tail = F.regexp_extract(ident, r"_(\d+)$", 1)
    top = existing.agg(F.coalesce(F.max(F.when(tail != "", tail).cast("bigint")), F.lit(0)).alias("_top"))
    placed = positions(new, [], list(order)).crossJoin(F.broadcast(top))
    return placed.withColumn(
        "new_id", F.concat(F.lit(prefix), F.lpad((F.col("_top") + F.col("pos") + 1).cast("string"), 6, "0"))
    ).drop("_top", "pos", "n")


def append_checked(df: DataFrame, path: str) -> str:
    """Append to a CSV folder of the same header, otherwise write beside it.

    Returns the folder used; an existing log is never rewritten.
    """
    spark = df.sparkSession
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException:
        header = df.columns
    target = path if header == df.columns else f"{path}-{len(df.columns)}cols"
    df.write.mode("append").option("header", True).csv(target)
    return target


def session_summary(trials: DataFrame) -> DataFrame:
    """Counts and accuracy per session over scored rows only (accuracy to 4 digits)."""
    scored = F.col("correct").isNotNull()
    return trials.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_trials_run"),
        F.count(F.when(scored, 1)).alias("n_scored"),
        F.count(F.when(F.col("correct"), 1)).alias("n_correct"),
        F.round(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"),
    )


def stale_keys(wanted: DataFrame, cache: DataFrame, key: Sequence[str], check: str) -> DataFrame:
    """Keys to compute again: absent from the cache, or stored under another check value."""
    return wanted.join(cache.select(*key, check), [*key, check], "left_anti")


def array_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
