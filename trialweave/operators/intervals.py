"""Interval joins by time buckets, epochs around events, and block gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def interval_join(
    points: DataFrame, intervals: DataFrame, by: Sequence[str], at: str, lo: str, hi: str,
    bucket: int | float, closed: str = "both", salts: int = 4,
) -> DataFrame:
    """Points inside intervals: an equi-join on (key, bucket, salt) plus the exact test.

    Points of one hot (key, bucket) are spread over ``salts`` tasks; intervals, the small
    side, are copied to each salt.  Each point has one bucket, so no pair appears twice.
    """
    p = points.withColumn("_b", F.floor(F.col(at) / bucket)).withColumn(
        "_s", F.pmod(F.xxhash64(*[F.col(c) for c in points.columns]), F.lit(salts))
    )
    span = F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))
    q = intervals.where(F.col(lo) <= F.col(hi)).withColumn("_b", F.explode(span)).withColumn(
        "_s", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(salts)]))
    )
    inside = F.col(at) >= F.col(lo)
    inside = inside & (F.col(at) <= F.col(hi) if closed == "both" else F.col(at) < F.col(hi))
    return p.join(q, [*by, "_b", "_s"]).where(inside).drop("_b", "_s")


def epochs(
    samples: DataFrame, onsets: DataFrame, by: Sequence[str], time: str, onset: str,
    tmin, tmax, closed: str = "both",
) -> DataFrame:
    """Samples in [onset + tmin, onset + tmax] of every event, with relative time ``rel``."""
    spans = onsets.withColumn("_lo", F.col(onset) + F.lit(tmin)).withColumn("_hi", F.col(onset) + F.lit(tmax))
    joined = interval_join(samples, spans, by, time, "_lo", "_hi", max(tmax - tmin, 1), closed)
    return joined.withColumn("rel", F.col(time) - F.col(onset)).drop("_lo", "_hi")


def baseline_corrected(
    ep: DataFrame, keys: Sequence[str], rel: str, value: str, lo, hi, out: str = "corrected"
) -> DataFrame:
    """Subtract the mean over ``lo <= rel <= hi`` of each key; keys without baseline stay null."""
    base = ep.where(F.col(rel).between(lo, hi)).groupBy(*keys).agg(F.avg(value).alias("_base"))
    return ep.join(base, list(keys), "left").withColumn(out, F.col(value) - F.col("_base")).drop("_base")


def reject_peak_to_peak(
    ep: DataFrame, epoch: Sequence[str], channel: str, value: str, limit
) -> DataFrame:
    """Drop every epoch in which any channel exceeds the peak-to-peak limit."""
    bad = (
        ep.groupBy(*epoch, channel)
        .agg((F.max(value) - F.min(value)).alias("_p2p"))
        .where(F.col("_p2p") > F.lit(limit))
        .select(*epoch)
        .distinct()
    )
    return ep.join(bad, list(epoch), "left_anti")


def block_gate(
    long: DataFrame, trial: Sequence[str], channel: str, value: str, p2p_limit, std_limit, max_share=0.1
) -> DataFrame:
    """Ledger of blocks: a channel is bad when non-finite, too large or too flat; a block with
    more than ``max_share`` bad channels is rejected."""
    v = F.col(value)
    finite = ~(F.isnan(v) | v.isNull() | (F.abs(v) == F.lit(float("inf"))))
    per_channel = long.groupBy(*trial, channel).agg(
        (F.max(F.when(finite, v)) - F.min(F.when(finite, v))).alias("p2p"),
        F.stddev_pop(F.when(finite, v)).alias("sd"),
        F.min(finite).alias("finite"),
    )
    bad = (~F.col("finite")) | (F.col("p2p") > F.lit(p2p_limit)) | (F.col("sd") < F.lit(std_limit))
    per_block = per_channel.groupBy(*trial).agg(
        F.count(F.lit(1)).alias("n_channels"),
        F.sum(F.when(bad, 1).otherwise(0)).alias("n_bad_channels"),
        F.max("p2p").alias("max_p2p"),
    )
    keep = F.col("n_bad_channels") / F.col("n_channels") <= F.lit(max_share)
    return per_block.withColumn("keep", keep).withColumn(
        "reason", F.when(keep, F.lit("ok")).otherwise(F.lit("block_artifact"))
    )


def complete_blocks(blocks: DataFrame, start: str, length: Column | int, max_t: str) -> DataFrame:
    """Blocks that neither start before 0 nor run past the end of the recording."""
    n = F.lit(length) if isinstance(length, int) else length
    return blocks.where((F.col(start) >= 0) & (F.col(start) + n <= F.col(max_t)))


def marker_segments(
    markers: DataFrame, by: Sequence[str], code: str, time: str, first: str, last: str
) -> DataFrame:
    """First occurrence of each of two markers per key, as [seg_lo, seg_hi]."""
    return markers.groupBy(*by).agg(
        F.min(F.when(F.col(code) == first, F.col(time))).alias("seg_lo"),
        F.min(F.when(F.col(code) == last, F.col(time))).alias("seg_hi"),
    ).where(F.col("seg_lo").isNotNull() & F.col("seg_hi").isNotNull() & (F.col("seg_lo") < F.col("seg_hi")))
