"""Matching events across clocks: nearest joins, clock offsets, pairing and recovery.

Nearest joins run as one ordered scan over the union of both sides, so their cost is linear
in the rows even where one session or one moment holds most of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .intervals import interval_join
from .ordered import Run, exact_quantiles, ordered_scan


def _scan_union(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, left_id: str,
    right_time: str, right_id: str, left_first: bool = False,
) -> tuple[DataFrame, Column]:
    right_mark = 1 if left_first else 0
    events = right.groupBy(*by, F.col(right_time).alias("_ts")).agg(F.min(right_id).alias("_id"))
    row = F.struct(*left.columns)
    lefts = left.select(
        *by, F.col(left_time).alias("_ts"), F.lit(1 - right_mark).alias("_k"),
        F.col(left_id).alias("_id"), row.alias("_row"),
    )
    rights = events.select(
        *by, "_ts", F.lit(right_mark).alias("_k"), "_id",
        F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"),
    )
    mark = F.when(F.col("_k") == right_mark, F.struct("_ts", "_id"))
    return lefts.unionByName(rights), mark


def nearest(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, left_id: str,
    right_time: str, right_id: str, tol=None,
) -> DataFrame:
    """Nearest right row on either side of every left row.

    A distance tie goes to the earlier right row, equal times to the smaller ``right_id``.
    Adds ``match_id``, ``match_time`` and ``err``; rows beyond ``tol`` are dropped.
    """
    both, mark = _scan_union(left, right, by, left_time, left_id, right_time, right_id)
    scanned = ordered_scan(
        both, by, ["_ts", "_k", "_id"],
        [Run("_p", "last", mark), Run("_n", "next", mark, strict=True)],
    ).where("_row is not null")
    dp, dn = F.col("_ts") - F.col("_p._ts"), F.col("_n._ts") - F.col("_ts")
    pick = F.when(dn.isNull() | (dp <= dn), F.col("_p")).otherwise(F.col("_n"))
    out = scanned.select("_row.*", pick.alias("_m"), "_ts")
    out = out.select(
        *left.columns, F.col("_m._id").alias("match_id"), F.col("_m._ts").alias("match_time"),
        F.abs(F.col("_ts") - F.col("_m._ts")).alias("err"),
    ).where("match_id is not null")
    return out if tol is None else out.where(F.col("err") <= F.lit(tol))


def following(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, left_id: str,
    right_time: str, right_id: str,
) -> DataFrame:
    """First right row strictly after every left row (``match_id``, ``match_time``)."""
    both, mark = _scan_union(left, right, by, left_time, left_id, right_time, right_id)
    # rights sort before lefts at equal times, so what follows a left row is strictly later
    scanned = ordered_scan(
        both, by, ["_ts", "_k", "_id"], [Run("_n", "next", mark, strict=True)]
    ).where("_row is not null")
    return scanned.select(
        "_row.*", F.col("_n._id").alias("match_id"), F.col("_n._ts").alias("match_time")
    ).where("match_id is not null")


def closest_per_match(matched: DataFrame, keys: Sequence[str], time: str, ident: str) -> DataFrame:
    """Keep one left row per key: smallest error, then the earlier row."""
    cols = [c for c in matched.columns if c not in keys]
    best = matched.groupBy(*keys).agg(
        F.min_by(F.struct(*cols), F.struct("err", time, ident)).alias("_b")
    )
    return best.select(*keys, "_b.*")


def clock_offset(
    edges: DataFrame, logged: DataFrame, by: Sequence[str], time: str, ident: str,
    search: int, step: int, tol: int,
) -> DataFrame:
    """Offset between two clocks per key, all in integer time units.

    The offset grid is ``first edge - first logged + k * step`` for ``k`` in
    ``[-search/step, search/step)``; the cell that explains most edges wins (first on a tie).
    Each edge covers whole runs of cells, so only run ends are emitted and summed.  The
    result is refined by the median residual of the edges explained.
    """
    by = list(by)
    first = edges.groupBy(*by).agg(F.min(time).alias("_e0")).join(
        logged.groupBy(*by).agg(F.min(time).alias("_l0")), by
    ).select(*by, (F.col("_e0") - F.col("_l0")).alias("coarse"))
    half = search // step
    reach = edges.join(first, by).select(
        *by, F.col(ident).alias("edge_id"), F.col(time).alias("edge_t"), "coarse",
        (F.col(time) - F.col("coarse") - search - tol).alias("lo"),
        (F.col(time) - F.col("coarse") + search + tol).alias("hi"),
    )
    near = interval_join(
        logged.select(*by, F.col(time).alias("log_t")), reach, by, "log_t", "lo", "hi", 2 * search
    )
    d = F.col("edge_t") - F.col("log_t") - F.col("coarse")
    near = near.select(*by, "edge_id", d.alias("d")).distinct()
    prev = F.lag("d").over(Window.partitionBy(*by, "edge_id").orderBy("d"))
    k_lo = F.floor((F.col("d") - tol) / step) + 1
    k_hi = F.ceil((F.col("d") + tol) / step)
    runs = near.select(
        *by,
        F.greatest(k_lo, F.coalesce(F.ceil((prev + tol) / step), F.lit(-half)), F.lit(-half)).alias("a"),
        F.least(k_hi, F.lit(half)).alias("b"),
    ).where("a < b")
    ends = runs.select(
        *by, F.explode(F.array(F.struct(F.col("a").alias("k"), F.lit(1).alias("w")),
                               F.struct(F.col("b").alias("k"), F.lit(-1).alias("w")))).alias("e")
    ).groupBy(*by, F.col("e.k").alias("k")).agg(F.sum("e.w").alias("w"))
    depth = F.sum("w").over(
        Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    )
    best = ends.select(*by, "k", depth.alias("n_inliers")).where(F.col("k") < half).groupBy(*by).agg(
        F.max_by(F.struct("k", "n_inliers"), F.struct("n_inliers", -F.col("k"))).alias("_b")
    )
    grid = best.join(first, by).select(
        *by, F.col("_b.k").alias("bin"), F.col("_b.n_inliers").alias("n_inliers"),
        (F.col("coarse") + F.col("_b.k") * step).alias("offset"),
    )
    shifted = edges.join(grid, by).select(
        *by, F.col(ident).alias("edge_id"), (F.col(time) - F.col("offset")).alias("t")
    )
    matched = nearest(
        shifted, logged.select(*by, F.col(time).alias("lt"), F.col(ident).alias("lid")),
        by, "t", "edge_id", "lt", "lid",
    ).where(F.col("err") < tol)
    resid = matched.select(*by, (F.col("t") - F.col("match_time")).alias("r"))
    med = exact_quantiles(resid, by, "r", {"median_resid": 0.5})
    return grid.join(med, by, "left").withColumn(
        "refined", F.col("offset") + F.coalesce("median_resid", F.lit(0.0))
    )


def pair_edges(matched: DataFrame, keys: Sequence[str], kind: str, sample: str, lo, hi) -> DataFrame:
    """Trials holding both a ``gap`` and an ``av`` edge whose gap length lies in [lo, hi]."""
    wide = matched.groupBy(*keys).agg(
        F.min(F.when(F.col(kind) == "gap", F.col(sample))).alias("gap_sample"),
        F.min(F.when(F.col(kind) == "av", F.col(sample))).alias("av_sample"),
    )
    return wide.withColumn("gap_dur", F.col("av_sample") - F.col("gap_sample")).where(
        F.col("gap_dur").between(lo, hi)
    )


def recover_missing(
    aligned: DataFrame, logged: DataFrame, edges: DataFrame, by: Sequence[str], trial: str,
    log_time: str, delay: str, edge_time: str, edge_id: str, tol,
) -> DataFrame:
    """Add trials that lost their second edge: the first edge plus the logged delay.

    A trial counts as recovered where an edge lies within ``tol`` of its logged time.
    """
    have = aligned.select(*by, trial, "gap_sample", "av_sample").withColumn("av_reconstructed", F.lit(False))
    missing = logged.join(aligned.select(*by, trial), [*by, trial], "left_anti").where(
        F.col(log_time).isNotNull() & F.col(delay).isNotNull()
    )
    near = nearest(missing, edges, by, log_time, trial, edge_time, edge_id, tol)
    found = near.select(
        *by, trial, F.col("match_time").alias("gap_sample"),
        (F.col("match_time") + F.col(delay)).alias("av_sample"), F.lit(True).alias("av_reconstructed"),
    )
    return have.unionByName(found)


def drop_twins(df: DataFrame, by: Sequence[str], time: str, ident: str, gap) -> DataFrame:
    """Drop a trigger that follows the previous one of its key by less than ``gap``."""
    scanned = ordered_scan(df, by, [time, ident], [Run("_prev", "last", F.col(time), strict=True)])
    return scanned.where(
        F.col("_prev").isNull() | (F.col(time) - F.col("_prev") >= F.lit(gap))
    ).drop("_prev")
