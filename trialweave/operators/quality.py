"""Channel quality: robust z scores, correlations, neighbours, reasons and repair."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.linalg import covariances
from ..session import written
from .spectral import matrix_applied
from .stats import map_rows


def channel_stats(long: DataFrame, by: Sequence[str], v: str = "v") -> DataFrame:
    """Peak-to-peak, population std and finite flag per channel; non-finite values count as 0."""
    x = F.col(v)
    ok = ~(F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    clean = F.when(ok, x).otherwise(0.0)
    return long.groupBy(*by).agg(
        (F.max(clean) - F.min(clean)).alias("p2p"), F.stddev_pop(clean).alias("sd"),
        F.var_pop(clean).alias("var"), F.min(ok).alias("finite"),
    )


def robust_z(df: DataFrame, by: Sequence[str], value: str, out: str, floor: float = 2.220446049250313e-16, add: float | None = None) -> DataFrame:
    """``0.6745 * (x - median) / MAD`` per group, nulls and NaN left out.

    The divisor is ``max(MAD, floor)``, or ``MAD + add`` where ``add`` is given.  ``df`` has one row per
    channel and key, so a group is as large as the montage and its medians are one exact aggregate.
    """
    by = list(by)
    clean = written(df.withColumn("_x", F.when(~F.isnan(value), F.col(value))), "robust-z")

    def attach(rows: DataFrame, col: str, name: str) -> DataFrame:
        med = rows.groupBy(*by).agg(F.percentile(col, F.lit(0.5)).alias(name))
        return rows.join(med, by) if by else rows.crossJoin(F.broadcast(med))

    centred = attach(clean, "_x", "_med").withColumn("_dev", F.abs(F.col("_x") - F.col("_med")))
    both = attach(centred, "_dev", "_mad")
    div = F.greatest(F.col("_mad"), F.lit(floor)) if add is None else F.col("_mad") + F.lit(add)
    return both.withColumn(out, F.lit(0.6745) * (F.col("_x") - F.col("_med")) / div).drop("_x", "_med", "_dev", "_mad")


def pooled_correlations(total: DataFrame, p: int, q: int) -> DataFrame:
    """``(ch, nbr, r, common_corr)`` for every channel pair from one pooled statistics row.

    ``common_corr`` is the correlation of ``ch`` with the across-channel mean; both follow from
    the covariance, so samples are read once and never shuffled.  p is a channel count.
    """

    def one(row):
        c = covariances(np.asarray(row["s"]), p, q)[3]
        sd = np.sqrt(np.maximum(np.diag(c), 1e-300))
        r = c / np.outer(sd, sd)
        common = c.mean(1) / (sd * np.sqrt(max(c.mean(), 1e-300)))
        for i in range(p):
            for j in range(p):
                yield (i, j, float(r[i, j]), float(common[i]))

    return map_rows(total.select("s"), one, "ch int, nbr int, r double, common_corr double")


def common_correlation(pairs: DataFrame) -> DataFrame:
    """Correlation of each channel with the across-channel mean."""
    return pairs.where("ch = nbr").select("ch", "common_corr")


def reasons(**tests: Column) -> Column:
    """Names of the tests that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in tests.items()]))


def nearest_channels(channels: DataFrame, by: Sequence[str], ch: str, pos: Sequence[str], k: int) -> DataFrame:
    """The ``k`` nearest other channels of each channel, as ``(ch, nbr, rank, dist)``.

    A montage is a dimension table: its channels are gathered into one array per montage and
    distances stay inside that array, so only k rows per channel are ever produced.
    """
    row = F.struct(F.col(ch).alias("c"), *[F.col(p).alias(p) for p in pos])
    cap = channels.groupBy(*by).agg(F.collect_list(row).alias("_all"))
    joined = channels.join(cap, list(by)) if by else channels.crossJoin(F.broadcast(cap))
    dist = lambda o: sum(((o[p] - F.col(p)) ** 2 for p in pos), F.lit(0.0))
    others = F.filter("_all", lambda o: o.c != F.col(ch))
    ranked = F.slice(F.sort_array(F.transform(others, lambda o: F.struct(dist(o).alias("d"), o.c.alias("c")))), 1, k)
    return joined.select(*by, ch, F.posexplode(ranked).alias("r", "o")).select(
        *by, ch, F.col("o.c").alias("nbr"), (F.col("r") + 1).alias("rank"), F.sqrt("o.d").alias("dist")
    )


def neighbour_coherence(pairs: DataFrame, edges: DataFrame, min_positions: int = 6) -> DataFrame:
    """Mean correlation of each channel with its neighbours; empty when positions are too few."""
    n = edges.select("ch").distinct().agg(F.count(F.lit(1)).alias("_n"))
    r = pairs.join(edges.select("ch", "nbr"), ["ch", "nbr"]).groupBy("ch").agg(F.avg("r").alias("coherence"))
    return r.crossJoin(F.broadcast(n)).where(F.col("_n") >= min_positions).drop("_n")


def scheduled_bad(schedule: DataFrame, spans: str, channels: str, min_share: float) -> DataFrame:
    """Channels listed bad in at least ``min_share`` of the trials.

    ``spans`` holds ``lo-hi`` or one number; the share is over the highest trial named.
    """
    lo = F.regexp_extract(spans, r"^\s*(\d+)", 1).cast("int")
    hi = F.coalesce(F.nullif(F.regexp_extract(spans, r"-\s*(\d+)", 1), F.lit("")).cast("int"), lo)
    rows = schedule.select(lo.alias("lo"), hi.alias("hi"), F.explode(channels).alias("ch"))
    top = rows.agg(F.max("hi").alias("_top"))
    seen = rows.select("ch", F.explode(F.sequence("lo", "hi")).alias("trial")).distinct()
    share = seen.groupBy("ch").agg(F.count(F.lit(1)).alias("n_trials")).crossJoin(F.broadcast(top))
    return share.withColumn("share", F.col("n_trials") / F.col("_top")).where(F.col("share") >= min_share).drop("_top")


def with_sources(lists: dict[str, DataFrame], ch: str) -> DataFrame:
    """Union of flagged channels with the sorted names of the lists that flagged them."""
    tagged = [df.select(ch, F.lit(name).alias("_src")) for name, df in lists.items()]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy(ch).agg(F.sort_array(F.collect_set("_src")).alias("sources"))


def neighbour_matrix(edges: DataFrame, p: int, weight: Column) -> np.ndarray:
    """Row-normalised neighbour weights as a ``p x p`` matrix for ``x @ matrix``.

    Repeated edges count once (the largest weight), so at most p * p numbers reach the driver.
    """
    m = np.zeros((p, p))
    for r in edges.select("ch", "nbr", weight.alias("w")).groupBy("ch", "nbr").agg(F.max("w").alias("w")).collect():
        m[r.nbr, r.ch] = r.w
    total = m.sum(0)
    return m / np.where(total == 0, 1.0, total)


def repair_from_neighbours(df: DataFrame, x: str, p: int, bad: DataFrame, edges: DataFrame) -> DataFrame:
    """Replace bad channels by the inverse-distance mean of their good neighbours.

    One matrix product per sample vector, no shuffle.  A bad channel without any good
    neighbour becomes null.
    """
    flags = bad.select("ch").distinct()
    good = edges.join(flags.withColumnRenamed("ch", "nbr"), "nbr", "left_anti").join(flags, "ch", "left_semi")
    m = neighbour_matrix(good, p, 1.0 / F.greatest(F.col("dist"), F.lit(1e-12)))
    lost = [r.ch for r in flags.where(F.col("ch").between(0, p - 1)).collect()]
    keep = np.eye(p)
    keep[:, lost] = m[:, lost]
    empty = [c for c in lost if not m[:, c].any()]
    out = matrix_applied(df, x, keep)
    if not empty:
        return out
    return out.withColumn(x, F.transform(x, lambda v, i: F.when(~i.isin(empty), v)))


def sparse_repair(df: DataFrame, x: str, p: int, edges: DataFrame, limit: float = 3.0) -> DataFrame:
    """Replace samples that lie more than ``limit`` residual stds from their neighbours' mean.

    Adds ``repaired``, an array of flags per channel.  Predictions are a matrix product per
    row; only the p residual stds are aggregated.
    """
    pred = matrix_applied(df, x, neighbour_matrix(edges, p, F.lit(1.0)), "_p")
    resid = pred.select(F.posexplode(F.zip_with(x, "_p", lambda a, b: a - b)).alias("ch", "r"))
    sd = resid.groupBy("ch").agg(F.stddev_pop("r").alias("sd"))
    row = sd.agg(F.transform(F.sort_array(F.collect_list(F.struct("ch", "sd"))), lambda r: r.sd * limit).alias("_lim"))
    both = pred.crossJoin(F.broadcast(row)).withColumn(
        "repaired", F.zip_with(F.zip_with(x, "_p", lambda a, b: F.abs(a - b)), "_lim", lambda d, m: d > m)
    )
    fixed = F.transform(F.arrays_zip(F.col(x).alias("v"), F.col("_p").alias("p"), F.col("repaired").alias("h")), lambda z: F.when(z.h, z.p).otherwise(z.v))
    return both.withColumn(x, fixed).drop("_p", "_lim")
