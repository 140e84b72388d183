"""Order-dependent work that stays parallel when one key holds most of the rows.

Three ways to cut an ordered sequence into blocks are used in the library:

* ``t div width`` for regularly sampled signals, where ``(key, t)`` is unique and a block
  therefore holds at most ``width`` rows;
* a hex prefix of the digest for md5 orders, which is uniform by construction;
* range blocks for anything else: the rows are range-partitioned on the whole sort key and
  written once, so that the block number of a row can never change under task retry.

Running values are then a window inside each block plus a carry from the block totals, and
no window ever spans a whole hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import md5_key
from ..session import shuffle_width, written


@dataclass(frozen=True)
class Run:
    """One running value.

    ``kind`` is ``sum``, ``count``, ``max`` or ``last`` (everything up to and including the
    row), or ``next`` (first non-null value after the row).  ``strict`` leaves the row out.
    """

    out: str
    kind: str
    expr: Column
    strict: bool = False


#: Rows that one task of an ordered scan sorts, on average, where there are many.
SCAN_ROWS = 1 << 18


def range_blocks(df: DataFrame, order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Add ``blk``: equal-sized consecutive blocks of the rows sorted by ``order``."""
    n = blocks or shuffle_width(df.sparkSession)
    cut = df.repartitionByRange(n, *order).withColumn("blk", F.spark_partition_id())
    return written(cut, "range-blocks")


def _total(run: Run, order: Column) -> Column:
    if run.kind == "sum":
        return F.sum(run.expr)
    if run.kind == "count":
        return F.count(run.expr)
    if run.kind == "max":
        return F.max(run.expr)
    present = F.when(run.expr.isNotNull(), order)
    if run.kind == "last":
        return F.max_by(run.expr, present)
    if run.kind == "next":
        return F.min_by(run.expr, present)
    raise ValueError(run.kind)


def ordered_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    runs: Sequence[Run],
    block: Column | None = None,
) -> DataFrame:
    """Add running values over ``order`` within ``by``.

    ``order`` must be unique within ``by``.  Without ``block`` the rows are cut into range
    blocks; with it, ``block`` must grow with ``order``.
    """
    by, order = list(by), list(order)
    if block is None:
        base = range_blocks(df, by + order)
        tasks = base.count() // SCAN_ROWS
        if tasks > shuffle_width(df.sparkSession):
            base = base.repartition(tasks, *by, "blk")
    else:
        base = df.withColumn("blk", block)
    key = F.struct(*order)
    totals = base.groupBy(*by, "blk").agg(*[_total(r, key).alias(f"_t_{r.out}") for r in runs])
    across = Window.partitionBy(*by).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*by).orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = []
    for r in runs:
        c = F.col(f"_t_{r.out}")
        if r.kind in ("sum", "count"):
            carry.append(F.sum(c).over(across))
        elif r.kind == "max":
            carry.append(F.max(c).over(across))
        else:
            carry.append(F.last(c, ignorenulls=True).over(across if r.kind == "last" else back))
    carried = totals.select(*by, "blk", *[c.alias(f"_c_{r.out}") for c, r in zip(carry, runs)])
    inside = Window.partitionBy(*by, "blk").orderBy(*order)
    mirror = Window.partitionBy(*by, "blk").orderBy(*[F.col(c).desc() for c in order])
    joined = base.join(carried, [*by, "blk"])
    keep = [c for c in base.columns if c != "blk"]
    return joined.select(
        *keep, *[_within(r, inside, mirror, F.col(f"_c_{r.out}")).alias(r.out) for r in runs]
    )


def _within(run: Run, inside, mirror, carry: Column) -> Column:
    """The running value inside one block, joined with what came before the block.

    Values that look ahead run over the mirrored order: a frame that only grows is linear,
    one that shrinks from the front is quadratic.
    """
    edge = -1 if run.strict else 0
    w = (mirror if run.kind == "next" else inside).rowsBetween(Window.unboundedPreceding, edge)
    if run.kind in ("sum", "count"):
        v = (F.sum if run.kind == "sum" else F.count)(run.expr).over(w)
        return F.coalesce(carry, F.lit(0)) + F.coalesce(v, F.lit(0))
    if run.kind == "max":
        return F.greatest(carry, F.max(run.expr).over(w))
    return F.coalesce(F.last(run.expr, ignorenulls=True).over(w), carry)


def _offsets(base: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows before each block and rows in all, per key; one row per (key, block)."""
    sizes = base.groupBy(*by, "blk").agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(*by).orderBy("blk")
    return sizes.select(
        *by,
        "blk",
        F.coalesce(F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_m").over(Window.partitionBy(*by)).alias("n"),
    )


def _positions(base: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    inside = Window.partitionBy(*by, "blk").orderBy(*order)
    keep = [c for c in base.columns if c != "blk"]
    return base.join(_offsets(base, by), [*by, "blk"]).select(
        *keep,
        (F.col("_off") + F.row_number().over(inside) - 1).cast("bigint").alias("pos"),
        F.col("n").cast("bigint").alias("n"),
    )


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``pos`` (0-based place of the row in ``order`` within ``by``) and group size ``n``."""
    return _positions(range_blocks(df, [*by, *order]), list(by), list(order))


def shuffled_positions(
    df: DataFrame, by: Sequence[str], keys: Sequence[str], seed: str, digits: int = 3
) -> DataFrame:
    """Place of each row in the md5 order of ``keys`` within ``by``: a reproducible shuffle.

    Blocks are hex prefixes (16 ** digits per group), so no range sampling is needed.
    """
    base = df.withColumn("_h", md5_key(seed, *by, *keys))
    base = base.withColumn("blk", F.substring("_h", 1, digits))
    return _positions(base, list(by), ["_h", *keys]).drop("_h")


def ntile_of(pos: Column, n: Column, k: int | Column) -> Column:
    """0-based bucket of ``pos`` among ``n`` rows cut into ``k`` parts, longer parts first."""
    k = F.lit(k) if isinstance(k, int) else k
    small = F.floor(n / k)
    long_parts = n % k
    edge = long_parts * (small + 1)
    return (
        F.when(pos < edge, F.floor(pos / (small + 1)))
        .otherwise(long_parts + F.floor((pos - edge) / F.greatest(small, F.lit(1))))
        .cast("int")
    )


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, for groups of any size.

    Equal values are counted first, the distinct values are placed by a block scan, and only
    the rows around each wanted place are kept, so no group is held in one task's memory.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = ordered_scan(counts, by, [value], [Run("_hi", "sum", F.col("_c"))])
    totals = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    at = placed.join(totals, by) if by else placed.crossJoin(F.broadcast(totals))
    lo_edge, hi_edge = F.col("_hi") - F.col("_c"), F.col("_hi")

    def picks(place: Column) -> Column:
        return (place >= lo_edge) & (place < hi_edge)

    aggs = []
    for name, q in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(q))
        aggs += [
            F.max(F.when(picks(F.floor(h)), F.col(value))).alias(f"_a_{name}"),
            F.max(F.when(picks(F.ceil(h)), F.col(value))).alias(f"_b_{name}"),
            F.max(h - F.floor(h)).alias(f"_w_{name}"),
        ]
    out = at.groupBy(*by).agg(*aggs)
    return out.select(
        *by,
        *[
            (F.col(f"_a_{m}") + (F.col(f"_b_{m}") - F.col(f"_a_{m}")) * F.col(f"_w_{m}")).alias(m)
            for m in probs
        ],
    )
