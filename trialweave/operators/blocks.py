"""Block + halo: frames of bounded reach over long regularly sampled series.

A row at time ``t`` belongs to block ``t div width``.  Rows near a block edge are also sent
to the neighbour that needs them, so a frame reaching ``before`` samples back and ``after``
samples ahead is complete inside one block and blocks run independently.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

DEFAULT_WIDTH = 4096


def with_halo(
    df: DataFrame, t: str = "t", before: int = 0, after: int = 0, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Add ``blk`` and ``core``; ``core`` is true on the one copy that owns the row."""
    home = F.floor(F.col(t) / F.lit(width))
    if not before and not after:
        return df.withColumn("blk", home).withColumn("core", F.lit(True))
    first = F.floor((F.col(t) - F.lit(after)) / F.lit(width))
    first = F.when(home >= 0, F.greatest(first, F.lit(0))).otherwise(first)
    last = F.floor((F.col(t) + F.lit(before)) / F.lit(width))
    return df.withColumn("blk", F.explode(F.sequence(first, last))).withColumn(
        "core", F.col("blk") == home
    )


def block_window(by: Sequence[str], t: str = "t"):
    return Window.partitionBy(*by, "blk").orderBy(t)


def framed(
    df: DataFrame,
    by: Sequence[str],
    columns: dict[str, Callable[[object], Column]],
    t: str = "t",
    before: int = 0,
    after: int = 0,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Add window columns ``name -> f(window)``, each reaching at most the given halo."""
    w = block_window(by, t)
    out = with_halo(df, t, before, after, width)
    added = [f(w).alias(name) for name, f in columns.items()]
    keep = [c for c in out.columns if c not in ("blk",)]
    return out.select(*keep, *added).where("core").drop("core")


def map_blocks(
    df: DataFrame,
    by: Sequence[str],
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: StructType,
    t: str = "t",
    before: int = 0,
    after: int = 0,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Run ``fn`` on each block (at most ``width + before + after`` rows, sorted by ``t``).

    ``fn`` gets the halo rows too and must emit results for rows whose ``core`` is true.
    """

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["core"].any():  # halo copies past the end of a series
            return pd.DataFrame([], columns=schema.names)
        return fn(pdf.sort_values(t, kind="stable").reset_index(drop=True))

    return with_halo(df, t, before, after, width).groupBy(*by, "blk").applyInPandas(task, schema)
