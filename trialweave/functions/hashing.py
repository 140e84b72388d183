"""Reproducible randomness: every draw is a function of ``md5(seed | key | ...)``.

md5 text is identical in every SQL engine, so folds, permutations and jitters can be
checked outside Spark, and a re-run after a lost executor draws the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def md5_key(seed: str, *cols: Column | str) -> Column:
    """Hex digest of ``seed|c1|c2|...``."""
    parts = [F.lit(seed)] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hex_int(digest: Column, start: int = 1, digits: int = 8) -> Column:
    """Unsigned integer from ``digits`` hex characters of a digest (``start`` is 1-based)."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def unit(digest: Column, start: int = 1) -> Column:
    """Uniform value in [0, 1) from eight hex characters."""
    return hex_int(digest, start, 8) / F.lit(4294967296.0)


def gauss(digest: Column) -> Column:
    """Standard normal value by Box-Muller from two uniforms of one digest."""
    u1 = (hex_int(digest, 1, 8) + F.lit(1)) / F.lit(4294967297.0)
    u2 = unit(digest, 9)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)
