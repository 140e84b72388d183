"""Renames, channel choices, predicates and small set guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


# Difficulty tiers from easiest to hardest.
DIFFICULTY = ("very_easy", "easy", "medium", "hard", "very_hard", "super_hard")

# Channel lists of the two scalp regions used for load contrasts.
FRONTAL = ("Fz", "F3", "F4", "FC5", "FC6", "AF7", "AF8", "Fpz", "Fp1", "Fp2", "F7", "F8")
PARIETAL = ("Pz", "P3", "P4", "P7", "P8", "PO7", "PO8", "Oz", "O1", "O2", "CP5", "CP6")


def ordinal(name: Column, order: Sequence[str] = DIFFICULTY) -> Column:
    """Place of a tier name in its order, from 0; null for an unknown name."""
    return (F.nullif(F.array_position(F.array(*[F.lit(v) for v in order]), name), F.lit(0)) - 1).cast("int")


def high_load(tier: Column, threshold: int = 3) -> Column:
    return F.when(tier >= threshold, "high").otherwise("low")


def rename_by_map(df: DataFrame, name: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Mapped names, unmapped names kept."""
    m = mapping.select(F.col(old).alias(name), F.col(new).alias("_new"))
    return df.join(m, name, "left").withColumn(name, F.coalesce("_new", name)).drop("_new")


def rename_if_complete(df: DataFrame, name: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Apply the map only where it covers every name; otherwise leave all names unchanged."""
    missing = df.select(name).distinct().join(
        mapping.select(F.col(old).alias(name)), name, "left_anti"
    ).agg(F.count(F.lit(1)).alias("_missing"))
    m = mapping.select(F.col(old).alias(name), F.col(new).alias("_new"))
    joined = df.join(m, name, "left").crossJoin(F.broadcast(missing))
    pick = F.when(F.col("_missing") == 0, F.col("_new")).otherwise(F.col(name))
    return joined.withColumn(name, pick).drop("_new", "_missing")


def swap_halves(df: DataFrame, number: str, half: int = 32) -> DataFrame:
    """Partner number of the other connector half, only where that number exists."""
    n = F.col(number)
    out = df.withColumn("swapped", F.when(n <= half, n + half).otherwise(n - half))
    have = df.select(n.alias("swapped")).distinct()
    return out.join(have, "swapped", "left_semi")


def region_of(name: Column) -> Column:
    """Scalp region by name prefix."""
    up = F.upper(name)
    # Prefixes of the two regions.
    posterior = up.rlike("^(O|P|I)")
    frontal = up.rlike("^(FP|AF)") | (up.startswith("F") & ~up.rlike("^(FC|FT|FP)"))
    return F.when(posterior, F.lit("posterior")).when(frontal, F.lit("frontal"))


def channels_or_all(df: DataFrame, name: str, wanted: Sequence[str]) -> DataFrame:
    """Rows of the wanted channels; all rows where none of them is present."""
    hits = df.where(F.col(name).isin(list(wanted))).agg(F.count(F.lit(1)).alias("_hits"))
    keep = (F.col("_hits") == 0) | F.col(name).isin(list(wanted))
    return df.crossJoin(F.broadcast(hits)).where(keep).drop("_hits")


def in_vocabulary(df: DataFrame, name: str, vocabulary: DataFrame, word: str) -> DataFrame:
    """Case-insensitive membership."""
    v = vocabulary.select(F.upper(word).alias("_u")).distinct()
    return df.withColumn("_u", F.upper(name)).join(v, "_u", "left_semi").drop("_u")


def decimated(df: DataFrame, t: str, rate: float, target: float) -> DataFrame:
    """Keep every k-th sample, ``k = max(1, round(rate / target))``."""
    k = max(1, round(rate / target))
    return df.where(F.col(t) % k == 0)


def fit_length(df: DataFrame, by: Sequence[str], t: str, value: str, n: int) -> DataFrame:
    """Series cut or extended to ``n`` samples; the last value is repeated."""
    tail = df.groupBy(*by).agg(F.max_by(value, t).alias("_v"), F.max(t).alias("_t"))
    short = tail.where(F.col("_t") < n - 1)
    extra = short.select(*by, F.explode(F.sequence(F.col("_t") + 1, F.lit(n - 1).cast("bigint"))).alias(t), F.col("_v").alias(value))
    return df.select(*by, t, value).where(F.col(t) < n).unionByName(extra)


def bounded(v: Column, limit: float = 8.0) -> Column:
    """Clip to [-limit, limit]; NaN and null become 0."""
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.nanvl(F.coalesce(v, F.lit(0.0)), F.lit(0.0))))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """One-row aggregate that fails the job where ``condition`` is false."""
    return df.withColumn("_ok", F.assert_true(condition, message)).where("_ok is null").drop("_ok")


def same_names(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """``only_left``, ``only_right`` and ``equal`` for two name sets."""
    la, lb = a.select(name).distinct().withColumn("_a", F.lit(1)), b.select(name).distinct().withColumn("_b", F.lit(1))
    return la.join(lb, name, "full_outer").agg(
        F.count(F.when(F.col("_b").isNull(), 1)).alias("only_left"),
        F.count(F.when(F.col("_a").isNull(), 1)).alias("only_right"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def top_by(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, ident: str) -> DataFrame:
    """The first ``k`` rows per key.  Ties are broken by ``ident`` so the choice is stable.

    Each salt keeps its own first ``k`` rows before the final ranking, so a hot key is
    reduced in parallel.
    """
    salt = F.pmod(F.xxhash64(ident), F.lit(64))
    first = Window.partitionBy(*by, "_salt").orderBy(*order, ident)
    last = Window.partitionBy(*by).orderBy(*order, ident)
    part = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    return part.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).drop("_salt", "_r")
