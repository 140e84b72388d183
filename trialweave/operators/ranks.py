"""Rank statistics: AUC, ROC, mid-ranks, Spearman, and effect sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import Run, ordered_scan


def _all_groups(df: DataFrame, by: Sequence[str], totals: DataFrame) -> DataFrame:
    return df.join(totals, list(by)) if by else df.crossJoin(F.broadcast(totals))


def auc(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve with half credit for ties; null with one class only.

    Scores are counted per distinct value first, so the scan sees distinct scores only.
    """
    counts = df.groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_p"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("_q"),
    )
    below = ordered_scan(counts, by, [score], [Run("_b", "sum", F.col("_q"), strict=True)])
    wins = F.col("_p") * (F.col("_b") + F.col("_q") / 2.0)
    agg = below.groupBy(*by).agg(F.sum(wins).alias("_w"), F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"))
    return agg.withColumn("auc", F.col("_w") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).drop("_w")


def roc_points(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """One ROC point per distinct threshold, from the highest score down."""
    counts = df.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_p"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("_q"),
    ).withColumn("_neg", -F.col("threshold"))
    cum = ordered_scan(counts, by, ["_neg"], [Run("tp", "sum", F.col("_p")), Run("fp", "sum", F.col("_q"))])
    total = counts.groupBy(*by).agg(F.sum("_p").alias("_all_pos"), F.sum("_q").alias("_all_neg"))
    out = _all_groups(cum, by, total)
    return out.select(*by, "threshold", (F.col("tp") / F.col("_all_pos")).alias("tpr"), (F.col("fp") / F.col("_all_neg")).alias("fpr"))


def mid_ranks(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank (1-based) of tied values."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = ordered_scan(counts, by, [value], [Run("_hi", "sum", F.col("_c"))])
    rank = cum.select(*by, value, (F.col("_hi") - (F.col("_c") - 1) / 2.0).alias(out))
    return df.join(rank, [*by, value])


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    ranked = mid_ranks(mid_ranks(df, by, x, "_rx"), by, y, "_ry")
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def cohens_d(by_label: Column, value: Column, eps: float = 1e-12) -> Column:
    """Aggregate expression: (mean of label 1 - mean of label 0) / pooled sample std."""
    a, b = F.when(by_label == 1, value), F.when(by_label == 0, value)
    na, nb = F.count(a), F.count(b)
    pooled = F.sqrt(((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b)) / (na + nb - 2))
    return (F.avg(a) - F.avg(b)) / (pooled + eps)


def one_sample_t(value: Column) -> Column:
    return F.avg(value) / (F.stddev_samp(value) / F.sqrt(F.count(value)))


def welch_t(by_label: Column, value: Column) -> Column:
    a, b = F.when(by_label == 1, value), F.when(by_label == 0, value)
    return (F.avg(a) - F.avg(b)) / F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b))


def safe_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation, 0 where a side has no variance."""
    r = F.corr(a, b)
    return F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))


def confusion(df: DataFrame, by: Sequence[str], label: str, pred: str) -> DataFrame:
    """All four cells in fixed label order, zeros included."""
    y, p = F.col(label), F.col(pred)
    cells = [
        F.count(F.when((y == i) & (p == j), 1)).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)
    ]
    return df.groupBy(*by).agg(*cells, F.avg((y == p).cast("double")).alias("accuracy"))
