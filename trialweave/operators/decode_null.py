"""Time-resolved discriminants of all label permutations from one Gram matrix per time and fold.

The pooled covariance inside the classes is the total scatter minus the scatter of the class means, so
a permutation needs only its class sums.  Rows are read once for all permutations; labels of a trial travel
with it as one array.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import linalg as la
from ..session import written
from .ranks import auc
from .stats import FLUSH_BYTES, _final_sum, _key_fields, _Sums, _whole, map_rows


def label_arrays(labels: DataFrame, trial: str, n_perm: int, y: str = "y") -> DataFrame:
    """``(trial, labels)``: the label of each permutation 0..n_perm in order, from ``(perm, trial, y)``."""
    packed = F.sort_array(F.collect_list(F.struct("perm", y)))
    return labels.where(F.col("perm") <= n_perm).groupBy(trial).agg(F.transform(packed, lambda r: r[y].cast("int")).alias("labels"))


def label_rows(labels: DataFrame, trial: str, n_perm: int, y: str = "y") -> DataFrame:
    """The same where a trial may come more than once: a row with labels for each time it comes."""
    packed = F.sort_array(F.collect_list(F.struct("perm", F.col(y).cast("int").alias("y"))))
    all_of = labels.where(F.col("perm") <= n_perm).groupBy(trial).agg(packed.alias("_all"))
    times = (F.size("_all") / (n_perm + 1)).cast("int")
    each = all_of.withColumn("_times", times).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    own = F.transform(F.sequence(F.lit(0), F.lit(n_perm)), lambda i: F.get("_all", i * F.col("_times") + F.col("_k"))["y"])
    return each.select(trial, own.alias("labels"))


def _permuted_sums(rows: DataFrame, by: Sequence[str], fold: str, x: str) -> DataFrame:
    """``(by..., fold, s)``: n, sums, products, then per permutation the count and sums of class 1."""
    keys = [*by, fold]
    fields = _key_fields(rows, keys)
    schema = T.StructType([*fields, T.StructField("piece", T.IntegerType()), T.StructField("a", T.ArrayType(T.DoubleType()))])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = _Sums(keys)
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False):
                v = np.stack(part[x].to_list())
                labels = np.stack(part["labels"].to_list()).astype(float)
                ones = np.hstack([labels.sum(0)[:, None], labels.T @ v])
                acc.add(key if isinstance(key, tuple) else (key,), np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel(), ones.ravel()]))
                if acc.bytes > FLUSH_BYTES:
                    yield from acc.frames()
        yield from acc.frames()

    partial = rows.select(*keys, x, "labels").mapInPandas(task, schema)
    return _whole(_final_sum(partial, keys), keys)


def _discriminants(s: np.ndarray, p: int, shrink: float | str) -> tuple[np.ndarray, np.ndarray]:
    """Weights (a row per permutation) and biases; a permutation with one class only gets nan."""
    n, total, gram = s[0], s[1 : 1 + p], s[1 + p : 1 + p + p * p].reshape(p, p)
    ones = s[1 + p + p * p :].reshape(-1, p + 1)
    w, b = np.full((len(ones), p), np.nan), np.full(len(ones), np.nan)
    for i, (n1, *sum1) in enumerate(ones):
        n0, s1 = n - n1, np.asarray(sum1)
        if n1 < 0.5 or n0 < 0.5:
            continue
        m1, m0 = s1 / n1, (total - s1) / n0
        within = (gram - n1 * np.outer(m1, m1) - n0 * np.outer(m0, m0)) / n
        within = la.oas(within, n) if shrink == "auto" else (1 - shrink) * within + shrink * np.trace(within) / p * np.eye(p)
        w[i] = np.linalg.lstsq(within, m1 - m0, rcond=None)[0]
        b[i] = -0.5 * (m0 + m1) @ w[i] + np.log(n1 / n0)
    return w, b


def permuted_curves(rows: DataFrame, by: Sequence[str], fold: str, y_arrays: DataFrame, trial: str, x: str, p: int, shrink: float | str = "auto", digits: int = 9) -> DataFrame:
    """``(by..., perm, v)``: cross-validated AUC of every permutation (0: the data) for each key, such as a time.

    ``rows`` are ``(trial, by..., fold, x)``, ``y_arrays`` ``(trial, labels)``.  ``shrink`` pulls the pooled
    covariance towards a scaled identity (``auto``: oracle approximating).
    """
    by = list(by)
    rows = written(rows.join(y_arrays, trial).select(trial, *by, fold, x, "labels"), "labelled-rows")
    held = written(_permuted_sums(rows, by, fold, x), "permuted-sums")
    total = held.groupBy(*by).agg(F.collect_list("s").alias("all"))  # one vector per fold
    types = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in [*by, fold])

    def one(row):
        w, b = _discriminants(np.sum(np.stack(row["all"]), axis=0) - np.asarray(row["s"]), p, shrink)
        yield (*[row[c] for c in [*by, fold]], w.ravel(), b)

    models = written(map_rows(held.join(total, by).select(*by, fold, "s", "all"), one, types + "w array<double>, b array<double>"), "permuted-models")
    met = rows.join(models, [*by, fold])
    fields = [*_key_fields(rows, by), T.StructField("labels", T.ArrayType(T.IntegerType())), T.StructField("scores", T.ArrayType(T.DoubleType()))]

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[[*by, "labels"]].copy()
            out["scores"] = [np.asarray(w).reshape(-1, p) @ np.asarray(v) + np.asarray(b) for v, w, b in zip(pdf[x], pdf["w"], pdf["b"])]
            yield out

    scored = met.mapInPandas(scores, T.StructType(fields))
    long = scored.select(*by, F.posexplode(F.arrays_zip("labels", "scores")).alias("perm", "z"))
    long = long.select(*by, "perm", F.col("z.labels").alias("y"), F.round("z.scores", digits).alias("score")).where(~F.isnan("score"))
    return auc(long, [*by, "perm"], "y", "score").select(*by, "perm", F.col("auc").alias("v"))
