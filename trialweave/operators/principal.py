"""Principal components of the training part of every fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import linalg as la
from ..session import written
from .stats import map_rows, moved_by, pilot_mean, sum_vectors, trial_stats

#: Numbers that the bases of all folds may have together when they go to every task.
MAX_NUMBERS = 1 << 22


def fold_bases(rows: DataFrame, fold: str, x: str, k: int) -> DataFrame:
    """``(model_fold, m, sd, basis)``: mean, std and the ``k`` leading directions of the standardised rows outside a fold.

    One Gram matrix per fold; a training part is the total minus the fold.  The basis is stored by
    component, each with its largest weight positive.
    """
    pilot = pilot_mean(rows, x)
    packed = moved_by(rows.select(fold, x), x, pilot).withColumn("_one", F.array(F.lit(1.0)))
    held = written(trial_stats(packed, [fold], x, "_one"), "fold-grams")
    total = sum_vectors(held, [], "s").withColumnRenamed("s", "_all")

    def one(row):
        s = np.asarray(row["_all"]) - np.asarray(row["s"])
        p = len(row["pilot"])
        if s[0] < 0.5:
            return
        _, m, _, cov, _, _ = la.covariances(s, p, 1)
        sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
        sd = np.where(sd < 1e-12, 1.0, sd)
        _, v = la.spectrum(cov / np.outer(sd, sd))
        v = v[:, : min(k, p)]
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
        yield (int(row[fold]), m + np.asarray(row["pilot"]), sd, v.T.ravel())

    joined = held.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(pilot))
    return map_rows(joined.select(fold, "s", "_all", "pilot"), one, "model_fold int, m array<double>, sd array<double>, basis array<double>")


def fold_components(rows: DataFrame, fold: str, k_folds: int, x: str, k: int) -> DataFrame:
    """Rows projected on the bases of all folds: ``model_fold``, ``part`` (``test`` where the row's fold is left out, else ``train``).

    A row is read once and leaves with ``k`` numbers per fold.
    """
    bases = written(fold_bases(rows, fold, x, k), "fold-bases")
    if (bases.agg(F.sum(F.size("basis"))).first()[0] or 0) > MAX_NUMBERS:
        raise ValueError("the bases of all folds are too large to go to every task: use fewer folds or components")
    held = {r["model_fold"]: (np.asarray(r["m"]), np.asarray(r["sd"]), np.asarray(r["basis"])) for r in bases.collect()}
    others = [f for f in rows.schema.fields if f.name not in (x, fold)]
    schema = T.StructType([*others, T.StructField("model_fold", T.IntegerType()), T.StructField("part", T.StringType()), T.StructField(x, T.ArrayType(T.DoubleType()))])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v, folds = np.stack(pdf[x].to_list()), pdf[fold].to_numpy()
            for f, (m, sd, basis) in held.items():
                out = pdf[[c.name for c in others]].copy()
                out["model_fold"] = f
                out["part"] = np.where(folds == f, "test", "train")
                out[x] = list(((v - m) / sd) @ basis.reshape(-1, len(m)).T)
                yield out

    return rows.mapInPandas(task, schema)
