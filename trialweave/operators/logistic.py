"""Penalised logistic regression of all folds at once, by Newton steps on summed gradients.

One scan of the rows serves every model of a step: a task adds up, for each model key and fold left out,
the loss, the gradient and the upper triangle of the Hessian.  Steps are solved in tasks; only weights
(a few numbers per feature and model) travel to the driver and back, checked against ``MAX_NUMBERS``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import written
from .stats import _Sums, _final_sum, _key_fields, _whole, map_rows, moved_by, pilot_mean, sum_vectors

MAX_NUMBERS = 1 << 24


def _train_moments(rows: DataFrame, by: Sequence[str], fold: str, x: str) -> DataFrame:
    """``(by..., model_fold, m, sd)``: mean and population std of the rows outside each fold; a zero std counts as 1."""
    by = list(by)
    pilot = pilot_mean(rows, x)
    packed = moved_by(rows.select(*by, fold, x), x, pilot).withColumn("_v", F.concat(F.array(F.lit(1.0)), F.col(x), F.transform(x, lambda v: v * v)))
    held = written(sum_vectors(packed, [*by, fold], "_v"), "fold-moments")
    total = sum_vectors(held, by, "s").withColumnRenamed("s", "_all")
    both = held.join(total, by) if by else held.crossJoin(F.broadcast(total))
    s = both.select(*by, F.col(fold).cast("int").alias("model_fold"), F.zip_with("_all", "s", lambda a, b: a - b).alias("s"))
    n, p = F.col("s")[0], F.expr("cast((size(s) - 1) div 2 as int)")
    mean = F.transform(F.slice("s", 2, p), lambda v: v / n)
    var = F.zip_with(F.transform(F.slice("s", p + 2, p), lambda v: v / n), mean, lambda q, m: F.greatest(q - m * m, F.lit(0.0)))
    sd = F.transform(var, lambda v: F.when(v < 1e-24, 1.0).otherwise(F.sqrt(v)))
    near = s.where(n > 0.5).select(*by, "model_fold", mean.alias("m"), sd.alias("sd"))
    return near.crossJoin(F.broadcast(pilot)).withColumn("m", F.zip_with("m", "pilot", lambda a, b: a + b)).drop("pilot")


def _keys_of(pdf: pd.DataFrame, by: Sequence[str]):
    return pdf.groupby(list(by), sort=False) if by else [((), pdf)]


def _tuple(key) -> tuple:
    return key if isinstance(key, tuple) else (key,)


def fit_logistic_folds(
    rows: DataFrame, by: Sequence[str], fold: str, y: str, x: str, penalty: float = 1.0,
    tol: float = 1e-8, max_steps: int = 50, halving: bool = True, leave: Sequence[int] | None = None,
) -> dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Models ``(by..., fold left out) -> (mean, std, weights with the intercept first)``.

    Minimises the summed log loss plus ``penalty / 2`` times the squared weights (not the
    intercept) on columns standardised by the training rows.  Starts at zero and ends when no
    weight of any model moves by ``tol``; a step that raises the loss is halved.  ``rows`` are read
    once per step and should be written beforehand; they are never copied per fold.  ``leave`` names
    the folds that a model is wanted without, by default every one.
    """
    by = list(by)
    moments = _train_moments(rows, by, fold, x)
    if leave is not None:
        moments = moments.where(F.col("model_fold").isin(list(leave)))
    base = {
        (*[r[c] for c in by], r["model_fold"]): (np.asarray(r["m"]), np.asarray(r["sd"]))
        for r in _checked(moments).collect()
    }
    weights = {key: np.zeros(len(m) + 1) for key, (m, _) in base.items()}
    names = [*by, "model_fold"]
    fields = [*_key_fields(rows, by), T.StructField("model_fold", T.IntegerType())]
    schema = T.StructType([*fields, T.StructField("piece", T.IntegerType()), T.StructField("a", T.ArrayType(T.DoubleType()))])
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    at: dict[tuple, np.ndarray] = dict(weights)
    step: dict[tuple, np.ndarray] = {}
    loss: dict[tuple, float] = {}
    open_models = set(weights)
    for _ in range(max_steps):
        if not open_models:
            break
        now = {k: (*base[k], at[k]) for k in open_models}

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = _Sums(names)
            for pdf in batches:
                for key, part in _keys_of(pdf, by):
                    values, folds = np.stack(part[x].to_list()), part[fold].to_numpy()
                    labels = part[y].to_numpy(dtype=float)
                    for model, (m, sd, w) in now.items():
                        used = folds != model[-1]
                        if model[:-1] != _tuple(key) or not used.any():
                            continue
                        z = np.hstack([np.ones((used.sum(), 1)), (values[used] - m) / sd])
                        f = z @ w
                        p = 1 / (1 + np.exp(-f))
                        error = p - labels[used]
                        lost = np.logaddexp(0, f).sum() - (f * labels[used]).sum()
                        upper = ((z * (p * (1 - p))[:, None]).T @ z)[np.triu_indices(z.shape[1])]
                        acc.add(model, np.concatenate([[lost], z.T @ error, upper]))
                        if acc.bytes > 96 << 20:
                            yield from acc.frames()
            yield from acc.frames()

        def solve(row):
            key = tuple(row[c] for c in names)
            w = now[key][2]
            s, p1 = np.asarray(row["s"]), len(w)
            ridge = np.full(p1, penalty)
            ridge[0] = 0.0
            hessian = np.zeros((p1, p1))
            hessian[np.triu_indices(p1)] = s[1 + p1 :]
            hessian = hessian + np.triu(hessian, 1).T + np.diag(ridge)
            move = np.linalg.lstsq(hessian, -(s[1 : 1 + p1] + ridge * w), rcond=None)[0]
            yield (*key, float(s[0] + 0.5 * (ridge * w * w).sum()), move)

        part = rows.select(*by, fold, y, x).mapInPandas(sums, schema)
        summed = _whole(_final_sum(part, names), names)
        for r in map_rows(summed, solve, types + ", loss double, move array<double>").collect():
            key = tuple(r[c] for c in names)
            if halving and key in loss and r["loss"] > loss[key] + 1e-10 * abs(loss[key]):
                step[key] = step[key] / 2
            else:
                weights[key], step[key], loss[key] = at[key], np.asarray(r["move"]), r["loss"]
            at[key] = weights[key] + step[key]
            if np.abs(step[key]).max() < tol:
                weights[key] = at[key]
                open_models.discard(key)
    for key in open_models:
        weights[key] = at[key]
    return {k: (*base[k], weights[k]) for k in weights}


def _checked(moments: DataFrame) -> DataFrame:
    kept = written(moments, "logistic-moments")
    numbers = kept.agg(F.sum(F.size("m"))).first()[0] or 0
    if 3 * numbers > MAX_NUMBERS:
        raise ValueError(f"{3 * numbers} weights and moments pass {MAX_NUMBERS}: fit fewer models at a time")
    return kept


def logistic_scores(rows: DataFrame, models: dict, by: Sequence[str], fold: str, x: str, out: str = "score") -> DataFrame:
    """Out-of-fold decision value (log odds) of each row; null where no model left its fold out."""
    by = list(by)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for key, part in _keys_of(pdf, [*by, fold]):
                part = part.copy()
                model = models.get(_tuple(key))
                if model is None:
                    part[out] = None
                else:
                    m, sd, w = model
                    part[out] = w[0] + ((np.stack(part[x].to_list()) - m) / sd) @ w[1:]
                parts.append(part)
            if parts:
                yield pd.concat(parts)

    return rows.mapInPandas(task, schema)


def logistic_cross_validated(rows: DataFrame, by: Sequence[str], fold: str, y: str, x: str, penalty: float = 1.0, **options) -> DataFrame:
    """Rows with their out-of-fold log odds ``score``."""
    rows = written(rows, "logistic-rows")
    return logistic_scores(rows, fit_logistic_folds(rows, by, fold, y, x, penalty, **options), by, fold, x)
