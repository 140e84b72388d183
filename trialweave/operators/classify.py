"""Discriminants and covariance classifiers as a few distributed aggregates per model.

Model keys (fold, time, permutation, feature set) are ordinary columns, so many models are
fitted by the same passes.  Training rows are summed per task before they are shuffled; a
model only ever sees statistics.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import linalg as la
from ..session import bounded_batches, written
from .stats import map_rows, moved_by, pilot_mean, sum_vectors, trial_stats


def train_rows(rows: DataFrame, fold: str, k: int) -> DataFrame:
    """Copies of the rows for the k - 1 folds they train (``model_fold``)."""
    many = rows.withColumn("model_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return many.where(F.col("model_fold") != F.col(fold)).drop(fold)


def test_rows(rows: DataFrame, fold: str) -> DataFrame:
    return rows.withColumn("model_fold", F.col(fold).cast("int")).drop(fold)


def _moments(rows: DataFrame, by: Sequence[str], x: str, pilot: DataFrame | None = None) -> DataFrame:
    """Count, mean and population std vectors per key, summed about ``pilot``; a zero std counts as 1."""
    if pilot is not None:
        rows = moved_by(rows, x, pilot)
    packed = rows.withColumn("_v", F.concat(F.array(F.lit(1.0)), F.col(x), F.transform(x, lambda v: v * v)))
    s = sum_vectors(packed, by, "_v")
    n = F.col("s")[0]
    p = F.expr("cast((size(s) - 1) div 2 as int)")
    count = F.array_repeat(n, p)
    mean = F.zip_with(F.slice("s", 2, p), count, lambda a, m: a / m)
    square = F.zip_with(F.slice("s", p + 2, p), count, lambda a, m: a / m)
    std = F.zip_with(square, mean, lambda a, m: F.sqrt(F.greatest(a - m * m, F.lit(0.0))))
    out = s.select(*by, n.alias("n"), mean.alias("m"), std.alias("sd"))
    if pilot is not None:
        out = out.crossJoin(F.broadcast(pilot)).withColumn("m", F.zip_with("m", "pilot", lambda a, b: a + b)).drop("pilot")
    return out.withColumn("sd", F.transform("sd", lambda v: F.when(v < 1e-12, 1.0).otherwise(v)))


def standardised(x: str, m: str, sd: str, clip: float | None = 8.0) -> Column:
    z = F.zip_with(F.zip_with(x, m, lambda a, b: a - b), sd, lambda a, b: a / b)
    if clip is None:
        return z
    return F.transform(z, lambda v: F.greatest(F.lit(-clip), F.least(F.lit(clip), F.nanvl(v, F.lit(0.0)))))


def _two_class_weights(parts: list[tuple], shrink: str | float) -> tuple[np.ndarray, float]:
    """Weights and bias from count, mean, std, products and fourth moment of class 0 and class 1."""
    p, total = len(parts[0][1]), sum(c[0] for c in parts)
    cov = np.zeros((p, p))
    for n, _, scale, products, fourth in parts:
        emp = products / n
        mu = np.trace(emp) / p
        if shrink == "auto":
            delta = ((emp - mu * np.eye(p)) ** 2).sum() / p
            beta = min(max((fourth / n - (emp**2).sum()) / (n * p), 0.0), delta)
            g = 0.0 if delta == 0 else beta / delta
        else:
            g = float(shrink)
        cov += n / total * ((1 - g) * emp + g * mu * np.eye(p)) * np.outer(scale, scale)
    (n0, m0, *_), (n1, m1, *_) = parts
    w = np.linalg.lstsq(cov, m1 - m0, rcond=None)[0]
    return w, float(-0.5 * (m0 + m1) @ w + np.log(n1 / n0))


def fit_lda(rows: DataFrame, by: Sequence[str], y: str, x: str, shrink: str | float = "auto") -> DataFrame:
    """Two-class discriminants: ``(by..., m, sd, w, b)``.

    Rows are standardised by their model's mean and std and bounded to [-8, 8].  ``auto``
    shrinks each class covariance by Ledoit-Wolf on its own standardised columns: the fourth
    moment it needs is the sum of squared row norms squared, one more aggregate.
    """
    by = list(by)
    # moments are one row per model: writing them keeps this at three scans of the rows
    base = written(_moments(rows, by, x, pilot_mean(rows, x)), "moments")
    attach = lambda d, e, on: d.join(e, on) if on else d.crossJoin(F.broadcast(e))
    z = attach(rows.select(*by, F.col(y).alias("_y"), x), base.drop("n"), by).select(*by, "_y", standardised(x, "m", "sd").alias("z"))
    cls = _moments(z, [*by, "_y"], "z").select(*by, "_y", F.col("n").alias("cn"), F.col("m").alias("cm"), F.col("sd").alias("csd"))
    cls = written(cls, "class-moments")
    u = z.join(cls.drop("cn"), [*by, "_y"]).select(*by, "_y", standardised("z", "cm", "csd", None).alias("u"))
    u = u.withColumn("q", F.array(F.aggregate("u", F.lit(0.0), lambda a, v: a + v * v)))
    both = trial_stats(u, [*by, "_y"], "u", "q").join(cls, [*by, "_y"])
    pair = both.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_y", "cn", "cm", "csd", "s"))).alias("c"))
    types = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by)

    def one(row):
        if len(row["c"]) < 2:
            return
        parts = []
        for c in row["c"]:
            p, s = len(c["cm"]), np.asarray(c["s"])
            parts.append((c["cn"], np.asarray(c["cm"]), np.asarray(c["csd"]), s[2 + p : 2 + p + p * p].reshape(p, p), s[2 + p + p * p]))
        yield (*[row[c] for c in by], *_two_class_weights(parts, shrink))

    weights = map_rows(pair, one, types + "w array<double>, b double")
    return attach(weights, base.drop("n"), by)


def lda_scores(rows: DataFrame, models: DataFrame, by: Sequence[str], x: str, out: str = "score") -> DataFrame:
    """Decision value of each row under its model (positive means class 1)."""
    joined = rows.join(models, list(by)) if by else rows.crossJoin(F.broadcast(models))
    z = standardised(x, "m", "sd")
    dot = F.aggregate(F.zip_with(z, "w", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return joined.withColumn(out, F.col("b") + dot).drop("m", "sd", "w", "b")


def probability(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-score))


def cross_validated(rows: DataFrame, by: Sequence[str], fold: str, k: int, y: str, x: str, shrink: str | float = "auto") -> DataFrame:
    """Out-of-fold decision values of every row.

    Where ``y`` is an array, it holds the row's label in each permutation: the result is then
    ``(by..., model_fold, perm, y, score)``, a row for each row and permutation.
    """
    keys = [*by, "model_fold"]
    if isinstance(rows.schema[y].dataType, T.ArrayType):
        return _relabelled_scores(rows, keys, fold, k, y, x, shrink)
    models = written(fit_lda(train_rows(rows, fold, k), keys, y, x, shrink), "discriminants")
    return lda_scores(test_rows(rows, fold), models, keys, x)


#: Permutations that a task fits side by side: it holds two p x p sums for each of them.
PERM_BLOCK = 32


class _Relabelled:
    """The discriminants of a block of permutations, from standardised rows that pass by twice."""

    def __init__(self, shrink: str | float):
        self.shrink, self.sums, self.products, self.w = shrink, None, None, None

    def moments(self, z: np.ndarray, labels: np.ndarray) -> None:
        new = []
        for c in (0, 1):
            own = (labels == c).T.astype(float)
            new.append(np.concatenate([own.sum(1)[:, None], own @ z, own @ (z * z)], axis=1))
        self.sums = np.stack(new) if self.sums is None else self.sums + np.stack(new)

    def scatter(self, z: np.ndarray, labels: np.ndarray) -> None:
        p = z.shape[1]
        if self.products is None:
            self.n = self.sums[:, :, 0]
            count = np.maximum(self.n, 1.0)[:, :, None]
            self.m = self.sums[:, :, 1 : 1 + p] / count
            sd = np.sqrt(np.maximum(self.sums[:, :, 1 + p :] / count - self.m * self.m, 0.0))
            self.sd = np.where(sd < 1e-12, 1.0, sd)
            self.products, self.fourth = np.zeros((*self.n.shape, p, p)), np.zeros(self.n.shape)
        for c, i in np.ndindex(*self.n.shape):
            u = (z[labels[:, i] == c] - self.m[c, i]) / self.sd[c, i]
            self.products[c, i] += u.T @ u
            self.fourth[c, i] += ((u * u).sum(1) ** 2).sum()

    def scores(self, z: np.ndarray) -> np.ndarray:
        """A column for each permutation, nan where its rows are of one class."""
        if self.w is None:
            perms = self.n.shape[1]
            self.w, self.b = np.full((perms, z.shape[1]), np.nan), np.full(perms, np.nan)
            for i in np.flatnonzero(self.n.min(0) > 0.5):
                parts = [(self.n[c, i], self.m[c, i], self.sd[c, i], self.products[c, i], self.fourth[c, i]) for c in (0, 1)]
                self.w[i], self.b[i] = _two_class_weights(parts, self.shrink)
        return z @ self.w.T + self.b


def _relabelled_scores(rows: DataFrame, keys: Sequence[str], fold: str, k: int, labels: str, x: str, shrink: str | float) -> DataFrame:
    """``(keys..., perm, y, score)``: ``fit_lda`` and ``lda_scores`` for all permutations of the labels.

    Rows are standardised once for each fold, as that does not depend on labels, and dealt to blocks of
    permutations.  They pass by in a task, sorted: for the class moments, for the products, and the held-out
    ones for their scores.  A task so holds the sums of its block, whatever the number of rows, and only scores leave it.
    """
    keys = list(keys)
    train = train_rows(rows, fold, k)
    base = written(_moments(train, keys, x, pilot_mean(train, x)), "moments")
    blocks = -(-(rows.agg(F.max(F.size(labels))).first()[0] or 0) // PERM_BLOCK)

    def dealt(part: DataFrame, *passes: int) -> DataFrame:
        z = part.join(base.drop("n"), keys).select(*keys, labels, standardised(x, "m", "sd").alias("z"))
        z = z.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in passes])))
        z = z.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0)))))
        return z.withColumn(labels, F.slice(labels, F.col("block") * PERM_BLOCK + 1, F.lit(PERM_BLOCK)))

    order = [*keys, "block", "pass"]
    seen = dealt(train, 0, 1).unionByName(dealt(test_rows(rows, fold), 2))
    tasks = min(max(base.count() * blocks, 1), 4096)
    bounded_batches(rows.sparkSession)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = models = None
        for pdf in batches:
            for new, part in pdf.groupby(order, sort=False):
                z, y = np.stack(part["z"].to_list()), np.stack(part[labels].to_list())
                if new[:-1] != at:
                    at, models = new[:-1], _Relabelled(shrink)
                if new[-1] == 0:
                    models.moments(z, y)
                elif new[-1] == 1:
                    models.scatter(z, y)
                else:
                    score = models.scores(z)
                    row, perm = np.nonzero(~np.isnan(score))
                    out = pd.DataFrame({"perm": perm + at[-1] * PERM_BLOCK, "y": y[row, perm], "score": score[row, perm]})
                    yield out.assign(**dict(zip(keys, at)))[[*keys, "perm", "y", "score"]]

    fields = [seen.schema[c] for c in keys]
    fields += [T.StructField("perm", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("score", T.DoubleType())]
    return seen.repartition(tasks, *keys, "block").sortWithinPartitions(*order).mapInPandas(task, T.StructType(fields))


def leave_one_out_lda(rows: DataFrame, by: Sequence[str], group: str, y: str, x: str, out: str = "score") -> DataFrame:
    """Decision value of each row under the discriminant of all rows outside its ``group``.

    Counts, sums and products are added per group and class; a model is the total minus the
    group's own part, so the cost grows with the rows and not with rows times groups.  A group
    whose rest holds one class only gets no model, and its rows a null.
    """
    keys, asked, pilot = [*by, group], rows, pilot_mean(rows, x)
    rows = moved_by(rows, x, pilot)
    outer = F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b)))
    packed = rows.withColumn("_v", F.concat(F.array(F.lit(1.0)), F.col(x), outer))
    own = written(sum_vectors(packed, [*keys, y], "_v"), "group-sums")
    total = sum_vectors(own, [*by, y], "s").withColumnRenamed("s", "_t")
    every = own.select(*keys).distinct()
    grid = every.join(total, list(by)) if by else every.crossJoin(F.broadcast(total))
    rest = grid.join(own, [*keys, y], "left").withColumn("s", F.when(F.col("s").isNull(), F.col("_t")).otherwise(F.zip_with("_t", "s", lambda a, b: a - b)))
    pair = rest.where(F.col("s")[0] > 0.5).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(y, "s"))).alias("c"))
    types = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keys)

    def one(row):
        sums = [np.asarray(c["s"]) for c in row["c"]]
        if len(sums) < 2:
            return
        p = int((np.sqrt(4 * len(sums[0]) - 3) - 1) / 2 + 0.5)
        n, m = [s[0] for s in sums], [s[1 : 1 + p] / s[0] for s in sums]
        within = sum(s[1 + p :].reshape(p, p) - k * np.outer(c, c) for s, k, c in zip(sums, n, m)) / sum(n)
        w = np.linalg.lstsq(within, m[1] - m[0], rcond=None)[0]
        yield (*[row[c] for c in keys], w, float(-0.5 * (m[0] + m[1]) @ w + np.log(n[1] / n[0])))

    models = map_rows(pair, one, types + "w array<double>, b double")
    moved = F.zip_with(F.zip_with(x, "pilot", lambda a, m: a - m), "w", lambda a, b: a * b)
    dot = F.aggregate(moved, F.lit(0.0), lambda a, v: a + v)
    scored = asked.join(models, keys, "left").crossJoin(F.broadcast(pilot)).withColumn(out, F.col("b") + dot)
    return scored.drop("w", "b", "pilot")


def match_discriminant(rows: DataFrame, fold: str, other_fold: str, k: int, own: str = "own", x: str = "x") -> DataFrame:
    """Out-of-fold decision between a trial's own stimulus (``own`` 1) and others' (0).

    ``rows`` are pairs of a signal and a stimulus with a vector of their correlations.  A pair trains
    a fold's model only if neither its signal (``fold``) nor its stimulus (``other_fold``) is held out.
    """
    train = train_rows(rows, fold, k).where(F.col("model_fold") != F.col(other_fold)).drop(other_fold)
    models = written(fit_lda(train, ["model_fold"], own, x, 0.0), "match-discriminants")
    return lda_scores(test_rows(rows, fold).drop(other_fold), models, ["model_fold"], x)


def class_covariances(stats: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Sum of trial statistics per model and class."""
    return sum_vectors(stats, [*keys, y], "s")


def with_square_norm(rows: DataFrame, x: str = "x", out: str = "q") -> DataFrame:
    """Add the squared norm of each row as a view of one column.

    Statistics of ``(x, out)`` then hold the third and fourth moments that Ledoit-Wolf shrinkage needs.
    """
    return rows.withColumn(out, F.array(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)))


def csp_filters(train: DataFrame, keys: Sequence[str], y: str, p: int, n: int) -> DataFrame:
    """Spatial filters per model from the class sums of trial statistics of ``with_square_norm`` rows.

    Class covariances are shrunk by Ledoit-Wolf, whose amount follows from the summed moments.
    """
    keys = list(keys)
    both = class_covariances(train, keys, y).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(y, "s"))).alias("c"))
    types = "".join(f"{c} {train.schema[c].dataType.simpleString()}, " for c in keys)

    def one(row):
        if len(row["c"]) == 2:
            covs = []
            for c in row["c"]:
                covs.append(la.ledoit_wolf_of_sums(np.asarray(c["s"]), p)[0])
            yield (*[row[c] for c in keys], la.csp(covs[1], covs[0], n).ravel())

    return map_rows(both, one, types + "filters array<double>")


def log_power(stats: DataFrame, filters: DataFrame, keys: Sequence[str], keep: Sequence[str], p: int, q: int) -> DataFrame:
    """Log variance of filtered trials, from their statistics."""
    joined = stats.join(filters, list(keys))
    cols = [*keys, *[c for c in keep if c not in keys]]
    types = "".join(f"{c} {joined.schema[c].dataType.simpleString()}, " for c in cols)

    def one(row):
        w = np.asarray(row["filters"]).reshape(p, -1)
        cov = la.covariances(np.asarray(row["s"]), p, q)[3]
        yield (*[row[c] for c in cols], np.log(np.einsum("ik,ij,jk->k", w, cov, w) + 1e-30))

    return map_rows(joined.select(*cols, "filters", "s"), one, types + "x array<double>")


def tangent_features(stats: DataFrame, train: DataFrame, keys: Sequence[str], keep: Sequence[str], p: int, q: int, rounds: int = 50, tol: float = 1e-6) -> DataFrame:
    """Tangent vectors of shrunk trial covariances at the training mean of their model.

    The mean is found by a fixed point: every round averages matrix logarithms with one
    distributed sum; only one p x p matrix per model travels between rounds.  It ends when the
    mean logarithm of every model is below ``tol`` in norm, or after ``rounds``.
    """
    keys = list(keys)
    types = "".join(f"{c} {train.schema[c].dataType.simpleString()}, " for c in keys)

    def first(row):
        cov = la.covariances(np.asarray(row["s"]), p, q)[3]
        yield (*[row[c] for c in keys], cov.ravel())

    mean = map_rows(sum_vectors(train, keys, "s"), first, types + "mean array<double>")

    def logs(row):
        s = np.asarray(row["s"])
        c = la.oas(la.covariances(s, p, q)[3], s[0])
        inv = la.sym_fn(np.asarray(row["mean"]).reshape(p, p), lambda w: 1 / np.sqrt(w))
        t = la.sym_fn(inv @ c @ inv, np.log)
        yield (*[row[c] for c in keys], np.concatenate([[1.0], t.ravel()]))

    def step(row):
        a = np.asarray(row["s"])
        root, log = la.sym_fn(np.asarray(row["mean"]).reshape(p, p), np.sqrt), a[1:].reshape(p, p) / a[0]
        yield (*[row[c] for c in keys], (root @ la.sym_fn_raw(log, np.exp) @ root).ravel(), float(np.linalg.norm(log)))

    mean = written(mean, "riemann-mean")
    for _ in range(rounds):
        total = sum_vectors(map_rows(train.select(*keys, "s").join(mean, keys), logs, types + "v array<double>"), keys, "v")
        moved = written(map_rows(total.join(mean, keys), step, types + "mean array<double>, moved double"), "riemann-mean")
        mean = moved.drop("moved")
        if (moved.agg(F.max("moved")).first()[0] or 0.0) < tol:
            break
    cols = [*keys, *[c for c in keep if c not in keys]]
    joined = stats.join(mean, keys)
    out_types = "".join(f"{c} {joined.schema[c].dataType.simpleString()}, " for c in cols)

    def vector(row):
        s = np.asarray(row["s"])
        inv = la.sym_fn(np.asarray(row["mean"]).reshape(p, p), lambda w: 1 / np.sqrt(w))
        yield (*[row[c] for c in cols], la.tangent_vector(la.oas(la.covariances(s, p, q)[3], s[0]), inv))

    return map_rows(joined.select(*cols, "mean", "s"), vector, out_types + "x array<double>")
