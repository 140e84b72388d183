"""Nested selection: model cells chosen inside the training part of every outer fold.

The inner folds of an outer fold are the other folds.  An inner model is therefore fitted on
everything but two folds, and its statistics are the total minus two fold sums; the model that
leaves out folds a and b serves outer fold a with inner fold b and the other way round.  Trials
are read once, whatever the number of folds and cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import hex_int, md5_key
from ..session import written
from .models import score
from .ordered import shuffled_positions
from .stats import sum_vectors

OUTSIDE = ["lo", "hi"]


def two_fold_train_stats(stats: DataFrame, fold: str = "fold") -> DataFrame:
    """Training statistics ``(lo, hi, s)`` without folds ``lo < hi``, from per-trial statistics ``s``."""
    held = written(sum_vectors(stats, [fold], "s"), "held-out")  # one row per fold
    total = sum_vectors(held, [], "s").withColumnRenamed("s", "_all")
    low = held.select(F.col(fold).cast("int").alias("lo"), F.col("s").alias("_a"))
    high = held.select(F.col(fold).cast("int").alias("hi"), F.col("s").alias("_b"))
    pairs = low.join(F.broadcast(high), F.col("lo") < F.col("hi")).crossJoin(F.broadcast(total))
    rest = F.zip_with(F.zip_with("_all", "_a", lambda t, a: t - a), "_b", lambda t, b: t - b)
    return pairs.select("lo", "hi", rest.alias("s"))


def outer_tasks(trials: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """A row for each trial and outer fold that it is not in: ``outer`` and the two folds its model leaves out."""
    own = F.col(fold).cast("int")
    many = trials.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("outer") != own)
    return many.withColumn("lo", F.least("outer", own)).withColumn("hi", F.greatest("outer", own))


def partners_outside(trials: DataFrame, k: int, m: int, seed: str = "nested") -> DataFrame:
    """``(i, outer, lo, hi, j)``: up to ``m`` trials with another stimulus from the inner training part.

    ``trials`` is ``(trial, stim, fold)``.  The stimuli outside each two folds stand on a ring in
    md5 order; a trial takes successive places after a start drawn for it and the outer fold.
    """
    twice = trials.withColumn("lo", F.explode(F.sequence(F.lit(0), F.lit(k - 2))))
    twice = twice.withColumn("hi", F.explode(F.sequence(F.col("lo") + 1, F.lit(k - 1))))
    twice = twice.where((F.col("fold") != F.col("lo")) & (F.col("fold") != F.col("hi")))
    stims = twice.groupBy(*OUTSIDE, "stim").agg(F.min("trial").alias("j"))
    ring = written(shuffled_positions(stims, OUTSIDE, ["stim"], seed), "rings")
    sizes = ring.groupBy(*OUTSIDE).agg(F.max("n").alias("_n"))
    wanted = outer_tasks(trials.withColumnRenamed("stim", "_stim"), k).join(F.broadcast(sizes), OUTSIDE)
    start = hex_int(md5_key(seed + "-start", "trial", "outer")) % F.col("_n")
    # one place more than asked for, as the own stimulus may be among them
    steps = F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(m + 1).cast("bigint"), F.col("_n")) - 1)
    wanted = wanted.select(
        F.col("trial").alias("i"), "outer", "lo", "hi", "_stim", "_n", start.alias("_s"), F.posexplode(steps).alias("_k", "_step")
    ).withColumn("pos", (F.col("_s") + F.col("_step")) % F.col("_n"))
    met = wanted.join(ring.select(*OUTSIDE, "pos", "stim", "j"), [*OUTSIDE, "pos"]).where(F.col("stim") != F.col("_stim"))
    drawn = met.groupBy("i", "outer", *OUTSIDE).agg(F.slice(F.sort_array(F.collect_list(F.struct("_k", "j"))), 1, m).alias("_d"))
    return drawn.select("i", "outer", *OUTSIDE, F.explode("_d").alias("d")).select("i", "outer", *OUTSIDE, F.col("d.j").alias("j"))


def nested_selection(
    stats: DataFrame, cross: DataFrame, partners: DataFrame, grid: Callable[[DataFrame, Sequence[str]], DataFrame],
    train: DataFrame, k: int, p: int, q: int, top: int,
) -> DataFrame:
    """Chosen cell and held-out tracking of every outer fold.

    ``stats`` are trial statistics with ``fold``, ``cross`` those of a trial with each of its
    ``partners`` ``(i, j, s)``, ``train`` the outer training statistics ``(fold, s)``; ``grid`` fits all
    cells of a statistics table.  Tracking is the matched score minus the mean score against the
    partners; a cell's ``cv`` is its mean over the trials outside the outer fold, under models that
    saw neither the trial's fold nor the outer one.  Result: ``(outer, cell, keep, shrink, cv,
    selected, tracking)``, the held-out ``tracking`` for the selected cell only.
    """
    inner = written(grid(two_fold_train_stats(stats), OUTSIDE), "inner-models")
    outer = written(grid(train, ["fold"]), "outer-models")
    cells = inner.select("model", "cell", "keep", "shrink").distinct()

    def mean_of_top(scores: DataFrame, keys: list[str]) -> DataFrame:
        return scores.where(F.col("comp") < top).groupBy("model", *keys).agg(F.avg("r").alias("r"))

    tasks = outer_tasks(stats.select("trial", "fold", "s"), k)
    matched = mean_of_top(score(inner, tasks, OUTSIDE, ["trial", "outer"], p, q), ["trial", "outer"])
    tied = partners.join(cross, ["i", "j"])
    null = mean_of_top(score(inner, tied, OUTSIDE, ["i", "outer", "j"], p, q), ["i", "outer", "j"])
    null = null.groupBy("model", F.col("i").alias("trial"), "outer").agg(F.avg("r").alias("n"))
    cv = matched.join(null, ["model", "trial", "outer"]).groupBy("outer", "model").agg(F.avg(F.col("r") - F.col("n")).alias("cv"))
    cv = written(cv.join(F.broadcast(cells), "model"), "inner-scores")
    best = cv.groupBy("outer").agg(F.max_by("cell", F.struct(F.round("cv", 9), -F.col("cell"))).alias("best"))
    cv = cv.join(F.broadcast(best), "outer").withColumn("selected", F.col("cell") == F.col("best")).drop("best")

    chosen = outer.withColumn("outer", F.col("fold").cast("int")).join(
        F.broadcast(cv.where("selected").select("outer", "cell")), ["outer", "cell"]
    ).drop("outer")
    own = mean_of_top(score(chosen, stats.select("trial", "fold", "s"), ["fold"], ["trial"], p, q), ["fold", "trial"])
    pairs = partners.select("i", "j").distinct().join(cross, ["i", "j"]).join(stats.select(F.col("trial").alias("i"), "fold"), "i")
    against = mean_of_top(score(chosen, pairs, ["fold"], ["i", "j"], p, q), ["fold", "i", "j"])
    against = against.groupBy("fold", F.col("i").alias("trial")).agg(F.avg("r").alias("n"))
    held = own.join(against, ["fold", "trial"]).groupBy(F.col("fold").cast("int").alias("outer")).agg(F.avg(F.col("r") - F.col("n")).alias("held"))
    return cv.join(F.broadcast(held), "outer", "left").select(
        "outer", "cell", "keep", "shrink", "cv", "selected", F.when(F.col("selected"), F.col("held")).alias("tracking")
    )
