"""Folds, permutations, bootstraps, mismatched partners and design tables in md5 order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.hashing import gauss, hex_int, md5_key, unit
from ..session import written
from .ordered import Run, exact_quantiles, ntile_of, ordered_scan, positions, shuffled_positions
from .series import largest_mass, true_runs


def kfold(ids: DataFrame, key: str, k: int, seed: str = "fold") -> DataFrame:
    """``fold`` 0..k-1 over shuffled ids, longer folds first."""
    return shuffled_positions(ids, [], [key], seed).withColumn("fold", ntile_of(F.col("pos"), F.col("n"), k)).drop("pos", "n")


def stratified_kfold(ids: DataFrame, key: str, label: str, k: int, seed: str = "fold") -> DataFrame:
    """Folds dealt out in turn within each label."""
    placed = shuffled_positions(ids, [label], [key], seed)
    return placed.withColumn("fold", (F.col("pos") % k).cast("int")).drop("pos", "n")


def grouped_folds(rows: DataFrame, group: str, k: int, seed: str = "fold") -> DataFrame:
    """Rows of one group share the fold of the group."""
    return rows.join(kfold(rows.select(group).distinct(), group, k, seed), group)


def permuted_labels(rows: DataFrame, key: str, label: str, n_perm: int, seed: str = "perm") -> DataFrame:
    """Rows of every permutation with a shuffled 0/1 label ``y``; ``perm = 0`` is the data.

    The first n1 places of the shuffled order get label 1, which draws a uniform relabelling
    without joining labels back.
    """
    drop = [] if label == "y" else [label]
    ones = rows.agg(F.sum(label).alias("_n1"))
    many = rows.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
    placed = shuffled_positions(many, ["perm"], [key], seed).crossJoin(F.broadcast(ones))
    shuffled = placed.withColumn("y", F.when(F.col("pos") < F.col("_n1"), 1).otherwise(0)).drop("pos", "n", "_n1", *drop)
    data = rows.withColumn("perm", F.lit(0)).withColumn("y", F.col(label).cast("int")).drop(*drop)
    return data.unionByName(shuffled)


def permutation_p(stats: DataFrame, by: Sequence[str], stat: str, add_one: bool = True) -> DataFrame:
    """Share of permuted statistics at least as large as the observed one (``perm = 0``).

    ``add_one`` counts the data as one of its own permutations.
    """
    seen = stats.where("perm = 0").select(*by, F.col(stat).alias("observed"))
    null = stats.where("perm > 0")
    joined = null.join(seen, list(by)) if by else null.crossJoin(F.broadcast(seen))
    agg = joined.groupBy(*by).agg(
        F.first("observed").alias("observed"), F.count(F.lit(1)).alias("n_perm"),
        F.count(F.when(F.col(stat) >= F.col("observed"), 1)).alias("n_ge"),
        F.avg(stat).alias("null_mean"), F.stddev_pop(stat).alias("null_sd"),
    )
    p = (F.col("n_ge") + 1) / (F.col("n_perm") + 1) if add_one else F.col("n_ge") / F.col("n_perm")
    return agg.withColumn("p", p)


def mean_difference(rows: DataFrame, by: Sequence[str], y: str, value: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        (F.avg(F.when(F.col(y) == 1, F.col(value))) - F.avg(F.when(F.col(y) == 0, F.col(value)))).alias("stat")
    )


def pairing_permutations(ids: DataFrame, key: str, n_perm: int, seed: str = "pair") -> DataFrame:
    """``(perm, i, j)``: every permutation of the pairing; ``perm = 0`` is the matched one.

    Only the pairs that some permutation uses are listed, never the full square.
    """
    place = positions(ids.select(key).distinct(), [], [key]).select(F.col(key).alias("j"), F.col("pos"))
    many = ids.select(F.col(key).alias("i")).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
    drawn = shuffled_positions(many, ["perm"], ["i"], seed).drop("n").join(place, "pos").select("perm", "i", "j")
    same = ids.select(F.lit(0).alias("perm"), F.col(key).alias("i"), F.col(key).alias("j"))
    return same.unionByName(drawn)


def mismatched_partners(trials: DataFrame, trial: str, stim: str, m: int, seed: str = "mismatch") -> DataFrame:
    """``m`` partners with another stimulus for every trial: ``(i, j)``.

    Stimuli are put in md5 order; a trial takes ``m`` successive places after a start drawn
    for it, counted round the circle and past its own stimulus.  Partners are distinct and
    never share the stimulus, and no pairs beyond these are formed.
    """
    stims = trials.groupBy(stim).agg(F.min(trial).alias("j"))
    ring = shuffled_positions(stims, [], [stim], seed)
    own = trials.join(ring.select(stim, F.col("pos").alias("_own"), F.col("n").alias("_n")), stim)
    own = own.withColumn("_m", F.least(F.lit(m), F.col("_n") - 1)).where("_m > 0")
    start = hex_int(md5_key(seed + "-start", trial)) % (F.col("_n") - 1)
    step = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1))
    wanted = own.select(F.col(trial).alias("i"), "_own", "_n", start.alias("_s"), step.alias("_k"))
    place = (F.col("_own") + 1 + (F.col("_s") + F.col("_k")) % (F.col("_n") - 1)) % F.col("_n")
    return wanted.withColumn("pos", place).join(ring.select("pos", "j"), "pos").select("i", "j")


def cluster_mass(curves: DataFrame, t: str, value: str, level: float = 0.95, chance: float = 0.5) -> DataFrame:
    """Clusters of the observed curve above the pointwise null quantile, with corrected p.

    ``curves`` is ``(perm, t, value)`` with ``perm = 0`` observed.  The null is the largest
    cluster mass of every permutation; p counts the data as one of its permutations.
    """
    thr = exact_quantiles(curves.where("perm > 0"), [t], value, {"thr": level})
    both = curves.join(thr, t)
    runs = true_runs(both, ["perm"], t, F.col(value) > F.col("thr"), F.col(value) - F.lit(chance))
    null = largest_mass(runs, curves.select("perm").distinct().where("perm > 0"), ["perm"])
    seen = runs.where("perm = 0").drop("perm")
    # observed clusters are few (at most one per two samples), the null is counted against each
    joined = null.crossJoin(F.broadcast(seen))
    return joined.groupBy("start", "end", "mass").agg(
        ((F.count(F.when(F.col("max_mass") >= F.col("mass"), 1)) + 1) / (F.count(F.lit(1)) + 1)).alias("p")
    )


#: Draws that one task counts at most, on average.
TASK_DRAWS = 1 << 18


def bootstrap_counts(
    ids: DataFrame, by: Sequence[str], key: str, n_boot: int, seed: str = "boot", carry: dict[str, Column] | None = None,
) -> DataFrame:
    """``(boot, by..., key, mult, carry...)``: how often each id is drawn, with replacement within ``by``.

    Draw ``k`` of bootstrap ``b`` is ``md5(b|by|k) mod n``; the draws of a bootstrap are its own
    rows, so hot groups are spread over tasks.  ``carry`` names aggregates over the rows of an id that
    come with its counts.  Draws are shuffled once, by the place they hit, into as many tasks as their
    number asks for, and nothing is broadcast.
    """
    some = ids.groupBy(*by, key).agg(*[c.alias(n) for n, c in carry.items()]) if carry else ids.select(*by, key).distinct()
    placed = written(positions(some, by, [key]), "places")
    tasks = max(placed.count() * n_boot // TASK_DRAWS, 1)
    draws = placed.select(*by, F.col("pos").alias("_k"), "n").withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    idx = hex_int(md5_key(seed, "boot", *by, "_k")) % F.col("n")
    hits = draws.select("boot", *by, idx.alias("pos")).repartition(tasks, *by, "pos")
    counts = hits.groupBy("boot", *by, "pos").agg(F.count(F.lit(1)).alias("mult"))
    return counts.join(placed.drop("n").hint("shuffle_hash"), [*by, "pos"]).select("boot", *by, key, "mult", *(carry or {}))


def balanced_plan(items: DataFrame, key: str, n: int, seed: str = "plan") -> DataFrame:
    """``(pos, key)``: the whole library shuffled again and again, cut at ``n`` trials."""
    size = items.agg(F.count(F.lit(1)).alias("_n"))
    reps = items.crossJoin(F.broadcast(size)).withColumn(
        "rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.lit(n - 1) / F.col("_n"))))
    )
    placed = shuffled_positions(reps, ["rep"], [key], seed)
    return placed.withColumn("pos", F.col("rep") * F.col("_n") + F.col("pos")).where(F.col("pos") < n).select("pos", key)


def two_level_plan(trials: DataFrame, key: str, first: str, second: str, seed: str = "focus") -> DataFrame:
    """Half of the trials get ``first`` (rounded down), the rest ``second``, shuffled."""
    placed = shuffled_positions(trials, [], [key], seed)
    half = F.floor(F.col("n") / 2)
    return placed.withColumn("focus", F.when(F.col("pos") < half, F.lit(first)).otherwise(F.lit(second))).drop("pos", "n")


def jittered(base: float, std: float, limit: float, digest: Column) -> Column:
    """Base duration plus clamped Gaussian jitter, never negative."""
    jitter = F.greatest(F.lit(-limit), F.least(F.lit(limit), gauss(digest) * std))
    return F.greatest(F.lit(0.0), F.lit(base) + jitter)


def frame_count(seconds: Column, rate: float) -> Column:
    return F.greatest(F.lit(1), F.rint(seconds * rate).cast("int"))


def offset_in_ranges(trials: DataFrame, by: Sequence[str], ranges: DataFrame, lo: str, hi: str, digest: Column) -> DataFrame:
    """A length-weighted uniform draw over the union of each key's ranges.

    The drawn place is looked up on the running length; where all ranges are points the draw
    picks one of them.
    """
    by = list(by)
    placed = ordered_scan(
        ranges.withColumn("_w", (F.col(hi) - F.col(lo)).cast("double")), by, [lo, hi],
        [Run("_cum", "sum", F.col("_w")), Run("_i", "count", F.lit(1))],
    )
    tot = ranges.groupBy(*by).agg(F.sum((F.col(hi) - F.col(lo)).cast("double")).alias("_all"), F.count(F.lit(1)).alias("_m"))
    lengths = F.col("_all") > 0
    # both sides lie on one axis (running length, or the number of a point); a draw belongs to the last
    # range that starts at or before it, which one ordered scan of the union finds
    starts = placed.join(tot, by).select(
        *by, F.when(lengths, F.col("_cum") - F.col("_w")).otherwise(F.col("_i") - 1.0).alias("_place"), F.lit(0).alias("_side"),
        F.col("_i").cast("bigint").alias("_i"), F.col(lo).cast("double").alias("_lo"), F.lit(None).cast(_as_struct(trials)).alias("_t"),
    )
    drawn = trials.withColumn("_u", unit(digest)).join(tot, by).select(
        *by, F.when(lengths, F.col("_u") * F.col("_all")).otherwise(F.floor(F.col("_u") * F.col("_m")).cast("double")).alias("_place"),
        F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_i"), F.lit(None).cast("double").alias("_lo"),
        F.struct(*trials.columns, F.when(lengths, 1.0).otherwise(0.0).alias("_slope")).alias("_t"),
    )
    start = F.struct(F.col("_place").alias("at"), F.col("_lo").alias("lo"))
    found = ordered_scan(
        starts.unionByName(drawn), by, ["_place", "_side", "_i"], [Run("_r", "last", F.when(F.col("_side") == 0, start))]
    ).where("_side = 1 and _r is not null")
    offset = F.col("_r.lo") + (F.col("_place") - F.col("_r.at")) * F.col("_t._slope")
    return found.select(*[F.col("_t")[c].alias(c) for c in trials.columns], offset.alias("offset"))


def _as_struct(trials: DataFrame) -> T.StructType:
    return T.StructType([*trials.schema.fields, T.StructField("_slope", T.DoubleType())])
