"""Order-dependent operators on sampled series, as windows over blocks with a halo."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .blocks import DEFAULT_WIDTH, framed, map_blocks
from .ordered import Run, ordered_scan


def zeros_like(x: Column) -> Column:
    return F.transform(x, lambda _: F.lit(0.0))


def causal_lags(df: DataFrame, by: Sequence[str], x: str, n: int, t: str = "t", width: int = DEFAULT_WIDTH) -> DataFrame:
    """Lags 0..n-1 of the vector ``x``, zero before the start, lag outer and channel inner."""
    lags = {
        f"_l{k}": (lambda w, k=k: F.coalesce(F.lag(x, k).over(w), zeros_like(F.col(x)))) for k in range(n)
    }
    out = framed(df, by, lags, t, before=n - 1, width=width)
    return out.withColumn("lagged", F.flatten(F.array(*[F.col(f"_l{k}") for k in range(n)]))).drop(*lags)


def signed_lags(
    df: DataFrame, by: Sequence[str], x: str, lags: Sequence[int], t: str = "t", width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Lags of either sign; the first and last ``max|lag|`` rows of a trial are zero for every lag."""
    reach = max(abs(k) for k in lags)
    length = df.groupBy(*by).agg((F.max(t) + 1).alias("_len"))
    base = df.join(length, list(by))
    inner = (F.col(t) >= reach) & (F.col(t) < F.col("_len") - reach)

    def column(k):
        return lambda w: F.lag(x, k).over(w) if k >= 0 else F.lead(x, -k).over(w)

    cols = {f"_l{i}": column(k) for i, k in enumerate(lags)}
    out = framed(base, by, cols, t, before=reach, after=reach, width=width)
    parts = [F.when(inner, F.col(c)).otherwise(zeros_like(F.col(x))) for c in cols]
    return out.withColumn("lagged", F.flatten(F.array(*parts))).drop("_len", *cols)


def shifted(df: DataFrame, by: Sequence[str], value: str, d: int, t: str = "t", out: str = "shifted") -> DataFrame:
    """Global shift by ``d`` samples with zeros on the vacated side."""
    moved = df.select(*by, (F.col(t) + d).alias(t), F.col(value).alias("_m"))
    return df.join(moved, [*by, t], "left").withColumn(out, F.coalesce("_m", F.lit(0.0))).drop("_m")


def moving_average(w, value: str, n: int) -> Column:
    return F.avg(value).over(w.rowsBetween(-(n - 1), 0)) if n > 1 else F.col(value)


def smoother_widths(bands: int, lo: int, hi: int) -> list[int]:
    """Distinct rounded log-spaced window lengths."""
    step = math.log(hi / lo) / (bands - 1)
    return sorted({round(lo * math.exp(step * i)) for i in range(bands)})


def smoother_bank(
    df: DataFrame, by: Sequence[str], value: str, widths: Sequence[int], t: str = "t", width: int = DEFAULT_WIDTH
) -> DataFrame:
    """One causal moving average per window length (``s_<n>``); early rows average what exists."""
    cols = {f"s_{n}": (lambda w, n=n: moving_average(w, value, n)) for n in widths}
    return framed(df, by, cols, t, before=max(widths) - 1, width=width)


def frame_change(df: DataFrame, by: Sequence[str], x: str, t: str = "t", width: int = DEFAULT_WIDTH) -> DataFrame:
    """Mean level and mean absolute change of a frame vector; the first change is 0."""
    out = framed(df, by, {"_prev": lambda w: F.lag(x, 1).over(w)}, t, before=1, width=width)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    change = total(F.zip_with(x, "_prev", lambda a, b: F.abs(a - b))) / F.size(x)
    return out.withColumn("level", total(F.col(x)) / F.size(x)).withColumn(
        "change", F.coalesce(change, F.lit(0.0))
    ).drop("_prev")


def counter_impulses(df: DataFrame, by: Sequence[str], order: Sequence[str], counter: str) -> DataFrame:
    """1 at rows where a running counter exceeds everything before it."""
    seen = ordered_scan(df, by, order, [Run("_top", "max", F.col(counter), strict=True)])
    rise = F.col(counter) > F.coalesce(F.col("_top"), F.lit(0))
    return seen.withColumn("impulse", F.when(rise, 1.0).otherwise(0.0)).drop("_top")


def true_runs(df: DataFrame, by: Sequence[str], t: str, mask: Column, mass: Column) -> DataFrame:
    """Maximal runs of consecutive true samples: start, end (exclusive) and summed ``mass``.

    A run starts where the previous sample is absent or false; the run number of a row is the
    count of starts so far, carried across blocks.
    """
    on = df.where(mask)
    prev = on.select(*by, (F.col(t) + 1).alias(t), F.lit(1).alias("_p"))
    marked = on.join(prev, [*by, t], "left").withColumn("_s", F.when(F.col("_p").isNull(), 1).otherwise(0))
    numbered = ordered_scan(marked, by, [t], [Run("_run", "sum", F.col("_s"))])
    return numbered.groupBy(*by, "_run").agg(
        F.min(t).alias("start"), (F.max(t) + 1).alias("end"), F.sum(mass).alias("mass")
    ).drop("_run")


def largest_mass(runs: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Largest run mass per group, 0 where a group has no run (negative masses never win)."""
    best = runs.groupBy(*by).agg(F.max("mass").alias("_m"))
    return groups.join(best, list(by), "left").withColumn("max_mass", F.coalesce("_m", F.lit(0.0))).drop("_m")


def full_windows(df: DataFrame, by: Sequence[str], t: str, size: int, length: DataFrame) -> DataFrame:
    """Non-overlapping windows; an incomplete tail is dropped unless it is the only window."""
    placed = df.join(length, list(by)).withColumn("win", F.floor(F.col(t) / size))
    whole = (F.col("win") + 1) * size <= F.col("_len")
    return placed.where(whole | ((F.col("win") == 0) & (F.col("_len") < size))).drop("_len")


def sliding_windows(df: DataFrame, by: Sequence[str], t: str, size: int, step: int, length: DataFrame) -> DataFrame:
    """Overlapping windows ``[k*step, k*step + size)`` that lie inside the series."""
    first = F.greatest(F.lit(0), F.floor((F.col(t) - size) / step) + 1)
    last = F.least(F.floor(F.col(t) / step), F.floor((F.col("_len") - size) / step))
    placed = df.join(length, list(by)).withColumn("_a", first).withColumn("_b", last).where("_a <= _b")
    return placed.withColumn("win", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b", "_len")


def equal_windows(t: Column, length: Column, n: int) -> Column:
    """Window number for ``n`` windows whose edges are ``int(k * length / n)``."""
    return F.floor(((t + 1) * n - 1) / length)


def spread_starts(length: Column, size: int, n: int) -> Column:
    """Distinct rounded starts of ``n`` windows spanning the series; one start when it is short."""
    last = length - size
    starts = F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(last * i / F.lit(max(n - 1, 1))).cast("bigint")
    ))
    return F.when(length <= size, F.array(F.lit(0).cast("bigint"))).otherwise(starts)


def spread_windows(df: DataFrame, by: Sequence[str], t: str, size: int, n: int, length: DataFrame) -> DataFrame:
    """Rows of each of the ``n`` spread windows (``start`` is the window's first sample)."""
    placed = df.join(length, list(by)).withColumn("start", F.explode(spread_starts(F.col("_len"), size, n)))
    return placed.where((F.col(t) >= F.col("start")) & (F.col(t) < F.col("start") + size)).drop("_len")


def lengths(df: DataFrame, by: Sequence[str], t: str = "t") -> DataFrame:
    return df.groupBy(*by).agg((F.max(t) + 1).alias("_len"))


def zscored(df: DataFrame, by: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """Z-score within a group by population std; a zero std counts as 1."""
    stat = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = (F.col(value) - F.col("_m")) / F.coalesce(F.nullif(F.col("_s"), F.lit(0.0)), F.lit(1.0))
    return df.join(stat, list(by)).withColumn(out, z).drop("_m", "_s")


def average_reference(x: Column) -> Column:
    """Subtract the across-channel mean from a sample vector.

    The mean is an argument of ``zip_with`` and not part of its lambda, so it is computed
    once per row and not once per channel.
    """
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    return F.zip_with(x, F.array_repeat(mean, F.size(x)), lambda v, m: v - m)


def with_flat_reference(x: Column, order: Sequence[int]) -> Column:
    """Append a flat channel, average-reference, and put the listed channels in that order."""
    full = average_reference(F.concat(x, F.array(F.lit(0.0))))
    place = {ch: i for i, ch in enumerate(order)}
    slots = F.array(*[F.lit(place.get(ch, -1)) for ch in range(max(order) + 2)])
    keyed = F.sort_array(F.zip_with(slots, full, lambda p, v: F.struct(p.alias("p"), v.alias("v"))))
    return F.transform(F.filter(keyed, lambda r: r.p >= 0), lambda r: r.v)


def upsampled(df: DataFrame, by: Sequence[str], t: str, value: str, factor: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """``factor`` times as many samples, on straight lines between neighbours; nothing follows the last sample."""
    near = framed(df.select(*by, t, value), by, {"_next": lambda w: F.lead(value).over(w), "_at": lambda w: F.lead(t).over(w)}, t, after=1, width=width)
    steps = F.when(F.col("_at") == F.col(t) + 1, F.sequence(F.lit(0), F.lit(factor - 1))).otherwise(F.array(F.lit(0)))
    rows = near.withColumn("_k", F.explode(steps))
    line = F.when(F.col("_k") == 0, F.col(value)).otherwise(F.col(value) + (F.col("_next") - F.col(value)) * F.col("_k") / factor)
    return rows.select(*by, (F.col(t) * factor + F.col("_k")).alias(t), line.alias(value))


def after_onset(df: DataFrame, segments: DataFrame, key: str, skip: int, t: str = "t") -> DataFrame:
    """The samples of each segment ``(key, start, end, ...)`` without its first ``skip``, with time counted from there.

    Segments are few per series, so samples are met by an equi-join on the series and filtered by the range.
    """
    inside = df.join(segments, key).where((F.col(t) >= F.col("start") + skip) & (F.col(t) < F.col("end")))
    return inside.withColumn(t, F.col(t) - F.col("start") - skip).drop("start", "end")


def interpolated(df: DataFrame, by: Sequence[str], t: str, value: str, min_valid: int = 8) -> DataFrame:
    """Linear interpolation across missing values, ends held flat.

    Series with fewer than ``min_valid`` values come back as null.
    """
    here = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    s = ordered_scan(df, by, [t], [Run("_a", "last", here), Run("_b", "next", here)])
    span = F.col("_b.t") - F.col("_a.t")
    inner = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(t) - F.col("_a.t")) / span
    v = F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v"))
    v = v.when(span == 0, F.col("_a.v")).otherwise(inner)
    valid = df.groupBy(*by).agg(F.count(F.when(here.isNotNull(), 1)).alias("_k"))
    filled = s.withColumn("filled", v).drop("_a", "_b").join(valid, list(by))
    return filled.withColumn("filled", F.when(F.col("_k") >= min_valid, F.col("filled"))).drop("_k")


def first_peak(df: DataFrame, by: Sequence[str], place: str, value: Column) -> DataFrame:
    """Place of the largest value, the first place on a tie."""
    return df.groupBy(*by).agg(
        F.max_by(place, F.struct(value, -F.col(place))).alias("peak"), F.max(value).alias("peak_value")
    )


def sign_fixed(df: DataFrame, by: Sequence[str], ident: str, weight: str) -> DataFrame:
    """Flip each vector so that its largest absolute weight is positive."""
    lead = df.groupBy(*by).agg(
        F.max_by(F.signum(weight), F.struct(F.abs(weight), -F.col(ident))).alias("_sgn")
    )
    return df.join(lead, list(by)).withColumn(weight, F.col(weight) * F.col("_sgn")).drop("_sgn")


def sign_agreed(df: DataFrame, full: DataFrame, by: Sequence[str], ident: str, weight: str) -> DataFrame:
    """Flip each vector of ``df`` whose correlation with the full-data vector is negative."""
    f = full.select(ident, F.col(weight).alias("_full"))
    joined = df.join(f, ident)
    side = joined.groupBy(*by).agg(F.corr(weight, "_full").alias("_r"))
    return joined.join(side, list(by)).withColumn(
        weight, F.when(F.col("_r") < 0, -F.col(weight)).otherwise(F.col(weight))
    ).drop("_full", "_r")


def edge_ramp(t: Column, length: Column, rate: float, ms: float = 5.0) -> Column:
    """Linear gain rising from 0 to 1 over the first ``ms`` and falling back at the end."""
    n = F.least(F.floor(length / 2), F.lit(int(rate * ms / 1000)))
    up, down = t / (n - 1), (length - 1 - t) / (n - 1)
    return F.when(n < 2, F.when((n == 1) & ((t == 0) | (t == length - 1)), 0.0).otherwise(1.0)).otherwise(
        F.least(F.lit(1.0), up, down)
    )


def peak_normalised(df: DataFrame, by: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Scale each clip so its largest absolute value is ``level``; silent clips stay as they are."""
    top = df.groupBy(*by).agg(F.max(F.abs(value)).alias("_p"))
    scaled = F.when(F.col("_p") > 0, F.col(value) / F.col("_p") * level).otherwise(F.col(value))
    return df.join(top, list(by)).withColumn("norm", scaled).drop("_p")


def concatenated(
    items: DataFrame, by: Sequence[str], pos: str, duration: str, gap: float
) -> DataFrame:
    """Start offset of each item when items follow one another with a silent gap."""
    s = ordered_scan(items, by, [pos], [Run("_off", "sum", F.col(duration) + F.lit(gap), strict=True)])
    return s.withColumnRenamed("_off", "offset")


def greedy_fill(items: DataFrame, group: str, pos: str, duration: str, target: float, clips: int) -> DataFrame:
    """Fill one clip per group until its running length reaches ``target``.

    Items after the completing one are dropped, groups that never reach the target are
    dropped, and the first ``clips`` groups in order of completion are kept.
    """
    run = ordered_scan(items, [group], [pos], [Run("_cum", "sum", F.col(duration))])
    done = run.where(F.col("_cum") >= target).groupBy(group).agg(F.min(pos).alias("_done"))
    first = done.orderBy("_done", group).limit(clips)
    place = F.row_number().over(Window.orderBy("_done", group))  # at most ``clips`` rows
    ranked = first.withColumn("clip", place)
    return run.join(ranked, group).where(F.col(pos) <= F.col("_done")).drop("_cum", "_done")


def sliding_correlations(
    df: DataFrame, trial: str, x: str, y: str, size: int, step: int, width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """``(trial, win, x)``: correlation of each column of ``x`` with the first of ``y`` in overlapping windows.

    Window ``win`` covers ``t`` from ``win * step`` to ``win * step + size - 1``; only whole windows count.
    Moments are summed up once along a block with its halo, and a window is the difference of two rows
    of that running sum, however many windows a sample is in.  A column without variance scores 0.
    """
    kind = df.schema[trial]
    schema = T.StructType([kind, T.StructField("win", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = pdf["t"].to_numpy()
        v, s = np.stack(pdf[x].to_list()), np.stack(pdf[y].to_list())[:, :1]
        # sums of squares lose digits far from zero: both sides are first moved by the block's mean
        v, s = v - v.mean(0), s - s.mean(0)
        run = np.cumsum(np.hstack([v, v * v, v * s, s, s * s]), axis=0)
        run = np.vstack([np.zeros((1, run.shape[1])), run])
        core = pdf["core"].to_numpy(dtype=bool)
        ends = np.flatnonzero(core & ((ts + 1 - size) % step == 0) & (ts + 1 >= size))
        first = ends - size + 1
        whole = (first >= 0) & (ts[np.maximum(first, 0)] == ts[ends] + 1 - size)
        ends, first = ends[whole], first[whole]
        if not len(ends):
            return pd.DataFrame([], columns=schema.names)
        p = v.shape[1]
        m = (run[ends + 1] - run[first]) / size
        a, aa, ab, b, bb = m[:, :p], m[:, p : 2 * p], m[:, 2 * p : 3 * p], m[:, 3 * p : 3 * p + 1], m[:, 3 * p + 1 :]
        spread = np.sqrt(np.maximum(aa - a * a, 0) * np.maximum(bb - b * b, 0))
        r = np.where(spread > 1e-15, (ab - a * b) / np.maximum(spread, 1e-300), 0.0)
        return pd.DataFrame({trial: [pdf[trial].iloc[0]] * len(ends), "win": (ts[ends] + 1 - size) // step, "x": list(r)}, columns=schema.names)

    return map_blocks(df.select(trial, "t", x, y), [trial], task, schema, "t", before=size - 1, after=0, width=width)
