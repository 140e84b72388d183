"""Sufficient statistics per trial, and everything that is a weighted sum of them.

Statistics travel as flat vectors cut into pieces of ``PIECE`` numbers.  Tasks add vectors
up per partition before anything is shuffled, and the pieces of one vector are summed by
different tasks, so neither a hot trial nor a wide model ends up in one place.  Python sees
batches of bounded bytes and hands out a few MB at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.linalg import gram, variances
from ..session import bounded_batches, written
from .blocks import DEFAULT_WIDTH, map_blocks

PIECE = 2048
FLUSH_BYTES = 64 << 20
HOLD_BYTES = 8 << 20
EMIT_BYTES = 1 << 20


def _key_fields(df: DataFrame, by: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in by]


def _piece_schema(df: DataFrame, by: Sequence[str]) -> T.StructType:
    bounded_batches(df.sparkSession)
    return T.StructType([*_key_fields(df, by), T.StructField("piece", T.IntegerType()), T.StructField("a", T.ArrayType(T.DoubleType()))])


class _Sums:
    """Per-task sums of vectors by key, flushed when they grow past the memory budget."""

    def __init__(self, by: Sequence[str]):
        self.by, self.sums, self.bytes, self.adds = list(by), {}, 0, 0

    @property
    def full(self) -> bool:
        """Past the budget, which is small where many keys came and few of them came again: holding them saves nothing."""
        once = len(self.sums) > 64 and self.adds <= 2 * len(self.sums)
        return self.bytes > (HOLD_BYTES if once else FLUSH_BYTES)

    def add(self, key: tuple, vector: np.ndarray) -> None:
        self.adds += 1
        if key in self.sums:
            self.sums[key] += vector
        else:
            self.sums[key] = np.array(vector, dtype="float64")
            self.bytes += self.sums[key].nbytes

    def frames(self) -> Iterator[pd.DataFrame]:
        """The sums in pieces, a few MB at a time; what is handed out is not held any longer."""
        out, held, names = [], 0, [*self.by, "piece", "a"]
        while self.sums:
            key, v = self.sums.popitem()
            for i in range(0, len(v), PIECE):
                out.append((*key, i // PIECE, v[i : i + PIECE]))
            held += v.nbytes
            if held > EMIT_BYTES:
                yield pd.DataFrame(out, columns=names)
                out, held = [], 0
        self.bytes = self.adds = 0
        yield pd.DataFrame(out, columns=names)

    def rows(self) -> pd.DataFrame:
        return pd.concat(list(self.frames()), ignore_index=True)


def _plain(key: tuple) -> tuple:
    """A key that can be compared: every missing part is None."""
    return tuple(None if k is None or k != k else k for k in key)


def _task_sums(partial: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the pieces that one task holds, so a task emits about one row per key and piece.

    Blocks come sorted by key: the pieces that came in first are handed out once ``HOLD_BYTES`` are held, so a
    worker needs the same memory whatever its number of keys.  The pieces of the row's own key stay.
    """
    names = partial.schema.names

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        out, held, full = [], 0, 0

        for pdf in batches:
            for key, v in zip(zip(*[pdf[c] for c in [*by, "piece"]]), pdf["a"]):
                key = _plain(key)
                if key in sums:
                    sums[key] += v
                    continue
                sums[key] = np.array(v, dtype="float64")
                held += sums[key].nbytes
                while held > HOLD_BYTES and (old := next(iter(sums)))[:-1] != key[:-1]:
                    out.append((*old, sums.pop(old)))
                    held -= out[-1][-1].nbytes
                    full += out[-1][-1].nbytes
                if full > EMIT_BYTES:
                    yield pd.DataFrame(out, columns=names)
                    out, full = [], 0
        while sums:
            old = next(iter(sums))
            out.append((*old, sums.pop(old)))
            full += out[-1][-1].nbytes
            if full > EMIT_BYTES:
                yield pd.DataFrame(out, columns=names)
                out, full = [], 0
        yield pd.DataFrame(out, columns=names)

    return partial.mapInPandas(task, partial.schema)


def _final_sum(partial: DataFrame, by: Sequence[str], blocks: bool = False) -> DataFrame:
    """Add the partial pieces of each vector.

    ``blocks`` marks partial rows made per block, which are first added per task.  A piece then has
    about one row per task.  The pieces are sorted by key inside a task and added as they pass by,
    so a task holds one sum and one batch, whatever the number of keys or of partial rows.
    """
    bounded_batches(partial.sparkSession)
    names = partial.schema.names
    if blocks:
        partial = _task_sums(partial, by)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total, out, held = None, None, [], 0
        for pdf in batches:
            for new, v in zip(zip(*[pdf[c] for c in [*by, "piece"]]), pdf["a"]):
                new = _plain(new)
                if new == key:
                    total += v
                    continue
                if key is not None:
                    out.append((*key, total))
                    held += total.nbytes
                if held > EMIT_BYTES:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
                key, total = new, np.array(v, dtype="float64")
        if key is not None:
            out.append((*key, total))
        yield pd.DataFrame(out, columns=names)

    keys = [*by, "piece"]
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(task, partial.schema)


def _whole(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join the pieces of each vector in order."""
    ordered = F.sort_array(F.collect_list(F.struct("piece", "a")))
    agg = [F.flatten(F.transform(ordered, lambda r: r.a)).alias("s")]
    return pieces.groupBy(*by).agg(*agg) if by else pieces.agg(*agg)


def sum_vectors(df: DataFrame, by: Sequence[str], vector: str, weight: str | None = None) -> DataFrame:
    """Element-wise (weighted) sum of an array column per key: ``(by..., s)``."""
    by = list(by)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = _Sums(by)
        for pdf in batches:
            w = pdf[weight].to_numpy() if weight else np.ones(len(pdf))
            keys = list(zip(*[pdf[c] for c in by])) if by else [()] * len(pdf)
            for key, v, m in zip(keys, pdf[vector], w):
                acc.add(key, np.asarray(v) * m)
                if acc.full:
                    yield from acc.frames()
        yield from acc.frames()

    need = [*by, vector] + ([weight] if weight else [])
    partial = df.select(*need).mapInPandas(task, _piece_schema(df, by))
    return _whole(_final_sum(partial, by), by)


def pilot_mean(df: DataFrame, x: str) -> DataFrame:
    """One row ``pilot``: the mean of an array column, element by element."""
    s = sum_vectors(df.select(F.concat(F.array(F.lit(1.0)), F.col(x)).alias("_v")), [], "_v")
    n, size = F.col("s")[0], F.size("s")
    return written(s.select(F.transform(F.slice("s", F.lit(2), size - 1), lambda v: v / n).alias("pilot")), "pilot")


def moved_by(df: DataFrame, x: str, pilot: DataFrame) -> DataFrame:
    """``df`` with ``x`` less the pilot mean.

    Covariances do not change, but sums of products of the moved values keep the digits that raw sums lose
    where the mean is large; sums of any parts of the rows stay mergeable, as all are moved alike.
    """
    return df.crossJoin(F.broadcast(pilot)).withColumn(x, F.zip_with(x, "pilot", lambda a, b: a - b)).drop("pilot")


def sum_vectors_by_draw(df: DataFrame, vector: str, weights: str) -> DataFrame:
    """``(draw, s)``: for each place of the array ``weights`` the sum of ``vector`` weighted by it.

    A row is read once for all draws; the sums of a task are one matrix product per batch.
    """
    bounded_batches(df.sparkSession)
    schema = T.StructType([T.StructField("draw", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("a", T.ArrayType(T.DoubleType()))])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = _Sums(["draw"])
        for pdf in batches:
            if not len(pdf):
                continue
            sums = np.stack(pdf[weights].to_list()).astype(float).T @ np.stack(pdf[vector].to_list())
            for draw, v in enumerate(sums):
                acc.add((draw,), v)
            if acc.bytes > FLUSH_BYTES:
                yield from acc.frames()
        yield from acc.frames()

    return _whole(_final_sum(df.select(vector, weights).mapInPandas(task, schema), ["draw"]), ["draw"])


def trial_stats(df: DataFrame, by: Sequence[str], x: str, y: str, t: str | None = None) -> DataFrame:
    """Statistics vector ``s`` per key of two array columns, without any lag.

    Where keys are many, ``t`` deals the rows by key and block of ``t``: they meet in one task and leave it as
    one vector a block.  Rows that lie spread would each become a vector of their own, far wider than the row.
    """
    by = list(by)
    rows = df.select(*by, x, y)
    if t:
        rows = df.select(*by, x, y, F.floor(F.col(t) / DEFAULT_WIDTH).alias("_blk")).repartition(*by, "_blk")
        rows = rows.sortWithinPartitions(*by, "_blk").drop("_blk")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = _Sums(by)
        for pdf in batches:
            groups = pdf.groupby(by, sort=False) if by else [((), pdf)]
            for key, part in groups:
                key = key if isinstance(key, tuple) else (key,)
                acc.add(key, gram(np.stack(part[x].to_list()), np.stack(part[y].to_list())))
                if acc.full:
                    yield from acc.frames()
        yield from acc.frames()

    partial = rows.mapInPandas(task, _piece_schema(df, by))
    return _whole(_final_sum(partial, by), by)


def lag_view(m: np.ndarray, rows: np.ndarray, lags: Sequence[int]) -> np.ndarray:
    """Rows of a block with the given lags side by side (lag outer), zero outside the block."""
    n, c = m.shape
    out = np.zeros((len(rows), len(lags) * c))
    for i, lag in enumerate(lags):
        src = rows - lag
        ok = (src >= 0) & (src < n)
        out[ok, i * c : (i + 1) * c] = m[src[ok]]
    return out


class Lags:
    """Lagged copies side by side (lag outer, channel inner)."""

    def __init__(self, lags: Sequence[int]):
        self.lags = [int(k) for k in lags]

    @property
    def size(self) -> int:
        return len(self.lags)

    @property
    def reach(self) -> int:
        return max(abs(k) for k in self.lags)

    def span(self, shift: int = 0) -> tuple[int, int]:
        moved = [k + shift for k in self.lags]
        return max(max(moved), 0), max(-min(moved), 0)

    def view(self, m: np.ndarray, rows: np.ndarray, ts: np.ndarray, shift: int = 0) -> np.ndarray:
        out = lag_view(m, rows, [k + shift for k in self.lags])
        if shift:  # the shifted series starts at 0, so a lag may not reach in front of it
            for i, k in enumerate(self.lags):
                out[ts < k, i * m.shape[1] : (i + 1) * m.shape[1]] = 0.0
        return out


class Smooth:
    """Causal moving averages of several lengths (length outer, channel inner)."""

    def __init__(self, widths: Sequence[int]):
        self.widths = [int(w) for w in widths]

    @property
    def size(self) -> int:
        return len(self.widths)

    @property
    def reach(self) -> int:
        return 0

    def span(self, shift: int = 0) -> tuple[int, int]:
        return max(max(self.widths) - 1 + shift, 0), max(-shift, 0)

    def view(self, m: np.ndarray, rows: np.ndarray, ts: np.ndarray, shift: int = 0) -> np.ndarray:
        if shift:
            m = lag_view(m, np.arange(len(m)), [shift])
        run = np.vstack([np.zeros((1, m.shape[1])), np.cumsum(m, axis=0)])
        parts = []
        for w in self.widths:
            lo = np.maximum(rows - w + 1, 0)
            parts.append((run[rows + 1] - run[lo]) / (rows + 1 - lo)[:, None])
        return np.hstack(parts)


Basis = Lags | Smooth


def as_basis(spec) -> Basis:
    return spec if isinstance(spec, (Lags, Smooth)) else Lags(spec)


def _view(pdf: pd.DataFrame, col: str, t: str, basis: Basis, edge: str, shift: int = 0) -> np.ndarray:
    """Basis view of the core rows of a block."""
    ts = pdf[t].to_numpy()
    core = pdf["core"].to_numpy(dtype=bool)
    base = ts - ts[0]
    v = np.stack(pdf[col].to_list())
    m = np.zeros((base[-1] + 1, v.shape[1]))
    m[base] = v
    out = basis.view(m, base[core], ts[core], shift)
    if edge == "both":
        length = pdf["_len"].to_numpy()[core]
        out[(ts[core] < basis.reach) | (ts[core] >= length - basis.reach)] = 0.0
    return out


def _framed(df: DataFrame, by: Sequence[str], t: str, edge: str) -> DataFrame:
    if edge != "both":
        return df
    return df.join(df.groupBy(*by).agg((F.max(t) + 1).alias("_len")), list(by))


def lagged_stats(
    df: DataFrame, by: Sequence[str], x: str, y: str, x_basis, y_basis, edge: str = "causal",
    t: str = "t", width: int = DEFAULT_WIDTH, shifts: Sequence[int] | None = None,
) -> DataFrame:
    """Statistics of basis views per key from block + halo; the wide view is never stored.

    ``edge='causal'`` puts zeros before the start; ``edge='both'`` also blanks the rows near
    both ends.  With ``shifts`` the stimulus side is first moved by each shift (zeros on the
    vacated side) and ``shift`` joins the key, so all shifts cost one scan.
    """
    by = list(by)
    xb, yb = as_basis(x_basis), as_basis(y_basis)
    moves = [0] if shifts is None else [int(d) for d in shifts]
    spans = [xb.span(), *[yb.span(d) for d in moves]]
    before, after = max(s[0] for s in spans), max(s[1] for s in spans)
    keys = _key_fields(df, by)
    if shifts is not None:
        keys = [*keys, T.StructField("shift", T.IntegerType())]
    names = [f.name for f in keys]
    schema = T.StructType([*keys, T.StructField("piece", T.IntegerType()), T.StructField("a", T.ArrayType(T.DoubleType()))])

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        acc = _Sums(names)
        key = tuple(pdf.iloc[0][by])
        xv = _view(pdf, x, t, xb, edge)
        for d in moves:
            yv = _view(pdf, y, t, yb, edge, d)
            acc.add(key if shifts is None else (*key, d), gram(xv, yv))
        return acc.rows()

    partial = map_blocks(_framed(df, by, t, edge), by, task, schema, t, before, after, width)
    return _whole(_final_sum(partial, names, blocks=True), names)


def mismatch_stats(
    sig: DataFrame, stim: DataFrame, pairs: DataFrame, x_basis, y_basis,
    edge: str = "causal", width: int = DEFAULT_WIDTH, sums: Callable[[np.ndarray, np.ndarray], np.ndarray] = gram,
) -> DataFrame:
    """Statistics of trial ``i``'s signal against trial ``j``'s stimulus for the listed pairs.

    Both sides are cut to the samples that both trials have, so every part of a pair's statistics
    is over the same overlap; a partner may start later or end earlier than the trial.  The
    stimuli of a trial's partners travel to the trial (a few numbers per sample) with their trial
    number, so the wide signal is read once whatever the number of partners.  ``sig`` is
    ``(trial, t, x)``, ``stim`` ``(trial, t, y)``; ``sums`` makes the vector of two views.
    """
    xb, yb = as_basis(x_basis), as_basis(y_basis)
    mate = stim.select(F.col("trial").alias("j"), "t", "y")
    near = pairs.join(mate, "j").groupBy(F.col("i").alias("trial"), "t").agg(
        F.sort_array(F.collect_list(F.struct("j", "y"))).alias("mates")
    )
    last = stim.groupBy(F.col("trial").alias("j")).agg((F.max("t") + 1).alias("m"))
    own_last = sig.groupBy(F.col("trial").alias("i")).agg((F.max("t") + 1).alias("n"))
    ends = pairs.join(last, "j").join(own_last, "i").groupBy(F.col("i").alias("trial")).agg(
        F.sort_array(F.collect_list(F.struct("j", F.least("m", "n").alias("end")))).alias("ends")
    )
    rows = sig.select("trial", "t", "x").join(near, ["trial", "t"]).join(ends, "trial")
    kt = sig.schema["trial"].dataType
    schema = T.StructType([
        T.StructField("i", kt), T.StructField("j", kt), T.StructField("piece", T.IntegerType()),
        T.StructField("a", T.ArrayType(T.DoubleType())),
    ])

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        acc = _Sums(["i", "j"])
        i = pdf.iloc[0]["trial"]
        ends = {e["j"]: e["end"] for e in pdf["ends"].iloc[0]}
        mates = [{m["j"]: m["y"] for m in row} for row in pdf["mates"]]
        for j in sorted(set().union(*mates)):
            held = np.array([j in m for m in mates])
            part = pdf.loc[held, ["trial", "t", "x", "core"]].copy()
            if not part["core"].any():
                continue
            part["_y"] = [np.asarray(m[j]) for m in mates if j in m]
            part["_len"] = ends[j]
            acc.add((i, j), sums(_view(part, "x", "t", xb, edge), _view(part, "_y", "t", yb, edge)))
        return acc.rows()

    before = max(xb.span()[0], yb.span()[0])
    after = max(xb.span()[1], yb.span()[1])
    part = map_blocks(rows, ["trial"], task, schema, "t", before, after, width)
    return _whole(_final_sum(part, ["i", "j"], blocks=True), ["i", "j"])


def correlation_vector(stats: DataFrame, by: Sequence[str], p: int, q: int, out: str = "x") -> DataFrame:
    """Correlation of each signal channel with each stimulus channel, from pooled ``moments`` ``s``."""
    types = "".join(f"{c} {stats.schema[c].dataType.simpleString()}, " for c in by)

    def one(row):
        vx, vy, cxy = variances(np.asarray(row["s"]), p, q)
        scale = np.sqrt(np.maximum(np.outer(vx, vy), 1e-300))
        yield (*[row[c] for c in by], (cxy / scale).ravel())

    return map_rows(stats.select(*by, "s"), one, types + f"{out} array<double>")


def total_stats(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sum_vectors(stats, by, "s")


def train_stats(stats: DataFrame, fold: str, by: Sequence[str] = ()) -> DataFrame:
    """Training statistics of every fold as total minus held-out: ``(by..., fold, s)``.

    ``by`` separates independent analyses (for example features or shifts).
    """
    by = list(by)
    held = written(sum_vectors(stats, [*by, fold], "s"), "held-out")  # one row per fold, read twice
    total = sum_vectors(held, by, "s").withColumnRenamed("s", "_all")
    joined = held.join(total, by) if by else held.crossJoin(F.broadcast(total))
    return joined.select(*by, fold, F.zip_with("_all", "s", lambda a, b: a - b).alias("s"))


def map_rows(df: DataFrame, fn: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """Run a small dense computation on each row (a row is one model's statistics)."""
    bounded_batches(df.sparkSession)
    cols = [c.split()[0] for c in schema.split(", ")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [r for row in pdf.to_dict("records") for r in fn(row)]
            yield pd.DataFrame(out, columns=cols)

    return df.mapInPandas(task, schema)
