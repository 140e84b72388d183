"""Lagged statistics in Toeplitz form: one product matrix per lag instead of one per pair of lags.

With zeros outside a trial, the sum over all times of ``x[t-i] x[t-j]'`` depends on ``j - i`` alone.  The
views of a model end with the trial, so the rows that would hang over its end are taken off again; they
depend on the last few samples only.  A fold's statistics are therefore ``L`` products of the channels
plus one small correction, whatever the number of samples, and models with fewer lags read the same table.
Tasks add up all blocks they hold before anything is emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.linalg import gram, projected_correlation
from ..session import written
from .blocks import DEFAULT_WIDTH, with_halo
from .models import Spec, weights
from .stats import FLUSH_BYTES, _final_sum, _framed, _key_fields, _Sums, _view, _whole, as_basis, map_rows, sum_vectors


def sum_over_blocks(
    rows: DataFrame, keys: Sequence[str], sum_by: Sequence[str], add: Callable[[pd.DataFrame, _Sums], None],
    fields: Sequence[T.StructField], before: int, after: int, t: str = "t", width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """``(sum_by..., s)``: vectors that ``add`` makes of each block + halo, summed in the task across blocks.

    Blocks of ``keys`` are dealt over the tasks; a task holds one block and its sums.
    """
    names = [f.name for f in fields]
    keys = list(keys)
    dealt = with_halo(rows, t, before, after, width).repartition(*keys, "blk").sortWithinPartitions(*keys, "blk", t)
    schema = T.StructType([*fields, T.StructField("piece", T.IntegerType()), T.StructField("a", T.ArrayType(T.DoubleType()))])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc, held = _Sums(names), []

        def close() -> None:
            block = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
            if block["core"].any():
                add(block, acc)

        for pdf in batches:
            if not len(pdf):
                continue
            mark = pdf[[*keys, "blk"]]
            cuts = [0, *(np.flatnonzero((mark != mark.shift()).any(axis=1).to_numpy())[1:]), len(pdf)]
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                part = pdf.iloc[a:b]
                if held and (i or (held[-1][[*keys, "blk"]].iloc[-1] != part[[*keys, "blk"]].iloc[0]).any()):
                    close()
                    held = []
                held.append(part)
                if acc.bytes > FLUSH_BYTES:
                    yield from acc.frames()
        if held:
            close()
        yield from acc.frames()

    return _whole(_final_sum(dealt.mapInPandas(task, schema), names), names)


def lagged_sums(
    df: DataFrame, keys: Sequence[str], sum_by: Sequence[str], x: str, y: str, x_basis, y_basis, edge: str = "causal",
    width: int = DEFAULT_WIDTH, shifts: Sequence[int] | None = None,
) -> DataFrame:
    """``(sum_by..., [shift], s)``: statistics of basis views as ``lagged_stats`` has them, without a row per trial."""
    xb, yb = as_basis(x_basis), as_basis(y_basis)
    moves = [0] if shifts is None else [int(d) for d in shifts]
    spans = [xb.span(), *[yb.span(d) for d in moves]]
    fields = [*_key_fields(df, sum_by), *([] if shifts is None else [T.StructField("shift", T.IntegerType())])]

    def add(block: pd.DataFrame, acc: _Sums) -> None:
        key = tuple(block.iloc[0][list(sum_by)])
        xv = _view(block, x, "t", xb, edge)
        for d in moves:
            acc.add(key if shifts is None else (*key, d), gram(xv, _view(block, y, "t", yb, edge, d)))

    return sum_over_blocks(
        _framed(df, list(keys), "t", edge), keys, sum_by, add, fields,
        max(s[0] for s in spans), max(s[1] for s in spans), width=width,
    )


def _dense(pdf: pd.DataFrame, col: str) -> tuple[np.ndarray, np.ndarray]:
    ts = pdf["t"].to_numpy()
    values = np.stack(pdf[col].to_list())
    out = np.zeros((ts[-1] - ts[0] + 1, values.shape[1]))
    out[ts - ts[0]] = values
    return out, ts - ts[0]


def lag_products(
    df: DataFrame, trial: str, sum_by: Sequence[str], x_lags: int, y_lags: int, width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """``(sum_by..., s)``: Toeplitz statistics of ``x`` and ``y`` for lags 0 to ``x_lags - 1`` and ``y_lags - 1``.

    ``df`` has ``sum_by``, ``trial``, ``t`` and the arrays ``x`` and ``y``; ``assemble`` makes the usual
    statistics vector of it.  ``s`` is linear in the trials: folds are differences as ever.
    """
    reach = max(x_lags, y_lags) - 1
    fields = _key_fields(df, sum_by)
    sum_by = list(sum_by)

    def products(block: pd.DataFrame, acc: _Sums) -> None:
        key = tuple(block.iloc[0][sum_by])
        (mx, base), (my, _) = _dense(block, "x"), _dense(block, "y")
        core = base[block["core"].to_numpy(dtype=bool)]

        def moved(m: np.ndarray, d: int) -> np.ndarray:
            out, at = np.zeros((len(core), m.shape[1])), core - d
            out[at >= 0] = m[at[at >= 0]]
            return out

        x0, y0 = mx[core], my[core]
        parts = [[float(len(core))], x0.sum(0), y0.sum(0)]
        parts += [(x0.T @ moved(mx, d)).ravel() for d in range(x_lags)]
        parts += [(y0.T @ moved(my, d)).ravel() for d in range(y_lags)]
        parts += [(moved(mx, -d).T @ y0 if d < 0 else x0.T @ moved(my, d)).ravel() for d in range(1 - x_lags, y_lags)]
        acc.add(key, np.concatenate(parts))

    whole = sum_over_blocks(df.select(*sum_by, trial, "t", "x", "y"), [trial], sum_by, products, fields, reach, 0, width=width)
    if not reach:
        return whole
    # at most ``reach`` samples of a trial: its last ones
    last = df.groupBy(trial).agg(F.max("t").alias("_last"))
    tail = df.join(last, trial).where(F.col("t") > F.col("_last") - reach)
    tails = tail.groupBy(*sum_by, trial).agg(F.first("_last").alias("last"), F.sort_array(F.collect_list(F.struct("t", "x", "y"))).alias("rows"))
    schema = T.StructType([*fields, T.StructField("piece", T.IntegerType()), T.StructField("a", T.ArrayType(T.DoubleType()))])

    def overhang(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = _Sums(sum_by)
        for pdf in batches:
            for row in pdf.to_dict("records"):
                at = np.array([reach - 1 - (row["last"] - r["t"]) for r in row["rows"]])
                views = []
                for col, lags in (("x", x_lags), ("y", y_lags)):
                    values = np.stack([r[col] for r in row["rows"]])
                    end = np.zeros((reach, values.shape[1]))
                    end[at] = values
                    view = np.zeros((reach, lags * values.shape[1]))
                    for lag in range(1, lags):  # row r lies r + 1 samples past the end
                        n = min(lag, reach)
                        view[:n, lag * values.shape[1] : (lag + 1) * values.shape[1]] = end[reach - lag : reach - lag + n] if lag <= reach else 0
                    views.append(view)
                acc.add(tuple(row[c] for c in sum_by), gram(*views))
                if acc.bytes > FLUSH_BYTES:
                    yield from acc.frames()
        yield from acc.frames()

    hung = _whole(_final_sum(tails.mapInPandas(overhang, schema), sum_by), sum_by).withColumnRenamed("s", "_e")
    joined = whole.join(hung, sum_by) if sum_by else whole.crossJoin(F.broadcast(hung))
    return joined.select(*sum_by, F.concat("s", "_e").alias("s"))


def assemble(s: np.ndarray, p: int, q: int, x_lags: int, y_lags: int, use_x: int, use_y: int) -> np.ndarray:
    """The statistics vector of ``use_x`` and ``use_y`` lags from products of ``x_lags`` and ``y_lags``."""
    sizes = [1, p, q, x_lags * p * p, y_lags * q * q, (x_lags + y_lags - 1) * p * q]
    n, sx, sy, xx, yy, xy, edge = np.split(np.asarray(s, dtype="float64"), np.cumsum(sizes))
    xx, yy, xy = xx.reshape(x_lags, p, p), yy.reshape(y_lags, q, q), xy.reshape(-1, p, q)
    bx, by = x_lags * p, y_lags * q
    if edge.size:
        _, ex, ey, exx, eyy, exy = np.split(edge, np.cumsum([1, bx, by, bx * bx, by * by]))
        exx, eyy, exy = exx.reshape(bx, bx), eyy.reshape(by, by), exy.reshape(bx, by)
    else:
        ex, ey, exx, eyy, exy = np.zeros(bx), np.zeros(by), np.zeros((bx, bx)), np.zeros((by, by)), np.zeros((bx, by))
    a, b = use_x * p, use_y * q
    same = lambda m, n, size: np.block([[m[j - i] if j >= i else m[i - j].T for j in range(n)] for i in range(n)])
    cross = np.block([[xy[j - i + x_lags - 1] for j in range(use_y)] for i in range(use_x)])
    return np.concatenate([
        n, np.tile(sx, use_x) - ex[:a], np.tile(sy, use_y) - ey[:b], (same(xx, use_x, p) - exx[:a, :a]).ravel(),
        (same(yy, use_y, q) - eyy[:b, :b]).ravel(), (cross - exy[:a, :b]).ravel(),
    ])


def fold_scores(
    table: DataFrame, channels: int, features: int, specs: dict[str, Spec], by: Sequence[str] = (),
    lags: tuple[int, int] | None = None, positive: bool = False,
) -> DataFrame:
    """``(by..., fold, model, comp, r)``: every model fitted without a fold and scored on it, from fold sums alone.

    ``table`` is ``(by..., fold, s)``; with ``lags`` it holds ``lag_products`` of that many lags, of which each
    model takes its own.  ``positive`` reads pairs of weights as positive on the first feature.
    """
    by = list(by)
    held = written(table, "fold-sums")
    total = sum_vectors(held, by, "s").withColumnRenamed("s", "_all")
    joined = held.join(total, by) if by else held.crossJoin(F.broadcast(total))
    types = "".join(f"{c} {held.schema[c].dataType.simpleString()}, " for c in [*by, "fold"])

    def one(row):
        own = np.asarray(row["s"])
        train = np.asarray(row["_all"]) - own
        for name, spec in specs.items():
            nx, ny = spec.x_basis().size, spec.y_basis().size
            part = (lambda s: assemble(s, channels, features, *lags, nx, ny)) if lags else (lambda s: s)
            ax, ay, _ = weights(part(train), channels, features, spec)
            if positive:
                flip = np.where(ay[0] < 0, -1.0, 1.0)
                ax, ay = ax * flip, ay * flip
            r = projected_correlation(part(own), channels * nx, features * ny, ax, ay)
            for comp, value in enumerate(r):
                yield (*[row[c] for c in [*by, "fold"]], name, comp, float(value))

    return map_rows(joined.select(*by, "fold", "s", "_all"), one, types + "model string, comp int, r double")
