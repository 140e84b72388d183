"""Selection without a leak: cells chosen on folds inside every training part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.models import Spec, grid_models
from ..operators.nested import nested_selection, partners_outside
from ..operators.stats import mismatch_stats, train_stats
from ..session import written
from .adapters import md5_sql
from .model_plans import BLOCK, FOLDS, P, _fold_stats, _folds, _views
from .registry import query
from .roi_plans import GRID, SPEC, J, _positive, _roi, _stats, solve_sql

NULLS = 3


def _selected(spark, sf, spec: Spec, stats, views, grid, p: int, q: int, top: int) -> DataFrame:
    sig, stim, _ = views
    trials = written(_folds(spark, sf).withColumn("stim", F.col("trial")), "trials")
    partners = written(partners_outside(trials, FOLDS, NULLS), "partners")
    cross = mismatch_stats(sig, stim, partners.select("i", "j").distinct(), spec.x_basis(), spec.y_basis(), width=BLOCK)
    out = nested_selection(stats, written(cross, "cross"), partners, grid, train_stats(stats, "fold"), FOLDS, p, q, top)
    return out.select("outer", "cell", "keep", "shrink", F.round("cv", 6).alias("cv"), "selected", F.round("tracking", 6).alias("tracking"))


@query("nested_tracking", "M10 J13 K4 O6")
def nested_tracking(spark: SparkSession, sf: str) -> DataFrame:
    """Kept directions and shrinkage of the 64-channel model, chosen anew inside every training part."""
    spec = Spec("cca", x_lags=2, y_lags=2, k=2, rcond=1e-6)
    st, p, q = _fold_stats(spark, sf, spec)
    grid = lambda table, keys: grid_models(table, keys, P, 1, spec, [10, 20, 40], [0.05, 0.3])
    return _selected(spark, sf, spec, st, _views(spark, sf), grid, p, q, 2)


FP = "kp AS (SELECT a.fold AS lo, b.fold AS hi FROM k a JOIN k b ON a.fold < b.fold)"
CELLS = f"gr AS (SELECT * FROM (VALUES {', '.join(f'({i}, {g}::DOUBLE)' for i, g in enumerate(GRID))}) v(cell, shrink))"


@query(
    "roi_nested_tracking", "M10 M9 J10 A17",
    f"""{J}, {FP}, {CELLS}, wi AS ({solve_sql('kp.lo, kp.hi, gr.cell', 'kp JOIN j ON j.fold <> kp.lo AND j.fold <> kp.hi CROSS JOIN gr', 'any_value(gr.shrink)')}),
    own AS (SELECT DISTINCT trial, fold FROM j), tk AS (SELECT trial AS i, own.fold, k.fold AS "outer", least(k.fold, own.fold) AS lo, greatest(k.fold, own.fold) AS hi FROM own JOIN k ON k.fold <> own.fold),
    ri AS (SELECT lo, hi, trial AS j, row_number() OVER (PARTITION BY lo, hi ORDER BY {md5_sql('nested', 'lo', 'hi', 'trial')}, trial) - 1 AS pos, count(*) OVER (PARTITION BY lo, hi) AS n FROM own JOIN kp ON own.fold <> lo AND own.fold <> hi),
    nn AS (SELECT DISTINCT lo, hi, n FROM ri),
    pr AS (SELECT tk.i, tk."outer", tk.lo, tk.hi, ri.j FROM tk JOIN nn USING (lo, hi) CROSS JOIN range({NULLS}) r(kk)
      JOIN ri ON ri.lo = tk.lo AND ri.hi = tk.hi AND ri.pos = (CAST('0x' || substr({md5_sql('nested-start', 'tk.i', 'tk."outer"')}, 1, 8) AS BIGINT) + kk) % nn.n WHERE kk < nn.n),
    m AS (SELECT cell, tk.i, tk."outer", corr(wa * a + wb * b, s) AS r FROM tk JOIN j ON j.trial = tk.i JOIN wi ON wi.lo = tk.lo AND wi.hi = tk.hi GROUP BY ALL),
    x AS (SELECT cell, pr.i, pr."outer", pr.j, corr(wa * a + wb * b, z.s) AS r FROM pr JOIN j ON j.trial = pr.i JOIN wi ON wi.lo = pr.lo AND wi.hi = pr.hi JOIN stim z ON z.trial = pr.j AND z.t = j.t GROUP BY ALL),
    c AS (SELECT m."outer", m.cell, avg(m.r - n.r) AS cv FROM m JOIN (SELECT cell, i, "outer", avg(r) AS r FROM x GROUP BY ALL) n ON n.cell = m.cell AND n.i = m.i AND n."outer" = m."outer" GROUP BY ALL),
    c2 AS (SELECT *, row_number() OVER (PARTITION BY "outer" ORDER BY round(cv, 9) DESC, cell) = 1 AS selected FROM c),
    wo AS ({solve_sql('k.fold, gr.cell', 'k JOIN j ON j.fold <> k.fold CROSS JOIN gr', 'any_value(gr.shrink)')}),
    sw AS (SELECT wo.* FROM wo JOIN c2 ON c2."outer" = wo.fold AND c2.cell = wo.cell AND c2.selected),
    hm AS (SELECT j.trial, j.fold, corr(wa * a + wb * b, s) AS r FROM j JOIN sw ON sw.fold = j.fold GROUP BY ALL),
    hx AS (SELECT p.i AS trial, avg(r) AS n FROM (SELECT d.i, d.j, corr(wa * a + wb * b, z.s) AS r FROM (SELECT DISTINCT i, j FROM pr) d JOIN j ON j.trial = d.i JOIN sw ON sw.fold = j.fold JOIN stim z ON z.trial = d.j AND z.t = j.t GROUP BY ALL) p GROUP BY p.i),
    hd AS (SELECT fold, avg(r - n) AS held FROM hm JOIN hx USING (trial) GROUP BY fold)
    SELECT "outer", c2.cell, 2 AS keep, shrink, round(cv, 6) AS cv, selected, CASE WHEN selected THEN round(held, 6) END AS tracking FROM c2 JOIN gr ON gr.cell = c2.cell LEFT JOIN hd ON hd.fold = "outer" """,
)
def roi_nested_tracking(spark: SparkSession, sf: str) -> DataFrame:
    """The same selection on two regional means."""
    grid = lambda table, keys: _positive(grid_models(table, keys, 2, 1, SPEC, [2], GRID))
    return _selected(spark, sf, SPEC, _stats(spark, sf), _roi(spark, sf), grid, 2, 1, 1)
