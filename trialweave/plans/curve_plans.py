"""Lag products, curves over the global shift, impulse responses and component summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.lag_products import assemble, fold_scores, lag_products, lagged_sums
from ..operators.models import Spec, fit, patterns
from ..operators.responses import component_summary, impulse_responses, transfer_function
from ..operators.spectral import band_pass, fir_bank, log_bands
from ..operators.stats import map_rows
from ..session import written
from .adapters import COND, LONG, STIM, trial_condition
from .model_plans import BLOCK, P, _folds, _views
from .registry import query
from .roi_plans import G, J, SHIFTS, _roi, solve_sql

RATE = 64.0


@query(
    "lagged_gram", "M11 A17 W1 G1",
    f"""{J}, l AS (SELECT j.trial, j.t, j.fold, i, coalesce(z.a, 0.0) AS a, coalesce(z.b, 0.0) AS b, coalesce(z.s, 0.0) AS s FROM j CROSS JOIN range(4) r(i) LEFT JOIN j z ON z.trial = j.trial AND z.t = j.t - i),
    v AS (SELECT trial, t, fold, i, unnest([a, b, s]) AS v, unnest(['a', 'b', 's']) AS side FROM l)
    SELECT x.fold, x.side || CAST(x.i AS VARCHAR) AS p, y.side || CAST(y.i AS VARCHAR) AS q, round(sum(x.v * y.v), 6) AS xy FROM v x JOIN v y ON x.trial = y.trial AND x.t = y.t
    WHERE (x.side = 's') <= (y.side = 's') AND (x.side <> 's' OR x.i < 3) AND (y.side <> 's' OR y.i < 3) GROUP BY ALL""",
)
def lagged_gram(spark: SparkSession, sf: str) -> DataFrame:
    """Products of all pairs of lagged columns per fold, put together from one product per lag."""
    import numpy as np

    _, _, both = _roi(spark, sf)
    table = lag_products(both.join(F.broadcast(_folds(spark, sf)), "trial"), "trial", ["fold"], 4, 3, width=BLOCK)

    def one(row):
        s = assemble(np.asarray(row["s"]), 2, 1, 4, 3, 4, 3)
        xx, yy, xy = np.split(s[1 + 8 + 3 :], np.cumsum([64, 9]))
        names, stim = [f"{c}{i}" for i in range(4) for c in "ab"], [f"s{i}" for i in range(3)]
        for m, left, right in ((xx, names, names), (yy, stim, stim), (xy, names, stim)):
            for a, line in zip(left, m.reshape(len(left), -1)):
                for b, value in zip(right, line):
                    yield (row["fold"], a, b, float(value))

    return map_rows(table, one, "fold int, p string, q string, xy double").withColumn("xy", F.round("xy", 6))


@query(
    "roi_presets", "M11 M12 M13",
    f"""{J}, jl AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY trial ORDER BY t), 0.0) AS s1 FROM j),
    fr AS (SELECT fold, 0 AS ch, a AS x, s AS a, s1 AS b FROM jl UNION ALL SELECT fold, 1, b, s, s1 FROM jl),
    wf AS ({solve_sql('k.fold, f.ch', 'k JOIN (SELECT fold, ch, a, b, x AS s FROM fr) f ON f.fold <> k.fold', '0.0::DOUBLE')}),
    wb AS ({solve_sql('k.fold', 'k JOIN j ON j.fold <> k.fold', '0.0::DOUBLE')}), wc AS ({solve_sql('k.fold', 'k JOIN j ON j.fold <> k.fold', str(G) + '::DOUBLE')}),
    rf AS (SELECT fr.fold, fr.ch, corr(wa * a + wb * b, x) AS r FROM fr JOIN wf ON wf.fold = fr.fold AND wf.ch = fr.ch GROUP BY ALL)
    SELECT 'forward' AS model, fold, round(max(r), 6) AS best_in_test FROM rf GROUP BY fold
    UNION ALL SELECT 'backward', j.fold, round(corr(wa * a + wb * b, s), 6) FROM j JOIN wb ON wb.fold = j.fold GROUP BY j.fold
    UNION ALL SELECT 'cca', j.fold, round(corr(wa * a + wb * b, s), 6) FROM j JOIN wc ON wc.fold = j.fold GROUP BY j.fold""",
)
def roi_presets(spark: SparkSession, sf: str) -> DataFrame:
    """Forward, backward and canonical models from one table of lag products, on two regional means."""
    _, _, both = _roi(spark, sf)
    table = written(lag_products(both.join(F.broadcast(_folds(spark, sf)), "trial"), "trial", ["fold"], 3, 4, width=BLOCK), "products")
    sc = fold_scores(table, 2, 1, {"forward": Spec("forward", y_lags=2, rcond=1e-12), "backward": Spec("backward", rcond=1e-12)}, lags=(3, 4))
    # the sign of a canonical pair is free: it is read as positive on the stimulus
    pair = fold_scores(table, 2, 1, {"cca": Spec("cca", k=1, shrink=G, rcond=1e-12)}, lags=(3, 4), positive=True)
    return sc.unionByName(pair).groupBy("model", "fold").agg(F.round(F.max("r"), 6).alias("best_in_test"))


CURVE_SHIFTS = list(range(-4, 9, 4))


@query("cca_curves", "M18 W5 J14")
def cca_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out correlation over the global shift for three canonical models.

    1: channels with lagged stimulus; 2: lagged channels with lagged stimulus; 3: lagged channels with a
    bank of stimulus bands.  One scan of each model's views serves all shifts and folds.
    """
    sig, stim, both = _views(spark, sf)
    folds = F.broadcast(_folds(spark, sf))
    bands = [band_pass(lo, hi, RATE, 8) for lo, hi in log_bands(1.0, 16.0, 5)]
    bank = fir_bank(stim.withColumnRenamed("y", "x"), ["trial"], "x", bands, out="y", width=BLOCK)
    views = {
        "1": (both, 1, Spec("cca", y_lags=4, keep_x=40, k=2, shrink=0.1, rcond=1e-6)),
        "2": (both, 1, Spec("cca", x_lags=3, y_lags=4, keep_x=60, k=2, shrink=0.1, rcond=1e-6)),
        "3": (sig.join(bank, ["trial", "t"]), len(bands), Spec("cca", x_lags=3, keep_x=60, k=2, shrink=0.1, rcond=1e-6)),
    }
    out = None
    for name, (rows, features, spec) in views.items():
        table = lagged_sums(rows.join(folds, "trial"), ["trial"], ["fold"], "x", "y", spec.x_basis(), spec.y_basis(), width=BLOCK, shifts=CURVE_SHIFTS)
        sc = fold_scores(table, P, features, {name: spec}, ["shift"])
        out = sc if out is None else out.unionByName(sc)
    return out.groupBy("model", "shift", "comp").agg(F.round(F.avg("r"), 6).alias("r"))


KERNEL = (0.25, 0.5, 0.25)


@query(
    "roi_cca_curves", "M18 J14",
    f"""{J}, s3 AS (SELECT trial, t, 0.25 * coalesce(lag(s) OVER w, 0.0) + 0.5 * s + 0.25 * coalesce(lead(s) OVER w, 0.0) AS s FROM stim WINDOW w AS (PARTITION BY trial ORDER BY t)),
    al AS (SELECT trial, t, fold, a, b, coalesce(lag(a) OVER (PARTITION BY trial ORDER BY t), 0.0) AS a1 FROM j),
    e AS (SELECT '1' AS model, d AS shift, al.trial, fold, a, b, coalesce(z.s, 0.0) AS s FROM al CROSS JOIN (VALUES {', '.join(f'({d})' for d in SHIFTS)}) v(d) LEFT JOIN stim z ON z.trial = al.trial AND z.t = al.t - d
      UNION ALL SELECT '2', d, al.trial, fold, a, a1, coalesce(z.s, 0.0) FROM al CROSS JOIN (VALUES {', '.join(f'({d})' for d in SHIFTS)}) v(d) LEFT JOIN stim z ON z.trial = al.trial AND z.t = al.t - d
      UNION ALL SELECT '3', d, al.trial, fold, a, a1, coalesce(z.s, 0.0) FROM al CROSS JOIN (VALUES {', '.join(f'({d})' for d in SHIFTS)}) v(d) LEFT JOIN s3 z ON z.trial = al.trial AND z.t = al.t - d),
    w AS ({solve_sql('k.fold, e.model, e.shift', 'k JOIN e ON e.fold <> k.fold', str(G) + '::DOUBLE')}),
    h AS (SELECT e.model, e.shift, e.fold, corr(wa * a + wb * b, s) AS r FROM e JOIN w ON w.fold = e.fold AND w.model = e.model AND w.shift = e.shift GROUP BY ALL)
    SELECT model, shift, 0 AS comp, round(avg(r), 6) AS r FROM h GROUP BY model, shift""",
)
def roi_cca_curves(spark: SparkSession, sf: str) -> DataFrame:
    """The three curves on regional means: two regions; one region and its lag; the same against a smoothed stimulus."""
    import numpy as np

    sig, stim, both = _roi(spark, sf)
    folds = F.broadcast(_folds(spark, sf))
    first = both.select("trial", "t", F.slice("x", 1, 1).alias("x"), "y")
    smooth = fir_bank(stim.withColumnRenamed("y", "x"), ["trial"], "x", [np.array(KERNEL)], out="y", width=BLOCK)
    out = None
    for name, rows, channels, lags in (
        ("1", both, 2, 1), ("2", first, 1, 2), ("3", first.drop("y").join(smooth, ["trial", "t"]), 1, 2),
    ):
        spec = Spec("cca", x_lags=lags, k=1, shrink=G, rcond=1e-12)
        table = lagged_sums(rows.join(folds, "trial"), ["trial"], ["fold"], "x", "y", spec.x_basis(), spec.y_basis(), width=BLOCK, shifts=SHIFTS)
        sc = fold_scores(table, channels, 1, {name: spec}, ["shift"], positive=True)
        out = sc if out is None else out.unionByName(sc)
    return out.groupBy("model", "shift", "comp").agg(F.round(F.avg("r"), 6).alias("r"))


@query(
    "impulse_response", "M17 M13",
    f"""WITH {LONG}, {STIM}, l AS (SELECT trial, t, s AS a, coalesce(lag(s) OVER (PARTITION BY trial ORDER BY t), 0.0) AS b FROM stim),
    c AS (SELECT ch, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, v) AS av, covar_pop(b, v) AS bv FROM long JOIN l USING (trial, t) GROUP BY ch),
    g AS (SELECT *, 1e-3 * (aa + bb) / 2 AS al FROM c),
    w AS (SELECT ch, ((bb + al) * av - ab * bv) / ((aa + al) * (bb + al) - ab * ab) AS h0, ((aa + al) * bv - ab * av) / ((aa + al) * (bb + al) - ab * ab) AS h1 FROM g),
    f AS (SELECT ch, CAST(k AS INTEGER) AS bin, h0 + h1 * cos(2 * pi() * k / 256) AS re, -h1 * sin(2 * pi() * k / 256) AS im, h0, h1 FROM w, range(129) r(k)),
    z AS (SELECT *, CASE WHEN abs(im) < 1e-12 THEN 0.0 ELSE im END AS im0, CASE WHEN abs(re) < 1e-12 THEN 0.0 ELSE re END AS re0 FROM f)
    SELECT ch, bin, bin * 0.25::DOUBLE AS hz, round(h0, 6) AS first_tap, round(h1, 6) AS second_tap, round(sqrt(re * re + im * im), 6) AS magnitude, round(atan2(im0, re0), 4) AS phase FROM z""",
)
def impulse_response(spark: SparkSession, sf: str) -> DataFrame:
    """Impulse response of every channel to the stimulus (two taps) with its transfer function."""
    _, _, both = _views(spark, sf)
    spec = Spec("relative_ridge_forward", y_lags=2)
    one = both.withColumn("fold", F.lit(0))
    total = lagged_sums(one, ["trial"], ["fold"], "x", "y", spec.x_basis(), spec.y_basis(), width=BLOCK)
    taps = written(impulse_responses(total, [], P, 2, spec), "taps")
    tf = transfer_function(taps, ["ch", "taps"], "taps", RATE)
    return tf.select(
        "ch", "bin", "hz", F.round(F.col("taps")[0], 6).alias("first_tap"), F.round(F.col("taps")[1], 6).alias("second_tap"),
        F.round("magnitude", 6).alias("magnitude"), F.round("phase", 4).alias("phase"),
    )


@query("component_maps", "M19 M6 A19")
def component_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Three components of all data: stimulus-side transfer function and correlation with every channel."""
    _, _, both = _views(spark, sf)
    spec = Spec("cca", x_lags=2, y_lags=8, keep_x=40, k=3, shrink=0.1, rcond=1e-6)
    table = lag_products(both.withColumn("fold", F.lit(0)), "trial", ["fold"], 2, 8, width=BLOCK)
    full = map_rows(table, lambda row: [(assemble(row["s"], P, 1, 2, 8, 2, 8),)], "s array<double>")
    parts = written(component_summary(full, P, 1, spec), "components")
    tf = transfer_function(parts, ["comp"], "taps", RATE).select("comp", F.lit("transfer").alias("kind"), F.col("bin").alias("i"), F.col("magnitude").alias("v"))
    topo = parts.select("comp", F.lit("map").alias("kind"), F.posexplode("topo").alias("i", "v"))
    return tf.unionByName(topo).withColumn("v", F.round("v", 6))


@query(
    "roi_component_maps", "M19 A19",
    f"""WITH {LONG}, {STIM}, roi AS (SELECT trial, t, avg(v) AS x FROM long GROUP BY ALL), e AS (SELECT roi.trial, roi.t, x, s AS a, coalesce(lag(s) OVER (PARTITION BY roi.trial ORDER BY roi.t), 0.0) AS b FROM roi JOIN stim USING (trial, t)),
    c AS (SELECT var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab, covar_pop(a, x) AS ca, covar_pop(b, x) AS cb FROM e),
    s AS (SELECT *, {1 - G} * va + {G} * (va + vb) / 2 AS sa, {1 - G} * vb + {G} * (va + vb) / 2 AS sb, {1 - G} * ab AS sx FROM c),
    r AS (SELECT *, (sb * ca - sx * cb) / (sa * sb - sx * sx) AS ra, (sa * cb - sx * ca) / (sa * sb - sx * sx) AS rb FROM s),
    n AS (SELECT ra / sqrt(ca * ra + cb * rb) AS h0, rb / sqrt(ca * ra + cb * rb) AS h1 FROM r),
    g AS (SELECT h0 * sg AS h0, h1 * sg AS h1, sg FROM (SELECT *, CASE WHEN abs(h1) > abs(h0) THEN sign(h1) ELSE sign(h0) END AS sg FROM n))
    SELECT 0 AS comp, 'transfer' AS kind, CAST(k AS INTEGER) AS i, round(sqrt((h0 + h1 * cos(2 * pi() * k / 256)) ** 2 + (h1 * sin(2 * pi() * k / 256)) ** 2), 6) AS v FROM g, range(129) r(k)
    UNION ALL SELECT 0, 'map', 0, round(sg, 6) FROM g""",
)
def roi_component_maps(spark: SparkSession, sf: str) -> DataFrame:
    """The same for the mean of all channels and a stimulus with two lags, whose component has a closed form."""
    _, stim, _ = _roi(spark, sf)
    sig, _, _ = _views(spark, sf)
    mean = F.array(F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x"))
    both = sig.select("trial", "t", mean.alias("x")).join(stim, ["trial", "t"])
    spec = Spec("cca", y_lags=2, k=1, shrink=G, rcond=1e-12)
    total = lagged_sums(both.withColumn("fold", F.lit(0)), ["trial"], ["fold"], "x", "y", spec.x_basis(), spec.y_basis(), width=BLOCK)
    parts = written(component_summary(total, 1, 1, spec), "components")
    tf = transfer_function(parts, ["comp"], "taps", RATE).select("comp", F.lit("transfer").alias("kind"), F.col("bin").alias("i"), F.col("magnitude").alias("v"))
    topo = parts.select("comp", F.lit("map").alias("kind"), F.posexplode("topo").alias("i", "v"))
    return tf.unionByName(topo).withColumn("v", F.round("v", 6))


@query(
    "signed_delay_response", "M14 M20",
    f"""WITH {LONG}, {STIM}, {COND}, l AS (SELECT trial, t, coalesce(lead(s) OVER w, 0.0) AS a, s AS b FROM stim WINDOW w AS (PARTITION BY trial ORDER BY t)),
    c AS (SELECT y, ch, count(*) * var_pop(a) AS aa, count(*) * var_pop(b) AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, v) AS av, count(*) * covar_pop(b, v) AS bv FROM long JOIN l USING (trial, t) JOIN cond USING (trial) GROUP BY ALL)
    SELECT y, ch, round(((bb + 1) * av - ab * bv) / ((aa + 1) * (bb + 1) - ab * ab), 6) AS ahead, round(((aa + 1) * bv - ab * av) / ((aa + 1) * (bb + 1) - ab * ab), 6) AS now FROM c""",
)
def signed_delay_response(spark: SparkSession, sf: str) -> DataFrame:
    """Ridge response of every channel with delays -1 and 0, for each attended condition."""
    _, _, both = _views(spark, sf)
    spec = Spec("ridge_forward", y_first=-1, y_lags=2, alpha=1.0)
    rows = both.join(F.broadcast(trial_condition(spark, sf).withColumnRenamed("y", "cond")), "trial")
    total = lagged_sums(rows, ["trial"], ["cond"], "x", "y", spec.x_basis(), spec.y_basis(), width=BLOCK)
    taps = impulse_responses(total, ["cond"], P, 2, spec)
    return taps.select(F.col("cond").alias("y"), "ch", F.round(F.col("taps")[0], 6).alias("ahead"), F.round(F.col("taps")[1], 6).alias("now"))


@query("final_patterns", "M20 M14 M27")
def final_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Three pattern sets of all data: forward response and backward pattern of attend-audio trials, and the forward
    response of attend-visual trials to two visual features (level and change of the second half of the channels)."""
    from ..operators.series import frame_change

    sig, stim, both = _views(spark, sf)
    cond = F.broadcast(trial_condition(spark, sf).withColumnRenamed("y", "cond"))
    seen = frame_change(sig.select("trial", "t", F.slice("x", 33, 32).alias("x")), ["trial"], "x", width=BLOCK)
    visual = sig.join(seen.select("trial", "t", F.array("level", "change").alias("y")), ["trial", "t"])
    out = None
    for name, rows, wanted, spec, features in (
        ("audio_forward", both, 1, Spec("ridge_forward", y_first=-2, y_lags=9, alpha=1.0), 1),
        ("audio_backward", both, 1, Spec("ridge_backward", x_first=-2, x_lags=5, alpha=1.0), 1),
        ("visual_forward", visual, 0, Spec("ridge_forward", y_first=-2, y_lags=9, alpha=1.0), 2),
    ):
        chosen = rows.join(cond, "trial").where(F.col("cond") == wanted)
        total = written(lagged_sums(chosen, ["trial"], ["cond"], "x", "y", spec.x_basis(), spec.y_basis(), width=BLOCK), "total")
        models = fit(total, ["cond"], P, features, {name: spec})
        if name == "audio_backward":
            pt = patterns(models, total, ["cond"], P * spec.x_lags, 1).select("comp", F.posexplode("px").alias("i", "w"))
        else:  # weights of every channel: delay outer, feature inner
            long = models.select("k", F.posexplode("ay").alias("i", "w"))
            pt = long.select((F.col("i") % F.col("k")).cast("int").alias("comp"), F.floor(F.col("i") / F.col("k")).cast("int").alias("i"), "w")
        pt = pt.select(F.lit(name).alias("kind"), "comp", "i", F.round("w", 6).alias("w"))
        out = pt if out is None else out.unionByName(pt)
    return out
