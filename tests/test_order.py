"""Ordered scans, positions and quantiles against brute force, with hot keys and ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from trialweave.operators.ordered import Run, exact_quantiles, ntile_of, ordered_scan, positions, shuffled_positions
from trialweave.operators.nearest import closest_per_match, following, nearest
from trialweave.operators.ranks import auc, mid_ranks
from trialweave.operators.series import interpolated, true_runs


def hot_events(n=3000, seed=3):
    """Two thirds of the rows belong to key 0, many share a time stamp."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.66, 0, rng.integers(1, 6, n))
    return pd.DataFrame({"g": key, "ts": rng.integers(0, 400, n), "id": np.arange(n), "v": rng.normal(size=n).round(3)})


def test_scan_over_blocks_equals_plain_windows(spark):
    pdf = hot_events()
    pdf.loc[pdf.index % 3 == 0, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    runs = [
        Run("s", "sum", F.col("v")), Run("c", "count", F.col("v"), strict=True), Run("m", "max", F.col("v")),
        Run("last", "last", F.col("v"), strict=True), Run("next", "next", F.col("v"), strict=True),
    ]
    got = ordered_scan(df, ["g"], ["ts", "id"], runs).toPandas().sort_values("id").reset_index(drop=True)
    w = Window.partitionBy("g").orderBy("ts", "id")
    up, ex = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    want = df.select(
        "id", F.coalesce(F.sum("v").over(up), F.lit(0)).alias("s"), F.count("v").over(ex).alias("c"), F.max("v").over(up).alias("m"),
        F.last("v", True).over(ex).alias("last"), F.first("v", True).over(ahead).alias("next"),
    ).toPandas().sort_values("id").reset_index(drop=True)
    for c in ("s", "c", "m", "last", "next"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9, err_msg=c)


def test_blocks_of_a_hot_key_are_balanced(spark):
    from trialweave.operators.ordered import range_blocks

    sizes = range_blocks(spark.createDataFrame(hot_events()), ["g", "ts", "id"], 8).groupBy("blk").count().toPandas()["count"]
    assert len(sizes) == 8 and sizes.max() < 3 * 3000 / 8


def test_positions_and_ntile(spark):
    df = spark.createDataFrame(hot_events())
    got = positions(df, ["g"], ["ts", "id"]).withColumn("b", ntile_of(F.col("pos"), F.col("n"), 7))
    w = Window.partitionBy("g").orderBy("ts", "id")
    bad = got.withColumn("rn", F.row_number().over(w) - 1).withColumn("nt", F.ntile(7).over(w) - 1)
    assert bad.where("rn <> pos or nt <> b").count() == 0


def test_shuffled_positions_are_a_permutation(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 2)
    got = shuffled_positions(df, ["g"], ["id"], "seed").groupBy("g").agg(F.countDistinct("pos").alias("d"), F.max("pos").alias("m"))
    assert {(r.d, r.m) for r in got.collect()} == {(250, 249)}


def test_exact_quantiles(spark):
    pdf = hot_events()
    got = exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", {"a": 0.025, "m": 0.5, "z": 0.975}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["a", "m", "z"]].astype(float), np.quantile(part["v"], [0.025, 0.5, 0.975]))


def test_nearest_with_ties_and_hot_key(spark):
    pdf = hot_events(800)
    left, right = pdf[pdf.id % 2 == 0], pdf[pdf.id % 2 == 1]
    dl = spark.createDataFrame(left).select("g", F.col("ts").alias("lt"), F.col("id").alias("lid"))
    dr = spark.createDataFrame(right).select("g", F.col("ts").alias("rt"), F.col("id").alias("rid"))
    m = nearest(dl, dr, ["g"], "lt", "lid", "rt", "rid", 3)
    got = {r.lid: (r.match_id, r.err) for r in m.collect()}
    best = {(r.g, r.match_id): r.lid for r in closest_per_match(m, ["g", "match_id"], "lt", "lid").collect()}
    nxt = {r.lid: r.match_id for r in following(dl, dr, ["g"], "lt", "lid", "rt", "rid").collect()}
    want, after, per = {}, {}, {}
    for _, a in left.iterrows():
        cand = right[right.g == a.g]
        d = (cand.ts - a.ts).abs()
        order = sorted(zip(d, cand.ts, cand.id))
        if order and order[0][0] <= 3:
            want[int(a.id)] = (int(order[0][2]), int(order[0][0]))
            key = (int(a.g), int(order[0][2]))
            per[key] = min(per.get(key, (1e9,)), (order[0][0], a.ts, a.id))
        later = sorted(zip(cand.ts[cand.ts > a.ts], cand.id[cand.ts > a.ts]))
        if later:
            after[int(a.id)] = int(later[0][1])
    assert got == want
    assert nxt == after
    assert best == {k: int(v[2]) for k, v in per.items()}


def test_auc_and_mid_ranks_with_ties(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"y": rng.integers(0, 2, 400), "s": rng.integers(0, 12, 400)})
    df = spark.createDataFrame(pdf)
    a, b = pdf.s[pdf.y == 1].to_numpy(), pdf.s[pdf.y == 0].to_numpy()
    want = ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))
    assert auc(df, [], "y", "s").head().auc == pytest.approx(want)
    ranks = mid_ranks(df, [], "s", "r").groupBy("s").agg(F.first("r").alias("r")).toPandas().set_index("s")["r"]
    np.testing.assert_allclose(ranks.sort_index(), pdf.s.rank().groupby(pdf.s).first().sort_index())


def test_runs_and_interpolation(spark):
    v = np.array([1, 1, 0, 1, 0, 0, 1, 1, 1, 0], float)
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "g int, t bigint, v double")
    runs = {(r.start, r.end) for r in true_runs(df, ["g"], "t", F.col("v") > 0, F.col("v")).collect()}
    assert runs == {(0, 2), (3, 4), (6, 9)}
    gaps = df.withColumn("v", F.when(F.col("t").isin(0, 3, 4, 9), F.lit(None)).otherwise(F.col("t") * 2.0))
    got = interpolated(gaps, ["g"], "t", "v", 3).orderBy("t").toPandas()["filled"]
    np.testing.assert_allclose(got, [2, 2, 4, 6, 8, 10, 12, 14, 16, 16])
    assert interpolated(gaps, ["g"], "t", "v", 8).where("filled is not null").count() == 0
