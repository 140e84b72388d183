"""Clock search, epochs, sources, text, design tables and plan shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators.intervals import epochs, interval_join
from trialweave.operators.nearest import clock_offset
from trialweave.operators.quality import nearest_channels, robust_z, sparse_repair
from trialweave.operators.resample import balanced_plan, cluster_mass, offset_in_ranges
from trialweave.operators.series import greedy_fill
from trialweave.operators.text import bigram_surprisal, onset_impulses
from trialweave.sources.logs import append_checked, merge_new, read_or_empty
from trialweave.sources.recordings import decode_samples, recording_start, scan_markers, scan_multiplexed


def test_planted_clock_offset_is_found(spark):
    rng = np.random.default_rng(4)
    logged = np.sort(rng.integers(0, 600_000, 40))
    edges = logged + 824 + rng.integers(-5, 6, 40)
    edges = np.sort(np.r_[edges[3:], rng.integers(0, 600_000, 6)])
    dl = spark.createDataFrame([(0, i, int(v)) for i, v in enumerate(logged)], "g int, id int, t bigint")
    de = spark.createDataFrame([(0, i, int(v)) for i, v in enumerate(edges)], "g int, id int, t bigint")
    r = clock_offset(de, dl, ["g"], "t", "id", 200_000, 10, 60).head()
    assert abs(r.refined - 824) <= 5 and r.n_inliers >= 36


def test_interval_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [(int(g), int(t), i) for i, (g, t) in enumerate(zip(np.where(rng.random(400) < 0.5, 0, 1), rng.integers(0, 300, 400)))]
    ivs = [(int(g), int(a), int(a + w), i) for i, (g, a, w) in enumerate(zip(rng.integers(0, 2, 30), rng.integers(0, 300, 30), rng.integers(0, 60, 30)))]
    p = spark.createDataFrame(pts, "g int, t int, pid int")
    q = spark.createDataFrame(ivs, "g int, lo int, hi int, qid int")
    got = {(r.pid, r.qid) for r in interval_join(p, q, ["g"], "t", "lo", "hi", 17).collect()}
    assert got == {(pid, qid) for g, t, pid in pts for h, lo, hi, qid in ivs if g == h and lo <= t <= hi}


def test_epoch_join_is_an_equi_join(spark):
    p = spark.range(1000).select(F.lit(0).alias("g"), F.col("id").alias("t"))
    q = spark.range(10).select(F.lit(0).alias("g"), (F.col("id") * 90).alias("onset"))
    plan = epochs(p, q, ["g"], "t", "onset", -5, 20)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_marker_file(spark, tmp_path):
    (tmp_path / "m.vmrk").write_text(
        "[Marker Infos]\nMk1=New Segment,,1,1,0,20250102030405678901\nMk2=Stimulus,S 15,101,1,0\nMk3=Stimulus, S 14,205,1,0\nMk4=Comment,S 15,3,1,0\n"
    )
    m = scan_markers(spark, str(tmp_path))
    assert [(r.code, r["sample"]) for r in m.where("kind = 'Stimulus'").orderBy("sample").collect()] == [("S 15", 101), ("S 14", 205)]
    assert recording_start(m).head().start_us == 1735787045678901


def test_multiplexed_file(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(50, 3)).astype("<f4")
    (tmp_path / "a.eeg").write_bytes(x.tobytes())
    got = decode_samples(scan_multiplexed(spark, str(tmp_path / "a.eeg"), 3)).orderBy("t").toPandas()
    np.testing.assert_array_equal(np.stack(got["x"].to_list()), x.astype("float64"))


def test_manifest_helpers(spark, tmp_path):
    assert read_or_empty(spark, str(tmp_path / "none"), "id string, n int").count() == 0
    a, b = spark.createDataFrame([("a", 1)], "id string, n int"), spark.createDataFrame([("a", 2), ("b", 3)], "id string, n int")
    assert {tuple(r) for r in merge_new(a, b, ["id"]).collect()} == {("a", 1), ("b", 3)}
    path = str(tmp_path / "log")
    assert append_checked(a, path) == path and append_checked(a, path) == path
    assert append_checked(a.withColumn("z", F.lit(1)), path) != path


def test_impulses_drop_out_of_range_and_add_up(spark):
    w = spark.createDataFrame([(0, 0.1, 2.0), (0, 0.12, 3.0), (0, 9.0, 7.0)], "clip int, start double, v double")
    grid = spark.range(10).select(F.lit(0).alias("clip"), F.col("id").alias("t"))
    got = {r.t: r.impulse for r in onset_impulses(w, ["clip"], "start", F.col("v"), 10.0, grid).collect()}
    assert got[1] == 5.0 and sum(got.values()) == 5.0


def test_surprisal_is_a_distribution(spark):
    toks = "a b a c a b b c a b".split()
    df = spark.createDataFrame(list(zip([None, *toks], toks)), "prev string, tok string")
    got = {(r.prev, r.tok): r.bits for r in bigram_surprisal(df, "prev", "tok").collect()}
    assert got[("a", "b")] == pytest.approx(-np.log2((3 + 1) / (4 + 3)))


def test_greedy_fill(spark):
    rows = [(0, 0, 3.0), (0, 1, 4.0), (0, 5, 9.0), (1, 2, 2.0), (2, 3, 8.0), (1, 4, 6.0)]
    df = spark.createDataFrame(rows, "spk int, pos int, dur double")
    got = {(r.spk, r.pos, r.clip) for r in greedy_fill(df, "spk", "pos", "dur", 7.0, 2).collect()}
    assert got == {(0, 0, 1), (0, 1, 1), (2, 3, 2)}


def test_balanced_plan_uses_items_evenly(spark):
    got = balanced_plan(spark.range(7).select(F.col("id").alias("item")), "item", 17).toPandas()
    assert sorted(got["pos"]) == list(range(17)) and got["item"].value_counts().agg(["min", "max"]).tolist() == [2, 3]


def test_offset_draw_over_ranges_and_points(spark):
    from trialweave.functions.hashing import md5_key

    trials = spark.range(400).select((F.col("id") % 2).alias("g"), F.col("id").alias("trial"))
    ranges = spark.createDataFrame([(0, 0.0, 1.0), (0, 10.0, 13.0), (1, 5.0, 5.0), (1, 8.0, 8.0)], "g bigint, lo double, hi double")
    got = offset_in_ranges(trials, ["g"], ranges, "lo", "hi", md5_key("cut", "trial")).toPandas()
    a, b = got[got.g == 0]["offset"], got[got.g == 1]["offset"]
    assert len(got) == 400 and set(b) == {5.0, 8.0}
    assert (((a >= 0) & (a < 1)) | ((a >= 10) & (a < 13))).all() and 0.6 < (a >= 10).mean() < 0.9


def test_neighbours_and_repair(spark):
    rng = np.random.default_rng(0)
    pos = rng.normal(size=(12, 3))
    ch = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pos)], "ch int, px double, py double, pz double")
    e = nearest_channels(ch, [], "ch", ["px", "py", "pz"], 3)
    d = np.linalg.norm(pos[:, None] - pos[None], axis=2) + np.eye(12) * 99
    got = {(r.ch, r["rank"]): r.nbr for r in e.collect()}
    assert got == {(i, k + 1): int(np.argsort(d[i])[k]) for i in range(12) for k in range(3)}
    base = rng.normal(size=200)
    x = base[:, None] + 0.1 * rng.normal(size=(200, 12))
    x[50, 4] += 30
    rows = spark.createDataFrame([(t, x[t].tolist()) for t in range(200)], "t int, x array<double>")
    fixed = {r.t: r for r in sparse_repair(rows, "x", 12, e, 6.0).collect()}
    assert fixed[50].repaired[4] and abs(fixed[50].x[4] - base[50]) < 0.5 and not any(fixed[3].repaired)


def test_robust_z_forms(spark):
    v = np.r_[np.arange(10.0), 100.0]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "ch int, v double")
    z = robust_z(df, [], "v", "z").orderBy("ch").toPandas()["z"]
    mad = np.median(np.abs(v - np.median(v)))
    np.testing.assert_allclose(z, 0.6745 * (v - np.median(v)) / mad)


def test_cluster_mass_finds_a_planted_cluster(spark):
    rng = np.random.default_rng(2)
    rows = [(p, t, float(0.5 + 0.05 * rng.normal() + (0.3 if p == 0 and 10 <= t < 18 else 0))) for p in range(40) for t in range(30)]
    got = cluster_mass(spark.createDataFrame(rows, "perm int, t bigint, v double"), "t", "v").orderBy(F.desc("mass")).head()
    assert got.start <= 10 and got.end >= 18 and got.p == pytest.approx(1 / 40)


def test_filters_and_columns_reach_the_scan(spark, sf):
    from trialweave.plans.adapters import events

    plan = events(spark, sf).where("event_type = 'view'").select("us")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan
