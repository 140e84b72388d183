"""Sums, bootstraps, marker files and trial state at sizes that used to grow with the data."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trialweave.operators.resample import bootstrap_counts
from trialweave.operators import stats
from trialweave.operators.stats import EMIT_BYTES, HOLD_BYTES, PIECE, _Sums, _task_sums, map_rows, sum_vectors, trial_stats
from trialweave.plans.source_plans import marker_files
from trialweave.sources.recordings import scan_markers


def test_python_batches_are_bounded_in_bytes(spark):
    wide = spark.range(0, 400, 1, 1).select("id", F.array_repeat(F.lit(1.0), 20000).alias("s"))
    map_rows(wide, lambda row: iter(()), "id bigint")

    def rows(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)]})

    assert wide.mapInPandas(rows, "n bigint").agg(F.max("n")).first()[0] * 160_000 <= 20 << 20


def test_sums_leave_a_task_in_small_frames():
    acc = _Sums(["k"])
    for k in range(200):
        acc.add((k,), np.full(3 * PIECE + 5, float(k)))
    frames = list(acc.frames())
    assert len(frames) > 1 and not acc.sums and acc.bytes == 0
    assert max(sum(v.nbytes for v in f["a"]) for f in frames) <= EMIT_BYTES + 8 * (3 * PIECE + 5)
    assert sum(v.sum() for f in frames for v in f["a"]) == sum(range(200)) * (3 * PIECE + 5)


def test_sums_of_repeated_and_missing_keys(spark):
    rows = spark.range(0, 600, 1, 6).select(
        F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("k"), F.transform(F.sequence(F.lit(1), F.lit(PIECE + 3)), lambda i: i * 1.0 + F.col("id")).alias("v")
    )
    got = {r["k"]: np.array(r["s"]) for r in sum_vectors(rows, ["k"], "v").collect()}
    base = np.arange(1, PIECE + 4)
    assert set(got) == {None, 1, 2, 3}
    for k, s in got.items():
        ids = np.arange(0 if k is None else k, 600, 4)
        assert np.array_equal(s, base * len(ids) + ids.sum())


def test_pieces_of_many_keys_pass_through_a_task(spark):
    schema = stats._piece_schema(spark.range(0).withColumnRenamed("id", "k"), ["k"])
    caught = []

    class Partial:
        def mapInPandas(self, task, schema):
            caught.append(task)

    Partial.schema = schema
    _task_sums(Partial(), ["k"])
    taken, given, most, got = 0, 0, 0, {}

    def batches():
        nonlocal taken, most
        for k in range(100):  # 100 keys of 12 pieces in two blocks each: 20 MB
            for block in range(2):
                yield pd.DataFrame({"k": [k] * 12, "piece": range(12), "a": [np.full(PIECE, float(k + block))] * 12})
            taken += 12 * PIECE * 8
            most = max(most, taken - given)

    rows = 0
    for frame in caught[0](batches()):
        given += sum(v.nbytes for v in frame["a"])
        rows += len(frame)
        assert sum(v.nbytes for v in frame["a"]) <= EMIT_BYTES + 8 * PIECE
        for k, piece, v in zip(frame["k"], frame["piece"], frame["a"]):
            got[k, piece] = got.get((k, piece), 0) + v
    assert most <= HOLD_BYTES + EMIT_BYTES + 2 * 12 * PIECE * 8
    assert rows == len(got) == 1200 and all((v == 2 * k + 1).all() for (k, _), v in got.items())


def test_sums_of_keys_that_do_not_come_again_are_not_held():
    once, again = _Sums(["k"]), _Sums(["k"])
    for k in range(300):
        once.add((k,), np.ones(2 * PIECE))
    for k in range(1500):
        again.add((k % 300,), np.ones(2 * PIECE))
    assert once.full and not again.full and once.bytes == again.bytes > HOLD_BYTES
    list(once.frames())
    assert not once.full and once.bytes == once.adds == 0


def test_pairs_travel_without_products_inside_a_side(spark, tmp_path, monkeypatch):
    from trialweave.plans import resampling_plans as plans

    rng, seen, vector = np.random.default_rng(3), [], plans.correlation_vector
    monkeypatch.setattr(plans, "correlation_vector", lambda st, *a: seen.append((st, vector(st, *a))) or seen[0][1])
    x = rng.normal(size=(200, 64)).astype("float32")
    rows = pd.DataFrame({"vec_id": range(200), "embedding": list(x.tolist()), "label": 1})
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert plans.pairing_permutation(spark, str(tmp_path)).first()["n_perm"] == 100
    pairs, r = seen[0]
    assert pairs.agg(F.max(F.size("s"))).first()[0] == 1 + 64 + 1 + 64 + 1 + 64
    s = {(w["trial"], w["t"]): w["s"] for w in plans.stimulus(spark, str(tmp_path)).collect()}
    found = r.collect()
    assert len(found) == 16
    for w in found:
        other = np.array([s[w["j"], t] for t in range(50)])
        want = [np.corrcoef(x[50 * w["i"] : 50 * w["i"] + 50, c], other)[0, 1] for c in range(64)]
        assert np.allclose(w["x"], want, atol=1e-9)


def test_a_trial_leaves_its_task_as_one_vector(spark, monkeypatch):
    seen = []
    final = stats._final_sum
    monkeypatch.setattr(stats, "_final_sum", lambda partial, by, blocks=False: seen.append(partial) or final(partial, by, blocks))
    rows = spark.range(0, 2000, 1, 8).select(
        (F.col("id") % 40).alias("trial"), F.floor(F.col("id") / 40).alias("t"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("x"), F.array(F.lit(1.0)).alias("y")
    ).repartition(8, "trial", "t")
    got = {r["trial"]: np.array(r["s"]) for r in trial_stats(rows, ["trial"], "x", "y", "t").collect()}
    assert seen[0].groupBy("trial", "piece").count().agg(F.max("count")).first()[0] == 1
    for k in range(40):
        ids = np.arange(k, 2000, 40.0)
        assert np.allclose(got[k][:4], [50, ids.sum(), 100, 50]) and np.allclose(got[k][4], (ids**2).sum())


def test_bootstrap_carries_the_rows_of_an_id_without_a_broadcast(spark):
    rows = spark.createDataFrame([(g, i, float(i * g + r)) for g in (1, 2) for i in range(50) for r in range(1 + i % 2)], "g int, id int, v double")
    draws = bootstrap_counts(rows, ["g"], "id", 5, carry={"c": F.count(F.lit(1)), "s": F.sum("v")})
    assert "Broadcast" not in draws._jdf.queryExecution().explainString(draws._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    joined = bootstrap_counts(rows, ["g"], "id", 5).join(rows, ["g", "id"])
    want = joined.groupBy("boot", "g").agg(F.sum("mult").alias("n"), F.sum(F.col("mult") * F.col("v")).alias("s"))
    got = draws.groupBy("boot", "g").agg(F.sum(F.col("mult") * F.col("c")).alias("n"), F.sum(F.col("mult") * F.col("s")).alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_marker_files_do_not_grow_with_the_sessions(spark, tmp_path):
    events = spark.range(0, 300, 1, 2).select(
        F.col("id").alias("event_id"), F.when(F.col("id") > 0, F.col("id")).alias("user_id"), F.lit("click").alias("event_type"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 1000).alias("ts"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    path = marker_files(spark, str(tmp_path))
    assert len(spark.read.text(path).inputFiles()) < 100
    marks = scan_markers(spark, path, "session").where("kind = 'Stimulus'").collect()
    assert sorted((int(m["session"] or 0), m["mk"], m["code"], m["sample"]) for m in marks) == [(i, i + 2, "click", i + 1) for i in range(300)]


def test_trial_state_calls_do_not_grow_with_the_trials(spark, tmp_path):
    from trialweave.streaming.markers import GROUPS, assemble_trials, drain, marker_stream, write_markers

    rows = spark.range(0, 9000, 1, 2).selectExpr(
        "id div 3 as session", "timestamp_seconds(1704067200 + id % 3) as ts",
        "to_json(named_struct('label', element_at(array('audio_onset', 'block_end', 'probe_response'), cast(id % 3 + 1 as int)), "
        "'trial', id % 2, 'marker_id', id, 'value', 1.5, 'k', 7)) as payload",
    )
    last = spark.sql("select 99999L as session, timestamp_seconds(1704967200) as ts, '{\"label\": \"trial_start\", \"trial\": 1}' as payload")
    write_markers(rows, str(tmp_path / "in" / "0"))
    time.sleep(1.1)  # files are read in the order of their time
    write_markers(last, str(tmp_path / "in" / "1"))
    stream = marker_stream(spark, str(tmp_path / "in" / "*"), "1 second", files=2)
    out = drain(assemble_trials(stream, 30.0)).collect()
    assert len({(r.session, r.trial) for r in out}) == len(out) == 6000
    assert GROUPS < 6000
    # markers 0, 2 of a session fall in one trial and marker 1 in the other, so no trial is complete
    assert not any(r.complete for r in out) and sum(r.probe == 7 for r in out) == 3000


def test_session_files_are_compressed_documents(spark, tmp_path):
    from trialweave.plans.source_plans import session_files
    from trialweave.sources.logs import read_sessions

    li = spark.range(0, 90, 1, 2).selectExpr(
        "id div 3 as l_orderkey", "cast(id % 3 as int) as l_linenumber", "id as l_partkey", "1.0D * id as l_extendedprice", "'O' as l_linestatus",
        "0.05D as l_discount", "2.0D as l_quantity", "0.04D as l_tax", "'N' as l_returnflag", "repeat('x', 50) as l_comment",
    )
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(30).selectExpr("id as o_orderkey", "date'2024-01-01' as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    path = session_files(spark, str(tmp_path))
    assert all(f.endswith(".gz") for f in spark.read.text(path).inputFiles())
    back = {r.session: [t.audio_stim for t in r.trials] for r in read_sessions(spark, path).collect()}
    assert back == {str(o): [str(3 * o + i) for i in range(3)] for o in range(30)}


def test_a_long_scan_is_cut_into_more_tasks(spark, monkeypatch):
    from trialweave.operators import ordered

    monkeypatch.setattr(ordered, "SCAN_ROWS", 20)
    rows = spark.range(0, 1000, 1, 4).selectExpr("id % 3 as k", "id as t")
    out = ordered.ordered_scan(rows, ["k"], ["t"], [ordered.Run("n", "count", F.lit(1))])
    assert out.rdd.getNumPartitions() >= 50
    assert all(r.n == r.t // 3 + 1 for r in out.collect())
