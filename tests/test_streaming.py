"""Drained streams equal their batch twins; late and unmatched rows are accounted for."""

from pyspark.sql import functions as F

from trialweave.session import scratch_path
from trialweave.streaming.markers import (
    assemble_trials, counter_steps, drain, drain_with_late_counts, marker_stream, responses, write_markers,
)


def markers(spark, rows):
    """rows: (session, second, label, trial, id, value, k)"""
    df = spark.createDataFrame(rows, "session bigint, s double, label string, trial bigint, marker_id bigint, value double, k int")
    body = F.struct("label", "trial", "marker_id", "value", "k")
    return df.select("session", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("ts"), F.to_json(body).alias("payload"))


def live(spark, rows, delay="10 seconds"):
    path = scratch_path(spark, "test-live")
    write_markers(markers(spark, rows).repartition(1), path)
    return marker_stream(spark, path, delay)


def test_audio_onset_overrides_whatever_the_order(spark):
    rows = [
        (1, 100.0, "probe_response", 7, 4, 0.0, 1), (1, 50.0, "av_onset", 7, 1, 0.0, 0), (1, 51.5, "audio_onset", 7, 2, 0.0, 0),
        (1, 90.0, "block_end", 7, 3, 38.0, 0), (1, 40.0, "av_onset", 8, 5, 0.0, 0), (1, 10_000.0, "trial_start", 9, 6, 0.0, 0),
    ]
    out = {r.trial: r for r in drain(assemble_trials(live(spark, rows), 30.0)).collect()}
    assert out[7].complete and out[7].onset_s == 51.5 and out[7].block_dur_s == 38.0 and out[7].probe == 1
    assert not out[8].complete and out[8].onset_s == 40.0  # timed out


def in_files(spark, files, delay="10 seconds"):
    """One file, and so one batch, for each list of rows."""
    path = scratch_path(spark, "test-files")
    for i, rows in enumerate(files):
        write_markers(markers(spark, rows).repartition(1), f"{path}/{i}")
    return marker_stream(spark, path + "/*", delay)


def test_a_later_batch_still_belongs_to_the_trial(spark):
    first = [(1, 50.0, "audio_onset", 7, 1, 0.0, 0), (1, 52.0, "block_end", 7, 2, 38.0, 0), (1, 53.0, "probe_response", 7, 3, 0.0, 1)]
    second = [(1, 51.0, "audio_onset", 7, 4, 0.0, 0)]
    end = [(1, 10_000.0, "trial_start", 9, 6, 0.0, 0)]
    want = [(7, 51.0, True)]
    for files in ([first + second, end], [first, second, end], [second, first, end]):
        out = drain(assemble_trials(in_files(spark, files), 30.0)).collect()
        assert [(r.trial, r.onset_s, r.complete) for r in out] == want


def test_counter_rises_do_not_depend_on_batches(spark):
    rows = [(1, float(s), "x", 3, s, 0.0, k) for s, k in ((100, 2), (101, 1), (102, 3), (103, 3))]
    end = [(1, 10_000.0, "x", 9, 900, 0.0, 1)]
    for files in ([rows, end], [rows[2:], rows[:2], end], [rows[1::2], rows[::2], end]):
        out = drain(counter_steps(in_files(spark, files), "1000 seconds")).collect()
        assert [(r.trial, r.rises, r.top) for r in out] == [(3, 2, 3)]


def test_beeps_without_an_answer_keep_a_null(spark):
    rows = [
        (1, 10.0, "beep", 1, 1, 0.0, 0), (1, 10.8, "answer", 1, 2, 0.0, 0), (1, 50.0, "beep", 1, 3, 0.0, 0),
        (1, 900.0, "beep", 1, 4, 0.0, 0), (1, 900.4, "answer", 1, 5, 0.0, 0),
    ]
    path = scratch_path(spark, "test-beeps")
    write_markers(markers(spark, rows).repartition(1), path)
    side = lambda label: marker_stream(spark, path, "1 second").where(F.col("label") == label)
    out = {r.beep: r.answer for r in drain(responses(side("beep"), side("answer"), "1500 milliseconds")).collect()}
    assert out[1] == 2 and out[4] == 5 and out[3] is None


def test_late_rows_are_counted(spark):
    early = [(1, float(s), "x", 1, s, 0.0, 0) for s in range(0, 50)]
    later = [(1, float(s), "x", 1, s, 0.0, 0) for s in range(1000, 1200)]
    windows, late = drain_with_late_counts([markers(spark, later), markers(spark, early)], "10 seconds", "100 seconds")
    assert late == 50
    assert {r.n for r in windows.collect()} == {100} and windows.count() == 2
