"""Live marker streams: ingest, trial assembly, windows, joins and late data.

State is bounded by the watermark, but for ``running_accuracy``, which keeps one row of two
numbers for each session.  The runners use ``availableNow`` and read a few files per batch, so a
finite folder of marker files is drained in many batches, as a live one is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_path

MARKER_SCHEMA = "session bigint, ts timestamp, payload string"
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
PAYLOAD = "label string, trial bigint, marker_id bigint, value double, k int"


def marker_stream(spark: SparkSession, path: str, delay: str = "1 hour", files: int = 2) -> DataFrame:
    """JSON-lines marker files as a stream with event time ``ts`` and parsed payload fields.

    ``files`` is the number of files that one batch reads at most.
    """
    reader = spark.readStream.schema(MARKER_SCHEMA).option("timestampFormat", MICROS)
    raw = reader.option("maxFilesPerTrigger", files).json(path)
    parsed = raw.select("session", "ts", F.from_json("payload", PAYLOAD).alias("p")).select("session", "ts", "p.*")
    return parsed.where("trial is not null").withWatermark("ts", delay)


def drain(stream: DataFrame, fmt: str = "parquet", name: str = "stream") -> DataFrame:
    """Append a stream to files with a checkpoint until the input is used up; read the files."""
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    query = (
        stream.writeStream.format(fmt).option("path", root + "/out").option("checkpointLocation", root + "/cp")
        .option("timestampFormat", MICROS).outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).format(fmt).option("timestampFormat", MICROS).load(root + "/out")


def drain_updates(stream: DataFrame, keys: list[str], name: str = "updates") -> DataFrame:
    """Run an update-mode aggregate; the latest row of every key is the result."""
    spark = stream.sparkSession
    root = scratch_path(spark, name)

    def save(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again overwrites its own folder, so no row is counted twice
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", root + "/cp")
        .outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(root + "/out")
    cols = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_r")).select(*keys, "_r.*")


TRIAL_STATE = (
    "session:bigint,trial:bigint,onset:double,onset_rank:int,onset_ts:double,block:double,block_ts:double,probe:int,probe_ts:double,"
    "seen_s:double,due_s:double"
)
STATE = f"trials array<struct<{TRIAL_STATE}>>"
TRIALS = "session bigint, trial bigint, onset_s double, block_dur_s double, probe int, complete boolean"
#: State groups that trials are dealt to: a call of the state function costs more than a trial.
GROUPS = 4096


def assembler(gap_s: float) -> Callable:
    """State function: collects the markers of trials until the watermark has passed a trial's last one by ``gap_s``.

    Nothing is emitted earlier, because a marker that belongs to the trial may still come.  The last
    audio onset wins over the first av onset whichever arrives first; for the other markers the
    latest event time wins.  A group holds many trials, each with a due time of its own; the group's
    time-out is the earliest of them.
    """
    names = TRIALS.replace(",", "").split()[::2]

    def add(trial: list, at: float, label: str, value, k) -> None:
        """One marker; the markers of a batch come in order of time."""
        onset, block, probe = 2, 5, 7
        if label == "audio_onset" and (trial[3] < 2 or at >= trial[4]):
            trial[onset : onset + 3] = at, 2, at
        elif label == "av_onset" and (trial[3] == 0 or (trial[3] == 1 and at < trial[4])):
            trial[onset : onset + 3] = at, 1, at
        elif label == "block_end" and (trial[6] is None or at >= trial[6]):
            trial[block : block + 2] = float(value), at
        elif label == "probe_response" and (trial[8] is None or at >= trial[8]):
            trial[probe : probe + 2] = (int(k) if k == k else None), at
        trial[9] = max(trial[9], at)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        trials = {(t[0], t[1]): list(t) for t in state.get[0]} if state.exists else {}
        touched = set()
        for pdf in batches if not state.hasTimedOut else ():
            whole = lambda c: [None if v != v else int(v) for v in pdf[c].tolist()]  # noqa: B023, E731
            times = [t.timestamp() for t in pdf["ts"]]
            ids, labels, values, ks = list(zip(whole("session"), whole("trial"))), *(pdf[c].tolist() for c in ("label", "value", "k"))
            for i in sorted(range(len(times)), key=times.__getitem__):
                trial = trials.setdefault(ids[i], [*ids[i], None, 0, None, None, None, None, None, 0.0, 0.0])
                add(trial, times[i], labels[i], values[i], ks[i])
            touched.update(ids)
        for ident in touched:
            trials[ident][10] = max(trials[ident][9] + gap_s, now / 1000.0 + 0.001)
        done = [trials.pop(ident) for ident, t in list(trials.items()) if ident not in touched and int(t[10] * 1000) < now]
        if trials:
            state.update(([tuple(t) for t in trials.values()],))
            state.setTimeoutTimestamp(max(int(min(t[10] for t in trials.values()) * 1000), now))
        elif state.exists:
            state.remove()
        if done:
            whole_trial = lambda t: t[2] is not None and t[6] is not None and t[8] is not None
            yield pd.DataFrame([(t[0], t[1], t[2], t[5], t[7], whole_trial(t)) for t in done], columns=names)

    return step


def assemble_trials(markers: DataFrame, gap_s: float) -> DataFrame:
    """Trials from markers, each emitted once, when no more of its markers can come."""
    lone = F.when(F.col("session").isNull(), -1).when(F.col("trial").isNull(), -2)  # missing keys spoil no whole number
    dealt = F.coalesce(lone, F.pmod(F.xxhash64("session", "trial"), F.lit(GROUPS)).cast("int"))
    rows = markers.select("session", "trial", "ts", "label", "value", "k", dealt.alias("_group"))
    return rows.groupBy("_group").applyInPandasWithState(assembler(gap_s), TRIALS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def trial_table(markers: DataFrame, span: str) -> DataFrame:
    """The trial table as a built-in streaming aggregate, for trials that lie inside one ``span``.

    Runs without Python: a row is updated with every batch and is final once ``complete``; the
    watermark drops the state of old windows.  ``assemble_trials`` is the form with time-outs.
    """
    when = lambda label: F.when(F.col("label") == label, F.col("ts"))
    agg = markers.groupBy("session", "trial", F.window("ts", span).alias("w")).agg(
        F.coalesce(F.max(when("audio_onset")), F.min(when("av_onset"))).alias("onset"),
        F.max_by("value", when("block_end")).alias("block_dur_s"),
        F.max_by("k", when("probe_response")).alias("probe"),
    )
    done = F.col("onset").isNotNull() & F.col("block_dur_s").isNotNull() & F.col("probe").isNotNull()
    return agg.select("session", "trial", "onset", "block_dur_s", "probe", done.alias("complete"))


def counter_steps(markers: DataFrame, span: str) -> DataFrame:
    """Rises of a counter inside a trial that lies in one ``span``: ``(session, trial, rises, top)``.

    Order matters, so a trial's markers are held until the watermark has passed the span, are
    then sorted and read once; that also bounds the state.
    """
    kept = F.sort_array(F.collect_list(F.struct("ts", "marker_id", "k")))
    start = F.struct(F.lit(0).alias("rises"), F.lit(0).alias("top"))
    rise = lambda s, m: F.struct(
        (s["rises"] + (m["k"] > s["top"]).cast("int")).alias("rises"), F.greatest(s["top"], m["k"]).alias("top")
    )
    held = markers.where("k is not null").groupBy("session", "trial", F.window("ts", span).alias("w")).agg(kept.alias("m"))
    return held.select("session", "trial", F.aggregate("m", start, rise).alias("c")).select("session", "trial", "c.rises", "c.top")


def without_twins(markers: DataFrame, keys: list[str]) -> DataFrame:
    """First marker of each key within the watermark delay."""
    return markers.dropDuplicatesWithinWatermark(keys)


def responses(beeps: DataFrame, answers: DataFrame, limit: str) -> DataFrame:
    """Beeps with the answers that follow within ``limit``; beeps without one keep a null."""
    b = beeps.select("session", F.col("ts").alias("beep_ts"), F.col("marker_id").alias("beep"))
    a = answers.select(F.col("session").alias("a_session"), F.col("ts").alias("answer_ts"), F.col("marker_id").alias("answer"))
    cond = (F.col("session") == F.col("a_session")) & (F.col("answer_ts") > F.col("beep_ts")) & (
        F.col("answer_ts") <= F.col("beep_ts") + F.expr(f"interval {limit}")
    )
    return b.join(a, cond, "left_outer").select("session", "beep", "beep_ts", "answer", "answer_ts")


def window_features(markers: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Mean, peak-to-peak and count per session and event-time window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return markers.groupBy("session", w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_v"), (F.max("value") - F.min("value")).alias("p2p")
    ).select("session", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "n", "mean_v", "p2p")


def bursts(markers: DataFrame, gap: str) -> DataFrame:
    """Runs of markers separated by at least ``gap``."""
    return markers.groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        "session", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "n"
    )


def running_accuracy(markers: DataFrame) -> DataFrame:
    """Scored answers and accuracy per session so far."""
    scored = markers.where("label = 'probe_response'")
    return scored.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_scored"), F.avg((F.col("k") > 50).cast("double")).alias("accuracy")
    )


def write_markers(markers: DataFrame, path: str) -> None:
    """Marker files as a producer would append them (microsecond stamps)."""
    markers.write.option("timestampFormat", MICROS).json(path)


#: Files of a slice of the feed at least, and markers in a file at most.
SLICE_FILES, FILE_ROWS = 2, 1_000_000


def write_marker_feed(markers: DataFrame, path: str, slices: int = 4, jitter_s: int = 1500) -> str:
    """Marker files as several batches that overlap: each marker moves by up to ``jitter_s`` in the order
    of arrival, and every slice of arrival time is one folder.  Its files are as many as its markers ask for,
    each written by a task of its own.  Returns the glob to read."""
    moved = F.unix_micros("ts") + (F.pmod(F.xxhash64("session", "payload"), F.lit(2 * jitter_s)) - jitter_s) * 1_000_000
    held = markers.withColumn("_at", moved)
    low, high, rows = held.agg(F.min("_at"), F.max("_at"), F.count(F.lit(1))).first()
    width, files = ((high or 0) - (low or 0)) // slices + 1, max(SLICE_FILES, -(-rows // (slices * FILE_ROWS)))
    for i in range(slices):
        part = held.where(F.floor((F.col("_at") - F.lit(low or 0)) / width) == i).drop("_at")
        write_markers(part.repartition(files), f"{path}/{i}")
    return f"{path}/*"


def drain_with_late_counts(feeds: list[DataFrame], delay: str, size: str) -> tuple[DataFrame, int]:
    """Add feeds of markers to one source folder, draining a windowed count after each.

    A last marker far ahead closes every window, so what was fed and is in no window came too late.
    Returns the windows and the exact number of late markers.
    """
    spark = feeds[0].sparkSession
    root = scratch_path(spark, "late")
    for i, feed in enumerate(feeds):
        write_markers(feed, f"{root}/in/{i}")
    fed = spark.read.schema(MARKER_SCHEMA).option("timestampFormat", MICROS).json(f"{root}/in/*")
    count, last = fed.agg(F.count(F.lit(1)), F.max("ts")).first()
    ahead = F.lit(last) + F.expr(f"2 * (interval {delay} + interval {size})")
    closing = spark.range(1).select(F.lit(-1).cast("bigint").alias("session"), ahead.alias("ts"), F.lit("{}").alias("payload"))
    write_markers(closing, f"{root}/in/{len(feeds)}")
    schema = None
    for i in range(len(feeds) + 1):
        # the glob grows with i, so each feed is a batch of its own although all files are there
        shown = ",".join(str(k) for k in range(i + 1))
        raw = spark.readStream.schema(MARKER_SCHEMA).option("timestampFormat", MICROS).json(f"{root}/in/{{{shown}}}")
        counts = raw.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w")).agg(F.count(F.lit(1)).alias("n"))
        counts = counts.select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "n")
        schema = counts.schema
        (
            counts.writeStream.format("parquet").option("path", root + "/out").option("checkpointLocation", root + "/cp")
            .outputMode("append").trigger(availableNow=True).start()
        ).awaitTermination()
    windows = spark.read.schema(schema).parquet(root + "/out")
    return windows, count - int(windows.agg(F.sum("n")).first()[0] or 0)
