"""Raw recordings as a data source: multiplexed little-endian float32 samples, channel-minor.

Every file is one recording.  The reader plans byte ranges of whole samples, so a long recording is read by
many tasks; the writer makes one file per recording and moves files into place when all tasks have ended,
so a task that runs twice leaves nothing behind.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "recording string, t bigint, x array<double>"
SUFFIX = ".eeg"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass
class ByteRange(InputPartition):
    path: str
    first: int  # sample
    count: int


class MultiplexedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.channels = options["path"], int(options["channels"])
        self.samples = int(options.get("samplesPerSplit", 1 << 16))

    def partitions(self) -> list[InputPartition]:
        files, root = _open(self.path)
        found = files.get_file_info(pafs.FileSelector(root, recursive=False))
        if not isinstance(found, list):
            found = [found]
        out: list[InputPartition] = []
        for info in sorted(found, key=lambda i: i.path):
            if info.type != pafs.FileType.File or not info.path.endswith(SUFFIX):
                continue
            total = info.size // (4 * self.channels)  # a sample that was cut off at the end is left out
            out += [ByteRange(info.path, a, min(self.samples, total - a)) for a in range(0, total, self.samples)]
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.path)
        width, at, step = 4 * self.channels, partition.first, 4096
        name = posixpath.basename(partition.path).removesuffix(SUFFIX)
        with files.open_input_file(partition.path) as raw:
            while at < partition.first + partition.count:
                n = min(step, partition.first + partition.count - at)
                raw.seek(at * width)
                values = np.frombuffer(raw.read(n * width), "<f4").astype("float64")
                offsets = np.arange(0, (n + 1) * self.channels, self.channels, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array(np.arange(at, at + n)), pa.ListArray.from_arrays(offsets, pa.array(values))],
                    names=["recording", "t", "x"],
                )
                at += n


@dataclass
class Files(WriterCommitMessage):
    names: list[tuple[str, str]]  # as written, as wanted


class MultiplexedWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator) -> WriterCommitMessage:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        names, stream, now = [], None, None
        try:
            for row in iterator:
                if row["recording"] != now:
                    if stream:
                        stream.close()
                    now = row["recording"]
                    made = posixpath.join(root, f"_{uuid.uuid4().hex}")
                    names.append((made, posixpath.join(root, now + SUFFIX)))
                    stream = files.open_output_stream(made)
                stream.write(np.asarray(row["x"], "<f4").tobytes())
        finally:
            if stream:
                stream.close()
        return Files(names)

    def commit(self, messages: list) -> None:
        files, _ = _open(self.path)
        for message in messages:
            for made, wanted in message.names if message else ():
                files.move(made, wanted)

    def abort(self, messages: list) -> None:
        files, _ = _open(self.path)
        for message in messages:
            for made, _wanted in message.names if message else ():
                files.delete_file(made)


class MultiplexedSource(DataSource):
    """``spark.read.format("multiplexed").option("channels", n).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "multiplexed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return MultiplexedReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MultiplexedWriter(self.options)


def scan_recordings(spark: SparkSession, path: str, channels: int, samples_per_split: int = 1 << 16) -> DataFrame:
    """``(recording, t, x)``: the samples of all recordings in a folder; ``recording`` is the file's name."""
    spark.dataSource.register(MultiplexedSource)
    options = {"channels": str(channels), "samplesPerSplit": str(samples_per_split)}
    return spark.read.format("multiplexed").options(**options).load(path)


def write_recordings(df: DataFrame, path: str) -> None:
    """Write ``(recording, t, x)`` as one file per recording, samples in order of ``t``."""
    df.sparkSession.dataSource.register(MultiplexedSource)
    rows = df.select(F.col("recording").cast("string").alias("recording"), F.col("t").cast("bigint").alias("t"), F.col("x").cast("array<double>").alias("x"))
    rows.repartition("recording").sortWithinPartitions("recording", "t").write.format("multiplexed").mode("append").save(path)
