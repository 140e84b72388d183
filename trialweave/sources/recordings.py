"""Scans of recording files: trigger text, headers, electrode tables and raw samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MARKER_LINE = r"^Mk(\d+)=([^,]*),([^,]*),(\d+),(\d+),(\d+)(?:,(\d{20}))?"


def scan_markers(spark: SparkSession, path: str, owner: str | None = None) -> DataFrame:
    """One row per ``Mk`` line; partition folders (for example ``session=``) become columns.

    With ``owner`` each line is headed by the name of its recording and a tab, and that becomes the column.
    """
    raw = spark.read.text(path)
    if owner:
        head = F.substring_index("value", "\t", 1)
        rest = F.col("value").substr(F.length(head) + 2, F.length("value"))
        raw = raw.where(F.col("value").contains("\t")).withColumns({owner: F.nullif(head, F.lit("")), "value": rest})
    part = lambda i: F.regexp_extract("value", MARKER_LINE, i)
    keys = [c for c in raw.columns if c != "value"]
    return raw.where(F.col("value").startswith("Mk")).select(
        *keys,
        part(1).cast("int").alias("mk"),
        part(2).alias("kind"),
        F.trim(part(3)).alias("code"),
        part(4).cast("bigint").alias("sample"),
        F.nullif(part(7), F.lit("")).alias("stamp"),
    )


def markers_of(markers: DataFrame, code: str) -> DataFrame:
    """Stimulus lines of one code."""
    return markers.where((F.col("kind") == "Stimulus") & (F.col("code") == code))


def recording_start(markers: DataFrame, zone: str = "UTC") -> DataFrame:
    """Start of each recording in epoch microseconds, from the 20-digit segment stamp.

    The stamp is local time, so the zone is an argument and not the host's setting.
    """
    keys = [c for c in markers.columns if c not in ("mk", "kind", "code", "sample", "stamp")]
    first = markers.where((F.col("kind") == "New Segment") & F.col("stamp").isNotNull())
    whole = F.make_timestamp(
        *[F.substring("stamp", a, n).cast("int") for a, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2))],
        F.substring("stamp", 13, 2).cast("decimal(8,6)"), F.lit(zone),
    )
    micros = F.unix_micros(whole) + F.substring("stamp", 15, 6).cast("bigint")
    return first.groupBy(*keys).agg(F.min(micros).alias("start_us"))


def sample_to_micros(start_us: Column, sample: Column, rate: float) -> Column:
    """Wall clock of a 1-based sample number."""
    return start_us + F.round((sample - 1) * (1_000_000.0 / rate)).cast("bigint")


def scan_headers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Channel lines and impedance lines of header files (one small file per session).

    Impedances count only after a line holding both ``Impedance`` and ``kOhm``.
    """
    raw = spark.read.text(path, wholetext=True)
    keys = [c for c in raw.columns if c != "value"]
    lines = raw.select(*keys, F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    pat = r"^Ch(\d+)=([^,]*),([^,]*),([^,]*),?(.*)$"
    channels = lines.where(F.col("line").rlike(pat)).select(
        *keys,
        F.regexp_extract("line", pat, 1).cast("int").alias("idx"),
        F.regexp_extract("line", pat, 2).alias("name"),
        F.regexp_extract("line", pat, 4).cast("double").alias("resolution"),
        F.regexp_extract("line", pat, 5).alias("unit"),
    )
    opened = F.col("line").contains("Impedance") & F.col("line").contains("kOhm")
    start = lines.where(opened).groupBy(*keys).agg(F.min("line_no").alias("_from"))
    imp = r"^\s*(\w+):\s+(\d+(?:\.\d+)?)\s*$"
    impedance = (
        lines.join(start, keys)
        .where((F.col("line_no") > F.col("_from")) & F.col("line").rlike(imp))
        .select(*keys, F.regexp_extract("line", imp, 1).alias("electrode"),
                F.regexp_extract("line", imp, 2).cast("double").alias("kohm"))
    )
    return channels, impedance


def scan_electrodes(spark: SparkSession, path: str) -> DataFrame:
    """Electrode rows of an XML montage; rows without a number are skipped."""
    schema = T.StructType([
        T.StructField("Name", T.StringType()), T.StructField("Number", T.IntegerType()),
        T.StructField("Theta", T.DoubleType()), T.StructField("Phi", T.DoubleType()),
    ])
    raw = spark.read.format("xml").option("rowTag", "Electrode").schema(schema).load(path)
    return raw.where(F.col("Number").isNotNull()).select(
        F.col("Name").alias("name"), F.col("Number").alias("number"),
        F.col("Theta").alias("theta"), F.col("Phi").alias("phi"),
    )


def scan_channel_map(spark: SparkSession, path: str) -> DataFrame:
    """``(number, label)`` from a JSON document ``{"map": {"1": "Fp1", ...}}``."""
    schema = "map map<string,string>"
    return spark.read.schema(schema).json(path).select(F.explode("map").alias("number", "label")).select(
        F.col("number").cast("int").alias("number"), "label"
    )


def scan_multiplexed(spark: SparkSession, path: str, channels: int) -> DataFrame:
    """Raw little-endian float32 samples, channel-minor, as ``(t, content)`` records.

    Fixed-length records let one large file be read by many tasks; there is no DataFrame
    reader for them, so this scan starts from ``binaryRecords``.
    """
    records = spark.sparkContext.binaryRecords(path, 4 * channels).zipWithIndex()
    return records.map(lambda r: (r[1], bytearray(r[0]))).toDF("t bigint, content binary")


def decode_samples(df: DataFrame, content: str = "content") -> DataFrame:
    """Replace a float32 byte column by ``x array<double>`` in Arrow batches."""
    keep = [f for f in df.schema.fields if f.name != content]
    schema = T.StructType([*keep, T.StructField("x", T.ArrayType(T.DoubleType()))])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["x"] = [np.frombuffer(bytes(b), dtype="<f4").astype("float64") for b in pdf[content]]
            yield pdf.drop(columns=[content])

    return df.mapInPandas(task, schema)
