"""Session helpers: configuration, the shared scratch folder, and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def local_session(cores: int | str = 8, app: str = "trialweave", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(cores)
    conf["spark.driver.memory"] = "12g"
    conf["spark.ui.enabled"] = "false"
    conf.update(extra)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is absent and the master is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="trialweave-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_root(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The copy survives executor loss, ends the lineage and gives the planner exact sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Let the session's Arrow batches hold at most ``limit`` bytes; a smaller setting stays.

    The row limit alone lets a batch of wide statistics vectors grow to GBs in every Python worker.
    """
    now = str(spark.conf.get(_BATCH)).lower().rstrip("b")
    if not now.isdigit() or int(now) > limit:
        spark.conf.set(_BATCH, str(limit))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
