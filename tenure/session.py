"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch of long texts is cut by its bytes: a Python worker holds one in several forms at a time.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # Duplicate keys in a JSON object: the last one wins, as in a jsonb column.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume."""
    builder = SparkSession.builder.appName("tenure")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    show_package(spark)
    return spark


def show_package(spark: SparkSession) -> None:
    """Let local Python workers import this package; on a cluster ship it with ``--py-files``."""
    context = spark.sparkContext
    if context.master.startswith("local"):
        root = str(Path(__file__).resolve().parent.parent)
        known = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in known:
            context.environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a local session may go without one; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tenure-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df, name: str, *partition_by: str):
    """Write ``df`` to the shared folder and go on from its files, which filters and columns can prune."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df):
    """Write ``df`` to the checkpoint folder and go on from the written rows."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
