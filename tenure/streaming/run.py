"""Starting streaming queries with their working folders in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tenure.session import ROCKSDB_PROVIDER


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state beyond memory, with incremental checkpoints."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def start_to_table(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to a parquet folder; the folder's commit log makes it exactly-once."""
    use_rocksdb(stream.sparkSession)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)


def start_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    use_rocksdb(stream.sparkSession)
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
