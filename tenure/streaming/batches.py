"""Streams whose step is a batch operator: ordered release, sweeps, and rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tenure.functions import fixed
from tenure.operators import metrics, recover
from tenure.sources.state import StateTable, append_rows, delete, exists


class OrderedRelease:
    """Hold events until every older transaction is done, then pass them on in (xid, id) order.

    For ``foreachBatch``. Folders below ``path``, each written one partition per
    batch, so a batch run again replaces what it wrote: arrivals, pending (what
    still waits after the batch), cursor (the watermark reached), released, and
    late. A batch opens its own arrivals, what waited after the batch before,
    and that batch's cursor, however long the stream has run; what waited two
    batches ago is deleted. A batch that a later one has followed is done: run
    again, it changes nothing. An event under the watermark reached before its
    batch cannot be released in order any more: it goes to late, so every event
    is in one of the two or still waits.
    """

    def __init__(self, path: str, watermark: Callable[[DataFrame, int], int | None]):
        """``watermark(batch, batch_id)``: the oldest transaction that may still write, None for no news."""
        self.path = path
        self.watermark = watermark

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if exists(spark, f"{self.path}/cursor/batch_id={batch_id + 1}"):
            # What waited before this batch is deleted by now, so it could not be released again.
            return
        append_rows(batch, f"{self.path}/arrivals", batch_id)
        mine = self._part(spark, "arrivals", batch_id, batch.schema)
        reached = self._reached(spark, batch_id)
        # A watermark never goes back, whatever the caller says.
        upto = max(reached, self.watermark(batch, batch_id) or 0)
        held = mine.where(F.col("xid") >= reached).unionByName(self.waiting(spark, batch_id - 1, batch.schema))
        due = held.where(F.col("xid") < upto)
        ordered = due.repartitionByRange("xid", "id").sortWithinPartitions("xid", "id")
        append_rows(ordered, f"{self.path}/released", batch_id)
        append_rows(mine.where(F.coalesce(F.col("xid") < reached, F.lit(True))), f"{self.path}/late", batch_id)
        append_rows(held.where(F.col("xid") >= upto), f"{self.path}/pending", batch_id)
        append_rows(spark.range(1).select(F.lit(upto).cast("bigint").alias("xid")), f"{self.path}/cursor", batch_id)
        delete(spark, f"{self.path}/pending/batch_id={batch_id - 2}")

    def _part(self, spark: SparkSession, folder: str, batch_id: int, schema: StructType) -> DataFrame:
        """One batch of a folder; a batch without rows has left nothing there."""
        place = f"{self.path}/{folder}/batch_id={batch_id}"
        return spark.read.schema(schema).parquet(place) if exists(spark, place) else spark.createDataFrame([], schema)

    def waiting(self, spark: SparkSession, batch_id: int, schema: StructType) -> DataFrame:
        """What waited after the batch."""
        return self._part(spark, "pending", batch_id, schema)

    def _reached(self, spark: SparkSession, batch_id: int) -> int:
        if batch_id == 0:
            return 0
        return self._part(spark, "cursor", batch_id - 1, StructType.fromDDL("xid BIGINT")).first()[0]

    def released(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/released").drop("batch_id")

    def late(self, spark: SparkSession) -> DataFrame:
        """Events that came under the watermark, or without a commit number."""
        return spark.read.parquet(f"{self.path}/late").drop("batch_id")


class Sweeper:
    """Take in step rows and sweep the state at the time reached by their arrival.

    For ``foreachBatch``; one sweep per trigger. New rows and swept rows are
    separate partitions of the transition log, numbered two per batch. The clock
    is the greatest ``arrived_at`` so far, a column of the batches that the state
    does not keep. A due time is no clock: a waiting step's lies in the future.

    Every ``compact_every`` batches the state under the running batch becomes a
    snapshot, so a trigger opens the last snapshot's live steps, fewer than
    ``compact_every`` earlier batches and as many rows of the clock. A batch that
    is run again finds the snapshot there, or writes it again if it was lost.
    """

    def __init__(self, path: str, arrived_at: str = "arrived_at", compact_every: int = 16, buckets: int = 16):
        self.path = path
        self.arrived_at = arrived_at
        self.compact_every = compact_every
        self.table = StateTable(path, buckets)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        intake, swept = 2 * batch_id, 2 * batch_id + 1
        if batch_id and batch_id % self.compact_every == 0:
            self.table.compact(spark, intake - 1)
        # Each batch's clock holds the greatest time up to it, so the one before is enough.
        arrived = batch.agg(F.max(self.arrived_at).alias("at"))
        if batch_id:
            arrived = arrived.unionByName(self._clock(spark, batch_id - 1)).agg(F.max("at").alias("at"))
        append_rows(arrived, f"{self.path}-clock", batch_id)
        self.table.put(batch.drop(self.arrived_at), intake)
        as_of = self._clock(spark, batch_id).first()
        if as_of is not None and as_of[0] is not None:
            state = self.table.state(spark, before=swept, live_only=True)
            self.table.commit(recover.sweep(state, F.lit(as_of[0])), swept)

    def _clock(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.schema("at TIMESTAMP").parquet(f"{self.path}-clock/batch_id={batch_id}")

    def state(self, spark: SparkSession) -> DataFrame:
        return self.table.state(spark)

    def events(self, spark: SparkSession) -> DataFrame:
        return self.table.events(spark)


def event_rate_stream(events: DataFrame, width: str = "1 second", delay: str = "0 seconds") -> DataFrame:
    """Terminal events per window, each window once, after later terminal events have closed it."""
    ended = events.where(F.col("event_type").isin(*fixed.TERMINAL_EVENT_TYPES))
    return metrics.event_rate(ended.withWatermark("created_at", delay), width)
