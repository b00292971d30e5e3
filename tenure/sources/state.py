"""Steps and their history as a log of batches with snapshots below it.

A batch is one partition of the log. A row holds the after-image of a step and, where
there was a transition, its event, so neither can be there without the other. A snapshot
holds the newest image of every step up to a batch, bucketed by step, live and ended
steps apart. The state is the last complete snapshot, less the steps that newer batches
hold, and those steps' newest images: what is read does not grow with the log.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tenure.functions import fixed
from tenure.operators.history import event_data
from tenure.schemas import schema

EVENT = ("event_type", "event_worker_id", "event_at", "event_data", "event_id")
# Events of one batch that get ids of their own.
IDS_PER_BATCH = 1 << 40
_SLICE_BITS = 16
_LIVE, _ENDED, _DONE = "live", "ended", "_DONE"
# Orders images of one step: the batch, and within a batch the generation and the time of the event.
_NEWEST = ("batch_id", "lease_version", "event_at")


def append_rows(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch as its own partition; writing it again replaces it."""
    (
        rows.withColumn("batch_id", F.lit(int(batch_id)).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def no_event() -> dict[str, Column]:
    text = F.lit(None).cast("string")
    nothing = {"event_type": text, "event_worker_id": text, "event_at": F.lit(None).cast("timestamp"), "event_data": text}
    return {**nothing, "event_id": F.lit(None).cast("bigint")}


def numbered(rows: DataFrame, batch_id: int) -> DataFrame:
    """``event_id`` of every row: batch, slice of the step's hash, place in the slice.

    Ids of a later batch are greater than all of an earlier one, and a batch written again
    gives the same ids. They are not dense: no task has to see all rows.
    """
    slice_ = F.call_function("shiftrightunsigned", F.xxhash64("step_id"), F.lit(64 - _SLICE_BITS))
    place = F.row_number().over(Window.partitionBy("__slice").orderBy("step_id", "lease_version", "event_type"))
    base = F.lit(int(batch_id) * IDS_PER_BATCH).cast("bigint")
    ids = base + F.col("__slice") * F.lit(IDS_PER_BATCH >> _SLICE_BITS) + place
    return rows.withColumn("__slice", slice_).withColumn("event_id", ids).drop("__slice")


class StateTable:
    """Log, snapshots and state below one path."""

    def __init__(self, path: str, buckets: int = 16):
        """``buckets``: parts of a snapshot; a snapshot keeps the number it was written with in its files."""
        self.path = path.rstrip("/")
        self.snapshots = f"{self.path}-snapshots"
        self.buckets = buckets

    # --- writing

    def put(self, images: DataFrame, batch_id: int) -> None:
        """Images without events: steps taken in."""
        append_rows(images.withColumns(no_event()), self.path, batch_id)

    def commit(self, transitions: DataFrame, batch_id: int) -> None:
        """State changes and their events together; rows without an event are rejections and change nothing.

        Writing a batch again replaces it and changes nothing, event ids included.
        """
        rows = transitions.where(F.col("event_type").isNotNull()).withColumn("event_data", event_data())
        columns = [c for c in schema("steps").names if c in rows.columns]
        append_rows(numbered(rows, batch_id).select(*columns, *EVENT), self.path, batch_id)

    # --- reading

    def batches(self, spark: SparkSession, above: int = -1, below: int | None = None) -> list[int]:
        """Numbers of the batches in the log, by the names of their folders."""
        found = _children(spark, self.path)
        numbers = sorted(int(name.partition("=")[2]) for name in found if name.startswith("batch_id="))
        return [n for n in numbers if n > above and (below is None or n < below)]

    def log(self, spark: SparkSession, above: int = -1, below: int | None = None) -> DataFrame | None:
        """Rows of the batches between two numbers, both exclusive; None if there are none. No other batch is opened."""
        numbers = self.batches(spark, above, below)
        if not numbers:
            return None
        paths = [f"{self.path}/batch_id={n}" for n in numbers]
        found = StructType([f for f in spark.read.parquet(paths[0]).schema if f.name != "event_id"])
        return spark.read.schema(found.add("event_id", "long").add("batch_id", "long")).option("basePath", self.path).parquet(*paths)

    def events(self, spark: SparkSession) -> DataFrame:
        """The history: the batch is the transaction (``xid``), ids grow with it."""
        rows = self.log(spark)
        if rows is None:
            return spark.createDataFrame([], schema("step_events").add("lease_version", "integer"))
        return rows.where(F.col("event_type").isNotNull()).select(
            F.col("event_id").alias("id"), "step_id", F.col("event_worker_id").alias("worker_id"), "event_type",
            F.col("event_data").alias("data"), F.col("event_at").alias("created_at"), F.col("batch_id").alias("xid"), "lease_version",
        )

    def state(self, spark: SparkSession, before: int | None = None, live_only: bool = False) -> DataFrame:
        """Newest image of every step, in batches under ``before`` if given.

        ``live_only`` leaves the ended steps of the snapshot unread; those that newer batches
        hold are there, whatever their status.
        """
        upto = self.last_snapshot(spark, before)
        tail = self.log(spark, -1 if upto is None else upto, before)
        newest = None if tail is None else _newest(tail)
        if upto is None:
            if newest is None:
                raise ValueError(f"no batch below {before} in {self.path}")
            return newest
        found = newest
        for kind in (_LIVE,) if live_only else (_LIVE, _ENDED):
            kept = self._snapshot(spark, upto, kind)
            if newest is not None:
                kept = kept.join(newest.select("step_id"), "step_id", "left_anti")
            found = kept if found is None else found.unionByName(kept, allowMissingColumns=True)
        return found

    # --- snapshots

    def last_snapshot(self, spark: SparkSession, before: int | None = None) -> int | None:
        """Batch of the last complete snapshot of batches under ``before``."""
        numbers = self._complete(spark)
        return max((n for n in numbers if before is None or n < before), default=None)

    def compact(self, spark: SparkSession, upto: int, keep: int = 2) -> bool:
        """Write the state of all batches up to ``upto`` as a snapshot; False if it is there or there is nothing to do.

        A snapshot counts once its marker is written, which comes last; one that was lost on
        the way is written again. Snapshots before the last ``keep`` are deleted, the log stays.
        """
        if upto in self._complete(spark) or not self.batches(spark, below=upto + 1):
            return False
        state = self.state(spark, before=upto + 1)
        ended = F.coalesce(F.col("status").isin(*fixed.TERMINAL_STATUSES), F.lit(False))
        for kind, rows in ((_LIVE, state.where(~ended)), (_ENDED, state.where(ended))):
            table = self._table(upto, kind)
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            delete(spark, self._place(upto, kind))
            # one task for each bucket, so that a bucket is one file
            dealt = rows.repartition(self.buckets, "step_id")
            dealt.write.bucketBy(self.buckets, "step_id").sortBy("step_id").option("path", self._place(upto, kind)).format("parquet").saveAsTable(table)
        _touch(spark, f"{self.snapshots}/upto={upto}/{_DONE}{self.buckets}")
        for old in sorted(self._complete(spark))[:-keep]:
            for kind in (_LIVE, _ENDED):
                spark.sql(f"DROP TABLE IF EXISTS {self._table(old, kind)}")
            delete(spark, f"{self.snapshots}/upto={old}")
        return True

    def _complete(self, spark: SparkSession) -> dict[int, int]:
        """Complete snapshots and their buckets."""
        found = {}
        for name in _children(spark, self.snapshots):
            for mark in _children(spark, f"{self.snapshots}/{name}"):
                if mark.startswith(_DONE):
                    found[int(name.partition("=")[2])] = int(mark.removeprefix(_DONE))
        return found

    def _place(self, upto: int, kind: str) -> str:
        return f"{self.snapshots}/upto={upto}/{kind}"

    def _table(self, upto: int, kind: str) -> str:
        return f"tenure_state_{md5(self.path.encode()).hexdigest()}_{upto}_{kind}"

    def _snapshot(self, spark: SparkSession, upto: int, kind: str) -> DataFrame:
        """A part of a snapshot with its buckets known to the planner, also in a session that did not write it."""
        table = self._table(upto, kind)
        if not spark.catalog.tableExists(table):
            place = self._place(upto, kind)
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(place).schema)
            buckets = self._complete(spark)[upto]
            spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (step_id) SORTED BY (step_id) INTO {buckets} BUCKETS LOCATION '{place}'"
            )
        return spark.table(table)


def _newest(rows: DataFrame) -> DataFrame:
    images = [c for c in rows.columns if c not in (*EVENT, "batch_id", "step_id")]
    newest = rows.groupBy("step_id").agg(F.max_by(F.struct(*images), F.struct(*_NEWEST)).alias("s"))
    return newest.select("step_id", "s.*")


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _children(spark: SparkSession, path: str) -> list[str]:
    files, place = _at(spark, path)
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    files, place = _at(spark, path)
    files.delete(place, True)


def _touch(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.create(place, True).close()
