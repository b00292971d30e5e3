"""The event log followed by a cursor: every event once, in commit order, in bounded pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions import fixed
from tenure.operators.history import START, XID_SLICE, Cursor, xid_slice
from tenure.operators.ordered import Running, running
from tenure.sources.state import append_rows

_CURSOR = "xid BIGINT, id BIGINT, position BIGINT"


class Tail:
    """Read on behind a cursor, up to the oldest transaction that may still write.

    For ``foreachBatch`` of any stream that tells of news; its rows are not looked at. A
    trigger takes everything between the cursor and the watermark in one pass and cuts it
    into pages of ``page`` events: pages follow each other without a gap over triggers, and
    each is short enough for one poll of a reader. Ids come out of order where commits do;
    what lies behind an open transaction waits for it, so nothing is skipped or repeated.

    Two folders below ``path``, one partition per batch each: ``events`` and ``cursor``.
    A batch run again begins at the cursor of the batch before and replaces what it wrote.
    """

    def __init__(
        self,
        log: Callable[[SparkSession], DataFrame],
        path: str,
        watermark: Callable[[DataFrame], int | None],
        page: int = fixed.STREAM_PAGE,
        start: Cursor = START,
        slice_width: int = XID_SLICE,
    ):
        """``watermark(log)``: the oldest transaction that may still write, None if that is not known now."""
        if page < 1:
            raise ValueError(f"a page needs at least one event, got {page}")
        self.log, self.path, self.watermark, self.page, self.start, self.slice_width = log, path, watermark, page, start, slice_width

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = self.log(spark)
        at = self.cursor(spark, batch_id - 1)
        upto = self.watermark(log)
        xid, id_ = F.col("xid"), F.col("id")
        # The comparisons on xid alone reach the file statistics, the rest settles ties.
        due = log.where((xid >= at["xid"]) & ((xid > at["xid"]) | (id_ > at["id"])) & (xid < (at["xid"] if upto is None else upto)))
        counted = running(due, [], ["xid", "id"], xid_slice(self.slice_width), position=Running("sum", F.lit(1).cast("bigint")))
        place = F.col("position") + F.lit(at["position"])
        paged = counted.withColumns({"position": place, "page": F.floor((place - 1) / self.page).cast("bigint")})
        append_rows(paged.repartitionByRange("xid", "id").sortWithinPartitions("xid", "id"), f"{self.path}/events", batch_id)
        last = self._batch(spark, batch_id, log).agg(F.max(F.struct("xid", "id", "position")).alias("c")).first()["c"]
        reached = [(last["xid"], last["id"], last["position"])] if last else [(at["xid"], at["id"], at["position"])]
        append_rows(spark.createDataFrame(reached, _CURSOR), f"{self.path}/cursor", batch_id)

    def _batch(self, spark: SparkSession, batch_id: int, log: DataFrame) -> DataFrame:
        schema = log.schema.add("position", "long").add("page", "long")
        # A batch without events leaves no folder.
        return spark.read.schema(schema).option("basePath", f"{self.path}/events").parquet(f"{self.path}/events").where(F.col("batch_id") == batch_id)

    def cursor(self, spark: SparkSession, batch_id: int) -> dict:
        """Where the batch left off."""
        if batch_id < 0:
            return {"xid": self.start.xid, "id": self.start.id, "position": 0}
        return spark.read.schema(_CURSOR).parquet(f"{self.path}/cursor/batch_id={batch_id}").first().asDict()

    def events(self, spark: SparkSession) -> DataFrame:
        """All events passed on so far, each with its position (from 1) and page (from 0)."""
        return spark.read.parquet(f"{self.path}/events").drop("batch_id")

    def poll(self, spark: SparkSession, page: int) -> DataFrame:
        """One page, in order: what a reader gets in one poll."""
        return self.events(spark).where(F.col("page") == page).orderBy("position")
