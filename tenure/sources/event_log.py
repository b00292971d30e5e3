"""The event history laid out for its three readings: pages, pages of one step, an event's place.

Each batch is written twice, in files of bounded length that hold one range each: by
(xid, id), and by (step_id, xid, id). A small table, a row per file, tells which range
lies where; it decides which files a reading opens, so a page costs the same whatever the
length of the log. Files carry Parquet Bloom filters on the ids that are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions import fixed
from tenure.operators.history import START, Cursor, page, page_limit
from tenure.sources.state import append_rows

_BY = {"commits": ("xid", "id"), "steps": ("step_id", "xid", "id")}
ROWS_PER_FILE = 1_000_000


class EventLog:
    """Events below ``path``; ``append`` takes them in, a batch number at a time."""

    def __init__(self, path: str, rows_per_file: int = ROWS_PER_FILE, rows_per_group: int = 100_000):
        self.path = path.rstrip("/")
        self.rows_per_file = rows_per_file
        self.rows_per_group = rows_per_group

    # --- writing

    def append(self, events: DataFrame, batch_id: int) -> None:
        """Write a batch, both copies and then what lies where; writing it again replaces it.

        A batch can be read once its last part is there: a reader goes by the table of files.
        """
        spark = events.sparkSession
        for copy, order in _BY.items():
            rows = events.repartitionByRange(*order).sortWithinPartitions(*order)
            (
                rows.withColumn("batch_id", F.lit(int(batch_id)).cast("bigint"))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .option("maxRecordsPerFile", self.rows_per_file)
                .option("parquet.block.row.count.limit", self.rows_per_group)
                .option(f"parquet.bloom.filter.enabled#{'id' if copy == 'commits' else 'step_id'}", "true")
                .partitionBy("batch_id")
                .parquet(f"{self.path}/{copy}")
            )
            written = spark.read.schema(events.schema.add("batch_id", "long")).parquet(f"{self.path}/{copy}")
            key = F.struct(*order)
            ranges = written.where(F.col("batch_id") == batch_id).groupBy(F.col("_metadata.file_path").alias("file")).agg(
                F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
            )
            append_rows(ranges, f"{self.path}/{copy}-files", batch_id)

    # --- reading

    def files(self, spark: SparkSession, copy: str) -> DataFrame:
        """file, n, low, high, first_id, last_id of every file of a copy."""
        return spark.read.parquet(f"{self.path}/{copy}-files")

    def events(self, spark: SparkSession) -> DataFrame:
        """All of them."""
        return spark.read.parquet(f"{self.path}/commits").drop("batch_id")

    def page(
        self, spark: SparkSession, after: Cursor = START, watermark: int | None = None, limit: int = fixed.DEFAULT_PAGE, step_id=None
    ) -> DataFrame:
        """As :func:`tenure.operators.history.page`, from the files that can hold the page.

        The end of a page is bounded from the table of files alone: of the files that lie
        behind the cursor as a whole, those with the lowest ends that hold ``limit`` events
        between them hold as many events up to the last of those ends. At most ``limit`` rows
        of that table are fetched for it. Files that begin later are not opened.
        """
        size = page_limit(limit)
        copy, prefix = ("commits", ()) if step_id is None else ("steps", (step_id,))
        ranges = self.files(spark, copy)
        begin = _point(ranges, (*prefix, after.xid, after.id))
        most = (*prefix, 2**63 - 1, 2**63 - 1)
        within = ranges.where((F.col("low") > begin) & (F.col("high") <= _point(ranges, most)))
        if watermark is not None:
            within = within.where(F.col("high.xid") < watermark)
        held = 0
        for row in within.orderBy("high").limit(size).select("n", "high").collect():
            held += row["n"]
            if held >= size:
                most = tuple(row["high"])
                break
        end = _point(ranges, most)
        opened = ranges.where((F.col("high") > begin) & (F.col("low") <= end))
        rows = self._rows(spark, copy, opened).where(F.struct(*_BY[copy]) <= end)
        return page(rows, after, watermark, size, step_id)

    def cursor_of(self, spark: SparkSession, event_id: int) -> DataFrame:
        """(xid, id) of an event, from the files whose ids enclose it."""
        opened = self.files(spark, "commits").where((F.col("first_id") <= event_id) & (F.col("last_id") >= event_id))
        return self._rows(spark, "commits", opened).where(F.col("id") == event_id).select("xid", "id")

    def _rows(self, spark: SparkSession, copy: str, opened: DataFrame) -> DataFrame:
        names = [r["file"] for r in opened.select("file").collect()]  # the files of one page, or those around one id
        whole = spark.read.parquet(f"{self.path}/{copy}").drop("batch_id")
        if not names:
            return whole.where(F.lit(False))
        return spark.read.schema(whole.schema).parquet(*names)


def _point(ranges: DataFrame, values: tuple) -> Column:
    """A key as a literal of the files' key type."""
    fields = ranges.schema["low"].dataType.fields
    return F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(values, fields, strict=True)])
