"""Writing transitions and event wire rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.schemas import EVENT_DATA
from tenure.sources.state import StateTable, append_rows

__all__ = ["append_rows", "committed_events", "current_state", "event_wire", "write_transitions"]


def write_transitions(transitions: DataFrame, path: str, batch_id: int) -> None:
    """Commit state changes and their events together, once for each batch number."""
    StateTable(path).commit(transitions, batch_id)


def current_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Newest after-image of every step written, in batches under ``before`` if given."""
    return StateTable(path).state(spark, before)


def committed_events(spark: SparkSession, path: str) -> DataFrame:
    """The history those rows hold, with ids, generations and the batch as commit number."""
    return StateTable(path).events(spark)


def event_wire(events: DataFrame) -> DataFrame:
    """Wire form of events, without the commit number, and the row as one JSON text."""
    rows = events.select(
        "id",
        F.col("step_id").alias("stepId"),
        F.col("worker_id").alias("workerId"),
        F.col("event_type").alias("eventType"),
        F.from_json("data", EVENT_DATA).alias("parsed"),
        "data",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("createdAt"),
    )
    wire = F.struct("id", "stepId", "workerId", "eventType", F.col("parsed").alias("data"), "createdAt")
    return rows.select("id", "stepId", "workerId", "eventType", "data", "createdAt", F.to_json(wire).alias("wire"))
