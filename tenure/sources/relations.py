"""Typed reads of the relations, the tail of the event log, and generated steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions import fixed
from tenure.functions.scalars import instant
from tenure.schemas import schema


def read_relation(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One relation from parquet, with its fixed schema, so no file is opened to infer it."""
    return spark.read.schema(schema(kind)).parquet(path)


def tail_relation(spark: SparkSession, path: str, kind: str, max_files: int | None = None) -> DataFrame:
    """A relation's folder as a stream; the checkpoint of the query is the cursor.

    A trigger takes all files that are new, or at most ``max_files`` of them.
    """
    stream = spark.readStream.schema(schema(kind))
    if max_files is not None:
        stream = stream.option("maxFilesPerTrigger", max_files)
    return stream.parquet(path)


def tail_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The event log as a stream. Start the query with ``trigger(processingTime=fixed.TAIL_POLL)``."""
    return tail_relation(spark, path, "step_events", max_files)


def synthetic_steps(spark: SparkSession, n: int, kind: str, eligible_at, max_attempts: int = fixed.DEFAULT_MAX_ATTEMPTS) -> DataFrame:
    """``n`` READY steps of one task type, generated in parallel, all eligible at one instant."""
    number = F.col("g").cast("string")
    payloads = {
        fixed.FAIL_THEN_HASH: F.struct(
            F.concat(F.lit("bench-"), number).alias("input"), F.lit(0).alias("failuresBeforeSuccess")
        ),
        fixed.HASH_AFTER_DELAY: F.struct(F.concat(F.lit("bench-"), number).alias("input"), F.lit(0).alias("delayMs")),
        fixed.IDEMPOTENT_EFFECT: F.struct(
            F.concat(F.lit("idem-"), number).alias("value"), F.lit(0).alias("delayAfterEffectMs")
        ),
    }
    digest = F.sha2(F.concat(F.lit(f"{kind}-"), number), 256)
    parts = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    at = instant(eligible_at)
    nothing = F.lit(None)
    return spark.range(1, n + 1).withColumnRenamed("id", "g").select(
        F.concat_ws("-", *parts).alias("step_id"),
        F.lit("READY").alias("status"),
        F.lit(0).alias("priority"),
        at.alias("available_at"),
        nothing.cast("string").alias("current_worker_id"),
        F.lit(0).alias("lease_version"),
        F.lit(0).alias("attempt_count"),
        F.lit(max_attempts).alias("max_attempts"),
        nothing.cast("string").alias("last_error"),
        nothing.cast("timestamp").alias("lease_expires_at"),
        F.lit(kind).alias("task_type"),
        F.to_json(payloads[kind]).alias("payload"),
        nothing.cast("string").alias("result"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )
