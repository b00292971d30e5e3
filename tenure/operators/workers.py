"""Worker registrations and heartbeats: evidence of life, never of ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions import fixed
from tenure.functions.scalars import instant, seconds_between, tenth
from tenure.operators.ordered import join_one, salt


def latest_registration(registrations: DataFrame, beats: DataFrame) -> DataFrame:
    """Current row per worker: last registration, and the last beat at or after it.

    A registration is its own first beat and overwrites the older row. Beats
    before the first registration belong to :func:`unregistered_beats`.
    """
    both = registrations.select("worker_id", F.col("ts").alias("registered_at"), "ts").unionByName(
        beats.select("worker_id", F.lit(None).cast("timestamp").alias("registered_at"), "ts")
    )
    # A beat after the last registration is later than it, one before it is
    # overwritten by it: either way the greatest instant is the current one.
    seen = both.groupBy("worker_id").agg(F.max("registered_at").alias("started_at"), F.max("ts").alias("last_heartbeat_at"))
    return seen.where(F.col("started_at").isNotNull())


def unregistered_beats(beats: DataFrame, registrations: DataFrame) -> DataFrame:
    """Beats of workers not registered by then; each is an error."""
    first = registrations.groupBy("worker_id").agg(F.min("ts").alias("__since"))
    joined = join_one(beats, first, ["worker_id"], salt("ts"), "left")
    return joined.where(F.col("__since").isNull() | (F.col("ts") < F.col("__since"))).drop("__since")


def heartbeat_age(workers: DataFrame, as_of, stale_s: float = fixed.HEARTBEAT_STALE_S) -> DataFrame:
    age = seconds_between(instant(as_of), F.col("last_heartbeat_at"))
    return workers.select("worker_id", tenth(age).alias("age_s"), (age > stale_s).alias("stale"))


def liveness_vs_lease(steps: DataFrame, workers: DataFrame, as_of, stale_s: float = fixed.HEARTBEAT_STALE_S) -> DataFrame:
    """RUNNING steps by heartbeat (fresh, stale, unknown) and lease (live, expired).

    The lease alone decides; the worker's row may be missing. Counted per worker
    first, so that a busy worker's steps do not meet its row one by one.
    """
    held = (
        steps.where(F.col("status") == "RUNNING")
        .groupBy(
            F.col("current_worker_id").alias("worker_id"),
            F.when(F.col("lease_expires_at") <= instant(as_of), "expired").otherwise("live").alias("lease"),
        )
        .agg(F.count("*").alias("n"))
    )
    aged = heartbeat_age(workers, as_of, stale_s).select("worker_id", "stale")
    joined = held.join(aged, "worker_id", "left")
    beat = F.when(F.col("stale").isNull(), "unknown").when(F.col("stale"), "stale").otherwise("fresh")
    return joined.groupBy(beat.alias("heartbeat"), "lease").agg(F.sum("n").alias("steps"))
