"""Alerts for workers that fall silent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions import fixed


def silences(beats: DataFrame, stale_s: float = fixed.HEARTBEAT_STALE_S) -> DataFrame:
    """One row per silence: worker_id, last_heartbeat_at, silent_since.

    Beats of a worker up to ``stale_s`` apart belong to one session; its last beat starts
    the silence. So each silence counts, however the beats are cut into batches, and the
    last session of a worker counts too: the caller knows how far the beats reach.
    """
    session = F.session_window("ts", f"{round(stale_s * 1000)} milliseconds")
    return beats.groupBy("worker_id", session).agg(F.max("ts").alias("last_heartbeat_at")).select(
        "worker_id", "last_heartbeat_at", F.col("session_window.end").alias("silent_since")
    )


def heartbeat_stream(beats: DataFrame, stale_s: float = fixed.HEARTBEAT_STALE_S, delay: str = "0 seconds") -> DataFrame:
    """``silences`` of a stream, each once, after the watermark has passed silent_since."""
    return silences(beats.withWatermark("ts", delay), stale_s)
