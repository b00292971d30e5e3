"""Eligibility, ranking and assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions import fixed
from tenure.functions.scalars import instant, plus_ms, seconds_between, tenth
from tenure.operators.ordered import ranked


def _claim_order():
    return [F.desc_nulls_last("priority"), F.asc_nulls_last("available_at"), F.asc_nulls_last("step_id")]


def by_status(steps: DataFrame, *statuses: str) -> DataFrame:
    return steps.where(F.col("status").isin(*statuses))


def unfinished(steps: DataFrame) -> DataFrame:
    """Steps in no terminal status."""
    return steps.where(~F.col("status").isin(*fixed.TERMINAL_STATUSES))


def any_in_status(steps: DataFrame, *statuses: str) -> DataFrame:
    """One row with column ``busy``; stops at the first match."""
    probe = by_status(steps, *statuses).select(F.lit(1).alias("hit")).limit(1)
    return probe.agg((F.count("hit") > 0).alias("busy"))


def expired(steps: DataFrame, as_of) -> DataFrame:
    """RUNNING steps whose deadline has come; the deadline itself is too late."""
    return steps.where((F.col("status") == "RUNNING") & (F.col("lease_expires_at") <= instant(as_of)))


def lease_clock(steps: DataFrame, as_of) -> DataFrame:
    """Signed seconds of lease left, to 0.1 s, and whether the deadline has passed."""
    now = instant(as_of)
    left = seconds_between(F.col("lease_expires_at"), now)
    return steps.select(
        "step_id",
        "status",
        tenth(left).alias("lease_remaining_s"),
        (F.col("lease_expires_at") <= now).alias("deadline_passed"),
    )


def claimable(steps: DataFrame, as_of) -> DataFrame:
    """READY, available, and with attempts left."""
    return steps.where(
        (F.col("status") == "READY")
        & (F.col("available_at") <= instant(as_of))
        & (F.col("attempt_count") < F.col("max_attempts"))
    )


def next_claimable(steps: DataFrame, as_of, k: int) -> DataFrame:
    """The first ``k`` in claim order: priority down, availability up, id up."""
    return claimable(steps, as_of).orderBy(*_claim_order()).limit(k)


def next_claimable_per(steps: DataFrame, as_of, k: int, by: str) -> DataFrame:
    """The first ``k`` of each group. Spark cuts each group to ``k`` before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*_claim_order()))
    return claimable(steps, as_of).withColumn("rank", rank).where(F.col("rank") <= k)


def excluding_busy(steps: DataFrame, busy: DataFrame) -> DataFrame:
    """Steps not held by another session; ``busy`` has the held step_id values."""
    return steps.join(busy.select("step_id").distinct(), "step_id", "left_anti")


def assign_batch(steps: DataFrame, workers: DataFrame, as_of, lease_ms: int, k: int | None = None) -> DataFrame:
    """Match the first ``k`` claimable steps with the first ``k`` workers, one each; all of them without ``k``.

    Returns the after-image of each claim, with the worker's id. Both sides are ranked by
    range, see :func:`tenure.operators.ordered.ranked`, so ``k`` may be as large as a table.
    """
    now = instant(as_of)
    chosen = ranked(claimable(steps, as_of), _claim_order(), "slot")
    idle = ranked(workers.select("worker_id").distinct(), [F.col("worker_id")], "slot")
    if k is not None:
        chosen, idle = chosen.where(F.col("slot") <= k), idle.where(F.col("slot") <= k)
    return (
        chosen.join(idle, "slot")
        .drop("slot")
        .withColumns(
            {
                "status": F.lit("RUNNING"),
                "current_worker_id": F.col("worker_id"),
                "lease_version": F.col("lease_version") + 1,
                "attempt_count": F.col("attempt_count") + 1,
                "lease_expires_at": plus_ms(now, lease_ms),
                "event_type": F.lit(fixed.STEP_CLAIMED),
                "event_at": now,
            }
        )
    )
