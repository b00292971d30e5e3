"""Lease recovery, retry promotion, and the attempt budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions import fixed
from tenure.functions.scalars import instant
from tenure.operators.select import expired


def _budget_left() -> Column:
    return F.col("attempt_count") < F.col("max_attempts")


def due(steps: DataFrame, as_of) -> DataFrame:
    """RETRY_WAIT steps whose wait is over."""
    return steps.where((F.col("status") == "RETRY_WAIT") & (F.col("available_at") <= instant(as_of)))


def _recovery(as_of) -> dict[str, Column]:
    left = _budget_left()
    return {
        "event_type": F.when(left, F.lit(fixed.LEASE_RECOVERED)).otherwise(F.lit(fixed.STEP_DEAD_LETTERED)),
        # The event names the owner that lost the step, so it is read before the owner is cleared.
        "event_worker_id": F.col("current_worker_id"),
        "reason": F.when(~left, F.lit(fixed.REASON_LEASE_BUDGET)),
        "event_at": instant(as_of),
        "status": F.when(left, F.lit("READY")).otherwise(F.lit("DEAD_LETTERED")),
        "current_worker_id": F.lit(None).cast("string"),
        "lease_expires_at": F.lit(None).cast("timestamp"),
    }


def _promotion(as_of) -> dict[str, Column]:
    return {
        "event_type": F.lit(fixed.RETRY_READY),
        "event_worker_id": F.lit(None).cast("string"),
        "reason": F.lit(None).cast("string"),
        "event_at": instant(as_of),
        "status": F.lit("READY"),
    }


def _oldest_first(rows: DataFrame, by: str, limit: int | None) -> DataFrame:
    # Without a bound nothing needs sorting.
    return rows if limit is None else rows.orderBy(F.asc(by), F.asc("step_id")).limit(limit)


def recover_expired(steps: DataFrame, as_of, limit: int | None = fixed.SWEEP_LIMIT) -> DataFrame:
    """After-images and events of expired leases, oldest deadline first.

    Steps with attempts left become READY, the others DEAD_LETTERED; counters,
    payload and last error stay. ``limit=None`` drains all of them.
    """
    return _oldest_first(expired(steps, as_of), "lease_expires_at", limit).withColumns(_recovery(as_of))


def promote_due(steps: DataFrame, as_of, limit: int | None = fixed.SWEEP_LIMIT) -> DataFrame:
    """After-images and events of due retries, oldest first; the budget is not looked at again."""
    return _oldest_first(due(steps, as_of), "available_at", limit).withColumns(_promotion(as_of))


def sweep(steps: DataFrame, as_of) -> DataFrame:
    """Recovery and promotion in one pass; their statuses are disjoint."""
    running = F.col("status") == "RUNNING"
    now = instant(as_of)
    rows = steps.where(
        (running & (F.col("lease_expires_at") <= now))
        | ((F.col("status") == "RETRY_WAIT") & (F.col("available_at") <= now))
    )
    recovery, promotion = _recovery(as_of), _promotion(as_of)
    return rows.withColumns(
        {
            name: F.when(running, value).otherwise(promotion.get(name, F.col(name) if name in steps.columns else None))
            for name, value in recovery.items()
        }
    )


def attempt_budget(steps: DataFrame) -> DataFrame:
    """Claims used and left; every claim counts, also one that ended in a crash."""
    left = F.greatest(F.col("max_attempts") - F.col("attempt_count"), F.lit(0))
    return steps.select(
        "step_id",
        F.col("attempt_count").alias("claims_used"),
        left.alias("claims_left"),
        (~_budget_left()).alias("exhausted"),
    )
