"""The three task computations as one expression per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions import fixed
from tenure.operators.effects import apply_effects, receipt_requests
from tenure.operators.validate import validate_tasks


def run_tasks(steps: DataFrame) -> DataFrame:
    """Validated steps plus ``result`` of the two hash tasks; null where a task fails.

    Effect tasks need the effect store: see :func:`run_effect_tasks`.
    """
    checked = validate_tasks(steps)
    hashed = F.to_json(F.struct(F.sha2(F.get_json_object("payload", "$.input"), 256).alias("hash")))
    hashing = F.col("task_type").isin(fixed.HASH_AFTER_DELAY, fixed.FAIL_THEN_HASH) & F.col("error_class").isNull()
    return checked.withColumn("result", F.when(hashing, hashed))


def run_effect_tasks(steps: DataFrame, store: DataFrame) -> DataFrame:
    """Valid effect tasks with the outcome and stored result of their one receipt."""
    valid = validate_tasks(steps).where((F.col("task_type") == fixed.IDEMPOTENT_EFFECT) & F.col("error_class").isNull())
    outcomes = apply_effects(receipt_requests(valid), store, order=("available_at", "step_id"))
    return outcomes.select("step_id", "idempotency_key", "request", "outcome", "result")
