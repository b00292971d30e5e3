"""Three-way audit of ownership: what claimers were told, the events, the step rows.

Everything is aggregated per (step, generation) before anything is joined, so a
step claimed again and again costs one row per generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions import fixed
from tenure.functions.scalars import tenth


def duplicate_grants(grants: DataFrame) -> DataFrame:
    """Generations more than one grant was given for."""
    counted = grants.groupBy("step_id", "lease_version").agg(
        F.count("*").alias("grants"),
        F.count_distinct("claimer_id").alias("claimers"),
        F.min("claimer_id").alias("first_claimer"),
    )
    return counted.where(F.col("grants") > 1)


def _sides(df: DataFrame, owner: str, prefix: str) -> DataFrame:
    return df.groupBy("step_id", "lease_version").agg(
        F.count("*").alias(f"{prefix}_n"), F.min(owner).alias(f"{prefix}_owner")
    )


def grants_vs_events(grants: DataFrame, events: DataFrame) -> DataFrame:
    """Generations where grants and claim events do not match one to one.

    problem: GRANT_WITHOUT_MATCHING_EVENT or EVENT_WITHOUT_GRANT.
    """
    claims = events.where(F.col("event_type") == fixed.STEP_CLAIMED)
    joined = _sides(grants, "claimer_id", "grant").join(
        _sides(claims, "worker_id", "event"), ["step_id", "lease_version"], "full"
    )
    single = (F.col("grant_n") == 1) & (F.col("event_n") == 1) & (F.col("grant_owner") == F.col("event_owner"))
    problem = F.when(F.col("grant_n").isNull(), "EVENT_WITHOUT_GRANT").when(
        ~F.coalesce(single, F.lit(False)), "GRANT_WITHOUT_MATCHING_EVENT"
    )
    return joined.select(
        "step_id",
        "lease_version",
        F.coalesce("grant_n", F.lit(0)).alias("grants"),
        F.coalesce("event_n", F.lit(0)).alias("events"),
        problem.alias("problem"),
    ).where(F.col("problem").isNotNull())


def generation_gaps(grants: DataFrame, steps: DataFrame) -> DataFrame:
    """Steps whose grants are not exactly generations 1 to lease_version, once each."""
    seen = grants.groupBy("step_id").agg(
        F.count("*").alias("grants"),
        F.count_distinct("lease_version").alias("generations"),
        F.min("lease_version").alias("first_generation"),
        F.max("lease_version").alias("last_generation"),
    )
    joined = steps.select("step_id", "lease_version").join(seen, "step_id", "left")
    none = F.col("grants").isNull() & (F.col("lease_version") == 0)
    exact = (
        (F.col("grants") == F.col("lease_version"))
        & (F.col("generations") == F.col("lease_version"))
        & (F.col("first_generation") == 1)
        & (F.col("last_generation") == F.col("lease_version"))
    )
    return joined.where(~(none | F.coalesce(exact, F.lit(False)))).select(
        "step_id",
        "lease_version",
        F.coalesce("grants", F.lit(0)).alias("grants"),
        F.coalesce("generations", F.lit(0)).alias("generations"),
        "first_generation",
        "last_generation",
    )


def running_owner_mismatch(steps: DataFrame, grants: DataFrame) -> DataFrame:
    """RUNNING steps whose owner is not the one granted the current generation."""
    granted = grants.groupBy("step_id", "lease_version").agg(F.min("claimer_id").alias("granted_to"))
    held = steps.where(F.col("status") == "RUNNING").select("step_id", "lease_version", "current_worker_id")
    joined = held.join(granted, ["step_id", "lease_version"], "left")
    return joined.where(F.col("granted_to").isNull() | ~F.col("granted_to").eqNullSafe(F.col("current_worker_id")))


def claimer_summary(counters: DataFrame, grants: DataFrame, steps: DataFrame) -> DataFrame:
    """One row: claim attempts and outcomes, grants per claimer, generations per step."""
    per_claimer = grants.groupBy("claimer_id").agg(F.count("*").alias("grants"))
    totals = counters.groupBy("claimer_id").agg(
        *[F.sum(c).alias(c) for c in ("attempts", "empty", "consistency_errors", "other_errors")]
    )
    joined = totals.join(per_claimer, "claimer_id", "left").withColumn("grants", F.coalesce("grants", F.lit(0)))
    sums = joined.agg(
        F.count("*").alias("claimers"),
        F.sum("attempts").alias("attempted_claims"),
        F.sum("grants").alias("successful_claims"),
        F.sum("empty").alias("empty_claims"),
        F.sum("consistency_errors").alias("claim_consistency_errors"),
        F.sum("other_errors").alias("other_errors"),
        F.count_if(F.col("grants") > 0).alias("claimers_with_a_grant"),
        F.min("grants").alias("min_grants"),
        F.max("grants").alias("max_grants"),
        F.lit(1).alias("one"),
    )
    generations = steps.agg(
        F.min("lease_version").alias("min_generations"),
        F.max("lease_version").alias("max_generations"),
        tenth(F.avg("lease_version")).alias("mean_generations"),
        F.lit(1).alias("one"),
    )
    return sums.join(generations, "one").drop("one")
