"""Lifecycle metrics: per step, per run, percentiles, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions import fixed
from tenure.functions.scalars import ms_between, seconds_between, tenth
from tenure.operators.percentiles import exact_percentiles

FRACTIONS = (0.5, 0.95, 0.99)
LATENCIES = ("end_to_end", "queue_wait", "service")


def result_ok() -> Column:
    """The stored hash equals the SHA-256 of the payload's input."""
    return F.get_json_object("result", "$.hash") == F.sha2(F.get_json_object("payload", "$.input"), 256)


def verify_hash(steps: DataFrame) -> DataFrame:
    return steps.select("step_id", "status", F.coalesce(result_ok(), F.lit(False)).alias("result_ok"))


def per_step(steps: DataFrame, events: DataFrame) -> DataFrame:
    """First and last claim, terminal event and latencies of each step.

    One conditional aggregation of the events; they are narrowed to the few
    types and columns needed and combined before they move.
    """
    claimed = F.col("event_type") == fixed.STEP_CLAIMED
    ended = F.col("event_type").isin(*fixed.TERMINAL_EVENT_TYPES)
    seen = (
        events.where(F.col("event_type").isin(fixed.STEP_CLAIMED, *fixed.TERMINAL_EVENT_TYPES))
        .groupBy("step_id")
        .agg(
            F.min(F.when(claimed, F.col("created_at"))).alias("first_claim_at"),
            F.max(F.when(claimed, F.col("created_at"))).alias("last_claim_at"),
            F.count_if(claimed).alias("claims"),
            F.max(F.when(ended, F.col("created_at"))).alias("terminal_at"),
            F.count_if(ended).alias("terminal_events"),
        )
    )
    joined = steps.join(seen, "step_id", "left")
    ok = result_ok() if "result" in steps.columns else F.lit(None).cast("boolean")
    return joined.select(
        "step_id",
        "status",
        "available_at",
        "lease_version",
        "first_claim_at",
        "last_claim_at",
        F.when(F.col("claims") > 0, F.col("claims")).alias("claims"),
        "terminal_at",
        F.when(F.col("terminal_events") > 0, F.col("terminal_events")).alias("terminal_events"),
        ok.alias("result_ok"),
        ms_between(F.col("terminal_at"), F.col("available_at")).alias("end_to_end_ms"),
        ms_between(F.col("first_claim_at"), F.col("available_at")).alias("queue_wait_ms"),
        ms_between(F.col("terminal_at"), F.col("last_claim_at")).alias("service_ms"),
    )


def _not_one(column: str) -> Column:
    return F.count_if(~F.col(column).eqNullSafe(F.lit(1)))


def run_summary(steps: DataFrame) -> DataFrame:
    """One row over the result of :func:`per_step`: counts, spans in seconds, rates."""
    succeeded = F.col("status") == "SUCCEEDED"
    sums = steps.agg(
        F.count("*").alias("tasks"),
        F.count_if(succeeded).alias("succeeded"),
        F.count_if(succeeded & F.col("result_ok")).alias("results_verified"),
        F.count_if(F.col("lease_version") != 1).alias("reclaimed_tasks"),
        _not_one("claims").alias("not_claimed_exactly_once"),
        _not_one("terminal_events").alias("without_one_terminal_event"),
        F.min("available_at").alias("first_eligible_at"),
        F.max("available_at").alias("last_eligible_at"),
        F.max("terminal_at").alias("last_terminal_at"),
        F.min("first_claim_at").alias("first_claim_at"),
    )
    c = F.col
    wall = seconds_between(c("last_terminal_at"), c("first_eligible_at"))
    active = seconds_between(c("last_terminal_at"), c("first_claim_at"))
    return sums.select(
        *[name for name in sums.columns if name != "first_claim_at"],
        (c("tasks") - c("succeeded")).alias("failed"),
        wall.alias("wall_seconds"),
        seconds_between(c("last_eligible_at"), c("first_eligible_at")).alias("arrival_span_seconds"),
        ms_between(c("first_claim_at"), c("first_eligible_at")).alias("first_claim_delay_ms"),
        active.alias("active_seconds"),
        (c("succeeded") / F.nullif(wall, F.lit(0.0))).alias("tasks_per_second"),
        (c("succeeded") / F.nullif(active, F.lit(0.0))).alias("tasks_per_active_second"),
    )


def latencies_long(steps: DataFrame) -> DataFrame:
    """(metric, ms) rows of the three latencies."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_ms").alias("ms")) for m in LATENCIES])
    return steps.select(F.explode(pairs).alias("x")).select("x.metric", "x.ms").where(F.col("ms").isNotNull())


def latency_percentiles(steps: DataFrame, approximate: bool = False, digits: int = 2) -> DataFrame:
    """metric, n, p50, p95, p99 and max in ms; exact with interpolation unless told otherwise."""
    rows = latencies_long(steps)
    if approximate:
        found = rows.groupBy("metric").agg(
            F.count("*").alias("n"), F.max("ms").alias("max"), F.percentile_approx("ms", list(FRACTIONS), 10_000).alias("percentiles")
        )
    else:
        found = exact_percentiles(rows, ["metric"], "ms", FRACTIONS, fixed_keys=True)
    names = ("p50", "p95", "p99")
    return found.select(
        "metric", "n", *[F.round(F.col("percentiles")[i], digits).alias(n) for i, n in enumerate(names)], F.round("max", digits).alias("max")
    )


def spread(runs: DataFrame, by: str, rate: str, medians: Sequence[str] = ()) -> DataFrame:
    """Per configuration: runs, median, least and greatest rate, spread in percent of the median."""
    base = runs.groupBy(by).agg(F.count("*").alias("runs"), F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"))
    names = (rate, *medians)
    pairs = F.array(*[F.struct(F.lit(n).alias("__name"), F.col(n).cast("double").alias("__value")) for n in names])
    found = exact_percentiles(runs.select(by, F.inline(pairs)), [by, "__name"], "__value", (0.5,))
    of = lambda n: F.max(F.when(F.col("__name") == n, F.col("percentiles")[0])).alias(f"median_{n}")
    base = base.join(found.groupBy(by).agg(*[of(n) for n in names]), by, "left")
    centre = F.col(f"median_{rate}")
    return base.withColumn("spread_percent", tenth((F.col("max_rate") - F.col("min_rate")) / centre * 100))


def measurable(summary: DataFrame, expected_tasks: int, numbers: Sequence[str]) -> DataFrame:
    """``summary`` plus the reason a run must not be recorded, null when it may be."""
    bad = [
        F.when(F.col(n).isNull() | F.isnan(n) | (F.abs(F.col(n)) == float("inf")), F.lit(f"non-finite {n}")) for n in numbers
    ]
    reason = F.coalesce(
        F.when(F.col("tasks") != expected_tasks, F.lit("unexpected number of tasks")),
        *bad,
        F.when(F.col("wall_seconds") <= 0, F.lit("non-positive wall time")),
    )
    return summary.withColumn("refused", reason)


def event_rate(events: DataFrame, width: str = "1 second", at: str = "created_at") -> DataFrame:
    """Terminal events per tumbling window; also usable on a stream with a watermark."""
    ended = events.where(F.col("event_type").isin(*fixed.TERMINAL_EVENT_TYPES))
    counted = ended.groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "n")
