"""Schemas of the relations."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "steps": """
        step_id STRING, status STRING, priority INT, available_at TIMESTAMP, current_worker_id STRING,
        lease_version INT, attempt_count INT, max_attempts INT, last_error STRING, lease_expires_at TIMESTAMP,
        task_type STRING, payload STRING, result STRING, created_at TIMESTAMP, updated_at TIMESTAMP
    """,
    "step_events": """
        id BIGINT, step_id STRING, worker_id STRING, event_type STRING, data STRING, created_at TIMESTAMP, xid BIGINT
    """,
    "workers": "worker_id STRING, started_at TIMESTAMP, last_heartbeat_at TIMESTAMP",
    "idempotent_effects": """
        idempotency_key STRING, effect_type STRING, request STRING, result STRING, created_at TIMESTAMP
    """,
    "owner_writes": """
        seq BIGINT, step_id STRING, worker_id STRING, lease_version INT, op STRING, ts TIMESTAMP,
        retryable BOOLEAN, error STRING, result STRING
    """,
    "effect_requests": """
        idempotency_key STRING, effect_type STRING, request STRING, ts TIMESTAMP, seq BIGINT
    """,
    "client_grants": "claimer_id STRING, step_id STRING, lease_version INT, attempt_count INT",
    "claimer_counters": """
        claimer_id STRING, attempts BIGINT, empty BIGINT, consistency_errors BIGINT, other_errors BIGINT
    """,
    "effect_observations": "step_id STRING, applied BOOLEAN, effect_id STRING",
    "heartbeats": "worker_id STRING, ts TIMESTAMP",
}

EVENT_DATA = "leaseVersion INT, attemptCount INT, availableAt STRING, error STRING, reason STRING, previousWorkerId STRING"

KINDS = tuple(_DDL)


def schema(kind: str) -> StructType:
    """Schema of one relation; raises ``KeyError`` for an unknown kind."""
    return StructType.fromDDL(_DDL[kind])
