"""Small tables for tests."""

from datetime import datetime, timedelta

from tenure.schemas import schema

NOW = datetime(2024, 6, 1, 12, 0, 0)


def at(seconds: float) -> datetime:
    return NOW + timedelta(seconds=seconds)


def steps(spark, rows):
    """Rows of dicts over a READY default."""
    default = {
        "step_id": "s", "status": "READY", "priority": 0, "available_at": at(-1), "current_worker_id": None,
        "lease_version": 0, "attempt_count": 0, "max_attempts": 3, "last_error": None, "lease_expires_at": None,
        "task_type": "fail_then_hash", "payload": '{"input":"x","failuresBeforeSuccess":0}', "result": None,
        "created_at": at(-60), "updated_at": at(-60),
    }
    s = schema("steps")
    return spark.createDataFrame([tuple({**default, **r}[c] for c in s.names) for r in rows], s)


def table(spark, kind, rows):
    s = schema(kind)
    return spark.createDataFrame([tuple(r.get(c) for c in s.names) for r in rows], s)


def running(step_id, worker="a", version=1, attempts=1, deadline=10.0, **more):
    return {
        "step_id": step_id, "status": "RUNNING", "current_worker_id": worker, "lease_version": version,
        "attempt_count": attempts, "lease_expires_at": at(deadline), **more,
    }


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
