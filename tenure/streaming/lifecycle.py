"""The lifecycle of every step as a stream: the same rules as the batch replay.

Rows later than the watermark are dropped (and counted by Spark); rows within it
wait in state and are taken in (ts, seq) order once the watermark has passed
them, so the outcome does not depend on how the input is cut into batches.
Expiry and retry times are event-time timers.
"""

from __future__ import annotations

import json
from collections.abc import Generator, Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from tenure.functions import fixed

_STEP = "status STRING, version INT, attempts INT, budget INT, worker STRING, deadline BIGINT, due BIGINT"
_WRITE = "ts BIGINT, seq BIGINT, op STRING, worker_id STRING, lease_version INT, retryable BOOLEAN, error STRING"
_STEP_NAMES, _WRITE_NAMES = ([column.split()[0] for column in ddl.split(",")] for ddl in (_STEP, _WRITE))
# Steps are kept in buckets, a value each: a call to the state is a trip to the JVM and back and a group's output a batch
# of its own, either of which costs more than reading and writing some hundred steps.
BUCKETS = 16_384
# A step's waiting writes up to so many are kept with it; more go to a list, which moves in parts.
_INLINE = 64
_OUT = """
    seq BIGINT, op STRING, accepted BOOLEAN, event_type STRING, lease_version INT, attempt_count INT, at BIGINT,
    worker_id STRING, reason STRING, error STRING
"""
# Places in a kept step, after step_id and _STEP.
_NEXT = 1 + len(_STEP_NAMES)
_LISTED, _WAITING = _NEXT + 1, _NEXT + 2
_ENDED = ("SUCCEEDED", "DEAD_LETTERED", "CANCELLED")
_out_row = Row("step_id", *[column.split()[0] for column in _OUT.split(",")])


def _struct(ddl: str) -> str:
    return f"STRUCT<{', '.join(column.strip().replace(' ', ': ', 1) for column in ddl.split(','))}>"


def _change(step: tuple) -> int | None:
    """When a step changes though nothing is written."""
    return step[5] if step[0] == "RUNNING" else step[6] if step[0] == "RETRY_WAIT" else None


class _Lifecycle(StatefulProcessor):
    """The steps of a bucket: each with its row, the instant it next changes at and the writes that wait."""

    def __init__(self, lease_us: int, max_attempts: int, key_type: str, given: bool = False):
        self.lease_us = lease_us
        self.max_attempts = max_attempts
        self.given = given
        kept = f"step_id {key_type}, {_STEP}, next BIGINT, listed BOOLEAN"
        self.bucket_schema = f"timer BIGINT, steps ARRAY<{_struct(kept)[:-1]}, waiting: ARRAY<{_struct(_WRITE)}>>>"
        self.list_schema = f"step_id {key_type}, {_WRITE}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", self.bucket_schema)
        self.waiting = handle.getListState("waiting", self.list_schema)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """The given steps of a bucket that change at an instant of their own, all in one row."""
        steps = [(*(told := tuple(step.values())), _change(told[1:]), False, []) for step in initialState[1]]
        first = -(-min(entry[_NEXT] for entry in steps) // 1000)
        self.handle.registerTimer(first)
        self.bucket.update((first, steps))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        return self._advance(rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advance((), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _advance(self, rows, watermark_ms: int, fired: int | None = None) -> Iterator[Row]:
        now = watermark_ms * 1000
        timer, kept = self.bucket.get() or (None, ())
        # Rows of the state go back into it as plain tuples.
        steps = {entry[0]: (*entry[:_WAITING], [tuple(write) for write in entry[_WAITING]]) for entry in kept}
        listed: dict = {}
        if any(entry[_LISTED] for entry in steps.values()):
            for write in self.waiting.get():
                listed.setdefault(write[0], []).append(tuple(write)[1:])
        arrived: dict = {}
        for row in rows:
            step, told = row[2], tuple(json.loads(row[3]).values())
            write = told[: len(_WRITE_NAMES)]
            entry = steps.get(step)
            if entry is None:
                begun = told[len(_WRITE_NAMES) :] if self.given else ("READY", 0, 0, self.max_attempts, None, None, None)
                entry = steps[step] = (step, *begun, None, False, ())
            # Generations only go up and ended steps stay ended: no need to wait for a verdict.
            if entry[1] in _ENDED or (write[2] != "CLAIM" and write[4] < entry[2]):
                yield self._out(step, write[1], write[2], False)
            else:
                arrived.setdefault(step, []).append(write)

        changed = len(steps) > len(kept)
        relisted = False
        for step, entry in steps.items():
            if step not in arrived and (entry[_NEXT] is None or entry[_NEXT] > now):
                continue
            waited = listed.get(step, ()) if entry[_LISTED] else entry[_WAITING]
            begun, later = yield from self._step(step, entry[1:_NEXT], chain(waited, arrived.get(step, ())), now)
            change = _change(begun)
            due = min((w[0] for w in later), default=None)
            due = change if due is None else due if change is None else min(due, change)
            many = len(later) > _INLINE
            if many or entry[_LISTED]:
                relisted = True
                listed[step] = later if many else []
            steps[step] = (step, *begun, due, many, [] if many else later)
            changed = True

        if relisted:
            left = [(step, *write) for step, writes in listed.items() for write in writes]
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        first = min((entry[_NEXT] for entry in steps.values() if entry[_NEXT] is not None), default=None)
        # Later than the watermark, so never the timer that has just fired; Spark deletes that one itself.
        wanted = None if first is None else -(-first // 1000)
        if timer != wanted:
            if timer is not None and timer != fired:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if changed or timer != wanted:
            self.bucket.update((wanted, list(steps.values())))

    def _step(self, key, begun: tuple, writes, now: int) -> Generator[Row, None, tuple[tuple, list]]:
        """One step up to ``now``: its row then, and the writes that still wait."""
        status, version, attempts, budget, worker, deadline, due = begun
        ready, later = [], []
        for write in writes:
            write = tuple(write)
            (ready if write[0] <= now else later).append(write)

        for write in [*sorted(ready, key=lambda w: (w[0], w[1])), None]:
            at = now if write is None else write[0]
            if status == "RUNNING" and deadline is not None and deadline <= at:
                spent = attempts >= budget
                status = "DEAD_LETTERED" if spent else "READY"
                kind, reason = (
                    (fixed.STEP_DEAD_LETTERED, fixed.REASON_LEASE_BUDGET) if spent else (fixed.LEASE_RECOVERED, None)
                )
                yield self._out(key, None, None, True, kind, version, attempts, deadline, worker, reason)
                worker = deadline = due = None
            elif status == "RETRY_WAIT" and due <= at:
                status = "READY"
                yield self._out(key, None, None, True, fixed.RETRY_READY, version, attempts, due)
            if write is None:
                break
            ts, seq, op, who, named, retryable, error = write
            if op == "CLAIM":
                if status != "READY" or attempts >= budget or (due is not None and due > ts):
                    yield self._out(key, seq, op, False)
                    continue
                status, version, attempts, worker, deadline, due = "RUNNING", version + 1, attempts + 1, who, ts + self.lease_us, None
                yield self._out(key, seq, op, True, fixed.STEP_CLAIMED, version, attempts, ts, worker)
                continue
            if status != "RUNNING" or who != worker or named != version:
                yield self._out(key, seq, op, False)
                continue
            if op == "RENEW":
                deadline = ts + self.lease_us
                yield self._out(key, seq, op, True)
                continue
            if op == "COMPLETE":
                status, kind, reason, error = "SUCCEEDED", fixed.STEP_SUCCEEDED, None, None
            elif retryable and attempts < budget:
                doublings = min(max(attempts - 1, 0), fixed.BACKOFF_MAX_DOUBLINGS)
                status, kind, reason = "RETRY_WAIT", fixed.STEP_RETRY_SCHEDULED, None
                due = ts + fixed.BACKOFF_BASE_MS * 1000 * 2**doublings
            else:
                status, kind = "DEAD_LETTERED", fixed.STEP_DEAD_LETTERED
                reason = fixed.REASON_BUDGET if retryable else fixed.REASON_NON_RETRYABLE
            yield self._out(key, seq, op, True, kind, version, attempts, ts, worker, reason, error)
            worker = deadline = None

        if status in _ENDED:
            for write in later:
                yield self._out(key, write[1], write[2], False)
            later = []
        return (status, version, attempts, budget, worker, deadline, due), later

    def _out(self, key, seq, op, accepted, kind=None, version=None, attempts=None, at=None, worker=None, reason=None, error=None) -> Row:
        return _out_row(key, seq, op, accepted, kind, version, attempts, at, worker, reason, error)


def _begun(steps: DataFrame) -> DataFrame:
    """Rows of steps in the columns that are kept of them."""
    micros = lambda c: F.unix_micros(F.col(c))
    waits = F.col("status").isin("READY", "RETRY_WAIT")
    begun = {
        "status": F.col("status"), "version": F.col("lease_version"), "attempts": F.col("attempt_count"), "budget": F.col("max_attempts"),
        "worker": F.col("current_worker_id"), "deadline": F.when(F.col("status") == "RUNNING", micros("lease_expires_at")), "due": F.when(waits, micros("available_at")),
    }
    return steps.select("step_id", *[begun[name].alias(name) for name in _STEP_NAMES])


def _as_begun(rows: DataFrame, steps: DataFrame, max_attempts: int) -> DataFrame:
    """Writes with their step's row at the start; a step that is not known begins READY and unclaimed."""
    known = _begun(steps).select("step_id", *[F.col(name).alias(f"begun_{name}") for name in _STEP_NAMES])
    fresh = {"status": "READY", "version": 0, "attempts": 0, "budget": max_attempts}
    joined = rows.join(known, "step_id", "left")
    return joined.withColumns({f"begun_{name}": F.coalesce(f"begun_{name}", F.lit(value)) for name, value in fresh.items()})


def _timed(steps: DataFrame, key: StructField, bucket: Column) -> DataFrame:
    """Steps that change at an instant of their own, whether or not they are written to; a row per bucket."""
    ends = F.when(F.col("status") == "RUNNING", F.col("deadline")).when(F.col("status") == "RETRY_WAIT", F.col("due"))
    timed = _begun(steps).where(ends.isNotNull()).withColumn("step_id", F.col("step_id").cast(key.dataType))
    return timed.groupBy(bucket).agg(F.collect_list(F.struct("step_id", *_STEP_NAMES)).alias("steps"))


def lifecycle_stream(
    writes: DataFrame,
    lease_ms: int = fixed.DEFAULT_LEASE_MS,
    delay: str = "0 seconds",
    max_attempts: int = fixed.DEFAULT_MAX_ATTEMPTS,
    steps: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Decisions and events of a stream of owner writes.

    One row per owner write (seq and op set, accepted or not) and per timed
    transition (seq and op null). Rows that changed a status carry the event.
    Writes naming a generation no step can reach are judged without state.

    ``steps``, a table that does not change while the stream runs, has steps as they
    were before the writes, each with its own ``max_attempts``. Those that are leased or
    wait for a retry are in the state from the first batch on, so they change in time even
    if nothing, or nothing that can be reached, is written to them. Other steps only change
    by writes: the first that is a claim or can be reached brings the row into the state.

    ``buckets``, fixed for the life of a checkpoint, is the number of groups that steps are
    kept in; a batch reads and writes the buckets of its steps and those with a timer due.
    """
    key = writes.schema["step_id"]
    out = StructType([StructField("step_id", key.dataType), *StructType.fromDDL(_OUT).fields])
    marked = writes.withWatermark("ts", delay)
    reachable = F.col("lease_version").between(1, max_attempts)
    if steps is not None:
        marked = _as_begun(marked, steps, max_attempts)
        left = F.greatest(F.col("begun_budget") - F.col("begun_attempts"), F.lit(0))
        reachable = F.col("lease_version").between(F.col("begun_version"), F.col("begun_version") + left)
    reachable = F.coalesce((F.col("op") == "CLAIM") | reachable, F.lit(False))
    write = [F.unix_micros("ts").alias("ts_us"), *[F.col(name) for name in _WRITE_NAMES[1:]]]
    given = [] if steps is None else [F.col(f"begun_{name}") for name in _STEP_NAMES]
    bucket = F.pmod(F.xxhash64("step_id"), F.lit(buckets)).alias("bucket")
    # A worker takes rows apart cell by cell, so all that is told of a write travels in one.
    told = F.to_json(F.struct(*write, *given), {"ignoreNullFields": "false"})
    rows = marked.where(reachable).select(bucket, "ts", "step_id", told.alias("told"))
    judged = rows.groupBy("bucket").transformWithState(
        _Lifecycle(lease_ms * 1000, max_attempts, key.dataType.simpleString(), steps is not None),
        outputStructType=out, outputMode="Append", timeMode="EventTime",
        initialState=None if steps is None else _timed(steps, key, bucket).groupBy("bucket"),
    )
    judged = judged.select(*[F.timestamp_micros("at").alias("at") if f == "at" else F.col(f) for f in out.names])
    hopeless = marked.where(~reachable).select(
        *[
            F.col(f.name) if f.name in ("step_id", "seq", "op") else F.lit(False).alias("accepted") if f.name == "accepted"
            else F.lit(None).cast("timestamp" if f.name == "at" else f.dataType).alias(f.name)
            for f in out.fields
        ]
    )
    return judged.unionByName(hopeless)
