"""Streaming queries and the transactional sink, run over the tables as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.functions import fixed
from tenure.functions.scalars import plus_ms
from tenure.operators import history, recover
from tenure.plans import views as v
from tenure.plans.arrivals import arriving, drain, drain_batches
from tenure.plans.lease_queries import BEGUN, REPLAY_DECISIONS, REPLAY_EVENTS, START, begun_steps, replay_ctes
from tenure.plans.registry import query
from tenure.plans.step_queries import _EXPIRED_SQL, _RECOVERED
from tenure.plans.views import AS_OF, LEASE_MS, with_views
from tenure.session import scratch_path, written
from tenure.sources.sinks import committed_events, current_state, write_transitions
from tenure.sources.state import StateTable
from tenure.streaming.batches import OrderedRelease, Sweeper, event_rate_stream
from tenure.streaming.effects import EffectLog
from tenure.streaming.heartbeats import heartbeat_stream
from tenure.streaming.lifecycle import lifecycle_stream
from tenure.streaming.tail import Tail


# The watermark counts in milliseconds.
_CLOCK = "(SELECT date_trunc('milliseconds', max({0})) FROM {1})"


@query(
    "src2_tail_events",
    with_views(f"""SELECT id, xid, step_id, event_type, created_at, position, (position - 1) // {fixed.STREAM_PAGE} AS page
        FROM (SELECT *, row_number() OVER (ORDER BY xid, id) AS position FROM v_plain_events)
        WHERE xid < (SELECT max(id) + 1 FROM v_plain_events)"""),
)
def _(spark, sf):
    """The log arrives in three parts, each followed up to what no later commit can precede; pages of a poll's size."""
    e = v.plain_events(spark, sf).select("id", "xid", "step_id", "event_type", "created_at")
    news, steps = arriving(e, "log", "id", parts=3)
    tail = Tail(steps.read, scratch_path(spark, "tail"), lambda log: log.agg(F.max("id") + 1).first()[0], slice_width=v.LOG_SLICE)
    drain_batches(news, tail, "tail-state", steps)
    return tail.events(spark)


@query("snk1_write_transitions", with_views(f"{_RECOVERED} {_EXPIRED_SQL}"))
def _(spark, sf):
    """Written twice, as after a lost driver: state and history come back once, together."""
    path = scratch_path(spark, "transitions")
    moved = recover.recover_expired(v.steps(spark, sf), AS_OF, limit=None)
    for _attempt in range(2):
        write_transitions(moved, path, 1)
    state = current_state(spark, path).select("step_id", "status", "current_worker_id", "lease_version", "attempt_count")
    told = committed_events(spark, path).select("step_id", "event_type", F.col("worker_id").alias("event_worker_id"), "data")
    return state.join(told, "step_id")


_LATER = "1999-03-01 00:00:00"


def _swept_until(spark, sf) -> StateTable:
    """All steps taken in, swept at two times, with a snapshot in between."""
    table = StateTable(scratch_path(spark, "swept"), buckets=8)
    table.put(v.steps(spark, sf), 0)
    table.commit(recover.sweep(table.state(spark, live_only=True), AS_OF), 1)
    table.compact(spark, 1)
    table.commit(recover.sweep(table.state(spark, live_only=True), _LATER), 2)
    return table


_SWEEPS = f"""sweeps AS (SELECT *,
    CASE WHEN due_at <= TIMESTAMP '{AS_OF}' THEN 1 WHEN due_at <= TIMESTAMP '{_LATER}' THEN 2 END AS xid,
    CASE WHEN status = 'RETRY_WAIT' THEN 'RETRY_READY' WHEN attempt_count < max_attempts THEN 'LEASE_RECOVERED' ELSE 'STEP_DEAD_LETTERED' END AS event_type
  FROM (SELECT *, CASE status WHEN 'RUNNING' THEN lease_expires_at WHEN 'RETRY_WAIT' THEN available_at END AS due_at FROM v_steps))"""


@query(
    "snk1_snapshot_state",
    with_views(
        """SELECT step_id, lease_version, attempt_count, CASE WHEN xid IS NULL THEN current_worker_id END AS current_worker_id,
          CASE WHEN xid IS NULL THEN status WHEN event_type = 'STEP_DEAD_LETTERED' THEN 'DEAD_LETTERED' ELSE 'READY' END AS status FROM sweeps""",
        _SWEEPS,
    ),
)
def _(spark, sf):
    """The snapshot with the newer batch laid over it."""
    return _swept_until(spark, sf).state(spark).select("step_id", "lease_version", "attempt_count", "current_worker_id", "status")


@query(
    "snk1_committed_history",
    with_views(
        """SELECT step_id, event_type || ':v' || lease_version AS history, CAST(xid AS BIGINT) AS xid, CASE WHEN status = 'RUNNING' THEN current_worker_id END AS worker_id
        FROM sweeps WHERE xid IS NOT NULL""",
        _SWEEPS,
    ),
)
def _(spark, sf):
    """Events read back with their generations, none lost by a reader that follows ids, next to each step's history."""
    events = _swept_until(spark, sf).events(spark)
    lost = history.missed_by_id_cursor(events).select("id")
    found = events.join(lost, "id", "left_anti").select("step_id", "xid", "worker_id")
    return history.history(events).join(found, "step_id")


def _lifecycle(spark, sf):
    stream, steps = arriving(v.fold_writes(spark, sf), "writes")
    return drain(lifecycle_stream(stream, LEASE_MS), "lifecycle", steps)


_WRITES_CLOCK = _CLOCK.format("ts", "events")
# Writes naming an unreachable generation need no clock: they are rejected as they come.
_HOPELESS = f"""UNION ALL SELECT step_id, seq, op, false FROM v_fold_writes
    WHERE op <> 'CLAIM' AND lease_version NOT BETWEEN 1 AND 3 AND ts > {_WRITES_CLOCK}"""


@query("stm1_lifecycle_decisions", with_views(REPLAY_DECISIONS + _HOPELESS, *replay_ctes(_WRITES_CLOCK), recursive=True))
def _(spark, sf):
    return _lifecycle(spark, sf).where(F.col("seq").isNotNull()).select("step_id", "seq", "op", "accepted")


@query("stm1_lifecycle_events", with_views(REPLAY_EVENTS, *replay_ctes(_WRITES_CLOCK), recursive=True))
def _(spark, sf):
    rows = _lifecycle(spark, sf).where(F.col("event_type").isNotNull())
    return rows.select("step_id", "lease_version", "event_type", F.col("at").alias("created_at"), "worker_id", "reason", "error")


_GIVEN = (BEGUN, *replay_ctes(_WRITES_CLOCK, start=START))
_GIVEN_HOPELESS = f"""UNION ALL SELECT step_id, seq, op, false FROM v_fold_writes JOIN ({START}) s USING (step_id)
    WHERE op <> 'CLAIM' AND lease_version NOT BETWEEN version AND version + greatest(budget - attempts, 0) AND ts > {_WRITES_CLOCK}"""


def _given_lifecycle(spark, sf):
    log = v.fold_writes(spark, sf)
    stream, steps = arriving(log, "writes")
    return drain(lifecycle_stream(stream, LEASE_MS, steps=written(begun_steps(log), "begun")), "lifecycle", steps)


@query("stm1_given_decisions", with_views(REPLAY_DECISIONS + _GIVEN_HOPELESS, *_GIVEN, recursive=True))
def _(spark, sf):
    """Steps begin in any state, each with its own budget."""
    return _given_lifecycle(spark, sf).where(F.col("seq").isNotNull()).select("step_id", "seq", "op", "accepted")


@query("stm1_given_events", with_views(REPLAY_EVENTS, *_GIVEN, recursive=True))
def _(spark, sf):
    """Every step, also one that only unreachable generations are named of."""
    rows = _given_lifecycle(spark, sf).where(F.col("event_type").isNotNull())
    return rows.select("step_id", "lease_version", "event_type", F.col("at").alias("created_at"), "worker_id", "reason", "error")


@query(
    "stm3_dedupe_effects",
    with_views("""
        SELECT idempotency_key, seq, CASE WHEN rn = 1 THEN 'APPLIED' WHEN effect_type = t1 AND request = r1 THEN 'REUSED' ELSE 'CONFLICT' END AS outcome
        FROM (SELECT *, row_number() OVER w AS rn, first_value(effect_type) OVER w AS t1, first_value(request) OVER w AS r1
          FROM v_effect_requests WINDOW w AS (PARTITION BY idempotency_key ORDER BY ts, seq))"""),
)
def _(spark, sf):
    requests, steps = arriving(v.effect_requests(spark, sf), "requests", "ts", parts=3)
    log = EffectLog(scratch_path(spark, "effect-log"))
    drain_batches(requests, log, "effects", steps)
    return log.outcomes(spark).select("idempotency_key", "seq", "outcome")


_STALE_S = 6 * 3600


@query(
    "stm4_heartbeat_alerts",
    with_views(f"""
        SELECT worker_id, ts AS last_heartbeat_at, ts + to_seconds({_STALE_S}) AS silent_since
        FROM (SELECT DISTINCT worker_id, ts, lead(ts) OVER (PARTITION BY worker_id ORDER BY ts) AS following FROM v_beats)
        WHERE coalesce(following > ts + to_seconds({_STALE_S}), true) AND ts + to_seconds({_STALE_S}) <= {_CLOCK.format('ts', 'v_beats')}"""),
)
def _(spark, sf):
    stream, steps = arriving(v.beats(spark, sf), "beats", "ts", parts=3)
    return drain(heartbeat_stream(stream, _STALE_S), "alerts", steps)


@query(
    "stm5_ordered_release",
    with_views("SELECT id, xid, step_id, event_type FROM v_plain_events WHERE xid < (SELECT max(id) + 1 FROM v_plain_events)"),
)
def _(spark, sf):
    """A later event has a greater id, and no commit number is under its id: so far up to the greatest id."""
    e = v.plain_events(spark, sf).select("id", "xid", "step_id", "event_type")
    release = OrderedRelease(scratch_path(spark, "release"), lambda batch, _: batch.agg(F.max("id") + 1).first()[0])
    stream, steps = arriving(e, "arrivals", "id", parts=3)
    drain_batches(stream, release, "release", steps)
    return release.released(spark)


@query(
    "stm6_event_rate",
    with_views(
        f"""SELECT date_trunc('minute', created_at) AS window_start, count(*) AS n FROM ended
        GROUP BY 1 HAVING date_trunc('minute', min(created_at)) + INTERVAL 1 MINUTE <= {_CLOCK.format('created_at', 'ended')}""",
        "ended AS (SELECT * FROM v_plain_events WHERE event_type IN ('STEP_SUCCEEDED', 'STEP_DEAD_LETTERED'))",
    ),
)
def _(spark, sf):
    e = v.plain_events(spark, sf).select("id", "event_type", "created_at")
    stream, steps = arriving(e, "ended", "created_at", parts=3)
    return drain(event_rate_stream(stream, "1 minute"), "rates", steps)


@query(
    "stm7_sweep_stream",
    with_views("""
        SELECT step_id, CASE WHEN status = 'RUNNING' AND lease_expires_at <= clock THEN CASE WHEN attempt_count < max_attempts THEN 'READY' ELSE 'DEAD_LETTERED' END
            WHEN status = 'RETRY_WAIT' AND available_at <= clock THEN 'READY' ELSE status END AS status, lease_version, attempt_count
        FROM v_steps, (SELECT max(CASE WHEN status = 'RETRY_WAIT' THEN available_at - to_days(CAST(step_id % 60 AS INTEGER))
          ELSE available_at END) AS clock FROM v_steps)"""),
)
def _(spark, sf):
    """A step waiting for a retry arrives up to 59 days before it is due, any other when it is available."""
    sweeper = Sweeper(scratch_path(spark, "sweeps"))
    waits = F.when(F.col("status") == "RETRY_WAIT", (F.col("step_id") % 60) * 86_400_000).otherwise(0)
    told = v.steps(spark, sf).withColumn("arrived_at", plus_ms(F.col("available_at"), -waits))
    stream, steps = arriving(told, "steps", "arrived_at", parts=3)
    drain_batches(stream, sweeper, "sweeps", steps)
    return sweeper.state(spark).select("step_id", "status", "lease_version", "attempt_count")
