"""Queries over leases, generations and owner writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.operators import fold, lease
from tenure.operators.history import event_data
from tenure.plans import views as v
from tenure.plans.registry import query
from tenure.plans.views import EVENTS_END, LEASE_MS, STEP_LEASE_MS, with_views
from tenure.session import written

_LEASE = f"to_milliseconds({LEASE_MS})"
_STEP_LEASE = f"to_milliseconds({STEP_LEASE_MS})"

# Generations with windows over whole steps, as plain SQL would do it.
_SPAN_CTES = (
    """placed AS (
        SELECT *, max(CASE WHEN op = 'CLAIM' THEN lease_version END) OVER w AS in_force,
          last_value(CASE WHEN op = 'CLAIM' THEN worker_id END IGNORE NULLS) OVER w AS owner
        FROM v_writes WINDOW w AS (PARTITION BY step_id ORDER BY ts, seq))""",
    f"""mine AS (
        SELECT p.*, c.ts AS claimed_at, coalesce(max(CASE WHEN p.op = 'RENEW' THEN p.ts END) OVER (
            PARTITION BY p.step_id, p.lease_version ORDER BY p.ts, p.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c.ts)
            + {_LEASE} AS due
        FROM placed p JOIN v_writes c ON c.op = 'CLAIM' AND c.step_id = p.step_id AND c.lease_version = p.lease_version
        WHERE p.op <> 'CLAIM' AND p.lease_version = p.in_force AND p.worker_id = p.owner)""",
    """judged AS (
        SELECT *, coalesce(sum(CASE WHEN (op = 'RENEW' AND ts >= due) OR (op <> 'RENEW' AND ts < due) THEN 1 ELSE 0 END) OVER (
            PARTITION BY step_id, lease_version ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
            AND ts < due AS counts
        FROM mine)""",
    f"""spans AS (
        SELECT c.step_id, c.lease_version, c.worker_id, c.ts AS claimed_at,
          count(j.seq) FILTER (j.op = 'RENEW') AS renewals, max(j.ts) FILTER (j.op = 'RENEW') AS last_renewed_at,
          coalesce(max(j.ts) FILTER (j.op = 'RENEW'), c.ts) + {_LEASE} AS deadline,
          max(j.op) FILTER (j.op <> 'RENEW') AS end_op, max(j.ts) FILTER (j.op <> 'RENEW') AS end_ts,
          max(j.seq) FILTER (j.op <> 'RENEW') AS end_seq, min(n.ts) AS next_at
        FROM v_writes c
        LEFT JOIN judged j ON j.counts AND j.step_id = c.step_id AND j.lease_version = c.lease_version
        LEFT JOIN v_writes n ON n.op = 'CLAIM' AND n.step_id = c.step_id AND n.lease_version = c.lease_version + 1
        WHERE c.op = 'CLAIM' GROUP BY c.step_id, c.lease_version, c.worker_id, c.ts)""",
)


@query(
    "lea1_lease_spans",
    with_views(
        """SELECT step_id, lease_version, worker_id, claimed_at, renewals, last_renewed_at, deadline,
          CASE WHEN end_op IS NOT NULL THEN end_op WHEN next_at < deadline THEN 'SUPERSEDED' ELSE 'EXPIRED' END AS ended_by,
          CASE WHEN end_op IS NOT NULL THEN end_ts WHEN next_at < deadline THEN next_at ELSE deadline END AS ended_at
        FROM spans""",
        *_SPAN_CTES,
    ),
)
def _(spark, sf):
    return lease.lease_spans(v.writes(spark, sf), LEASE_MS).drop("end_seq")


_DECIDED = """decided AS (
    SELECT p.*, CASE
        WHEN p.in_force IS NULL THEN 'NEVER_CLAIMED'
        WHEN (p.ts, p.seq) > (s.end_ts, s.end_seq) THEN 'NOT_RUNNING'
        WHEN p.worker_id <> s.worker_id THEN 'WRONG_WORKER'
        WHEN p.lease_version <> p.in_force THEN 'STALE_VERSION'
        WHEN p.ts >= s.deadline THEN 'LEASE_EXPIRED' ELSE 'ACCEPTED' END AS decision,
      CASE WHEN p.in_force IS NULL THEN 'before_first_claim'
        WHEN p.lease_version < p.in_force AND (p.ts, p.seq) > (s.end_ts, s.end_seq) THEN 'after_successor_ended'
        WHEN p.lease_version < p.in_force AND p.ts < s.deadline THEN 'successor_live'
        WHEN (p.ts, p.seq) > (s.end_ts, s.end_seq) THEN 'after_end'
        WHEN p.ts >= s.deadline THEN 'expired_before_recovery' ELSE 'live' END AS phase
    FROM placed p LEFT JOIN spans s ON s.step_id = p.step_id AND s.lease_version = p.in_force
    WHERE p.op <> 'CLAIM')"""


@query(
    "fen2_authorize_asof",
    with_views(
        "SELECT seq, step_id, op, in_force, decision, decision = 'ACCEPTED' AS accepted, phase FROM decided", *_SPAN_CTES, _DECIDED
    ),
)
def _(spark, sf):
    rows = lease.authorize_asof(v.writes(spark, sf), LEASE_MS)
    return rows.select("seq", "step_id", "op", "in_force", "decision", "accepted", "phase")


@query(
    "fen3_stale_summary",
    with_views(
        """SELECT phase, op, count(*) AS attempts, count(*) FILTER (decision = 'ACCEPTED') AS accepted,
          count(*) FILTER (coalesce(lease_version < in_force, false) OR phase <> 'live') AS stale_attempts,
          count(*) FILTER ((coalesce(lease_version < in_force, false) OR phase <> 'live') AND decision = 'ACCEPTED') AS stale_accepted
        FROM decided GROUP BY phase, op""",
        *_SPAN_CTES,
        _DECIDED,
    ),
)
def _(spark, sf):
    return lease.stale_summary(lease.authorize_asof(v.writes(spark, sf), LEASE_MS))


_AUTH = """CASE WHEN s.step_id IS NULL THEN 'NO_SUCH_STEP' WHEN s.status <> 'RUNNING' THEN 'NOT_RUNNING'
    WHEN s.current_worker_id <> w.worker_id THEN 'WRONG_WORKER' WHEN s.lease_version <> w.lease_version THEN 'STALE_VERSION'
    WHEN s.lease_expires_at <= w.ts THEN 'LEASE_EXPIRED' ELSE 'ACCEPTED' END"""
_JUDGED = f"""judged AS (SELECT w.*, {_AUTH} AS decision FROM v_step_writes w LEFT JOIN v_steps s USING (step_id))"""


@query(
    "fen1_authorize",
    with_views("SELECT seq, step_id, op, decision, decision = 'ACCEPTED' AS accepted FROM judged", _JUDGED),
)
def _(spark, sf):
    return lease.authorize(v.steps(spark, sf), v.step_writes(spark, sf)).select("seq", "step_id", "op", "decision", "accepted")


# Owner writes one by one: a renewal in time moves the deadline, the first end in time is the last write that counts.
_REPLAYED = (
    """owned AS (SELECT w.*, s.lease_expires_at AS due, row_number() OVER (PARTITION BY w.step_id ORDER BY w.ts, w.seq) AS i
        FROM v_step_writes w JOIN v_steps s ON s.step_id = w.step_id AND s.status = 'RUNNING' AND s.lease_version > 0
          AND s.lease_version = w.lease_version AND s.current_worker_id = w.worker_id)""",
    f"""replayed AS (SELECT step_id, CAST(0 AS BIGINT) AS i, due AS deadline, CAST(0 AS BIGINT) AS renewals, CAST(0 AS BIGINT) AS last FROM owned WHERE i = 1
        UNION ALL SELECT o.step_id, o.i,
          CASE WHEN r.last = 0 AND o.op = 'RENEW' AND o.ts < r.deadline THEN o.ts + {_STEP_LEASE} ELSE r.deadline END,
          r.renewals + CASE WHEN r.last = 0 AND o.op = 'RENEW' AND o.ts < r.deadline THEN 1 ELSE 0 END,
          CASE WHEN r.last = 0 AND o.op <> 'RENEW' AND o.ts < r.deadline THEN o.i ELSE r.last END
        FROM replayed r JOIN owned o ON o.step_id = r.step_id AND o.i = r.i + 1)""",
    "final AS (SELECT * FROM replayed QUALIFY row_number() OVER (PARTITION BY step_id ORDER BY i DESC) = 1)",
)


@query(
    "fen3_rejected_left_alone",
    with_views(
        """SELECT step_id, rejected, coalesce(step_id % 53 = 0, false) AS row_changed, coalesce(more, 0) AS new_events
        FROM (SELECT step_id, count(*) AS rejected FROM judged GROUP BY step_id HAVING count(*) FILTER (decision = 'ACCEPTED') = 0)
        LEFT JOIN (SELECT l_orderkey AS step_id, count(*) AS more FROM lineitem WHERE l_partkey % 59 = 0 GROUP BY 1) USING (step_id)
        WHERE step_id % 53 = 0 AND step_id IN (SELECT step_id FROM v_steps) OR more > 0""",
        _JUDGED,
    ),
)
def _(spark, sf):
    """Planted: a row in 53 has moved, and lines of some parts have left a second event."""
    before = v.steps(spark, sf)
    moved = F.col("attempt_count") + F.when(F.col("step_id") % 53 == 0, 1).otherwise(0)
    told = v.line_events(spark, sf)
    again = v.table(spark, sf, "lineitem").where(F.col("l_partkey") % 59 == 0).select(F.col("l_orderkey").alias("step_id"))
    decisions = lease.authorize(before, v.step_writes(spark, sf))
    return lease.rejected_left_alone(decisions, before, before.withColumn("attempt_count", moved), told.select("step_id"), told.select("step_id").unionByName(again))


@query(
    "fen4_apply_renewals",
    with_views(
        """SELECT step_id, 'RUNNING' AS status, lease_version, current_worker_id, deadline AS lease_expires_at, renewals
        FROM final JOIN v_steps USING (step_id) WHERE renewals > 0 AND last = 0""",
        *_REPLAYED,
        recursive=True,
    ),
)
def _(spark, sf):
    rows = lease.apply_renewals(v.steps(spark, sf), v.step_writes(spark, sf), STEP_LEASE_MS)
    return rows.select("step_id", "status", "lease_version", "current_worker_id", "lease_expires_at", "renewals")


_ENDED = ("step_id", "status", "lease_version", "attempt_count", "current_worker_id", "event_type", "event_worker_id", "event_at")
_WON = """won AS (SELECT o.step_id, o.seq, o.ts, o.retryable, o.error, o.result, o.worker_id, s.lease_version, s.attempt_count, s.max_attempts, s.available_at
    FROM final f JOIN owned o ON o.step_id = f.step_id AND o.i = f.last JOIN v_steps s ON s.step_id = o.step_id WHERE o.op = '{op}')"""


@query(
    "fen5_apply_completions",
    with_views(
        """SELECT step_id, 'SUCCEEDED' AS status, lease_version, attempt_count, CAST(NULL AS VARCHAR) AS current_worker_id,
          'STEP_SUCCEEDED' AS event_type, worker_id AS event_worker_id, ts AS event_at, result,
          '{"leaseVersion":' || lease_version || ',"attemptCount":' || attempt_count || '}' AS data FROM won""",
        *_REPLAYED,
        _WON.format(op="COMPLETE"),
        recursive=True,
    ),
)
def _(spark, sf):
    rows = lease.apply_completions(v.steps(spark, sf), v.step_writes(spark, sf), STEP_LEASE_MS)
    return rows.select(*_ENDED, "result", event_data().alias("data"))


@query(
    "fen6_apply_failures",
    with_views(
        """SELECT step_id, CASE WHEN retry THEN 'RETRY_WAIT' ELSE 'DEAD_LETTERED' END AS status, lease_version, attempt_count,
          CAST(NULL AS VARCHAR) AS current_worker_id,
          CASE WHEN retry THEN 'STEP_RETRY_SCHEDULED' ELSE 'STEP_DEAD_LETTERED' END AS event_type,
          worker_id AS event_worker_id, ts AS event_at, error AS last_error, due AS available_at,
          '{"leaseVersion":' || lease_version || ',"attemptCount":' || attempt_count || CASE
            WHEN retry THEN ',"availableAt":"' || strftime(due, '%Y-%m-%d %H:%M:%S.%f') || '"'
            WHEN retryable THEN ',"reason":"attempt_budget_exhausted"' ELSE ',"reason":"non_retryable_failure"' END
            || ',"error":"' || CASE WHEN length(error) <= 200 THEN error ELSE substr(error, 1, 199) || '…' END || '"}' AS data
        FROM (SELECT *, retryable AND attempt_count < max_attempts AS retry,
            CASE WHEN retryable AND attempt_count < max_attempts
              THEN ts + to_milliseconds(CAST(500 * power(2, least(greatest(attempt_count - 1, 0), 3)) AS BIGINT))
              ELSE available_at END AS due FROM won)""",
        *_REPLAYED,
        _WON.format(op="FAIL"),
        recursive=True,
    ),
)
def _(spark, sf):
    rows = lease.apply_failures(v.steps(spark, sf), v.step_writes(spark, sf), STEP_LEASE_MS)
    return rows.select(*_ENDED, "last_error", "available_at", event_data().alias("data"))


_FRESH = """SELECT DISTINCT step_id, 'READY' AS status, 0 AS version, 0 AS attempts, 3 AS budget, CAST(NULL AS VARCHAR) AS worker,
    CAST(NULL AS TIMESTAMP) AS deadline, CAST(NULL AS TIMESTAMP) AS due FROM logged"""


def replay_ctes(as_of: str, writes: str = "v_fold_writes", start: str = _FRESH) -> tuple[str, ...]:
    """The row-by-row replay as a recursive query; a closing END row applies the timers at ``as_of``."""
    backoff = "to_milliseconds(CAST(500 * power(2, least(greatest(attempts - 1, 0), 3)) AS BIGINT))"
    return (
        f"""logged AS (
            SELECT step_id, seq, ts, op, worker_id, lease_version, retryable, error, result FROM {writes} WHERE ts <= {as_of}
            UNION ALL SELECT DISTINCT step_id, 9223372036854775807, {as_of}, 'END', NULL, NULL, NULL, NULL, NULL
              FROM (SELECT step_id FROM {writes} WHERE ts <= {as_of}{_also(start)}))""",
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY ts, seq) AS rn FROM logged)",
        f"""replay AS (
            SELECT step_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS TIMESTAMP) AS ts, '' AS op,
              status AS before, status, version, attempts, budget, worker, deadline,
              due, CAST(NULL AS VARCHAR) AS last_error, CAST(NULL AS VARCHAR) AS result,
              false AS accepted, status AS was, CAST(NULL AS VARCHAR) AS old_worker, CAST(NULL AS TIMESTAMP) AS old_deadline,
              CAST(NULL AS TIMESTAMP) AS old_due, 0 AS old_version
            FROM ({start})
            UNION ALL
            SELECT step_id, rn, seq, ts, op, before,
              CASE WHEN NOT ok THEN before WHEN op = 'CLAIM' THEN 'RUNNING' WHEN op = 'COMPLETE' THEN 'SUCCEEDED'
                WHEN op = 'FAIL' THEN CASE WHEN retryable AND attempts < budget THEN 'RETRY_WAIT' ELSE 'DEAD_LETTERED' END ELSE before END,
              CASE WHEN ok AND op = 'CLAIM' THEN version + 1 ELSE version END,
              CASE WHEN ok AND op = 'CLAIM' THEN attempts + 1 ELSE attempts END, budget,
              CASE WHEN ok AND op = 'CLAIM' THEN worker_id WHEN ok AND op IN ('COMPLETE', 'FAIL') THEN NULL
                WHEN before <> 'RUNNING' THEN NULL ELSE worker END,
              CASE WHEN ok AND op IN ('CLAIM', 'RENEW') THEN ts + {_LEASE} WHEN ok AND op IN ('COMPLETE', 'FAIL') THEN NULL
                WHEN before <> 'RUNNING' THEN NULL ELSE deadline END,
              CASE WHEN ok AND op = 'FAIL' AND retryable AND attempts < budget THEN ts + {backoff} WHEN ok AND op = 'CLAIM' THEN NULL
                WHEN was = 'RUNNING' AND before <> 'RUNNING' THEN NULL ELSE due END,
              CASE WHEN ok AND op = 'FAIL' THEN error ELSE last_error END,
              CASE WHEN ok AND op = 'COMPLETE' THEN new_result ELSE result END,
              ok, was, worker, deadline, due, version
            FROM (
              SELECT *, coalesce(CASE WHEN op = 'CLAIM' THEN before = 'READY' AND attempts < budget AND coalesce(due <= ts, true)
                  WHEN op = 'END' THEN false
                  ELSE before = 'RUNNING' AND worker_id = worker AND lease_version = version AND deadline > ts END, false) AS ok
              FROM (
                SELECT n.step_id, n.rn, n.seq, n.ts, n.op, n.worker_id, n.lease_version, n.retryable, n.error, n.result AS new_result,
                  r.status AS was, r.version, r.attempts, r.budget, r.worker, r.deadline, r.due, r.last_error, r.result,
                  CASE WHEN r.status = 'RUNNING' AND r.deadline <= n.ts THEN CASE WHEN r.attempts < r.budget THEN 'READY' ELSE 'DEAD_LETTERED' END
                    WHEN r.status = 'RETRY_WAIT' AND r.due <= n.ts THEN 'READY' ELSE r.status END AS before
                FROM replay r JOIN numbered n ON n.step_id = r.step_id AND n.rn = r.rn + 1)))""",
    )


def _also(start: str) -> str:
    """Steps that have no write, where the start names them."""
    return "" if start == _FRESH else f" UNION SELECT step_id FROM ({start})"


REPLAY_DECISIONS = "SELECT step_id, seq, op, accepted FROM replay WHERE rn > 0 AND op <> 'END'"
REPLAY_STATE = """SELECT step_id, status, version AS lease_version, attempts AS attempt_count,
    worker AS current_worker_id, deadline AS lease_expires_at, due AS available_at, last_error, result
    FROM replay WHERE op = 'END'"""
REPLAY_EVENTS = """
    SELECT step_id, version AS lease_version, CASE op WHEN 'CLAIM' THEN 'STEP_CLAIMED' WHEN 'COMPLETE' THEN 'STEP_SUCCEEDED'
        ELSE CASE status WHEN 'RETRY_WAIT' THEN 'STEP_RETRY_SCHEDULED' ELSE 'STEP_DEAD_LETTERED' END END AS event_type,
      ts AS created_at, CASE WHEN op = 'CLAIM' THEN worker ELSE old_worker END AS worker_id,
      CASE WHEN status = 'DEAD_LETTERED' THEN CASE WHEN retryable THEN 'attempt_budget_exhausted' ELSE 'non_retryable_failure' END END AS reason,
      CASE WHEN op = 'FAIL' THEN last_error END AS error
    FROM replay LEFT JOIN (SELECT seq, retryable FROM logged WHERE op = 'FAIL') USING (seq)
    WHERE accepted AND op IN ('CLAIM', 'COMPLETE', 'FAIL')
    UNION ALL
    SELECT step_id, old_version, CASE was WHEN 'RETRY_WAIT' THEN 'RETRY_READY'
        ELSE CASE before WHEN 'READY' THEN 'LEASE_RECOVERED' ELSE 'STEP_DEAD_LETTERED' END END,
      CASE was WHEN 'RETRY_WAIT' THEN old_due ELSE old_deadline END, CASE WHEN was = 'RUNNING' THEN old_worker END,
      CASE WHEN was = 'RUNNING' AND before = 'DEAD_LETTERED' THEN 'lease_expired_attempt_budget_exhausted' END, NULL
    FROM replay WHERE rn > 0 AND was <> before
"""
_END = f"TIMESTAMP '{EVENTS_END}'"


def _log(spark, sf):
    """The writes as a written table, which a log of owner writes is; every round reads it."""
    return written(v.fold_writes(spark, sf), "fold-writes")


@query("stm2_fold_decisions", with_views(REPLAY_DECISIONS, *replay_ctes(_END), recursive=True))
def _(spark, sf):
    w = _log(spark, sf)
    generations = fold.lifecycle_fold(w, EVENTS_END, LEASE_MS)
    return fold.fold_decisions(w, generations, EVENTS_END).select("step_id", "seq", "op", "accepted")


@query("stm2_fold_state", with_views(REPLAY_STATE, *replay_ctes(_END), recursive=True))
def _(spark, sf):
    w = _log(spark, sf)
    return fold.fold_state(w, fold.lifecycle_fold(w, EVENTS_END, LEASE_MS), EVENTS_END)


@query("stm2_fold_events", with_views(REPLAY_EVENTS, *replay_ctes(_END), recursive=True))
def _(spark, sf):
    rows = fold.fold_events(fold.lifecycle_fold(_log(spark, sf), EVENTS_END, LEASE_MS), EVENTS_END)
    return rows.select("step_id", "lease_version", "event_type", "created_at", "worker_id", "reason", "error")


# Every kind of step at the start, with budgets of their own; every seventh is not known.
BEGUN = """begun AS (SELECT DISTINCT step_id, CASE step_id % 7 WHEN 3 THEN 'RETRY_WAIT' WHEN 4 THEN 'RUNNING' WHEN 5 THEN
    CASE WHEN step_id % 2 = 0 THEN 'PENDING' ELSE 'SUCCEEDED' END ELSE 'READY' END AS status,
  CAST(step_id % 2 AS INTEGER) AS version, CAST(step_id % 3 AS INTEGER) AS attempts, CAST(1 + step_id % 5 AS INTEGER) AS budget,
  CASE WHEN step_id % 7 = 4 THEN 'w' || (step_id // 100 % 8) END AS worker,
  CASE WHEN step_id % 7 = 4 THEN TIMESTAMP '2024-01-01' + to_days(CAST(3 * (step_id % 100) + 1 AS INTEGER)) END AS deadline,
  TIMESTAMP '2024-01-01' + to_hours(CAST(step_id % 96 AS INTEGER)) AS available_at FROM v_fold_writes WHERE step_id % 7 <> 6)"""
START = """SELECT step_id, status, version, attempts, budget, worker, deadline, CASE WHEN status IN ('READY', 'RETRY_WAIT') THEN available_at END AS due FROM begun
    UNION ALL SELECT DISTINCT step_id, 'READY', 0, 0, 3, NULL, NULL, NULL FROM v_fold_writes WHERE step_id % 7 = 6"""


def begun_steps(log):
    """The same steps as rows of the relation."""
    c, day = F.col("step_id"), 86_400_000
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    held = c % 7 == 4
    ended = F.when(c % 2 == 0, "PENDING").otherwise("SUCCEEDED")
    return log.select("step_id").distinct().where(c % 7 != 6).select(
        "step_id",
        F.when(c % 7 == 3, "RETRY_WAIT").when(held, "RUNNING").when(c % 7 == 5, ended).otherwise("READY").alias("status"),
        (c % 2).cast("int").alias("lease_version"),
        (c % 3).cast("int").alias("attempt_count"),
        (1 + c % 5).cast("int").alias("max_attempts"),
        F.when(held, F.concat(F.lit("w"), (F.floor(c / 100) % 8).cast("string"))).alias("current_worker_id"),
        F.when(held, v.plus_ms(start, (3 * (c % 100) + 1) * day)).alias("lease_expires_at"),
        v.plus_ms(start, c % 96 * 3_600_000).alias("available_at"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(None).cast("string").alias("result"),
    )


_GIVEN = (BEGUN, *replay_ctes(_END, start=START))
_GIVEN_STATE = REPLAY_STATE.replace("due AS available_at", "coalesce(due, available_at) AS available_at").replace(
    "FROM replay", "FROM replay LEFT JOIN (SELECT step_id, available_at FROM begun) USING (step_id)"
)


def _replayed(spark, sf):
    log = written(v.fold_writes(spark, sf), "fold-writes")
    begun = written(begun_steps(log), "begun")
    return log, begun, fold.lifecycle_fold(log, EVENTS_END, LEASE_MS, steps=begun)


@query("stm2_given_decisions", with_views(REPLAY_DECISIONS, *_GIVEN, recursive=True))
def _(spark, sf):
    """Steps begin in any state, each with its own budget."""
    log, _steps, generations = _replayed(spark, sf)
    return fold.fold_decisions(log, generations, EVENTS_END).select("step_id", "seq", "op", "accepted")


@query("stm2_given_state", with_views(_GIVEN_STATE, *_GIVEN, recursive=True))
def _(spark, sf):
    log, begun, generations = _replayed(spark, sf)
    return fold.fold_state(log, generations, EVENTS_END, begun)


@query("stm2_given_events", with_views(REPLAY_EVENTS, *_GIVEN, recursive=True))
def _(spark, sf):
    rows = fold.fold_events(_replayed(spark, sf)[2], EVENTS_END)
    return rows.select("step_id", "lease_version", "event_type", "created_at", "worker_id", "reason", "error")
