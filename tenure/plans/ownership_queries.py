"""Queries over grants and workers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.operators import ownership, workers
from tenure.plans import views as v
from tenure.plans.registry import query
from tenure.plans.views import AS_OF, EVENTS_END, with_views

_PAIR = "GROUP BY step_id, lease_version"


@query(
    "own1_duplicate_grants",
    with_views(f"""SELECT step_id, lease_version, count(*) AS grants, count(DISTINCT claimer_id) AS claimers,
        min(claimer_id) AS first_claimer FROM v_grants {_PAIR} HAVING count(*) > 1"""),
)
def _(spark, sf):
    return ownership.duplicate_grants(v.grants(spark, sf))


@query(
    "own2_grants_vs_events",
    with_views(f"""
        SELECT * FROM (
          SELECT step_id, lease_version, coalesce(g.n, 0) AS grants, coalesce(e.n, 0) AS events,
            CASE WHEN g.n IS NULL THEN 'EVENT_WITHOUT_GRANT'
              WHEN NOT coalesce(g.n = 1 AND e.n = 1 AND g.owner = e.owner, false) THEN 'GRANT_WITHOUT_MATCHING_EVENT' END AS problem
          FROM (SELECT step_id, lease_version, count(*) AS n, min(claimer_id) AS owner FROM v_grants {_PAIR}) g
          FULL JOIN (SELECT step_id, lease_version, count(*) AS n, min(worker_id) AS owner FROM v_grant_events WHERE event_type = 'STEP_CLAIMED' {_PAIR}) e
            USING (step_id, lease_version))
        WHERE problem IS NOT NULL"""),
)
def _(spark, sf):
    return ownership.grants_vs_events(v.grants(spark, sf), v.grant_events(spark, sf))


@query(
    "own3_generation_gaps",
    with_views("""
        SELECT s.step_id, s.lease_version, coalesce(n, 0) AS grants, coalesce(d, 0) AS generations, lo AS first_generation, hi AS last_generation
        FROM v_steps s LEFT JOIN (SELECT step_id, count(*) AS n, count(DISTINCT lease_version) AS d, min(lease_version) AS lo,
          max(lease_version) AS hi FROM v_grants GROUP BY step_id) g USING (step_id)
        WHERE NOT (coalesce(n, 0) = s.lease_version AND coalesce(d, 0) = s.lease_version
          AND (s.lease_version = 0 OR (lo = 1 AND hi = s.lease_version)))"""),
)
def _(spark, sf):
    return ownership.generation_gaps(v.grants(spark, sf), v.steps(spark, sf))


_OWNED = "step_id, lease_version, 'c' || substr(current_worker_id, 2) AS current_worker_id"


@query(
    "own4_running_owner_mismatch",
    with_views(f"""
        SELECT s.*, g.granted_to FROM (SELECT {_OWNED} FROM v_steps WHERE status = 'RUNNING') s
        LEFT JOIN (SELECT step_id, lease_version, min(claimer_id) AS granted_to FROM v_grants {_PAIR}) g USING (step_id, lease_version)
        WHERE g.granted_to IS DISTINCT FROM s.current_worker_id"""),
)
def _(spark, sf):
    s = v.steps(spark, sf).withColumn("current_worker_id", F.concat(F.lit("c"), F.substring("current_worker_id", 2, 10)))
    return ownership.running_owner_mismatch(s, v.grants(spark, sf))


@query(
    "own5_claimer_summary",
    with_views("""
        SELECT count(*) AS claimers, CAST(sum(attempts) AS BIGINT) AS attempted_claims, CAST(sum(coalesce(n, 0)) AS BIGINT) AS successful_claims,
          CAST(sum(empty) AS BIGINT) AS empty_claims, CAST(sum(consistency_errors) AS BIGINT) AS claim_consistency_errors,
          CAST(sum(other_errors) AS BIGINT) AS other_errors, count(*) FILTER (coalesce(n, 0) > 0) AS claimers_with_a_grant,
          min(coalesce(n, 0)) AS min_grants, max(coalesce(n, 0)) AS max_grants,
          (SELECT min(lease_version) FROM v_steps) AS min_generations, (SELECT max(lease_version) FROM v_steps) AS max_generations,
          (SELECT round(avg(lease_version), 1) FROM v_steps) AS mean_generations
        FROM v_counters LEFT JOIN (SELECT claimer_id, count(*) AS n FROM v_grants GROUP BY 1) USING (claimer_id)"""),
)
def _(spark, sf):
    return ownership.claimer_summary(v.counters(spark, sf), v.grants(spark, sf), v.steps(spark, sf))


@query(
    "wrk1_latest_registration",
    with_views("""
        SELECT worker_id, max(r) AS started_at, max(ts) AS last_heartbeat_at FROM (
          SELECT worker_id, ts AS r, ts FROM v_registrations UNION ALL SELECT worker_id, NULL, ts FROM v_beats)
        GROUP BY worker_id HAVING max(r) IS NOT NULL"""),
)
def _(spark, sf):
    return workers.latest_registration(v.registrations(spark, sf), v.beats(spark, sf))


@query(
    "wrk2_unregistered_beats",
    with_views("""
        SELECT worker_id, ts, seq FROM v_beats b
        WHERE NOT EXISTS (SELECT 1 FROM v_registrations r WHERE r.worker_id = b.worker_id AND r.ts <= b.ts)"""),
)
def _(spark, sf):
    return workers.unregistered_beats(v.beats(spark, sf), v.registrations(spark, sf))


_AGE = f"(epoch_us(TIMESTAMP '{EVENTS_END}') - epoch_us(last_heartbeat_at)) / 1000000.0"


@query(
    "wrk3_heartbeat_age",
    with_views(f"SELECT worker_id, round({_AGE}, 1) AS age_s, {_AGE} > 600 AS stale FROM v_workers"),
)
def _(spark, sf):
    return workers.heartbeat_age(v.workers(spark, sf), EVENTS_END, stale_s=600)


@query(
    "wrk4_liveness_vs_lease",
    with_views(f"""
        SELECT CASE WHEN w.worker_id IS NULL THEN 'unknown' WHEN {_AGE} > 3600 THEN 'stale' ELSE 'fresh' END AS heartbeat,
          CASE WHEN lease_expires_at <= TIMESTAMP '{AS_OF}' + (TIMESTAMP '{EVENTS_END}' - TIMESTAMP '{AS_OF}') THEN 'expired' ELSE 'live' END AS lease,
          count(*) AS steps
        FROM (SELECT current_worker_id, lease_expires_at + to_days(9000) AS lease_expires_at FROM v_steps WHERE status = 'RUNNING') s
        LEFT JOIN v_workers w ON w.worker_id = s.current_worker_id
        GROUP BY 1, 2"""),
)
def _(spark, sf):
    """Deadlines moved to the time of the heartbeats, so that both clocks are one."""
    s = v.steps(spark, sf).withColumn("lease_expires_at", v.plus_ms(F.col("lease_expires_at"), 9000 * 86_400_000))
    rows = workers.liveness_vs_lease(s, v.workers(spark, sf), EVENTS_END, stale_s=3600)
    return rows.withColumn("steps", F.col("steps").cast("bigint"))
