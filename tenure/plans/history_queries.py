"""Queries over the event history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.functions import fixed
from tenure.operators import grammar, metrics
from tenure.operators import history as h
from tenure.operators.ordered import Running, running
from tenure.plans import views as v
from tenure.plans.registry import query
from tenure.plans.views import EVENTS_START, LOG_SLICE, with_views
from tenure.session import scratch_path
from tenure.sources.event_log import EventLog
from tenure.sources.sinks import event_wire

_TERMINAL = "('STEP_SUCCEEDED', 'STEP_DEAD_LETTERED')"


@query(
    "snk2_event_wire",
    with_views("""
        SELECT id, step_id AS "stepId", worker_id AS "workerId", event_type AS "eventType", data, created AS "createdAt",
          '{"id":' || id || ',"stepId":' || step_id || ',"workerId":"' || worker_id || '","eventType":"' || event_type
            || '","data":' || data || ',"createdAt":"' || created || '"}' AS wire
        FROM (SELECT *, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created FROM v_events)"""),
)
def _(spark, sf):
    return event_wire(v.events(spark, sf))


@query(
    "evt1_emit_events",
    with_views("""
        SELECT step_id, worker_id, event_type, data, created_at FROM v_events
        WHERE event_type IN ('STEP_CLAIMED', 'STEP_SUCCEEDED', 'RETRY_READY')"""),
)
def _(spark, sf):
    """Accepted transitions give events; the others, rejected here, give none."""
    e = v.events(spark, sf)
    kept = F.when(F.col("event_type").isin("STEP_CLAIMED", "STEP_SUCCEEDED", "RETRY_READY"), F.col("event_type"))
    nothing = F.lit(None).cast("string")
    return h.emit_events(
        e.select(
            "step_id",
            F.col("worker_id").alias("event_worker_id"),
            kept.alias("event_type"),
            "lease_version",
            F.col("lease_version").alias("attempt_count"),
            F.col("created_at").alias("event_at"),
            F.lit(None).cast("timestamp").alias("available_at"),
            nothing.alias("reason"),
            nothing.alias("last_error"),
        )
    )


_WATERMARK = 5000
_PAGE = "SELECT id, xid, step_id, event_type FROM v_plain_events"


@query(
    "evt2_page",
    with_views(f"{_PAGE} WHERE xid < {_WATERMARK} AND (xid > 400 OR (xid = 400 AND id > 390)) ORDER BY xid, id LIMIT 500"),
)
def _(spark, sf):
    rows = h.page(v.plain_events(spark, sf), h.Cursor(400, 390), _WATERMARK, limit=1000)
    return rows.select("id", "xid", "step_id", "event_type")


@query("evt2_page_of_step", with_views(f"{_PAGE} WHERE xid < {_WATERMARK} AND step_id = 7 ORDER BY xid, id LIMIT 100"))
def _(spark, sf):
    return h.page(v.plain_events(spark, sf), watermark=_WATERMARK, step_id=7).select("id", "xid", "step_id", "event_type")


def _laid_out(spark, sf) -> EventLog:
    """The log taken in by three batches, in files of a few pages."""
    log = EventLog(scratch_path(spark, "event-log"), rows_per_file=2_000)
    e = v.plain_events(spark, sf).select("id", "xid", "step_id", "event_type")
    for batch in range(3):
        log.append(e.where(F.pmod(F.floor(F.col("id") / 1_000), F.lit(3)) == batch), batch)
    return log


@query(
    "evt2_page_from_files",
    with_views(f"{_PAGE} WHERE xid < {_WATERMARK} AND (xid > 400 OR (xid = 400 AND id > 390)) ORDER BY xid, id LIMIT 500"),
)
def _(spark, sf):
    return _laid_out(spark, sf).page(spark, h.Cursor(400, 390), _WATERMARK, limit=500)


@query("evt2_page_of_step_from_files", with_views(f"{_PAGE} WHERE xid > 100 AND step_id = 7 ORDER BY xid, id LIMIT 20"))
def _(spark, sf):
    return _laid_out(spark, sf).page(spark, h.Cursor(100, 2**62), limit=20, step_id=7)


@query("evt3_cursor_from_files", with_views("SELECT xid, id FROM v_plain_events WHERE id = 777"))
def _(spark, sf):
    return _laid_out(spark, sf).cursor_of(spark, 777)


@query("evt3_resolve_cursor", with_views("SELECT xid, id FROM v_plain_events WHERE id = 777"))
def _(spark, sf):
    return h.cursor_of(v.plain_events(spark, sf), 777)


@query(
    "evt4_commit_watermark",
    with_views("SELECT coalesce((SELECT min(xid) FROM v_plain_events WHERE worker_id = 'w5'), (SELECT max(xid) + 1 FROM v_plain_events)) AS watermark"),
)
def _(spark, sf):
    e = v.plain_events(spark, sf)
    return h.commit_watermark(e.where(F.col("worker_id") == "w5").select("xid"), e)


@query(
    "evt5_missed_by_id_cursor",
    with_views("""
        SELECT id, xid, highest_before FROM (
          SELECT id, xid, max(id) OVER (ORDER BY xid, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before
          FROM v_plain_events) WHERE id < highest_before"""),
)
def _(spark, sf):
    return h.missed_by_id_cursor(v.plain_events(spark, sf), LOG_SLICE)


_HISTORY = "string_agg(event_type || ':v' || lease_version, ' ' ORDER BY xid, id)"


@query("evt6_history", with_views(f"SELECT step_id, {_HISTORY} AS history FROM v_events GROUP BY step_id"))
def _(spark, sf):
    return h.history(v.events(spark, sf), slice_width=LOG_SLICE)


@query(
    "evt6_history_segments",
    with_views(
        f"SELECT step_id, xid // {LOG_SLICE} AS segment, {_HISTORY} AS history FROM v_events GROUP BY step_id, xid // {LOG_SLICE}"
    ),
)
def _(spark, sf):
    text = F.concat(F.col("event_type"), F.lit(":v"), F.col("lease_version").cast("string"))
    return h.history_segments(v.events(spark, sf), text, LOG_SLICE)


_BY_DAY = "CAST(step_id * 1000 + floor((epoch_us(created_at) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000) AS BIGINT)"
_SHORT = f"""short AS (SELECT day_id AS step_id, id, xid, event_type, CAST(sum(CASE WHEN event_type = 'STEP_CLAIMED' THEN 1 ELSE 0 END)
    OVER (PARTITION BY day_id ORDER BY xid, id) AS INTEGER) AS lease_version
    FROM (SELECT *, {_BY_DAY} AS day_id FROM v_plain_events))"""


def _short(spark, sf):
    """Histories per user and day, short enough that some are as expected."""
    day = F.floor((F.unix_micros("created_at") - F.unix_micros(F.lit(EVENTS_START).cast("timestamp"))) / 86_400_000_000)
    e = v.plain_events(spark, sf).withColumn("step_id", (F.col("step_id") * 1000 + day).cast("bigint"))
    claimed = F.when(F.col("event_type") == fixed.STEP_CLAIMED, 1).otherwise(0)
    return running(e, ["step_id"], ["xid", "id"], h.xid_slice(LOG_SLICE), lease_version=Running("sum", claimed))


@query(
    "evt7_conformance",
    with_views(
        """SELECT step_id, count(*) AS n_events FROM short GROUP BY step_id
        HAVING string_agg(event_type || ':v' || lease_version, ' ' ORDER BY xid, id) <> 'STEP_CLAIMED:v1 LEASE_RECOVERED:v1'""",
        _SHORT,
    ),
)
def _(spark, sf):
    return h.conformance(_short(spark, sf), "STEP_CLAIMED:v1 LEASE_RECOVERED:v1", LOG_SLICE)


def _walked(pattern: grammar.Automaton, events: str) -> tuple[str, ...]:
    """The same automaton walked event by event."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    moves = ", ".join(f"({', '.join(map(text, m))})" for m in pattern.moves)
    accepting = ", ".join(map(text, pattern.accepting))
    return (
        f"""SELECT step_id, max(n) AS n_events, arg_max(state, n) AS state, arg_max(state, n) IN ({accepting}) AS accepted,
          max(bad) AS first_illegal_id, bool_and(steady) AS generations_ok FROM walk WHERE n > 0 GROUP BY step_id""",
        f"moves AS (SELECT * FROM (VALUES {moves}) m(a, e, b))",
        f"""listed AS (SELECT *, row_number() OVER w AS n, lease_version = count(*) FILTER (event_type = 'STEP_CLAIMED') OVER w AS steady
          FROM {events} WINDOW w AS (PARTITION BY step_id ORDER BY xid, id ROWS UNBOUNDED PRECEDING))""",
        f"""walk AS (SELECT step_id, 0::BIGINT AS n, {text(pattern.start)} AS state, NULL::BIGINT AS bad, true AS steady FROM (SELECT DISTINCT step_id FROM listed)
          UNION ALL SELECT w.step_id, l.n, coalesce(m.b, '{grammar.DEAD}'), CASE WHEN bad IS NULL AND m.b IS NULL THEN l.id ELSE bad END, l.steady
          FROM walk w JOIN listed l ON l.step_id = w.step_id AND l.n = w.n + 1 LEFT JOIN moves m ON m.a = w.state AND m.e = l.event_type)""",
    )


def _recursive(body: str, *ctes: str) -> str:
    return with_views(body, *ctes, recursive=True)


_BUDGET = grammar.lifecycle(max_attempts=3)
_OPEN, _ONE, _TWO = "as new", "one retry", "two retries"
# At most two retries in a row; every other event takes the count back.
_RETRIES = grammar.Automaton(
    _OPEN,
    (_OPEN, _ONE),
    (
        *[(s, e, _OPEN) for s in (_OPEN, _ONE, _TWO) for e in ("STEP_CLAIMED", "STEP_SUCCEEDED", "LEASE_RECOVERED", "RETRY_READY")],
        (_OPEN, "STEP_RETRY_SCHEDULED", _ONE),
        (_ONE, "STEP_RETRY_SCHEDULED", _TWO),
    ),
)


_WALKED = _walked(_BUDGET, "short")


@query("evt7_pattern", _recursive(_WALKED[0], _SHORT, *_WALKED[1:]))
def _(spark, sf):
    """Histories of a user's day: any crashes and retries in up to three claims, then an end."""
    return grammar.matches(_short(spark, sf), _BUDGET)


_HOT = "hot AS (SELECT * REPLACE (CASE WHEN step_id % 3 = 0 THEN 0 ELSE step_id END AS step_id) FROM v_events)"
_HOT_WALKED = _walked(_RETRIES, "hot")


@query("evt7_pattern_of_long_histories", _recursive(_HOT_WALKED[0], _HOT, *_HOT_WALKED[1:]))
def _(spark, sf):
    """Whole histories, a third of all events in one of them."""
    e = v.events(spark, sf).withColumn("step_id", F.when(F.col("step_id") % 3 == 0, 0).otherwise(F.col("step_id")).cast("bigint"))
    return grammar.matches(e, _RETRIES)


_PAIRS = ", ".join(f"'{a or ''}>{b}'" for a, b in fixed.EVENT_SUCCESSORS)


@query(
    "evt7_lifecycle_conformance",
    with_views(
        """SELECT step_id, count(*) AS n_events,
          count(*) FILTER (NOT legal) AS illegal_events,
          arg_max(event_type, xid * 1000000000000 + id) IN ('STEP_SUCCEEDED', 'STEP_DEAD_LETTERED') AS finished
        FROM judged GROUP BY step_id""",
        f"""judged AS (SELECT *, coalesce(before, '') || '>' || event_type IN ({_PAIRS})
              AND lease_version = coalesce(version_before, 0) + CASE WHEN event_type = 'STEP_CLAIMED' THEN 1 ELSE 0 END AS legal
            FROM (SELECT *, lag(event_type) OVER w AS before, lag(lease_version) OVER w AS version_before
              FROM v_events WINDOW w AS (PARTITION BY step_id ORDER BY xid, id)))""",
    ),
)
def _(spark, sf):
    return h.lifecycle_conformance(v.events(spark, sf), LOG_SLICE)


@query(
    "evt8_reconcile_state",
    with_views("""
        SELECT * FROM (
          SELECT s.step_id, s.status, s.attempt_count, e.claims, e.last_event,
            s.attempt_count = e.claims AS claims_agree,
            s.status = CASE e.last_event WHEN 'STEP_CLAIMED' THEN 'RUNNING' WHEN 'STEP_SUCCEEDED' THEN 'SUCCEEDED'
              WHEN 'STEP_RETRY_SCHEDULED' THEN 'RETRY_WAIT' WHEN 'STEP_DEAD_LETTERED' THEN 'DEAD_LETTERED' ELSE 'READY' END AS status_agrees
          FROM v_user_steps s JOIN (
            SELECT step_id, count(*) FILTER (event_type = 'STEP_CLAIMED') AS claims,
              arg_max(event_type, xid * 1000000000000 + id) AS last_event
            FROM v_plain_events GROUP BY step_id) e USING (step_id))
        WHERE NOT (claims_agree AND status_agrees)"""),
)
def _(spark, sf):
    return h.reconcile_state(v.user_steps(spark, sf), v.plain_events(spark, sf))


for _name, _column in (("type", "event_type"), ("worker", "worker_id")):

    @query(f"evt9_counts_by_{_name}", with_views(f"SELECT {_column}, count(*) AS n FROM v_plain_events GROUP BY {_column}"))
    def _(spark, sf, column=_column):
        return h.counts_by(v.plain_events(spark, sf), column)


@query(
    "evt9_completions_by_worker",
    with_views("""SELECT worker_id, count(*) AS completed
        FROM (SELECT DISTINCT worker_id, step_id, lease_version FROM v_events WHERE event_type = 'STEP_SUCCEEDED') GROUP BY worker_id"""),
)
def _(spark, sf):
    return h.completions_by_worker(v.events(spark, sf))


@query("evt9_counts_by_status", with_views("SELECT status, count(*) AS n FROM v_steps GROUP BY status"))
def _(spark, sf):
    return h.counts_by(v.steps(spark, sf), "status")


@query(
    "evt10_per_minute",
    with_views(
        """SELECT second, coalesce(n, 0) AS n
        FROM (SELECT unnest(generate_series(0, (SELECT max(second) FROM counted))) AS second) LEFT JOIN counted USING (second)""",
        f"""counted AS (SELECT CAST(floor((epoch_us(created_at) - epoch_us(TIMESTAMP '{EVENTS_START}')) / 60000000) AS BIGINT) AS second,
              count(*) AS n FROM v_plain_events WHERE event_type IN {_TERMINAL} GROUP BY 1)""",
    ),
)
def _(spark, sf):
    return h.per_interval(v.plain_events(spark, sf), EVENTS_START, width_s=60)


@query("evt11_latest", with_views(f"{_PAGE} ORDER BY xid DESC, id DESC LIMIT 50"))
def _(spark, sf):
    return h.latest(v.plain_events(spark, sf)).select("id", "xid", "step_id", "event_type")


@query(
    "evt12_duplicate_transitions",
    with_views("""SELECT step_id, lease_version, count(*) AS n FROM v_events
        WHERE event_type = 'STEP_SUCCEEDED' GROUP BY 1, 2 HAVING count(*) > 1"""),
)
def _(spark, sf):
    return h.duplicate_transitions(v.events(spark, sf), fixed.STEP_SUCCEEDED)


@query(
    "met7_event_rate",
    with_views(f"""SELECT date_trunc('second', created_at) AS window_start, count(*) AS n FROM v_plain_events
        WHERE event_type IN {_TERMINAL} GROUP BY 1"""),
)
def _(spark, sf):
    return metrics.event_rate(v.plain_events(spark, sf))
