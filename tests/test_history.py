import pytest
from tests.helpers import NOW, at, rows, steps

from tenure.functions import fixed
from tenure.operators import history as h
from tenure.operators import metrics
from tenure.sources.sinks import event_wire


def log(spark, entries):
    """(id, xid, step, type, version) rows."""
    return spark.createDataFrame(
        [(i, x, s, t, v, "w", at(i), f'{{"leaseVersion":{v},"attemptCount":{v}}}') for i, x, s, t, v in entries],
        "id long, xid long, step_id string, event_type string, lease_version int, worker_id string, created_at timestamp, data string",
    )


def plain(spark, pairs):
    return log(spark, [(i, x, "s", fixed.STEP_CLAIMED, 1) for i, x in pairs])


def read_all(events, limit, watermark=None):
    cursor, seen = h.START, []
    while True:
        got = h.page(events, cursor, watermark, limit).collect()
        following = h.next_cursor(got, cursor)
        if not got:
            assert following == cursor
            return seen
        seen += [(r.xid, r.id) for r in got]
        cursor = following


def test_pages_are_complete_and_ordered(spark):
    pairs = [(i, 100 - i if i % 3 else 50) for i in range(1, 26)]
    assert read_all(plain(spark, pairs), 7) == sorted((x, i) for i, x in pairs)


def test_an_event_that_commits_late_is_not_lost(spark):
    """Id 1 is still in flight while id 2 is there; the watermark holds id 2 back."""
    before, after = plain(spark, [(2, 11)]), plain(spark, [(2, 11), (1, 10)])
    assert h.page(before, watermark=10).collect() == []
    assert read_all(after, 10, watermark=12) == [(10, 1), (11, 2)]


def test_missed_by_a_plain_id_cursor(spark):
    events = plain(spark, [(1, 5), (2, 1), (3, 2), (4, 9), (5, 4)])
    assert rows(h.missed_by_id_cursor(events, slice_width=2), "id") == [(1,), (4,)]
    pairs = [(i, i + (i * 37) % 20) for i in range(300)]
    order = sorted((x, i) for i, x in pairs)
    want = {i for n, (_, i) in enumerate(order) if any(j > i for _, j in order[:n])}
    assert {r.id for r in h.missed_by_id_cursor(plain(spark, pairs), slice_width=16).collect()} == want


def test_page_limits(spark):
    events = plain(spark, [(i, i) for i in range(1, 602)])
    assert h.page(events, limit=1000).count() == 500 and h.page(events).count() == 100
    for bad in (0, -1, 1.5, "5", True):
        with pytest.raises(ValueError):
            h.page(events, limit=bad)


def test_cursor_of_an_id(spark):
    events = plain(spark, [(7, 70)])
    assert h.resolve_cursor(events, 7) == h.Cursor(70, 7)
    assert h.resolve_cursor(events, 0) == h.START == h.resolve_cursor(events, -5)
    assert h.resolve_cursor(events, 8) is None


def test_commit_watermark(spark):
    events, none = plain(spark, [(1, 5), (2, 9)]), spark.createDataFrame([], "xid long")
    assert h.commit_watermark(none, events).first().watermark == 10
    assert h.commit_watermark(spark.createDataFrame([(4,), (7,)], "xid long"), events).first().watermark == 4
    assert h.commit_watermark(none, events.limit(0)).first().watermark == 0


def of(step, text, start):
    return [(start + n, start + n, step, *_split(entry)) for n, entry in enumerate(text.split(" "))]


def _split(entry):
    kind, version = entry.split(":v")
    return kind, int(version)


def test_history_and_conformance(spark):
    long = " ".join(f"STEP_CLAIMED:v{n} LEASE_RECOVERED:v{n}" for n in range(1, 30))
    events = log(spark, of("crash", fixed.CRASH_HISTORY, 1) + of("retry", fixed.RETRY_HISTORY, 20) + of("long", long, 100))
    assert rows(h.history(events, slice_width=3), "step_id", "history") == [("crash", fixed.CRASH_HISTORY), ("long", long), ("retry", fixed.RETRY_HISTORY)]
    assert rows(h.conformance(events, fixed.CRASH_HISTORY), "step_id") == [("long",), ("retry",)]
    parts = h.history_segments(events, h.F.col("event_type"), 3).where("step_id = 'long'")
    assert max(len(r.history.split(" ")) for r in parts.collect()) <= 3


def test_lifecycle_conformance(spark):
    events = log(spark, of("crash", fixed.CRASH_HISTORY, 1) + of("retry", fixed.RETRY_HISTORY, 20)
                 + of("same version", "STEP_CLAIMED:v1 LEASE_RECOVERED:v1 STEP_CLAIMED:v1", 40) + of("no claim", "STEP_SUCCEEDED:v1", 50))
    assert rows(h.lifecycle_conformance(events, slice_width=2), "step_id", "n_events", "illegal_events", "finished") == [
        ("crash", 4, 0, True), ("no claim", 1, 1, True), ("retry", 5, 0, True), ("same version", 3, 1, False),
    ]


def test_reconcile_state(spark):
    s = steps(spark, [
        {"step_id": "crash", "status": "SUCCEEDED", "attempt_count": 2}, {"step_id": "retry", "status": "RUNNING", "attempt_count": 2},
        {"step_id": "quiet"}, {"step_id": "lost", "status": "RUNNING", "attempt_count": 1},
    ])
    events = log(spark, of("crash", fixed.CRASH_HISTORY, 1) + of("retry", fixed.RETRY_HISTORY, 20))
    assert rows(h.reconcile_state(s, events), "step_id", "claims_agree", "status_agrees") == [("lost", False, False), ("retry", True, False)]


def test_duplicate_transitions_and_counts(spark):
    events = log(spark, of("a", "STEP_CLAIMED:v1 STEP_CLAIMED:v1 STEP_CLAIMED:v2", 1))
    assert rows(h.duplicate_transitions(events, fixed.STEP_CLAIMED), "step_id", "lease_version", "n") == [("a", 1, 2)]
    assert rows(h.counts_by(events, "event_type"), "event_type", "n") == [("STEP_CLAIMED", 3)]


def test_per_second_fills_zeros(spark):
    events = log(spark, [(i, i, "s", fixed.STEP_SUCCEEDED, 1) for i in (0, 0, 3, 7)] + [(9, 9, "s", fixed.STEP_CLAIMED, 1)])
    got = [(r.second, r.n) for r in h.per_interval(events, NOW, chunk=3).orderBy("second").collect()]
    assert got == [(0, 2), (1, 0), (2, 0), (3, 1), (4, 0), (5, 0), (6, 0), (7, 1)]
    assert h.per_interval(events.limit(0), NOW).count() == 0


def test_latest_is_newest_first(spark):
    assert [r.id for r in h.latest(plain(spark, [(i, i) for i in range(60)])).collect()] == list(range(59, 9, -1))


def test_wire_rows_have_no_commit_number(spark):
    wire = event_wire(log(spark, [(1, 99, "s", fixed.STEP_CLAIMED, 2)]))
    assert wire.columns == ["id", "stepId", "workerId", "eventType", "data", "createdAt", "wire"]
    assert wire.first().wire == (
        '{"id":1,"stepId":"s","workerId":"w","eventType":"STEP_CLAIMED","data":{"leaseVersion":2,"attemptCount":2},'
        '"createdAt":"2024-06-01 12:00:01.000000"}'
    )


def test_metrics_of_a_small_run(spark):
    s = steps(spark, [{"step_id": x, "status": "SUCCEEDED", "available_at": NOW, "lease_version": 1} for x in "abc"])
    events = log(spark, [(1, 1, "a", fixed.STEP_CLAIMED, 1), (2, 2, "a", fixed.STEP_SUCCEEDED, 1), (3, 3, "b", fixed.STEP_CLAIMED, 1),
                         (5, 5, "b", fixed.STEP_CLAIMED, 2), (6, 6, "b", fixed.STEP_SUCCEEDED, 2)])
    per = metrics.per_step(s, events)
    total = metrics.run_summary(per).first()
    assert (total.tasks, total.not_claimed_exactly_once, total.without_one_terminal_event, total.wall_seconds) == (3, 2, 1, 6.0)
    assert rows(metrics.latency_percentiles(per), "metric", "n", "p50", "max") == [
        ("end_to_end", 2, 4000.0, 6000.0), ("queue_wait", 2, 2000.0, 3000.0), ("service", 2, 1000.0, 1000.0),
    ]
    rough = metrics.latency_percentiles(per, approximate=True)
    assert {r.metric for r in rough.collect()} == set(metrics.LATENCIES)
    judged = metrics.measurable(metrics.run_summary(per), 4, ["wall_seconds"])
    assert judged.first().refused == "unexpected number of tasks"
    assert metrics.measurable(metrics.run_summary(per), 3, ["wall_seconds", "tasks_per_second"]).first().refused is None
