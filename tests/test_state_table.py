"""Snapshots, the batches over them, and the history that can be read back."""

import re
import shutil

import pytest
from tests.helpers import NOW, at, rows, running, steps

from tenure.operators import history, recover
from tenure.plans.arrivals import drain_batches
from tenure.schemas import schema
from tenure.session import scratch_path
from tenure.sources.state import StateTable
from tenure.streaming.batches import Sweeper
from tests.test_streaming import Feed


@pytest.fixture
def table(spark):
    return StateTable(scratch_path(spark, "state"), buckets=4)


def _opened(df):
    """Batches and snapshots whose files a query opens."""
    files = df.inputFiles()
    return {int(x) for f in files for x in re.findall(r"batch_id=(\d+)", f)}, {int(x) for f in files for x in re.findall(r"upto=(\d+)", f)}


@pytest.fixture(scope="module")
def template(spark):
    """Batch 0: 40 steps running until their own second; batches 1 to 6 recover what is due."""
    table, n = StateTable(scratch_path(spark, "state")), 40
    table.put(steps(spark, [running(f"s{i:03}", worker=f"w{i % 3}", version=1 + i % 2, attempts=1 + i % 3, deadline=i) for i in range(n)]), 0)
    for b in range(1, 7):
        table.commit(recover.sweep(table.state(spark), at(5 * b)), b)
    return table.path


@pytest.fixture
def filled(table, template):
    shutil.copytree(template, table.path)
    return table


def test_state_is_the_last_snapshot_and_newer_batches_only(spark, filled):
    table = filled
    whole = rows(table.state(spark), "step_id", "status", "lease_version")
    assert _opened(table.state(spark)) == ({0, 1, 2, 3, 4, 5, 6}, set())
    assert table.compact(spark, 4) and not table.compact(spark, 4)
    assert _opened(table.state(spark)) == ({5, 6}, {4})
    assert rows(table.state(spark), "step_id", "status", "lease_version") == whole
    # Earlier states are still there.
    assert _opened(table.state(spark, before=4)) == ({0, 1, 2, 3}, set())
    assert table.state(spark, before=2).where("status = 'RUNNING'").count() == 34
    assert table.compact(spark, 6) and _opened(table.state(spark)) == (set(), {6})
    assert rows(table.state(spark), "step_id", "status", "lease_version") == whole


def test_a_lost_compaction_does_not_count_and_can_be_run_again(spark, filled, monkeypatch):
    table = filled
    from tenure.sources import state

    def lost(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(state, "_touch", lost)
    with pytest.raises(RuntimeError, match="driver lost"):
        table.compact(spark, 5)
    assert table.last_snapshot(spark) is None and _opened(table.state(spark))[1] == set()
    whole = rows(table.state(spark), "step_id", "status")
    monkeypatch.undo()
    assert table.compact(spark, 5) and table.last_snapshot(spark) == 5
    assert rows(table.state(spark), "step_id", "status") == whole


def test_only_the_last_snapshots_stay(spark, filled):
    table = filled
    for b in range(1, 7):
        table.compact(spark, b)
    assert table.last_snapshot(spark) == 6 and table.last_snapshot(spark, before=6) == 5 and table.last_snapshot(spark, before=5) is None


def test_a_snapshot_is_not_shuffled_and_its_ended_steps_not_read(spark, filled):
    table = filled
    table.compact(spark, 4)
    live = table.state(spark, live_only=True)
    assert not any("/ended/" in f for f in live.inputFiles()) and any("/live/" in f for f in live.inputFiles())
    assert {r[0] for r in rows(table.state(spark).where("status in ('READY', 'RUNNING')"), "step_id")} <= {r[0] for r in rows(live, "step_id")}
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = live._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    merge = plan[plan.index("LeftAnti"):]
    assert "Exchange" not in merge[: merge.index("FileScan parquet spark_catalog")]


def test_another_session_finds_the_buckets(spark, filled):
    table = filled
    table.compact(spark, 6)
    other = spark.newSession()
    for kind in ("live", "ended"):
        other.sql(f"DROP TABLE IF EXISTS {table._table(6, kind)}")
    again = StateTable(table.path, buckets=99)  # what it was written with counts
    assert rows(again.state(other), "step_id", "status") == rows(table.state(spark), "step_id", "status")


def test_ids_are_the_same_when_a_batch_is_written_again(spark, filled):
    table = filled
    told = rows(table.events(spark), "id", "xid", "step_id", "event_type", "lease_version", "data")
    table.commit(recover.sweep(table.state(spark, before=3), at(15)).repartition(7), 3)
    assert rows(table.events(spark), "id", "xid", "step_id", "event_type", "lease_version", "data") == told
    assert len({t[0] for t in told}) == len(told) and [t[1] for t in sorted(told)] == sorted(t[1] for t in told)


def test_the_history_is_read_by_pages_and_by_step(spark, filled):
    table = filled
    events, seen, cursor = table.events(spark), [], history.START
    while page := history.page(events, cursor, limit=7).collect():
        seen += [(r.xid, r.id) for r in page]
        cursor = history.next_cursor(page, cursor)
    assert seen == sorted((r.xid, r.id) for r in events.collect()) and len(seen) == 31
    assert history.resolve_cursor(events, seen[9][1]) == history.Cursor(*seen[9])
    assert history.missed_by_id_cursor(events).count() == 0
    texts = dict(rows(history.history(events), "step_id", "history"))
    assert texts["s000"] == "LEASE_RECOVERED:v1" and texts["s005"] == "STEP_DEAD_LETTERED:v2"


def test_no_batch_and_no_event(spark, table):
    with pytest.raises(ValueError, match="no batch"):
        table.state(spark)
    assert table.events(spark).count() == 0 and not table.compact(spark, 3)
    table.put(steps(spark, [{"step_id": "a"}]), 0)
    table.commit(recover.sweep(table.state(spark), NOW), 1)  # nothing is due
    assert rows(table.state(spark), "step_id", "status") == [("a", "READY")] and table.events(spark).count() == 0


def test_a_trigger_opens_the_last_snapshot_and_what_came_after(spark):
    s = schema("steps").add("arrived_at", "timestamp")

    def told(second, *found):
        return [{**r.asDict(), "arrived_at": at(second)} for r in steps(spark, list(found)).collect()]

    parts = [told(i, running(f"s{i}", deadline=i + 2.5), {"step_id": f"r{i}", "status": "RETRY_WAIT", "available_at": at(i + 1)}) for i in range(5)]
    plain = {}
    for every in (2, 100):
        sweeper = Sweeper(scratch_path(spark, "sweeps"), compact_every=every, buckets=2)
        feed = Feed(spark, s, parts)
        drain_batches(feed.stream, sweeper, "sweeps", feed)
        plain[every] = rows(sweeper.state(spark), "step_id", "status"), rows(sweeper.events(spark), "step_id", "event_type", "xid")
        if every == 2:
            batches, snapshots = _opened(sweeper.table.state(spark, before=9, live_only=True))
            assert snapshots == {7} and batches == {8}
            sweeper(spark.createDataFrame([tuple(r.get(c) for c in s.names) for r in parts[4]], s), 4)  # the last batch again
            assert rows(sweeper.state(spark), "step_id", "status") == plain[every][0]
    assert plain[2] == plain[100]
