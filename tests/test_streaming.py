
from collections import Counter

import pytest
from tests.helpers import NOW, at, rows, running, steps, table
from tests.test_lease import LEASE, plain_replay, random_log, write

from tenure.operators import history, recover
from tenure.operators.effects import apply_effects
from tenure.plans.arrivals import drain, drain_batches
from tenure.schemas import schema
from tenure.session import scratch_path, shared_folder
from tenure.sources.relations import read_relation, synthetic_steps, tail_events
from tenure.sources.sinks import append_rows, committed_events, current_state, write_transitions
from tenure.streaming.batches import OrderedRelease, Sweeper, event_rate_stream
from tenure.streaming.effects import EffectLog
from tenure.streaming.heartbeats import heartbeat_stream, silences
from tenure.streaming.lifecycle import lifecycle_stream


class Feed:
    """A folder read as a stream; each part arrives just before the query runs once more."""

    def __init__(self, spark, kind_or_schema, parts):
        self.spark = spark
        self.schema = schema(kind_or_schema) if isinstance(kind_or_schema, str) else kind_or_schema
        self.path = scratch_path(spark, "feed")
        self.parts = parts
        spark.createDataFrame([], self.schema).write.parquet(self.path)
        self.stream = spark.readStream.schema(self.schema).parquet(self.path)

    def __iter__(self):
        for part in self.parts:
            data = [tuple(r.get(c) for c in self.schema.names) for r in part]
            self.spark.createDataFrame(data, self.schema).write.mode("append").parquet(self.path)
            yield len(part)


def cut(log, parts, delay):
    """The log in arrival order: by time, out of order by less than ``delay``."""
    ordered = sorted(log, key=lambda w: (w["ts"].timestamp() + (w["seq"] * 37 % 100) / 100 * delay))
    size = -(-len(ordered) // parts)
    return [ordered[i : i + size] for i in range(0, len(ordered), size)]


@pytest.mark.parametrize("parts", [1, 4])
def test_lifecycle_stream_equals_the_replay_however_it_is_cut(spark, parts):
    log = random_log(5, 300)
    end = max(w["ts"] for w in log)
    # The last row only moves the clock: to 200 s past the rest, minus the delay.
    closing = write(10_000, "closing", "CLAIM", (end - NOW).total_seconds() + 200)
    feed = Feed(spark, "owner_writes", [*cut(log, parts, delay=20), [closing]])
    got = drain(lifecycle_stream(feed.stream, LEASE, delay="20 seconds"), "lifecycle", feed).collect()
    decisions, events, _ = plain_replay(log, at((end - NOW).total_seconds() + 180))
    assert {r.seq: r.accepted for r in got if r.seq is not None and r.seq != 10_000} == decisions
    told = [(r.step_id, r.lease_version, r.event_type, r.at, r.worker_id) for r in got if r.event_type and r.step_id != "closing"]
    assert sorted(told, key=str) == events


def test_lifecycle_stream_keeps_many_steps_in_one_group(spark):
    """A group costs a batch of output and trips to the state; steps share one, with few writes that wait or many."""
    log = random_log(6, 700)
    end = max(w["ts"] for w in log)
    waits = Counter(w["step_id"] for w in log if w["op"] == "CLAIM" or 1 <= w["lease_version"] <= 3)
    assert len(waits) > 2 and max(waits.values()) > 64
    closing = write(10_000, "closing", "CLAIM", (end - NOW).total_seconds() + 200)
    feed = Feed(spark, "owner_writes", [*cut(log, 2, delay=20), [closing]])
    got = drain(lifecycle_stream(feed.stream, LEASE, delay="20 seconds", buckets=1), "lifecycle", feed).collect()
    decisions, events, _ = plain_replay(log, at((end - NOW).total_seconds() + 180))
    assert {r.seq: r.accepted for r in got if r.seq is not None and r.seq != 10_000} == decisions
    told = [(r.step_id, r.lease_version, r.event_type, r.at, r.worker_id) for r in got if r.event_type and r.step_id != "closing"]
    assert sorted(told, key=str) == events


def test_lifecycle_stream_from_given_steps_equals_the_replay(spark):
    """Steps in any state, with budgets of their own; the first write brings the row into the state."""
    log = random_log(8, 250)
    end = max(w["ts"] for w in log)
    begun = {}
    for i, name in enumerate(sorted({w["step_id"] for w in log})):
        status = ("READY", "RUNNING", "RETRY_WAIT", "SUCCEEDED", "READY", "PENDING")[i % 6]
        held = {"current_worker_id": "a", "lease_expires_at": at(i % 7 * 13)} if status == "RUNNING" else {"current_worker_id": None, "lease_expires_at": None}
        if i % 11:
            begun[name] = {"status": status, "lease_version": i % 3, "attempt_count": i % 4, "max_attempts": 1 + i % 5, "available_at": at(i % 5 * 9), **held}
    given = steps(spark, [{"step_id": k, **b} for k, b in begun.items()])
    closing = write(10_000, "closing", "CLAIM", (end - NOW).total_seconds() + 200)
    feed = Feed(spark, "owner_writes", [*cut(log, 3, delay=20), [closing]])
    got = drain(lifecycle_stream(feed.stream, LEASE, delay="20 seconds", steps=given), "lifecycle", feed).collect()
    decisions, events, _ = plain_replay(log, at((end - NOW).total_seconds() + 180), begun=begun)
    assert {r.seq: r.accepted for r in got if r.seq is not None and r.seq != 10_000} == decisions
    told = [(r.step_id, r.lease_version, r.event_type, r.at, r.worker_id) for r in got if r.event_type and r.step_id != "closing"]
    claimed = {w["step_id"] for w in log if w["op"] == "CLAIM"}
    assert sorted((t for t in told if t[0] in claimed), key=str) == sorted((e for e in events if e[0] in claimed), key=str)


@pytest.mark.parametrize("parts, buckets", [(1, 16_384), (3, 1)])
def test_time_passes_for_given_steps_that_nothing_counts_for(spark, parts, buckets):
    """Leases lapse and retries come due without a write, and with none but of generations out of reach."""
    held = lambda deadline, **more: {"status": "RUNNING", "lease_version": 1, "attempt_count": 1, "max_attempts": 3, "available_at": at(-1), "current_worker_id": "a", "lease_expires_at": deadline, **more}
    waits = lambda due: held(None, status="RETRY_WAIT", available_at=due, current_worker_id=None)
    begun = {
        "alone": held(at(5.0005)), "beyond": held(at(6)), "spent": held(at(7), attempt_count=3), "renewed": held(at(8)), "far": held(at(10_000)),
        "old": held(at(-86_400 * 365 * 60)), "waits": waits(at(9)), "named": waits(at(9.5)), "later": waits(at(10_000)), "taken": waits(at(3)),
        "idle": held(None, status="READY", current_worker_id=None), "ended": held(None, status="SUCCEEDED", current_worker_id=None),
    }
    log = [
        write(1, "beyond", "COMPLETE", 2, "a", 9), write(2, "renewed", "RENEW", 4, "a", 1), write(3, "taken", "CLAIM", 5, "a", 2),
        write(4, "named", "RENEW", 11, "a", 0), write(5, "new", "CLAIM", 12, "a", 1), write(6, "ended", "COMPLETE", 13, "a", 1),
    ]
    given = steps(spark, [{"step_id": k, **b} for k, b in begun.items()])
    size = -(-len(log) // parts)
    feed = Feed(spark, "owner_writes", [*[log[i : i + size] for i in range(0, len(log), size)], [write(9, "closing", "CLAIM", 60)]])
    got = drain(lifecycle_stream(feed.stream, LEASE, steps=given, buckets=buckets), "lifecycle", feed).collect()
    decisions, events, _ = plain_replay(log, at(60), begun=begun)
    assert {r.seq: r.accepted for r in got if r.seq not in (None, 9)} == decisions
    told = [(r.step_id, r.lease_version, r.event_type, r.at, r.worker_id) for r in got if r.event_type and r.step_id != "closing"]
    assert sorted(told, key=str) == events
    assert {e[0] for e in events} == set(begun) - {"far", "later", "idle", "ended"} | {"new"}


def test_effects_are_first_wins_across_batches(spark):
    def request(seq, key, body, ts):
        return {"idempotency_key": key, "effect_type": "t", "request": body, "ts": at(ts), "seq": seq}

    feed = Feed(spark, "effect_requests", [
        [request(2, "k", '{"value":"v"}', 5), request(1, "k", '{"value":"w"}', 5), request(3, "l", '{"value":1}', 9)],
        [request(4, "k", '{ "value":"w"}', 1), request(5, "l", '{"value":2}', 1)],
    ])
    log = EffectLog(scratch_path(spark, "effect-log"))
    drain_batches(feed.stream, log, "effects", feed)
    got = log.outcomes(spark)
    assert rows(got, "seq", "outcome") == [(1, "APPLIED"), (2, "CONFLICT"), (3, "APPLIED"), (4, "REUSED"), (5, "CONFLICT")]
    stored = {r.seq: r.result for r in got.collect()}
    assert stored[4] == stored[1] is not None


def test_a_later_beat_moves_the_alert(spark):
    def beat(worker, ts):
        return {"worker_id": worker, "ts": at(ts)}

    feed = Feed(spark, "heartbeats", [
        [beat("quiet", 0), beat("busy", 0)], [beat("busy", 5)], [beat("busy", 9), beat("clock", 9.5)], [beat("clock", 14)],
    ])
    got = drain(heartbeat_stream(feed.stream, stale_s=6), "alerts", feed)
    assert rows(got, "worker_id", "last_heartbeat_at", "silent_since") == [("quiet", at(0), at(6))]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_effects_equal_the_batch_however_they_are_cut(spark, parts):
    """Blank and long keys, blank types and broken JSON are answered too; an older store counts."""
    bodies = ['{"value":1}', '{"value": 1}', '{"value":2}', "no json"]
    asked = [
        {"idempotency_key": [" ", "k" * 201, "a", "b", "old"][i % 5], "effect_type": ["t", "t", "t", " "][i % 4],
         "request": bodies[(i // 3) % 4], "ts": at(i), "seq": i}
        for i in range(42)
    ]
    store = spark.createDataFrame(
        [("old", "t", '{"value":2}', "{}", at(-9))], "idempotency_key string, effect_type string, request string, result string, created_at timestamp"
    )
    size = -(-len(asked) // parts)
    feed = Feed(spark, "effect_requests", [asked[i : i + size] for i in range(0, len(asked), size)])
    log = EffectLog(scratch_path(spark, "effect-log"), store)
    drain_batches(feed.stream, log, "effects", feed)
    wanted = apply_effects(table(spark, "effect_requests", asked), store)
    got = rows(log.outcomes(spark), "seq", "outcome", "result")
    assert got == rows(wanted, "seq", "outcome", "result") and len(got) == 42
    assert {o for _, o, _ in got} == {"APPLIED", "REUSED", "CONFLICT", "INVALID"}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_every_silence_counts_however_beats_are_cut(spark, parts):
    seconds = [("a", 0), ("a", 4), ("b", 5), ("a", 10), ("a", 100), ("b", 101), ("a", 106.001), ("z", 120)]
    beats = [{"worker_id": w, "ts": at(t)} for w, t in seconds]
    size = -(-len(beats) // parts)
    feed = Feed(spark, "heartbeats", [beats[i : i + size] for i in range(0, len(beats), size)])
    got = rows(drain(heartbeat_stream(feed.stream, stale_s=6), "alerts", feed), "worker_id", "last_heartbeat_at", "silent_since")
    assert got == [(w, at(t), at(t + 6)) for w, t in [("a", 10), ("a", 100), ("a", 106.001), ("b", 5), ("b", 101)]]
    twin = silences(table(spark, "heartbeats", beats), 6).where("silent_since <= timestamp'2024-06-01 12:02:00'")
    assert rows(twin, "worker_id", "last_heartbeat_at", "silent_since") == got


def test_ordered_release_reports_what_comes_too_late(spark):
    parts = [[{"xid": 9, "id": 1}], [{"xid": 19, "id": 2}], [{"xid": 4, "id": 3}, {"xid": 29, "id": 4}]]
    feed = Feed(spark, spark.createDataFrame([], "xid long, id long").schema, parts)
    release = OrderedRelease(scratch_path(spark, "release"), lambda _, batch: 10 * (batch + 1))
    drain_batches(feed.stream, release, "release", feed)
    assert rows(release.released(spark), "id") == [(1,), (2,), (4,)]
    assert rows(release.late(spark), "xid", "id") == [(4, 3)]


def test_ordered_release_loses_nothing(spark):
    """Transaction 10 is still open when 11 and 12 arrive; nothing overtakes it."""
    parts = [[{"xid": 11, "id": 2}, {"xid": 9, "id": 1}], [{"xid": 12, "id": 4}], [{"xid": 10, "id": 3}], [{"xid": 20, "id": 5}]]
    oldest_open = {0: 10, 1: 10, 2: 13, 3: 21}
    s = spark.createDataFrame([], "xid long, id long").schema
    feed = Feed(spark, s, parts)
    release = OrderedRelease(scratch_path(spark, "release"), lambda _, batch: oldest_open[batch])
    drain_batches(feed.stream, release, "release", feed)
    by_batch = spark.read.parquet(f"{release.path}/released")
    order = [(r.xid, r.id) for r in sorted(by_batch.collect(), key=lambda r: (r.batch_id, r.xid, r.id))]
    assert order == [(9, 1), (10, 3), (11, 2), (12, 4), (20, 5)]
    # The same batch again changes nothing.
    release(spark.createDataFrame([(10, 3)], s), 2)
    assert release.released(spark).count() == 5


def test_sweeper_follows_arrival_and_promotes_nothing_early(spark):
    s = schema("steps").add("arrived_at", "timestamp")

    def told(seconds, *found):
        return [{**r.asDict(), "arrived_at": at(seconds)} for r in steps(spark, list(found)).collect()]

    waiting = {"step_id": "w", "status": "RETRY_WAIT", "available_at": at(3)}
    far = {"step_id": "far", "status": "RETRY_WAIT", "available_at": at(3_600)}
    feed = Feed(spark, s, [told(0, running("a", deadline=5), waiting, far), told(3, {"step_id": "x"}), told(6, {"step_id": "y"})])
    sweeper = Sweeper(scratch_path(spark, "sweeps"))
    drain_batches(feed.stream, sweeper, "sweeps", feed)
    assert rows(sweeper.state(spark), "step_id", "status") == [
        ("a", "READY"), ("far", "RETRY_WAIT"), ("w", "READY"), ("x", "READY"), ("y", "READY"),
    ]
    assert rows(committed_events(spark, sweeper.path), "step_id", "event_type", "created_at", "xid") == [
        ("a", "LEASE_RECOVERED", at(6), 5), ("w", "RETRY_READY", at(3), 3),
    ]


def test_event_rate_drops_late_events(spark):
    s = spark.createDataFrame([], "event_type string, created_at timestamp").schema

    def ended(*seconds):
        return [{"event_type": "STEP_SUCCEEDED", "created_at": at(x)} for x in seconds]

    feed = Feed(spark, s, [ended(0.1, 0.9, 1.5), ended(5.0), ended(0.5, 6.0), ended(9.0)])
    got = drain(event_rate_stream(feed.stream), "rates", feed)
    assert rows(got, "window_start", "n") == [(at(0), 2), (at(1), 1), (at(5), 1), (at(6), 1)]


def test_a_batch_of_transitions_is_replaced_not_repeated(spark):
    path = scratch_path(spark, "transitions")
    s = steps(spark, [running("a", deadline=-1), running("b", attempts=3, deadline=-1)])
    append_rows(s.selectExpr("*", "CAST(NULL AS STRING) event_type", "CAST(NULL AS STRING) event_worker_id",
                             "CAST(NULL AS TIMESTAMP) event_at", "CAST(NULL AS STRING) event_data"), path, 0)
    for _ in range(2):
        write_transitions(recover.recover_expired(s, NOW), path, 1)
    assert rows(current_state(spark, path), "step_id", "status") == [("a", "READY"), ("b", "DEAD_LETTERED")]
    assert rows(current_state(spark, path, before=1), "step_id", "status") == [("a", "RUNNING"), ("b", "RUNNING")]
    assert rows(committed_events(spark, path), "step_id", "event_type", "worker_id", "xid") == [
        ("a", "LEASE_RECOVERED", "a", 1), ("b", "STEP_DEAD_LETTERED", "a", 1),
    ]


def test_tail_resumes_from_its_checkpoint(spark):
    def event(i):
        return {"id": i, "step_id": "s", "event_type": "STEP_CLAIMED", "data": "{}", "created_at": at(i), "xid": i}

    feed = Feed(spark, "step_events", [[event(1), event(2)], [event(3)]])
    out = drain(tail_events(spark, feed.path), "tail", feed)
    assert rows(out, "id") == [(1,), (2,), (3,)]
    assert read_relation(spark, feed.path, "step_events").count() == 3


def test_synthetic_steps(spark):
    got = synthetic_steps(spark, 50, "idempotent_effect", NOW)
    assert got.schema.names == schema("steps").names
    assert got.count() == got.select("step_id").distinct().count() == 50
    assert got.where("payload = '{\"value\":\"idem-50\",\"delayAfterEffectMs\":0}'").count() == 1
    assert table(spark, "steps", [r.asDict() for r in got.limit(3).collect()]).count() == 3


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Context:
        master = "yarn"

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
