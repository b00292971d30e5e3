import pytest
from tests.helpers import NOW, at, rows, running, steps

from tenure.functions import fixed
from tenure.operators import recover, select, tasks, validate
from tenure.operators.history import emit_events


def ids(df):
    return [r.step_id for r in df.collect()]


def test_audit_steps_finds_each_broken_rule(spark):
    s = steps(spark, [
        {"step_id": "ok"}, running("fine"),
        {"step_id": "negative", "attempt_count": -1}, {"step_id": "none", "max_attempts": 0},
        running("no owner", worker=None), running("version 0", version=0), running("no deadline", lease_expires_at=None),
        {"step_id": "null type", "task_type": None},
    ])
    assert rows(validate.audit_steps(s), "step_id", "rule") == sorted([
        ("negative", "attempt_count_nonnegative"), ("none", "max_attempts_positive"), ("no owner", "running_requires_owner"),
        ("version 0", "running_requires_owner"), ("no deadline", "running_requires_owner"), ("null type", "task_type_not_null"),
    ])


def test_vocabulary_counts_null_as_unknown(spark):
    df = spark.createDataFrame([("READY",), ("ready",), (None,)], "status string")
    assert {r[0] for r in validate.audit_vocabulary(df, "status", fixed.STATUSES).collect()} == {"ready", None}


def test_audit_transitions(spark):
    chain = ["PENDING", "READY", "RUNNING", "READY", "RUNNING", "SUCCEEDED", "READY"]
    data = [("a", at(i), i, s) for i, s in enumerate(chain)] + [("b", at(0), 0, "SUCCEEDED")]
    h = spark.createDataFrame(data, "step_id string, ts timestamp, seq long, status string")
    assert rows(validate.audit_transitions(h, slice_s=2), "step_id", "seq", "from_status", "to_status") == [("a", 6, "SUCCEEDED", "READY")]


@pytest.mark.parametrize("task,payload,attempt,expected", [
    ("hash_after_delay", '{"input":"a","delayMs":0}', 1, None),
    ("hash_after_delay", '{"input":"a","delayMs":60000}', 1, None),
    ("hash_after_delay", '{"input":"a","delayMs":60001}', 1, "INVALID"),
    ("hash_after_delay", '{"input":"a","delayMs":-1}', 1, "INVALID"),
    ("hash_after_delay", '{"input":"a","delayMs":0.5}', 1, "INVALID"),
    ("hash_after_delay", '{"input":"a","delayMs":"5"}', 1, "INVALID"),
    ("hash_after_delay", '{"input":"","delayMs":0}', 1, "INVALID"),
    ("hash_after_delay", '{"delayMs":0}', 1, "INVALID"),
    ("hash_after_delay", "null", 1, "INVALID"),
    ("hash_after_delay", "7", 1, "INVALID"),
    ("hash_after_delay", '{"input":"a","delayMs":0}', 0, "INVALID"),
    ("mystery", "{}", 1, "INVALID"),
    (None, "{}", 1, "INVALID"),
    ("fail_then_hash", '{"input":"a","failuresBeforeSuccess":2}', 2, "RUNTIME"),
    ("fail_then_hash", '{"input":"a","failuresBeforeSuccess":2}', 3, None),
    ("fail_then_hash", '{"input":"a","failuresBeforeSuccess":9007199254740992}', 1, "INVALID"),
    ("idempotent_effect", '{"value":"v","delayAfterEffectMs":0}', 1, None),
    ("idempotent_effect", '{"value":"v","delayAfterEffectMs":0,"idempotencyKey":null}', 1, "INVALID"),
    ("idempotent_effect", '{"value":"","delayAfterEffectMs":0}', 1, "INVALID"),
])
def test_validate_tasks(spark, task, payload, attempt, expected):
    s = steps(spark, [{"step_id": "00000000-0000-4000-8000-000000000001", "task_type": task, "payload": payload, "attempt_count": attempt}])
    found = validate.validate_tasks(s).first()
    assert found.error_class == expected and (found.error is None) == (expected is None)


def test_run_tasks_hashes_the_input(spark):
    s = steps(spark, [{"payload": '{"input":"abc","failuresBeforeSuccess":1}', "attempt_count": n, "step_id": str(n)} for n in (1, 2)])
    got = {r.step_id: (r.result, r.error) for r in tasks.run_tasks(s).collect()}
    assert got["1"] == (None, "fail_then_hash deterministic failure on attempt 1")
    assert got["2"] == ('{"hash":"ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}', None)


def test_audit_keys(spark):
    df = spark.createDataFrame([(" ", "k" * 200, "t"), ("w", "k" * 201, ""), ("w", "", "t")], "worker_id string, idempotency_key string, effect_type string")
    assert rows(validate.audit_keys(df), "rule") == [("effect_type_blank",), ("idempotency_key_blank",), ("idempotency_key_too_long",), ("worker_id_blank",)]


def test_claim_order_is_priority_then_age_then_id(spark):
    s = steps(spark, [
        {"step_id": "p1", "priority": 1, "available_at": at(-60)}, {"step_id": "p5 old", "priority": 5, "available_at": at(-30)},
        {"step_id": "p5 new", "priority": 5, "available_at": at(-10)}, {"step_id": "p10", "priority": 10, "available_at": at(-1)},
        {"step_id": "tie b", "priority": 0}, {"step_id": "tie a", "priority": 0},
    ])
    assert ids(select.next_claimable(s, NOW, 6)) == ["p10", "p5 old", "p5 new", "p1", "tie a", "tie b"]
    busy = spark.createDataFrame([("p10",), ("p5 old",)], "step_id string")
    assert ids(select.next_claimable(select.excluding_busy(s, busy), NOW, 1)) == ["p5 new"]


def test_what_is_not_claimable(spark):
    others = [{"step_id": x, "status": x} for x in fixed.STATUSES if x not in ("READY", "RUNNING")]
    s = steps(spark, [
        *others, running("r"), {"step_id": "later", "priority": 100, "available_at": at(0.001)},
        {"step_id": "spent", "attempt_count": 3}, {"step_id": "now", "available_at": NOW}, {"step_id": "last try", "attempt_count": 2},
    ])
    assert sorted(ids(select.claimable(s, NOW))) == ["last try", "now"]


def test_next_claimable_per_group(spark):
    s = steps(spark, [{"step_id": f"{t}{i}", "task_type": t, "priority": i} for t in "ab" for i in range(5)])
    assert sorted(ids(select.next_claimable_per(s, NOW, 2, "task_type"))) == ["a3", "a4", "b3", "b4"]


def test_assign_batch_gives_each_step_one_worker(spark):
    s = steps(spark, [{"step_id": f"s{i}", "priority": i, "lease_version": 4, "attempt_count": 1} for i in range(5)])
    workers = spark.createDataFrame([("w1",), ("w2",), ("w3",), ("w3",)], "worker_id string")
    got = select.assign_batch(s, workers, NOW, 30_000, 3)
    assert rows(got, "step_id", "current_worker_id", "status", "lease_version", "attempt_count", "lease_expires_at") == [
        ("s2", "w3", "RUNNING", 5, 2, at(30)), ("s3", "w2", "RUNNING", 5, 2, at(30)), ("s4", "w1", "RUNNING", 5, 2, at(30)),
    ]


def test_lease_clock(spark):
    s = steps(spark, [running("live", deadline=1.26), running("gone", deadline=0)])
    assert rows(select.lease_clock(s, NOW), "step_id", "lease_remaining_s", "deadline_passed") == [("gone", 0.0, True), ("live", 1.3, False)]


def test_any_in_status(spark):
    s = steps(spark, [{"status": "SUCCEEDED"}])
    assert not select.any_in_status(s, "READY", "RUNNING").first().busy
    assert select.any_in_status(s, "SUCCEEDED").first().busy


def test_recovery_boundaries_and_budget(spark):
    s = steps(spark, [
        running("at the deadline", worker="w", version=7, attempts=2, deadline=0), running("spent", version=3, attempts=3, deadline=-5),
        running("live", deadline=0.001), {"step_id": "ghost", "status": "SUCCEEDED", "current_worker_id": "w", "lease_expires_at": at(-9)},
    ])
    got = recover.recover_expired(s, NOW)
    assert rows(got, "step_id", "status", "event_type", "event_worker_id", "reason", "lease_version", "attempt_count", "current_worker_id") == [
        ("at the deadline", "READY", "LEASE_RECOVERED", "w", None, 7, 2, None),
        ("spent", "DEAD_LETTERED", "STEP_DEAD_LETTERED", "a", "lease_expired_attempt_budget_exhausted", 3, 3, None),
    ]
    told = {r.step_id: r.data for r in emit_events(got).collect()}
    assert told["at the deadline"] == '{"leaseVersion":7,"attemptCount":2,"previousWorkerId":"w"}'
    assert '"reason":"lease_expired_attempt_budget_exhausted"' in told["spent"]


def test_recovery_is_bounded_and_oldest_first(spark):
    s = steps(spark, [running(f"{i:03d}", deadline=-i) for i in range(101)])
    bounded = ids(recover.recover_expired(s, NOW))
    assert len(bounded) == 100 and "000" not in bounded
    assert recover.recover_expired(s, NOW, limit=None).count() == 101


def test_promotion_keeps_the_budget_unchecked(spark):
    s = steps(spark, [
        {"step_id": "due", "status": "RETRY_WAIT", "available_at": NOW, "attempt_count": 3},
        {"step_id": "early", "status": "RETRY_WAIT", "available_at": at(0.001)},
    ])
    assert rows(recover.promote_due(s, NOW), "step_id", "status", "event_type", "event_worker_id") == [("due", "READY", "RETRY_READY", None)]


def test_sweep_is_recovery_and_promotion(spark):
    s = steps(spark, [
        running("a", deadline=-1), running("b", attempts=3, deadline=-1), running("c", deadline=1),
        {"step_id": "d", "status": "RETRY_WAIT"}, {"step_id": "e"},
    ])
    columns = ("step_id", "status", "event_type", "event_worker_id", "reason", "current_worker_id", "lease_expires_at")
    both = rows(recover.recover_expired(s, NOW, None).select(*columns).union(recover.promote_due(s, NOW, None).select(*columns)), *columns)
    assert rows(recover.sweep(s, NOW), *columns) == both and len(both) == 3


def test_attempt_budget_counts_crashes(spark):
    s = steps(spark, [{"step_id": "a", "attempt_count": 2}, {"step_id": "b", "attempt_count": 4}])
    assert rows(recover.attempt_budget(s), "step_id", "claims_used", "claims_left", "exhausted") == [("a", 2, 1, False), ("b", 4, 0, True)]


def test_busy_probe_stops_at_the_first_match(spark, small):
    from tenure.plans import views

    plan = select.any_in_status(views.steps(spark, small), "READY")._jdf.queryExecution().executedPlan().toString()
    assert "Limit" in plan


def test_assign_batch_ranks_both_sides_by_range(spark):
    """All workers of a table, ties down to the id, without a window over all rows."""
    s = steps(spark, [{"step_id": f"s{i:03}", "priority": i % 3, "available_at": at(-(i % 4) - 1)} for i in range(150)]).repartition(5)
    workers = spark.createDataFrame([(f"w{i:03}",) for i in range(90)], "worker_id string").repartition(3)
    got = dict(rows(select.assign_batch(s, workers, NOW, 30_000), "current_worker_id", "step_id"))
    order = sorted(range(150), key=lambda i: (-(i % 3), -(i % 4), f"s{i:03}"))
    assert got == {f"w{k:03}": f"s{i:03}" for k, i in enumerate(order[:90])}
    assert select.assign_batch(s, workers.where("false"), NOW, 30_000).count() == 0
