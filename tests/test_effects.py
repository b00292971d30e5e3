from tests.helpers import NOW, at, rows, steps, table

from tenure.operators import effects, ownership, tasks, workers


def request(seq, key, body, kind="demo_receipt", ts=0.0):
    return {"idempotency_key": key, "effect_type": kind, "request": body, "ts": at(ts), "seq": seq}


def outcomes(spark, requests, store=()):
    out = effects.apply_effects(table(spark, "effect_requests", requests), table(spark, "idempotent_effects", list(store)))
    return {r.seq: (r.outcome, r.result) for r in out.collect()}


def test_first_wins_and_equal_requests_reuse_it(spark):
    got = outcomes(spark, [
        request(3, "k", '{"b":2, "value":"v"}', ts=2), request(2, "k", '{"value":"v","b":2.0}', ts=1), request(1, "k", '{"value":"w"}', ts=3),
        request(4, "k", '{"value":"v","b":2}', "other", ts=4), request(5, "l", '{"value":7}'),
    ])
    assert got[2][0] == "APPLIED" and got[3] == ("REUSED", got[2][1])
    assert got[1] == got[4] == ("CONFLICT", None)
    assert got[2][1].endswith('"value":"v"}') and got[5][1].endswith('"value":7}')


def test_the_store_wins_over_every_request(spark):
    store = [{"idempotency_key": "k", "effect_type": "demo_receipt", "request": '{"value": "v"}', "result": "old", "created_at": at(99)}]
    requests = [request(1, "k", '{"value":"v"}'), request(2, "k", '{"value":"x"}'), request(3, "new", '{"value":"v"}')]
    got = outcomes(spark, requests, store)
    assert got[1] == ("REUSED", "old") and got[2] == ("CONFLICT", None) and got[3][0] == "APPLIED"
    out = effects.apply_effects(table(spark, "effect_requests", requests), table(spark, "idempotent_effects", store))
    assert rows(effects.new_store_rows(out), "idempotency_key") == [("new",)]


def test_invalid_requests_neither_apply_nor_block(spark):
    bad = [request(1, " ", "{}"), request(2, "k" * 201, "{}"), request(3, "k", "{}", " "), request(4, "k", "not json"), request(5, None, "{}")]
    got = outcomes(spark, [*bad, request(6, "k", "{}", ts=9), request(7, "k" * 200, "{}")])
    assert {got[i][0] for i in range(1, 6)} == {"INVALID"}
    assert got[6][0] == got[7][0] == "APPLIED"


def test_a_hot_key_applies_once(spark):
    got = outcomes(spark, [request(i, "hot", f'{{"value":{i % 2}}}', ts=i % 50) for i in range(2000)])
    assert sorted(o for o, _ in got.values()).count("APPLIED") == 1 and got[0][0] == "APPLIED"
    assert sum(o == "REUSED" for o, _ in got.values()) == 999


def test_hot_keys_and_others_decide_alike(spark):
    """Spread over parts or whole in a task, a key's outcomes are the same; stored, invalid and missing keys too."""
    asked = [request(i, f"k{i % 7}" if i % 3 else "hot", f'{{"value":{i % 2}}}', ts=i % 50) for i in range(600)]
    asked += [request(600 + i, None, "{}") for i in range(50)] + [request(700, "hot", "no JSON"), request(701, "k1", '{"value" : 1.0}', ts=99)]
    store = [{"idempotency_key": k, "effect_type": "demo_receipt", "request": '{"value":1}', "result": f"old {k}", "created_at": at(0)} for k in ("k3", "gone")]
    tables = table(spark, "effect_requests", asked), table(spark, "idempotent_effects", store)
    whole, spread, mixed = (
        {r.seq: (r.outcome, r.result) for r in effects.apply_effects(*tables, hot_rows=n).collect()} for n in (10_000, 0, 100)
    )
    assert whole == spread == mixed and len(whole) == len(asked)
    assert sum(o == "APPLIED" for o, _ in whole.values()) == 7 and "old k3" in {r for _, r in whole.values()}


def test_effect_tasks_use_one_receipt_per_step(spark):
    uuid = "ABCDEF01-0000-4000-8000-000000000001"
    s = steps(spark, [{"step_id": uuid, "task_type": "idempotent_effect", "payload": '{"value":"v","delayAfterEffectMs":0}', "attempt_count": 1}])
    first = tasks.run_effect_tasks(s, table(spark, "idempotent_effects", [])).first()
    assert first.outcome == "APPLIED" and first.idempotency_key == f"step:{uuid.lower()}:demo_receipt"
    assert first.request == f'{{"stepId":"{uuid.lower()}","value":"v"}}'
    stored = [{"idempotency_key": first.idempotency_key, "effect_type": "demo_receipt", "request": first.request, "result": first.result, "created_at": NOW}]
    again = tasks.run_effect_tasks(s, table(spark, "idempotent_effects", stored)).first()
    assert (again.outcome, again.result) == ("REUSED", first.result)


def test_effect_consistency(spark):
    seen = table(spark, "effect_observations", [
        {"step_id": s, "applied": a, "effect_id": e} for s, a, e in
        [("good", True, "1"), ("good", False, "1"), ("twice", True, "2"), ("twice", True, "2"), ("two ids", True, "3"), ("two ids", False, "4"), ("other", True, "5")]
    ])
    store = spark.createDataFrame([("good", "1"), ("twice", "2"), ("two ids", "3"), ("other", "6")], "step_id string, effect_id string")
    got = rows(effects.effect_consistency(seen, store), "step_id", "not_applied_once", "several_ids", "differs_from_store")
    assert got == [("other", False, False, True), ("twice", True, False, False), ("two ids", False, True, True)]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    data = [("a", 1), ("b", None), ("c", 3)]
    base = effects.fingerprint(spark.createDataFrame(data, "k string, n int")).first()
    assert effects.fingerprint(spark.createDataFrame(data[::-1], "k string, n int").repartition(3)).first() == base
    assert effects.fingerprint(spark.createDataFrame([("a", 1), ("b", 0), ("c", 3)], "k string, n int")).first() != base


def test_ownership_audit(spark):
    grants = table(spark, "client_grants", [
        {"claimer_id": c, "step_id": s, "lease_version": v, "attempt_count": v} for c, s, v in
        [("c1", "good", 1), ("c2", "good", 2), ("c1", "double", 1), ("c2", "double", 1), ("c1", "gap", 2), ("c1", "untold", 1)]
    ])
    events = spark.createDataFrame(
        [("good", 1, "c1"), ("good", 2, "c2"), ("double", 1, "c1"), ("gap", 2, "c9"), ("extra", 1, "c1")],
        "step_id string, lease_version int, worker_id string",
    ).selectExpr("*", "'STEP_CLAIMED' AS event_type")
    s = steps(spark, [
        {"step_id": "good", "status": "RUNNING", "lease_version": 2, "current_worker_id": "c2"}, {"step_id": "double", "lease_version": 1},
        {"step_id": "gap", "lease_version": 2}, {"step_id": "untold", "status": "RUNNING", "lease_version": 1, "current_worker_id": "c7"},
        {"step_id": "never", "lease_version": 0}, {"step_id": "ghost", "status": "RUNNING", "lease_version": 1, "current_worker_id": "c1"},
    ])
    assert rows(ownership.duplicate_grants(grants), "step_id", "grants", "claimers") == [("double", 2, 2)]
    assert rows(ownership.grants_vs_events(grants, events), "step_id", "problem") == [
        ("double", "GRANT_WITHOUT_MATCHING_EVENT"), ("extra", "EVENT_WITHOUT_GRANT"), ("gap", "GRANT_WITHOUT_MATCHING_EVENT"),
        ("untold", "GRANT_WITHOUT_MATCHING_EVENT"),
    ]
    assert rows(ownership.generation_gaps(grants, s), "step_id") == [("double",), ("gap",), ("ghost",)]
    assert rows(ownership.running_owner_mismatch(s, grants), "step_id", "granted_to") == [("ghost", None), ("untold", "c1")]
    counters = table(spark, "claimer_counters", [
        {"claimer_id": c, "attempts": 10, "empty": e, "consistency_errors": 0, "other_errors": 1} for c, e in [("c1", 6), ("c2", 8), ("idle", 10)]
    ])
    total = ownership.claimer_summary(counters, grants, s).first()
    assert (total.claimers, total.attempted_claims, total.successful_claims, total.min_grants, total.max_grants) == (3, 30, 6, 0, 4)
    assert (total.min_generations, total.max_generations, total.mean_generations) == (0, 2, 1.2)


def test_workers(spark):
    regs = table(spark, "heartbeats", [{"worker_id": w, "ts": at(t)} for w, t in [("a", 0), ("a", 50), ("b", 10)]])
    beats = table(spark, "heartbeats", [{"worker_id": w, "ts": at(t)} for w, t in [("a", 20), ("a", 60), ("b", 5), ("b", 10), ("c", 1)]])
    assert rows(workers.latest_registration(regs, beats), "worker_id", "started_at", "last_heartbeat_at") == [("a", at(50), at(60)), ("b", at(10), at(10))]
    assert rows(workers.unregistered_beats(beats, regs), "worker_id", "ts") == [("b", at(5)), ("c", at(1))]


def test_only_the_lease_decides(spark):
    s = steps(spark, [
        {"step_id": i, "status": "RUNNING", "current_worker_id": w, "lease_version": 1, "lease_expires_at": at(d)}
        for i, w, d in [("1", "fresh", -1), ("2", "stale", 1), ("3", "missing", 0), ("4", "fresh", 1)]
    ])
    known = table(spark, "workers", [
        {"worker_id": "fresh", "started_at": at(-99), "last_heartbeat_at": at(-6)}, {"worker_id": "stale", "started_at": at(-99), "last_heartbeat_at": at(-6.001)},
    ])
    assert rows(workers.liveness_vs_lease(s, known, NOW), "heartbeat", "lease", "steps") == [
        ("fresh", "expired", 1), ("fresh", "live", 1), ("stale", "live", 1), ("unknown", "expired", 1),
    ]
