import random

import pytest
from tests.helpers import NOW, at, rows, running, steps, table

from tenure.functions import fixed
from tenure.operators import fold, lease
from tenure.operators.history import emit_events

LEASE = 10_000


def write(seq, step, op, ts, worker="a", version=1, **more):
    return {"seq": seq, "step_id": step, "op": op, "ts": at(ts), "worker_id": worker, "lease_version": version, **more}


def spans(spark, writes):
    columns = ("step_id", "lease_version", "renewals", "deadline", "ended_by", "ended_at")
    return rows(lease.lease_spans(table(spark, "owner_writes", writes), LEASE, slice_s=7), *columns)


def test_renewal_must_come_before_the_deadline(spark):
    got = spans(spark, [
        write(1, "in time", "CLAIM", 0), write(2, "in time", "RENEW", 9.999999), write(3, "in time", "RENEW", 19.9),
        write(4, "at the deadline", "CLAIM", 0), write(5, "at the deadline", "RENEW", 10), write(6, "at the deadline", "RENEW", 11),
        write(7, "never again", "CLAIM", 0), write(8, "never again", "RENEW", 5), write(9, "never again", "RENEW", 15),
        write(10, "never again", "COMPLETE", 16),
    ])
    assert got == [
        ("at the deadline", 1, 0, at(10), "EXPIRED", at(10)),
        ("in time", 1, 2, at(29.9), "EXPIRED", at(29.9)),
        ("never again", 1, 1, at(15), "EXPIRED", at(15)),
    ]


def test_a_generation_ends_with_its_first_live_end(spark):
    got = spans(spark, [
        write(1, "done", "CLAIM", 0), write(2, "done", "RENEW", 5), write(3, "done", "COMPLETE", 14), write(4, "done", "RENEW", 14.5),
        write(5, "done", "FAIL", 15),
        write(6, "too late", "CLAIM", 0), write(7, "too late", "COMPLETE", 10),
        write(8, "not mine", "CLAIM", 0), write(9, "not mine", "COMPLETE", 1, worker="b"), write(10, "not mine", "COMPLETE", 2, version=2),
        write(11, "taken", "CLAIM", 0), write(12, "taken", "CLAIM", 4, worker="b", version=2),
    ])
    assert got == [
        ("done", 1, 1, at(15), "COMPLETE", at(14)), ("not mine", 1, 0, at(10), "EXPIRED", at(10)),
        ("taken", 1, 0, at(10), "SUPERSEDED", at(4)), ("taken", 2, 0, at(14), "EXPIRED", at(14)),
        ("too late", 1, 0, at(10), "EXPIRED", at(10)),
    ]


def test_authorize_names_the_first_broken_condition(spark):
    s = steps(spark, [running("s", "a", 2, deadline=5), {"step_id": "done", "status": "SUCCEEDED", "lease_version": 2}])
    w = table(spark, "owner_writes", [
        write(1, "s", "COMPLETE", 4.9, "a", 2), write(2, "s", "COMPLETE", 5, "a", 2), write(3, "s", "RENEW", 1, "a", 1),
        write(4, "s", "FAIL", 1, "b", 2), write(5, "done", "RENEW", 1, "a", 2), write(6, "none", "RENEW", 1),
    ])
    assert rows(lease.authorize(s, w), "seq", "decision", "accepted") == [
        (1, "ACCEPTED", True), (2, "LEASE_EXPIRED", False), (3, "STALE_VERSION", False), (4, "WRONG_WORKER", False),
        (5, "NOT_RUNNING", False), (6, "NO_SUCH_STEP", False),
    ]


def test_stale_writes_of_a_frozen_worker(spark):
    """A freezes, B takes over and completes; A keeps trying, also under B's name."""
    w = [write(1, "s", "CLAIM", 0), write(2, "s", "RENEW", 1)]
    w += [write(10 + i, "s", op, 12) for i, op in enumerate(lease.OWNER_OPS)]
    w += [write(20, "s", "CLAIM", 13, "b", 2)]
    w += [write(30 + i, "s", op, 14, name) for i, (op, name) in enumerate((o, n) for o in lease.OWNER_OPS for n in "ab")]
    w += [write(40, "s", "COMPLETE", 15, "b", 2)]
    w += [write(50 + i, "s", op, 16) for i, op in enumerate(lease.OWNER_OPS)]
    decisions = lease.authorize_asof(table(spark, "owner_writes", w), LEASE, slice_s=3).cache()
    got = {r.seq: (r.phase, r.accepted) for r in decisions.collect()}
    assert got[2] == ("live", True) and got[40] == ("live", True)
    assert {got[10 + i] for i in range(3)} == {("expired_before_recovery", False)}
    assert {got[30 + i] for i in range(6)} == {("successor_live", False)}
    assert {got[50 + i] for i in range(3)} == {("after_successor_ended", False)}
    assert sum(r.stale_accepted for r in lease.stale_summary(decisions).collect()) == 0


def test_apply_renewals_moves_only_the_deadline(spark):
    s = steps(spark, [running("s", deadline=5), running("t", deadline=5), running("u", deadline=5)])
    w = table(spark, "owner_writes", [
        write(1, "s", "RENEW", 4), write(2, "s", "RENEW", 13.9), write(3, "s", "RENEW", 24), write(4, "t", "RENEW", 5), write(5, "u", "RENEW", 1, "b"),
    ])
    got = lease.apply_renewals(s, w, LEASE)
    assert rows(got, "step_id", "status", "lease_version", "current_worker_id", "lease_expires_at", "renewals") == [("s", "RUNNING", 1, "a", at(23.9), 2)]


def test_apply_completions_takes_the_first_in_time(spark):
    s = steps(spark, [running("s", deadline=5), running("t", deadline=5)])
    w = table(spark, "owner_writes", [
        write(2, "s", "COMPLETE", 3, result='{"n":2}'), write(1, "s", "COMPLETE", 3, result='{"n":1}'), write(3, "s", "COMPLETE", 4),
        write(4, "s", "COMPLETE", 1, "b", result='{"n":0}'), write(5, "t", "COMPLETE", 5),
    ])
    got = lease.apply_completions(s, w)
    assert rows(got, "step_id", "status", "result", "current_worker_id", "lease_expires_at", "lease_version") == [("s", "SUCCEEDED", '{"n":1}', None, None, 1)]
    assert rows(emit_events(got), "event_type", "worker_id", "data") == [("STEP_SUCCEEDED", "a", '{"leaseVersion":1,"attemptCount":1}')]


def test_apply_failures_retries_or_gives_up(spark):
    s = steps(spark, [
        running("retry", version=41, attempts=2, deadline=5), running("spent", attempts=3, deadline=5), running("fatal", deadline=5),
    ])
    w = table(spark, "owner_writes", [
        write(1, "retry", "FAIL", 1, version=41, retryable=True, error="e" * 201), write(2, "spent", "FAIL", 1, retryable=True, error="e"),
        write(3, "fatal", "FAIL", 1, retryable=False, error="e"),
    ])
    got = lease.apply_failures(s, w)
    assert rows(got, "step_id", "status", "available_at", "event_type", "reason") == [
        ("fatal", "DEAD_LETTERED", at(-1), "STEP_DEAD_LETTERED", "non_retryable_failure"),
        ("retry", "RETRY_WAIT", at(2), "STEP_RETRY_SCHEDULED", None),
        ("spent", "DEAD_LETTERED", at(-1), "STEP_DEAD_LETTERED", "attempt_budget_exhausted"),
    ]
    told = {r.step_id: r.data for r in emit_events(got).collect()}
    assert told["retry"].endswith(f'"availableAt":"2024-06-01 12:00:02.000000","error":"{"e" * 199}…"}}')
    assert {r.step_id: len(r.last_error) for r in got.collect()}["retry"] == 201


def test_owner_writes_of_all_kinds_decide_once(spark):
    """The first end in time counts, later writes do not; a renewal lets a later completion in."""
    s = steps(spark, [running("once", deadline=10), running("longer", deadline=30), running("late", deadline=5)])
    w = table(spark, "owner_writes", [
        write(1, "once", "COMPLETE", 1), write(2, "once", "FAIL", 2, retryable=True), write(3, "once", "RENEW", 3),
        write(4, "longer", "RENEW", 20), write(5, "longer", "COMPLETE", 29.9),
        write(6, "late", "RENEW", 4), write(7, "late", "RENEW", 14), write(8, "late", "FAIL", 14.5, retryable=True),
    ])
    ended = lease.apply_completions(s, w, LEASE)
    assert rows(ended, "step_id", "status", "event_at") == [("longer", "SUCCEEDED", at(29.9)), ("once", "SUCCEEDED", at(1))]
    assert lease.apply_failures(s, w, LEASE).count() == 0
    assert rows(lease.apply_renewals(s, w, LEASE), "step_id", "lease_expires_at", "renewals") == [("late", at(14), 1)]


# --- the replay ----------------------------------------------------------------


def random_log(seed, n=600):
    """Many steps, one of them with a third of all writes; ties in time; bad workers and versions."""
    r = random.Random(seed)
    log = []
    for seq in range(n):
        step = 0 if r.random() < 0.34 else r.randrange(1, 40)
        op = r.choices(["CLAIM", "RENEW", "COMPLETE", "FAIL"], [4, 4, 1, 2])[0]
        log.append(write(
            seq, f"s{step}", op, r.randrange(0, 4 * n if step == 0 else 400) / 4, r.choice("aaab"), r.choice([1, 1, 1, 2, 2, 3, 0, 4]),
            retryable=r.random() < 0.8, error=f"error {seq}" if op == "FAIL" else None, result=f'{{"n":{seq}}}' if op == "COMPLETE" else None,
        ))
    return log


def plain_replay(log, as_of, lease_s=10.0, max_attempts=3, begun=None):
    """Row by row, as the rules say; ``begun`` has rows of steps as they were before."""
    decisions, events, state = {}, [], {}
    for step in sorted({w["step_id"] for w in log if w["ts"] <= as_of} | set(begun or ())):
        if begun:
            first = {"status": "READY", "lease_version": 0, "attempt_count": 0, "max_attempts": max_attempts, **begun.get(step, {})}
            found = replay_given(first, [w for w in log if w["step_id"] == step and w["ts"] <= as_of], as_of, lease_s)
            decisions |= found[0]
            events += [(step, *e) for e in found[1]]
            state[step] = found[2]
            continue
        status, version, worker, deadline, due, error, result = "READY", 0, None, None, None, None, None
        mine = sorted((w for w in log if w["step_id"] == step and w["ts"] <= as_of), key=lambda w: (w["ts"], w["seq"]))
        for w in [*mine, None]:
            now = w["ts"] if w else as_of
            if status == "RUNNING" and deadline <= now:
                status = "READY" if version < max_attempts else "DEAD_LETTERED"
                kind = fixed.LEASE_RECOVERED if status == "READY" else fixed.STEP_DEAD_LETTERED
                events.append((step, version, kind, deadline, worker))
                worker = deadline = None
            elif status == "RETRY_WAIT" and due <= now:
                status = "READY"
                events.append((step, version, fixed.RETRY_READY, due, None))
            if w is None:
                continue
            if w["op"] == "CLAIM":
                ok = status == "READY" and version < max_attempts
                if ok:
                    status, version, worker, deadline, due = "RUNNING", version + 1, w["worker_id"], now + (at(lease_s) - NOW), None
                    events.append((step, version, fixed.STEP_CLAIMED, now, worker))
            else:
                ok = status == "RUNNING" and (w["worker_id"], w["lease_version"]) == (worker, version)
                if ok and w["op"] == "RENEW":
                    deadline = now + (at(lease_s) - NOW)
                elif ok:
                    if w["op"] == "COMPLETE":
                        status, kind, result = "SUCCEEDED", fixed.STEP_SUCCEEDED, w["result"]
                    else:
                        error = w["error"]
                        if w["retryable"] and version < max_attempts:
                            status, kind, due = "RETRY_WAIT", fixed.STEP_RETRY_SCHEDULED, now + (at(0.5 * 2 ** (version - 1)) - NOW)
                        else:
                            status, kind = "DEAD_LETTERED", fixed.STEP_DEAD_LETTERED
                    events.append((step, version, kind, now, worker))
                    worker = deadline = None
            decisions[w["seq"]] = ok
        state[step] = (status, version, worker, deadline, error, result)
    return decisions, sorted(events, key=str), state


def replay_given(step, writes, as_of, lease_s):
    """One step from a given row: (decisions, events, (status, generation, attempts, worker, deadline))."""
    decisions, events = {}, []
    status, version, attempts, budget = (step[c] for c in ("status", "lease_version", "attempt_count", "max_attempts"))
    worker, deadline, due = step.get("current_worker_id"), step.get("lease_expires_at"), step.get("available_at")
    for w in [*sorted(writes, key=lambda w: (w["ts"], w["seq"])), {"op": "END", "ts": as_of, "seq": None}]:
        now, left = w["ts"], attempts < budget
        if status == "RUNNING" and deadline <= now:
            events.append((version, fixed.LEASE_RECOVERED if left else fixed.STEP_DEAD_LETTERED, deadline, worker))
            status, worker, deadline, due = "READY" if left else "DEAD_LETTERED", None, None, None
        elif status == "RETRY_WAIT" and due <= now:
            events.append((version, fixed.RETRY_READY, due, None))
            status = "READY"
        if w["op"] == "CLAIM":
            ok = status == "READY" and left and (due is None or due <= now)
            if ok:
                status, version, attempts, worker, deadline, due = "RUNNING", version + 1, attempts + 1, w["worker_id"], now + (at(lease_s) - NOW), None
                events.append((version, fixed.STEP_CLAIMED, now, worker))
        else:
            ok = status == "RUNNING" and (w.get("worker_id"), w.get("lease_version")) == (worker, version)
            if ok and w["op"] == "RENEW":
                deadline = now + (at(lease_s) - NOW)
            elif ok and w["op"] == "COMPLETE":
                events.append((version, fixed.STEP_SUCCEEDED, now, worker))
                status, worker, deadline = "SUCCEEDED", None, None
            elif ok:
                retry = w["retryable"] and left
                events.append((version, fixed.STEP_RETRY_SCHEDULED if retry else fixed.STEP_DEAD_LETTERED, now, worker))
                status, due = ("RETRY_WAIT", now + (at(0.5 * 2 ** min(max(attempts - 1, 0), 3)) - NOW)) if retry else ("DEAD_LETTERED", None)
                worker = deadline = None
        if w["seq"] is not None:
            decisions[w["seq"]] = ok
    return decisions, events, (status, version, attempts, worker, deadline)


def test_fold_from_given_steps_with_budgets_of_their_own(spark):
    """Every status at the start, spent and large budgets, steps without writes and writes without a step."""
    log = random_log(3, 500)
    begun = {}
    for i in range(0, 46):
        status = ("READY", "RUNNING", "RETRY_WAIT", "READY", "PENDING", "SUCCEEDED", "RUNNING")[i % 7]
        begun[f"s{i}"] = {
            "status": status, "lease_version": i % 3, "attempt_count": i % 4, "max_attempts": (1, 2, 3, 7)[i // 2 % 4], "available_at": at(i % 5 * 9),
            **({"current_worker_id": "a", "lease_expires_at": at(i % 6 * 11)} if status == "RUNNING" else {}),
        }
    del begun["s9"], begun["s17"]
    until = at(400.0)
    decisions, events, state = plain_replay(log, until, begun=begun)
    w = table(spark, "owner_writes", log)
    given = steps(spark, [{"step_id": k, "current_worker_id": None, "lease_expires_at": None, **b} for k, b in begun.items()])
    generations = fold.lifecycle_fold(w, until, LEASE, slice_s=5, steps=given)
    assert {r.seq: r.accepted for r in fold.fold_decisions(w, generations, until).collect()} == decisions
    told = fold.fold_events(generations, until).collect()
    assert sorted(((r.step_id, r.lease_version, r.event_type, r.created_at, r.worker_id) for r in told), key=str) == sorted(events, key=str)
    final = fold.fold_state(w, generations, until, given).collect()
    assert {r.step_id: (r.status, r.lease_version, r.attempt_count, r.current_worker_id, r.lease_expires_at) for r in final} == state
    assert {r.attempt_count for r in final} >= set(range(5)) and len(final) == len(state)


@pytest.mark.parametrize("seed,until", [(1, 90.0), (2, 700.0)])
def test_fold_equals_a_row_by_row_replay(spark, seed, until):
    log = random_log(seed)
    decisions, events, state = plain_replay(log, at(until))
    w = table(spark, "owner_writes", log)
    generations = fold.lifecycle_fold(w, at(until), LEASE, slice_s=5)
    got = {r.seq: r.accepted for r in fold.fold_decisions(w, generations, at(until)).collect()}
    assert got == decisions
    told = fold.fold_events(generations, at(until)).collect()
    assert sorted(((r.step_id, r.lease_version, r.event_type, r.created_at, r.worker_id) for r in told), key=str) == events
    final = fold.fold_state(w, generations, at(until)).collect()
    assert {r.step_id: (r.status, r.lease_version, r.current_worker_id, r.lease_expires_at, r.last_error, r.result) for r in final} == state
    # One end per generation at most; every claim is one attempt.
    assert generations.groupBy("step_id", "lease_version").count().where("count > 1").count() == 0
    assert {r.step_id: r.attempt_count for r in final} == {
        s: sum(e[0] == s and e[2] == fixed.STEP_CLAIMED for e in events) for s in state
    }


def test_texts_of_writes_stay_behind_while_steps_are_settled(spark):
    """They do not move with every write; the write that ends a step is looked up, the least of equal ones."""
    s = steps(spark, [running("a", deadline=60)])
    w = table(spark, "owner_writes", [
        write(2, "a", "FAIL", 1, error="x", retryable=False), write(1, "a", "FAIL", 1, error="z", retryable=False), write(1, "a", "FAIL", 1, error="y", retryable=False),
    ])
    settled = lease.settle_steps(s, w, LEASE)
    assert not {"end_retryable", "end_error", "end_result"} & set(settled.columns)
    got = lease.apply_failures(s, w, LEASE)
    assert rows(got, "step_id", "status", "last_error", "event_at") == [("a", "DEAD_LETTERED", "y", at(1))]
