"""Histories against automata, and the log followed by a cursor."""

import random

import pytest
from tests.helpers import at, rows

from tenure.functions import fixed
from tenure.operators import grammar
from tenure.operators.history import Cursor
from tenure.plans.arrivals import drain_batches
from tenure.session import scratch_path
from tenure.streaming.tail import Tail
from tests.test_streaming import Feed

EVENTS = "step_id string, xid long, id long, event_type string, lease_version int"
CRASH = [tuple(e.split(":v")) for e in fixed.CRASH_HISTORY.split()]
RETRY = [tuple(e.split(":v")) for e in fixed.RETRY_HISTORY.split()]


def _walk(pattern, events):
    state, bad, claims, steady = pattern.start, None, 0, True
    moves = {m[:2]: m[2] for m in pattern.moves}
    for _xid, id_, kind, version in sorted(events):
        after = moves.get((state, kind), grammar.DEAD)
        if after == grammar.DEAD and bad is None:
            bad = id_
        state = after
        claims += kind == fixed.STEP_CLAIMED
        steady &= version == claims
    return len(events), state, state in pattern.accepting, bad, steady


def _log(seed, n):
    """Legal histories of any length, some cut short, some with an event changed; step "hot" has a third of all events."""
    rng, log, next_id = random.Random(seed), {}, 0
    for k in range(n):
        step = "hot" if k == 0 else f"s{k}"
        events, version = [], 0
        for _ in range(n if k == 0 else rng.randrange(4)):
            version += 1
            events.append((fixed.STEP_CLAIMED, version))
            events += [(fixed.LEASE_RECOVERED, version)] if rng.random() < 0.5 else [(fixed.STEP_RETRY_SCHEDULED, version), (fixed.RETRY_READY, version)]
        events += [(fixed.STEP_CLAIMED, version + 1), (rng.choice(fixed.TERMINAL_EVENT_TYPES), version + 1)]
        if rng.random() < 0.3 and k:
            events[rng.randrange(len(events))] = (rng.choice([*fixed.EVENT_TYPES, "UNKNOWN", None]), rng.choice([version, 1, None]))
        if rng.random() < 0.2 and k:
            events = events[: rng.randrange(1, len(events) + 1)]
        log[step] = [(next_id + i + i // 5, next_id + i, kind, v) for i, (kind, v) in enumerate(events)]
        next_id += len(events)
    return log


@pytest.mark.parametrize("parts", [1, 9, None])
@pytest.mark.parametrize("pattern", [grammar.lifecycle(), grammar.lifecycle(3), grammar.sequence([fixed.STEP_CLAIMED, fixed.STEP_SUCCEEDED])])
def test_matches_equal_a_walk_however_the_log_is_cut(spark, pattern, parts):
    log = _log(4, 150)
    df = spark.createDataFrame([(s, *e) for s, events in log.items() for e in events], EVENTS).repartition(6)
    got = {r[0]: tuple(r)[1:] for r in grammar.matches(df, pattern, parts=parts).collect()}
    assert got == {s: _walk(pattern, events) for s, events in log.items()}
    assert {r[2] for r in got.values()} == {True, False} or pattern.start == "0"


def test_the_two_expected_histories(spark):
    told = [("crash", CRASH), ("retry", RETRY), ("open", CRASH[:-1]), ("stale", [*CRASH[:-1], ("STEP_SUCCEEDED", "1")])]
    df = spark.createDataFrame([(s, i, i, kind, int(v)) for s, events in told for i, (kind, v) in enumerate(events)], EVENTS)
    got = rows(grammar.matches(df, grammar.lifecycle(2)), "step_id", "state", "accepted", "first_illegal_id", "generations_ok")
    assert got == [
        ("crash", "STEP_SUCCEEDED 2", True, None, True), ("open", "STEP_CLAIMED 2", False, None, True),
        ("retry", "STEP_SUCCEEDED 2", True, None, True), ("stale", "STEP_SUCCEEDED 2", True, None, False),
    ]
    exact = grammar.sequence([kind for kind, _ in CRASH])
    assert rows(grammar.matches(df, exact).where("accepted"), "step_id") == [("crash",), ("stale",)]
    assert rows(grammar.matches(df, grammar.lifecycle(1)), "step_id", "first_illegal_id") == [("crash", 2), ("open", 2), ("retry", 3), ("stale", 2)]


def test_a_hot_step_is_spread_and_nothing_is_collected(spark):
    events = _log(1, 400)["hot"]
    df = spark.createDataFrame([("hot", *e) for e in events], EVENTS)
    found = grammar.matches(df, grammar.lifecycle(), parts=8)
    assert rows(found, "n_events", "accepted") == [(len(events), True)]
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "rangepartitioning(step_id" in plan
    # Ranges of one step: its part in each range is one row for the composition.
    ranges = df.repartitionByRange(8, "step_id", "xid", "id").rdd.glom().map(len).collect()
    assert sum(n > 0 for n in ranges) >= 6


def test_null_steps_and_empty_logs(spark):
    none = spark.createDataFrame([], EVENTS)
    assert grammar.matches(none, grammar.lifecycle()).collect() == []
    df = spark.createDataFrame([(None, 1, 1, fixed.STEP_CLAIMED, 1), ("a", 2, 2, None, None)], EVENTS)
    assert rows(grammar.matches(df, grammar.lifecycle()), "step_id", "state", "first_illegal_id") == [("a", grammar.DEAD, 2)]


def test_an_automaton_has_one_move_for_an_event():
    with pytest.raises(ValueError, match="two moves"):
        grammar.Automaton("a", ("b",), (("a", "x", "b"), ("a", "x", "a")))
    with pytest.raises(ValueError, match="illegal"):
        grammar.Automaton("a", ("illegal",), ())


TAILED = "xid long, id long, created_at timestamp"


def _tail(spark, parts, watermarks, page=3):
    feed = Feed(spark, spark.createDataFrame([], TAILED).schema, parts)
    given = iter(watermarks)
    tail = Tail(lambda s: s.read.schema(TAILED).parquet(feed.path), scratch_path(spark, "tail"), lambda _: next(given), page)
    return feed, tail


def test_tail_passes_every_event_once_in_commit_order(spark):
    """Transaction 10 is open while 11 and 12 commit; its event has the lowest id."""
    event = lambda xid, id_: {"xid": xid, "id": id_, "created_at": at(id_)}
    parts = [[event(11, 5), event(9, 1)], [event(12, 6)], [event(10, 2), event(12, 4)], [event(20, 9)]]
    feed, tail = _tail(spark, parts, [10, 10, 13, None])
    drain_batches(feed.stream, tail, "tail-state", feed)
    told = rows(tail.events(spark), "position", "page", "xid", "id")
    assert told == [(1, 0, 9, 1), (2, 0, 10, 2), (3, 0, 11, 5), (4, 1, 12, 4), (5, 1, 12, 6)]
    assert [r.id for r in tail.poll(spark, 1).collect()] == [4, 6]
    assert tail.cursor(spark, 3) == {"xid": 12, "id": 6, "position": 5}


def test_tail_resumes_where_a_batch_was_lost(spark):
    event = lambda i: {"xid": i, "id": i, "created_at": at(i)}
    parts = [[event(i) for i in range(1, 8)], [event(i) for i in range(8, 12)]]
    feed, tail = _tail(spark, parts, [7, 99, 99, 99])
    steps = iter(feed)
    next(steps)
    drain_batches(feed.stream, tail, "tail-state", (0,))
    before = rows(tail.events(spark), "id", "position")
    next(steps)
    news = spark.createDataFrame([], TAILED)
    tail(news, 1)  # written, but the query was lost before it could say so
    tail(news, 1)
    tail(news, 2)  # nothing new
    assert sorted((r.id, r.position) for r in tail.events(spark).collect()) == [(i, i) for i in range(1, 12)]
    assert before == [(i, i) for i in range(1, 7)] and tail.events(spark).groupBy("page").count().where("count > 3").count() == 0


def test_tail_starts_behind_a_cursor_and_prunes(spark):
    event = lambda i: {"xid": i // 2, "id": i, "created_at": at(i)}
    feed, _ = _tail(spark, [[event(i) for i in range(20)]], [])
    list(feed)
    tail = Tail(lambda s: s.read.schema(TAILED).parquet(feed.path), scratch_path(spark, "tail"), lambda _: 9, 200, Cursor(3, 6))
    tail(spark.createDataFrame([], TAILED), 0)
    assert sorted(r.id for r in tail.events(spark).collect()) == list(range(7, 18))
    with pytest.raises(ValueError, match="page"):
        Tail(None, "", None, page=0)
