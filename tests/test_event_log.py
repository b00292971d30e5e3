"""The log in files of known ranges: what a reading returns, and how much of the log it opens."""

import random

import pytest
from tests.helpers import rows

from tenure.operators import history
from tenure.operators.history import Cursor
from tenure.session import scratch_path
from tenure.sources.event_log import EventLog

SCHEMA = "id long, xid long, step_id string, event_type string"
PER_FILE = 50


def _events(n=3_000):
    """Commits out of id order; a third of all events in one step."""
    rng = random.Random(7)
    return [(i, i + rng.randrange(20), "hot" if rng.random() < 0.34 else f"s{rng.randrange(200):03}", "STEP_CLAIMED") for i in range(1, n + 1)]


@pytest.fixture(scope="module")
def told():
    return _events()


@pytest.fixture(scope="module")
def log(spark, told):
    made = EventLog(scratch_path(spark, "event-log"), rows_per_file=PER_FILE, rows_per_group=25)
    for batch in range(4):
        part = [e for e in told if e[0] * 4 // (len(told) + 1) == batch]
        made.append(spark.createDataFrame(part, SCHEMA), batch)
        if batch == 1:
            made.append(spark.createDataFrame(part, SCHEMA).repartition(3), batch)  # again, as after a lost driver
    return made


def _expected(told, after, watermark, limit, step):
    found = sorted((x, i, s) for i, x, s, _ in told if (x, i) > (after.xid, after.id) and (watermark is None or x < watermark) and step in (None, s))
    return found[:limit]


@pytest.mark.parametrize("step", [None, "hot", "s007", "none"])
@pytest.mark.parametrize(("after", "watermark", "limit"), [
    (Cursor(), None, 100), (Cursor(777, 770), None, 60), (Cursor(1_400, 2**40), 1_405, 100), (Cursor(2_980, 0), None, 500), (Cursor(10**9, 0), None, 5), (Cursor(1_490, 1), None, 1),
])
def test_pages_are_those_of_the_whole_log(spark, log, told, step, after, watermark, limit):
    got = log.page(spark, after, watermark, limit, step)
    assert [(r.xid, r.id, r.step_id) for r in got.collect()] == _expected(told, after, watermark, limit, step)


def test_a_page_opens_a_bounded_number_of_files(spark, log, told):
    for copy in ("commits", "steps"):
        assert log.files(spark, copy).agg({"n": "sum"}).first()[0] == len(told) and log.files(spark, copy).count() >= 4 * 15
        assert log.files(spark, copy).where(f"n > {PER_FILE}").count() == 0
    # A page of 40 needs one full file behind the cursor, and those whose ranges lie over it: a few, in a log of any length.
    for after in (Cursor(), Cursor(900, 0), Cursor(2_000, 0)):
        assert len(log.page(spark, after, limit=40).inputFiles()) <= 5
    for step in ("hot", "s007"):
        assert len(log.page(spark, Cursor(1_500, 0), limit=40, step_id=step).inputFiles()) <= 9
    for event_id in (1, 1_500, 3_000):
        found = log.cursor_of(spark, event_id)
        assert len(found.inputFiles()) <= 3
        assert rows(found, "xid", "id") == [(x, i) for i, x, _, _ in told if i == event_id]
    assert log.cursor_of(spark, 10**9).collect() == []


def test_a_lookup_reads_few_rows(spark, log):
    """The scan's own count: row groups are skipped by their statistics and Bloom filters."""
    found = log.cursor_of(spark, 1_500)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()

    def scanned(node):
        here = node.metrics().get("numOutputRows").get().value() if "Scan" in node.nodeName() else 0
        children = node.children()
        below = sum(scanned(children.apply(i)) for i in range(children.size()))
        return here + below + (scanned(node.executedPlan()) if "AdaptiveSparkPlan" in node.nodeName() else 0)

    assert 0 < scanned(plan) <= 3 * 25


def test_paging_through_the_log_loses_nothing(spark, log, told):
    seen, cursor = [], history.START
    while found := log.page(spark, cursor, limit=500).collect():
        seen += [(r.xid, r.id) for r in found]
        cursor = history.next_cursor(found, cursor)
    assert seen == sorted((x, i) for i, x, _, _ in told)


def test_a_limit_is_positive(spark, log):
    with pytest.raises(ValueError, match="positive"):
        log.page(spark, limit=0)
