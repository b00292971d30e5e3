"""The plans are the ones meant, and every query agrees with its SQL."""

import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tenure.functions import fixed
from tenure.operators import effects, history, lease, metrics, ownership, select
from tenure.plans import views as v

QUERIES, SQL = driver.queries(), driver.oracle_sql()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def unpartitioned_windows(text):
    return re.findall(r"Window \[.*\], \[\], \[", text) + re.findall(r"Exchange SinglePartition", text)


def test_top_k_keeps_k_rows_per_task(spark, small):
    text = plan(select.next_claimable(v.steps(spark, small), v.AS_OF, 10))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert "LessThanOrEqual(o_orderdate" in text


def test_top_k_per_group_is_cut_before_the_shuffle(spark, small):
    assert plan(select.next_claimable_per(v.steps(spark, small), v.AS_OF, 3, "attempt_count")).count("WindowGroupLimit") == 2


def test_cursor_pages_push_their_bound(spark, small):
    events = v.table(spark, small, "events").select(F.col("event_id").alias("xid"), F.col("event_id").alias("id"))
    text = plan(history.page(events, history.Cursor(100, 1), 900))
    assert "GreaterThanOrEqual(event_id,100)" in text and "LessThan(event_id,900)" in text


def test_sweeps_and_filters_do_not_shuffle(spark, small):
    from tenure.operators import recover

    for df in (recover.sweep(v.steps(spark, small), v.AS_OF), select.claimable(v.steps(spark, small), v.AS_OF)):
        assert "Exchange" not in plan(df) and "Window" not in plan(df)


def test_no_window_runs_over_raw_rows_in_one_partition(spark, small):
    w, e = v.writes(spark, small), v.events(spark, small)
    for df in (lease.lease_spans(w), lease.authorize_asof(w), history.lifecycle_conformance(e), history.history(e),
               effects.apply_effects(v.effect_requests(spark, small), v.effect_store(spark, small))):
        assert not unpartitioned_windows(plan(df))


def test_running_windows_are_within_slices(spark, small):
    """No window over rows is partitioned by the step alone; only one over slice totals may be."""
    text = plan(lease.with_generation(v.table(spark, small, "events").selectExpr(
        "event_id seq", "user_id step_id", "'w' worker_id", "1 lease_version", "'CLAIM' op", "ts")))
    windows = re.findall(r"\+- Window \[(.*?) windowspecdefinition\((.*?), specified", text)
    assert len(windows) == 2
    assert sum("ts#" in spec for _, spec in windows) == 1
    rows_spec = next(spec for _, spec in windows if "ts#" in spec)
    assert "__slice" in rows_spec


def test_scans_read_only_what_they_need(spark, small):
    text = plan(ownership.duplicate_grants(v.grants(spark, small)))
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_linenumber:int>" in text
    text = plan(metrics.latency_percentiles(metrics.per_step(v.steps(spark, small), v.line_events(spark, small))))
    assert "o_orderpriority" not in text and "l_extendedprice" not in text


def test_no_python_in_batch_plans(spark, small):
    for name in ("lea1_lease_spans", "ide1_apply_effects", "met3_latency_percentiles", "evt6_history", "val5_validate_tasks"):
        assert "Python" not in plan(QUERIES[name](spark, small))


def test_fixed_values():
    assert len(fixed.STATUSES) == 7 and len(fixed.EVENT_TYPES) == 6 and len(fixed.TASK_TYPES) == 3


def test_entry(spark):
    assert driver.entry(spark).columns == ["metric", "n", "p50", "p95", "p99", "max"]
    text = re.compile(r"op\d+_|pipeline$")  # the text operators' queries have SQL only where SQL can say it
    assert set(SQL) <= set(QUERIES)
    assert all(text.match(name) for name in set(QUERIES) - set(SQL))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for file in os.listdir(small):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{small}/{file}'")
    return con


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def comparable(data):
    plain = [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in data]
    return sorted(plain, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    relation = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields} == types
    got = comparable(df.select(*columns).collect())
    want = comparable(relation.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert got == want
