"""One step with a third of all writes: joins to it are split, and slices keep its windows small."""

import pytest
from pyspark.sql import functions as F
from tests.helpers import NOW

from tenure.functions.scalars import plus_ms
from tenure.operators import fold, lease
from tenure.operators.ordered import join_one, salt

N = 60_000


@pytest.fixture
def eager_skew(spark):
    """Skew handling for small tables, and no broadcast that would hide it."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def hot_writes(spark, tmp_path):
    """A written log, as a log of owner writes is."""
    start = F.lit(str(NOW)).cast("timestamp")
    log = spark.range(0, N, 1, 8).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000 + 1).alias("step_id"),
        F.lit("a").alias("worker_id"),
        F.lit(1).alias("lease_version"),
        F.when(F.col("id") < 15_001, "CLAIM").otherwise("RENEW").alias("op"),
        plus_ms(start, F.col("id") * 10).alias("ts"),
        F.lit(True).alias("retryable"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("result"),
    )
    log.write.parquet(str(tmp_path / "log"))
    return spark.read.parquet(str(tmp_path / "log"))


def executed(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_authorize_splits_a_hot_step(eager_skew, hot_writes):
    steps = hot_writes.select("step_id").distinct().select(
        "step_id", F.lit("RUNNING").alias("status"), F.lit("a").alias("current_worker_id"), F.lit(1).alias("lease_version"),
        F.lit("2024-06-01 12:05:00").cast("timestamp").alias("lease_expires_at"),
    )
    steps = eager_skew.createDataFrame(steps.collect(), steps.schema)
    rows, plan = executed(lease.authorize(steps, hot_writes))
    assert len(rows) == N and sum(r.accepted for r in rows) == 30_000
    assert "skew=true" in plan


def test_replay_of_a_hot_step(eager_skew, hot_writes):
    lease_ms = 600_000
    generations = fold.lifecycle_fold(hot_writes, "2024-06-01 12:20:00", lease_ms, slice_s=60)
    found = {r.step_id: r.renewals for r in generations.where("lease_version = 1").collect()}
    assert found[0] == N // 3 - 5_001
    assert sum(found.values()) == N - 15_001


def test_join_one_spreads_a_hot_key(eager_skew, hot_writes):
    one = hot_writes.groupBy("step_id").agg(F.min("ts").alias("first"))
    joined = join_one(hot_writes, one, ["step_id"], salt("seq"))
    sizes = joined.select("step_id", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in sizes) == N
    assert max(r["count"] for r in sizes) < N / 3
