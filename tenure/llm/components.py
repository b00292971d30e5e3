"""Groups of linked ids: union-find inside tasks, smallest labels between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import stored


def _forests(batches):
    """Union-find over one task's links; one row per id that is not its tree's root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(u), root(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    ids = list(parent)
    for i in range(0, len(ids), 50_000):
        part = ids[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (u, v): the smallest id it can reach.

    Every task first shrinks its own links to a forest. Then labels go along what is left
    and along themselves until none changes; each round is one minimum per id, combined
    before the shuffle, so a hub meets nowhere. Only the sum of labels reaches the driver.
    """
    forest = stored(links.mapInArrow(_forests, "u long, v long"), "forest")
    both = forest.select("u", "v").unionAll(forest.select("v", "u")).toDF("id", "label")
    labels = stored(both.unionAll(both.select("id", "id")).groupBy("id").agg(F.min("label").alias("label")), "labels")
    before = None
    while (now := labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]) != before:
        before = now
        of = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
        seen = forest.join(of("u"), "u").join(of("v"), "v").withColumn("low", F.least("u_label", "v_label"))
        told = seen.select(F.explode(F.array("u", "v", "u_label", "v_label")).alias("id"), F.col("low").alias("label"))
        lower = labels.unionAll(told).groupBy("id").agg(F.min("label").alias("label"))
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("further"))
        labels = stored(lower.join(jump, "label").select("id", F.col("further").alias("label")), "labels")
    return labels.withColumnRenamed("label", "component")
