"""Where two versions of a table differ: a tree of checksums over ranges of the key's hash.

A version is written by range of the hash of its key, with one checksum for each of the
finest ranges and, level by level, one for each group of ``FAN`` of them. Two versions are
compared from the root down, and only below nodes that differ; the rows themselves are
read only in the ranges that are left, so equal versions cost one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN_BITS = 4
FAN = 1 << FAN_BITS
_PLACE, _LEAF = "__place", "__leaf"
_SUMS = ("n", "c1", "c2")


class HashTree:
    """One version of a table below ``path``, compared with others by ``keys``."""

    def __init__(self, path: str, keys: Sequence[str], levels: int = 3):
        """``levels`` below the root; there are ``FAN ** levels`` ranges."""
        self.path, self.keys, self.levels = path.rstrip("/"), list(keys), levels

    def write(self, df: DataFrame) -> None:
        """Rows in order of the hash, a folder for each range of the first level; then the checksums, coarsest last."""
        spark = df.sparkSession
        place = F.xxhash64(*self.keys)
        leaf = F.call_function("shiftrightunsigned", place, F.lit(64 - FAN_BITS * self.levels))
        top = F.call_function("shiftright", F.col(_LEAF), F.lit(FAN_BITS * (self.levels - 1))).cast("int")
        rows = df.withColumn(_PLACE, place).withColumn(_LEAF, leaf).withColumn("__top", top)
        rows.repartitionByRange("__top", _LEAF, _PLACE).sortWithinPartitions("__top", _LEAF, _PLACE).write.mode("overwrite").partitionBy("__top").parquet(f"{self.path}/rows")
        rows.where(F.lit(False)).write.mode("overwrite").parquet(f"{self.path}/columns")  # an empty table leaves no folder behind
        written = spark.read.schema(rows.schema).parquet(f"{self.path}/rows")
        nodes = written.groupBy(F.col(_LEAF).alias("node")).agg(*_sums(df.columns))
        for level in range(self.levels, -1, -1):
            nodes.write.mode("overwrite").parquet(f"{self.path}/level={level}")
            nodes = spark.read.schema(nodes.schema).parquet(f"{self.path}/level={level}")
            above = F.call_function("shiftright", F.col("node"), F.lit(FAN_BITS)).alias("node")
            nodes = nodes.groupBy(above).agg(*[F.sum(c).cast(nodes.schema[c].dataType).alias(c) for c in _SUMS])

    def nodes(self, spark: SparkSession, level: int) -> DataFrame:
        """node, n, c1, c2 of one level; the root is level 0."""
        return spark.read.parquet(f"{self.path}/level={level}")

    def differing_leaves(self, spark: SparkSession, other: HashTree) -> list[int]:
        """Ranges whose checksums differ, found from the root down; ``FAN ** levels`` numbers at most."""
        if (self.keys, self.levels) != (other.keys, other.levels):
            raise ValueError("trees of different keys or depth")
        suspects = [0]
        for level in range(self.levels + 1):
            mine, theirs = (
                t.nodes(spark, level).where(F.col("node").isin(suspects)).select("node", F.struct(*_SUMS).alias(name)) for t, name in ((self, "a"), (other, "b"))
            )
            different = mine.join(theirs, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("node").collect()
            found = sorted(r["node"] for r in different)
            if not found or level == self.levels:
                return found
            suspects = [x * FAN + i for x in found for i in range(FAN)]
        return []

    def rows(self, spark: SparkSession, leaves: Sequence[int] | None = None) -> DataFrame:
        """The rows, of some ranges only if given: other folders and row groups are not read."""
        columns = spark.read.parquet(f"{self.path}/columns").schema
        stored = spark.read.schema(columns).parquet(f"{self.path}/rows")
        if leaves is not None:
            tops = sorted({x >> (FAN_BITS * (self.levels - 1)) for x in leaves})
            stored = stored.where(F.col("__top").isin(tops) & F.col(_LEAF).isin(list(leaves)))
        return stored.drop(_PLACE, _LEAF, "__top")

    def diff(self, spark: SparkSession, other: HashTree) -> DataFrame:
        """The keys whose rows differ: keys, change (ADDED, REMOVED or CHANGED, seen from this version to ``other``).

        Keys are equal also where both are null. Of rows with equal keys the number and the
        checksum are compared.
        """
        leaves = self.differing_leaves(spark, other)

        def side(tree: HashTree, name: str) -> DataFrame:
            found = tree.rows(spark, leaves)
            summed = found.groupBy(*[F.col(k).alias(f"__{name}_{k}") for k in self.keys]).agg(*_sums(found.columns))
            return summed.withColumn(name, F.struct(*_SUMS)).drop(*_SUMS)

        same = [F.col(f"__a_{k}").eqNullSafe(F.col(f"__b_{k}")) for k in self.keys]
        both = side(self, "a").join(side(other, "b"), same, "full").where(~F.col("a").eqNullSafe(F.col("b")))
        change = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").otherwise("CHANGED")
        keys = [F.when(F.col("a").isNull(), F.col(f"__b_{k}")).otherwise(F.col(f"__a_{k}")).alias(k) for k in self.keys]
        return both.select(*keys, change.alias("change"))


def _sums(columns: Sequence[str]) -> list[Column]:
    """n, c1, c2: the number of rows and sums over 104 bits of their digests, which tell sets of rows apart, nulls too."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(columns) if not c.startswith("__")]), {"ignoreNullFields": "false"})
    digest = F.md5(text)
    part = lambda at, name: F.sum(F.conv(F.substring(digest, at, 13), 16, 10).cast("decimal(28,0)")).cast("decimal(38,0)").alias(name)
    return [F.count("*").alias("n"), part(1, "c1"), part(14, "c2")]
