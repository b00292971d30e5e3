"""Running values per key that never need a whole key in one task.

A window over ``PARTITION BY key`` sends all rows of a key to one task, which a
key with a third of all rows does not survive. Here each key is cut into slices
(of time, of commit number, of value) that follow the row order. Rows are
windowed within (key, slice); the totals of earlier slices, one row per slice,
are carried forward and joined back. Both shuffles use (key, slice), so the
rows move once and the totals are combined before they move.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenure.session import scratch_path

_SLICE = "__slice"
FAN = 1024


@dataclass(frozen=True)
class Running:
    """A running value: ``sum``, ``min``, ``max`` or ``last`` (last non-null)."""

    kind: str
    value: Column
    inclusive: bool = True

    def over(self, window) -> Column:
        if self.kind == "last":
            return F.last(self.value, ignorenulls=True).over(window)
        return getattr(F, self.kind)(self.value).over(window)

    def total(self, order: Sequence[Column]) -> Column:
        if self.kind == "last":
            return F.max(F.when(self.value.isNotNull(), F.struct(*order, self.value.alias("value"))))["value"]
        return getattr(F, self.kind)(self.value)

    def carry(self, total: Column, window) -> Column:
        if self.kind == "last":
            return F.last(total, ignorenulls=True).over(window)
        return getattr(F, self.kind)(total).over(window)

    def merge(self, here: Column, before: Column) -> Column:
        if self.kind == "sum":
            zero = F.lit(0)
            return F.coalesce(here, zero) + F.coalesce(before, zero)
        if self.kind == "min":
            return F.least(here, before)
        if self.kind == "max":
            return F.greatest(here, before)
        return F.coalesce(here, before)


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, levels: int | None = None, **values: Running
) -> DataFrame:
    """``df`` plus one column per entry of ``values``.

    ``order`` must be a total, ascending order within a key, ``slice_by`` a
    number that does not decrease along it, and neither may be null. With more
    ``levels`` the totals of a key's slices are carried forward in slices
    again, ``FAN`` at a time; without keys there are two, so that not even the
    totals of a whole log meet in one task.
    """
    levels = levels or (1 if keys else 2)
    columns = df.columns
    order_columns = [F.col(name) for name in order]
    rows = df.withColumn(_SLICE, slice_by)

    inner = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    frames = {
        True: inner.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        False: inner.rowsBetween(Window.unboundedPreceding, -1),
    }
    here = rows.select("*", *[v.over(frames[v.inclusive]).alias(f"__here_{n}") for n, v in values.items()])

    totals = rows.groupBy(*keys, _SLICE).agg(*[v.total(order_columns).alias(f"__total_{n}") for n, v in values.items()])
    if levels == 1:
        earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            *keys, _SLICE, *[v.carry(F.col(f"__total_{n}"), earlier).alias(f"__before_{n}") for n, v in values.items()]
        )
    else:
        fine = f"__fine{levels}"
        above = {f"__before_{n}": Running(v.kind, F.col(f"__total_{n}"), inclusive=False) for n, v in values.items()}
        coarse = F.floor(F.col(fine) / F.lit(FAN)).cast("bigint")
        totals = totals.withColumnRenamed(_SLICE, fine)
        carried = running(totals, keys, [fine], coarse, levels - 1, **above)
        carried = carried.select(*keys, F.col(fine).alias(_SLICE), *above)
    joined = here.join(carried, [*keys, _SLICE])
    merged = [v.merge(F.col(f"__here_{n}"), F.col(f"__before_{n}")).alias(n) for n, v in values.items()]
    return joined.select(*columns, *merged)


def fan_out() -> int:
    """Parts a hot key is cut into: the session's shuffle partitions, 64 at least, so they grow with what it is set up for."""
    return max(64, int(SparkSession.active().conf.get("spark.sql.shuffle.partitions")))


def salt(*columns: str, parts: int | None = None) -> Column:
    """Slice for joins that need no order: spreads a key over ``parts`` by its rows' own values."""
    return F.pmod(F.xxhash64(*columns), F.lit(parts or fan_out())).cast("bigint")


def join_one(many: DataFrame, one: DataFrame, keys: Sequence[str], slice_by: Column, how: str = "inner") -> DataFrame:
    """Join rows to the single row of their key, also when one key has most rows.

    A plain join would move all rows of a key to one task. Here the row of a key
    goes once to every slice its rows occupy, and the rows move by (key, slice).
    """
    keys = list(keys)
    rows = many.withColumn(_SLICE, slice_by)
    placed = rows.select(*keys, _SLICE).distinct().join(one, keys)
    return rows.join(placed, [*keys, _SLICE], how).drop(_SLICE)


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` plus each row's place in ``order``, from 1, without a task that sees all rows.

    Rows are written sorted by range; a row's place is its place in its range after the
    sizes of the ranges before, one row each. ``order`` must tell all rows apart.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ranked")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The number holds the range in its upper 31 bits and counts the range's rows in the lower 33.
    ranges.withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.schema(df.schema.add("__id", "long")).parquet(path)
    rows = rows.withColumn("__range", F.shiftrightunsigned("__id", 33))
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(sizes.select("__range", before.alias("__before")), "__range")
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.select(*df.columns, place.alias(name))
