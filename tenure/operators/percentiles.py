"""Exact interpolated percentiles without sorting or collecting a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.operators.ordered import Running, join_one, running, salt

# How far the edges lie from a percentile: ten times what the sketch may be wrong.
BRACKET = 1e-3
SKETCH_ACCURACY = 10_000
SLICES = 1024


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Sequence[float],
    fixed_keys: bool = False,
    bracket: float = BRACKET,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """One row per key with ``n``, ``max`` and ``percentiles`` (linear interpolation).

    First pass: a mergeable sketch gives two edges around each percentile; all
    edges of a key cut its values into a few parts. Second pass: the parts are
    counted, exactly. Third pass: the parts that hold a wanted rank, usually
    the narrow ones, are counted per value, and these counts are ranked in
    slices. The sketch decides how much is ranked, never the result: where it
    is off, the wanted rank lies in a neighbouring part and that one is ranked.
    ``fixed_keys`` says that the keys are a short list known in advance, so that
    the edges can be broadcast; else values are counted before they move, so a
    frequent value is one row.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    values = rows.withColumn("c", F.lit(1)) if fixed_keys else rows.groupBy(*keys, "v").agg(F.count("*").alias("c"))

    def with_key(one: DataFrame) -> DataFrame:
        """The values with the single row of their key, and the part they lie in: how many edges are below."""
        joined = values.join(F.broadcast(one), keys) if fixed_keys else join_one(values, one, keys, salt("v"))
        below = F.aggregate("b.edges", F.lit(0), lambda k, e: k + F.when(e < F.col("v"), 1).otherwise(0))
        return joined.withColumn("part", below)

    cuts = sorted({c for p in fractions for c in (max(p - bracket, 0.0), min(p + bracket, 1.0))})
    bounds = rows.groupBy(*keys).agg(
        F.count("v").alias("n"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.percentile_approx("v", cuts, F.lit(accuracy)).alias("edges"),
    )
    about = bounds.select(*keys, F.struct("n", "low", "high", F.array_sort(F.array_distinct("edges")).alias("edges")).alias("b"))
    counts = with_key(about).groupBy(*keys, "part").agg(F.sum("c").alias("c"), F.first("b").alias("b"))

    n = F.col("b.n")
    places = [F.lit(p) * (n - 1) for p in fractions]
    ranks = [(F.floor(x), F.least(F.floor(x) + 1, n - 1)) for x in places]
    # A key has one row per part here, fewer than three for each fraction.
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before, upto = F.col("before"), F.col("before") + F.col("c")
    held = counts.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))).where(
        F.exists(F.array(*[r for pair in ranks for r in pair]), lambda r: (r >= before) & (r < upto))
    )
    marks = held.groupBy(*keys).agg(F.first("b").alias("b"), F.collect_list(F.struct("part", "before")).alias("parts"))

    mark = F.get(F.filter("parts", lambda x: x["part"] == F.col("part")), F.lit(0))
    inside = with_key(marks).withColumn("mark", mark).where(F.col("mark").isNotNull())
    counted = inside.groupBy(*keys, "part", "v").agg(
        F.sum("c").alias("c"), F.first("mark.before").alias("before"), F.first("b").alias("b")
    )
    low = F.coalesce(F.get("b.edges", F.col("part") - 1), F.col("b.low"))
    high = F.coalesce(F.get("b.edges", F.col("part")), F.col("b.high"))
    place = F.coalesce(F.floor((F.col("v") - low) / F.nullif(high - low, F.lit(0.0)) * SLICES), F.lit(0)).cast("bigint")
    ranked = running(counted, [*keys, "part"], ["v"], place, here=Running("sum", F.col("c")))
    reached = F.col("before") + F.col("here")
    picked = ranked.groupBy(*keys).agg(
        F.first("b").alias("b"),
        *[F.min(F.when(reached > r, F.col("v"))).alias(f"{end}{i}") for i, pair in enumerate(ranks) for end, r in zip(("lower", "upper"), pair)],
    )
    result = [
        F.when(x == F.floor(x), F.col(f"lower{i}")).otherwise(
            F.col(f"lower{i}") + (x - F.floor(x)) * (F.col(f"upper{i}") - F.col(f"lower{i}"))
        )
        for i, x in enumerate(places)
    ]
    return picked.select(*keys, n.alias("n"), F.col("b.high").alias("max"), F.array(*result).alias("percentiles"))
