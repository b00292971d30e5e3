import random

import numpy as np
from pyspark.sql import functions as F

from tenure.operators.ordered import Running, join_one, running, salt
from tenure.operators.percentiles import exact_percentiles


def skewed(n=3000, seed=7):
    """A third of all rows under one key."""
    r = random.Random(seed)
    return [(0 if r.random() < 0.34 else r.randrange(1, 40), r.randrange(500), i, r.choice([None, r.randrange(100)])) for i in range(n)]


def test_running_values_equal_a_plain_replay(spark):
    data = skewed()
    df = spark.createDataFrame(data, "k int, t int, s int, x int")
    out = running(
        df, ["k"], ["t", "s"], F.floor(F.col("t") / 20),
        total=Running("sum", F.col("x")),
        before=Running("last", F.col("x"), inclusive=False),
        last=Running("last", F.col("x")),
        low=Running("min", F.col("x")),
        high=Running("max", F.col("x"), inclusive=False),
    )
    got = {r.s: (r.total, r.before, r.last, r.low, r.high) for r in out.collect()}
    want = {}
    for key in {d[0] for d in data}:
        total, seen = 0, []
        for _, _, s, x in sorted((d for d in data if d[0] == key), key=lambda d: (d[1], d[2])):
            before, high = (seen[-1] if seen else None), max(seen, default=None)
            if x is not None:
                total += x
                seen.append(x)
            want[s] = (total, before, seen[-1] if seen else None, min(seen, default=None), high)
    assert got == want


def test_running_without_keys(spark):
    df = spark.createDataFrame([(i, (i * 7919) % 101) for i in range(500)], "t int, x int")
    out = running(df, [], ["t"], F.floor(F.col("t") / 50), high=Running("max", F.col("x")))
    high = -1
    for r in sorted(out.collect()):
        high = max(high, r.x)
        assert r.high == high


def test_join_one_keeps_all_rows_of_a_hot_key(spark):
    data = skewed()
    many = spark.createDataFrame(data, "k int, t int, s int, x int")
    one = spark.createDataFrame([(k, f"name {k}") for k in range(20)], "k int, name string")
    inner = join_one(many, one, ["k"], salt("s")).collect()
    assert len(inner) == sum(d[0] < 20 for d in data) and all(r.name == f"name {r.k}" for r in inner)
    left = join_one(many, one, ["k"], salt("s"), "left").collect()
    assert len(left) == len(data) and sum(r.name is None for r in left) == sum(d[0] >= 20 for d in data)


def check_percentiles(spark, values, fixed_keys, **options):
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("other", 1.0), ("other", None)], "k string, v double")
    fractions = (0.0, 0.5, 0.95, 0.99, 1.0)
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", fractions, fixed_keys, **options).collect()}
    np.testing.assert_allclose(got["k"].percentiles, np.quantile(values, fractions), rtol=1e-12)
    assert got["k"].n == len(values) and got["k"].max == max(values)
    assert got["other"].percentiles == [1.0] * 5 and got["other"].n == 1


def test_percentiles_of_few_values(spark):
    check_percentiles(spark, [1, 2, 4], True)


def test_percentiles_through_brackets(spark):
    r = np.random.default_rng(1)
    check_percentiles(spark, list(r.normal(size=30_000)), True)
    check_percentiles(spark, list(r.normal(size=20_000)), False)


def test_percentiles_where_the_sketch_is_off(spark):
    """Edges that miss the wanted ranks cost more ranking, not the result."""
    r = np.random.default_rng(3)
    check_percentiles(spark, list(r.normal(size=5_000)), False, bracket=1e-9, accuracy=20)
    check_percentiles(spark, list(r.normal(size=10_001)), True, bracket=1e-9, accuracy=20)


def test_percentiles_with_a_third_of_values_equal(spark):
    r = np.random.default_rng(2)
    check_percentiles(spark, [5.0] * 10_000 + list(r.exponential(10, size=20_000)), False)
