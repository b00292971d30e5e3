"""Two versions of a table: what differs, and how little is read to find it."""

import pytest
from tests.helpers import rows

from tenure.session import scratch_path
from tenure.sources.hash_tree import FAN, HashTree

SCHEMA = "a long, b string, x double, y string"


def _tree(spark, data, keys=("a", "b"), levels=2):
    tree = HashTree(scratch_path(spark, "version"), keys, levels)
    tree.write(spark.createDataFrame(data, SCHEMA).repartition(3))
    return tree


DATA = [(i // 2, f"k{i % 2}", i / 3, None if i % 7 == 0 else "y") for i in range(600)]


def test_equal_versions_are_settled_at_the_root(spark):
    one, two = _tree(spark, DATA), _tree(spark, list(reversed(DATA)))
    assert rows(one.nodes(spark, 0), "node", "n") == [(0, 600)] and one.nodes(spark, 2).count() <= FAN**2
    assert one.differing_leaves(spark, two) == []
    found = one.diff(spark, two)
    assert found.collect() == []


def test_differences_by_key_and_only_their_ranges_are_read(spark):
    later = [r for r in DATA if r[:2] != (5, "k0")] + [(10_000, "new", 0.0, "y"), (None, None, 1.0, "y")]
    later = [(a, b, x, "z") if (a, b) == (100, "k1") else (a, b, None, y) if (a, b) == (7, "k0") else (a, b, x, y) for a, b, x, y in later]
    later.append(later[20])  # a row twice
    one, two = _tree(spark, DATA), _tree(spark, later)
    got = one.diff(spark, two)
    assert rows(got, "a", "b", "change") == sorted(
        [(5, "k0", "REMOVED"), (10_000, "new", "ADDED"), (None, None, "ADDED"), (100, "k1", "CHANGED"), (7, "k0", "CHANGED"), (*later[20][:2], "CHANGED")],
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )
    leaves = one.differing_leaves(spark, two)
    assert len(leaves) <= 6 and one.rows(spark, leaves).count() < 40
    assert len({f.rsplit("/", 2)[1] for f in one.rows(spark, leaves).inputFiles()}) >= 1
    plan = one.rows(spark, leaves)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "__top" in plan and "__leaf" in plan


def test_null_and_text_of_null_differ(spark):
    one, two = _tree(spark, [(1, "k", None, None)]), _tree(spark, [(1, "k", None, "null")])
    assert rows(one.diff(spark, two), "a", "change") == [(1, "CHANGED")]
    assert rows(_tree(spark, []).diff(spark, one), "a", "change") == [(1, "ADDED")]


def test_trees_must_be_alike(spark):
    with pytest.raises(ValueError, match="different keys"):
        HashTree("a", ["x"]).differing_leaves(spark, HashTree("b", ["y"]))
