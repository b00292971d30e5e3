"""Stages of the pipeline: what they must remove at any size of the input, and what they do with odd rows."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, source string"


def _words(i: int, n: int) -> str:
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_quality_rules_have_a_limit_that_does_not_grow_with_the_host(spark):
    menu = ["Home About", "Read all of our many terms of use and our notes on privacy", "Sign up today"]
    rows = [(i, _words(i, 60), "a") for i in range(200)]
    rows += [(300 + i, "\n".join([*menu, _words(300 + i, 60)]), "a") for i in range(12)]
    furniture = [_words(900 + k, 20) for k in range(8)]
    rows += [(400 + i, "\n".join([*furniture, _words(400 + i, 5)]), "a") for i in range(12)]  # little of their own
    rows += [(500 + i, _words(800, 60), "a") for i in range(15)]  # exact copies count once
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, df, "").collect()}
    assert got[300] == rows[200][1] and all(got[300 + i] == _words(300 + i, 60) for i in range(1, 12))
    assert got[400] == rows[212][1] and not set(range(401, 412)) & set(got)
    assert all(got[500 + i] == _words(800, 60) for i in range(15)) and len(got) == 200 + 12 + 1 + 15


def test_line_dedup_has_a_limit_that_does_not_grow_with_the_corpus(spark):
    planted = _words(900, 55)
    rows = [(i, _words(i, 30), "a") for i in range(300)]
    rows += [(400 + i, f"{planted}\n{_words(400 + i, 30)}", "a") for i in range(12)] + [(500 + i, planted, "a") for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, df, "").collect()}
    assert got[400] == rows[300][1] and all(got[400 + i] == _words(400 + i, 30) for i in range(1, 12))
    assert set(got) == {*range(300), *range(400, 412)}  # those with nothing else go


# Names that the stages use inside.
CLASHES = (
    "host", "doc", "text_key", "n_words", "common", "size", "target", "taken", "position", "place", "slice", "component_id",
    "key", "first", "n_shingles", "uses", "digest", "kept_text", "keep_bitmap", "gone", "u", "v", "label", "item_id", "a.b",
)
TABLE = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def _odd_rows():
    good, long = [_words(i, 80) for i in range(9)], " ".join(f"v{i}" for i in range(40_000))
    rows = [
        (1, good[0], "a"), (2, good[1], "a"), (None, good[2], "a"), (None, good[3], "a"), (None, good[4], None), (None, good[2], "a"),
        (5, good[5], "b"), (5, good[5], "b"), (5, good[6], "b"), (6, good[7], None), (7, good[7], "a"), (8, None, "a"), (9, "", "a"),
        (10, " \n \t", None), (11, long, "b"), (12, "too short", "b"), (None, None, None), (13, good[8], "b"), (14, good[8] + "\n" + good[8], "b"), (0, good[0], "c"),
    ]
    return [(i, t, "en", s, len(t or ""), *(f"{k}-{c}" for c in CLASHES)) for k, (i, t, s) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_odd_rows(), TABLE).repartition(3)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [(1, _words(6, 80)), (2, "an item that no document holds"), (None, "x y z"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def _number(row):
    """Which row of the fixture this is, by a column that only passes through."""
    return int(row["host"].split("-")[0])


def test_stages_take_odd_rows_each_by_its_own(spark, odd, sf):
    plain = {k: r for k, r in enumerate(_odd_rows())}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        added = ["size", "target", "taken", "position"] if name == "mixing" else []
        assert set(out.columns) == set(odd.columns) and len(out.columns) == len(odd.columns), name
        rows = out.collect()
        got = [_number(r) for r in rows]
        assert max(collections.Counter(got).values()) == 1, name  # no row is multiplied
        for r in rows:  # and all other columns belong to it
            assert all(r[c] == f"{_number(r)}-{c}" for c in CLASHES if c not in added), name
            assert (r["doc_id"], r["source"]) == (plain[_number(r)][0], plain[_number(r)][3]), name
        kept = set(got)
        if name == "quality_rules":
            assert kept == set(plain) - {11, 12, 13, 15, 16, 18}  # too few words, or nothing but repeats
        elif name == "line_dedup":
            assert kept == set(plain)
        elif name == "near_dedup":  # the smallest id of a group, null last
            assert kept == set(plain) - {0, 10, 18, *({5} if 5 not in kept else {2}), *({6} if 6 not in kept else {7})} and len(kept) == 15
        elif name == "decontamination":
            assert kept == set(plain) - {8}
        else:
            assert [r["position"] for r in rows] == sorted(r["position"] for r in rows) and kept <= set(plain) - {11, 12, 13, 16}
            assert sum(int(r["taken"]) for r in rows) > 0


def test_stages_take_empty_tables(spark, odd, sf):
    none = odd.filter("1 = 0")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf)
        assert out.collect() == [] and set(out.columns) >= set(odd.columns), name


def test_stages_take_rows_from_files_and_from_elsewhere_alike(spark, odd, sf, tmp_path):
    odd.write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    for name, stage in corpus_pipeline.STAGES:
        one, two = (sorted(map(str, stage(spark, d, sf).select("doc_id", F.xxhash64("text")).collect())) for d in (odd, read))
        assert one == two, name
