"""Operator 4: what stands around an item must not hide it, and scattered words must not make one."""

from tenure.llm import retrieval


def _found(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in retrieval.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_filler_does_not_hide_a_short_item(spark):
    # the filler consists of words that the benchmark knows, so it weighs in the window
    items = [(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(150)] + [(200, "when does the river bend")]
    filler = " ".join(f"w{i}x{i % 40}" for i in range(150) for _ in range(3))
    docs = [(1, f"{filler} when does the river bend {filler}"), *[(10 + i, "when does the river") for i in range(40)]]
    assert (1, 200) in _found(spark, docs, items)


def test_scattered_words_are_no_item(spark):
    item = [f"k{i}" for i in range(10)]
    scattered = " ".join(f"{w} " + " ".join(f"{w}f{j}" for j in range(9)) for w in item)
    docs = [(1, scattered), (2, "a b c " + " ".join(item) + " d e f"), (3, "a b " + " filler ".join(item[:4]) + " " + " ".join(item[4:]))]
    assert _found(spark, docs, [(7, " ".join(item))]) == {(2, 7), (3, 7)}
    assert retrieval.closest_span(list("abc"), list("xaxxbxabyc"), 4) == (3, 6)


def test_stage_judges_rows_without_an_id_each(spark):
    item = "when does the river bend towards the old mill"
    docs = [(None, f"so {item} then"), (None, "a clean text"), (None, "another clean text"), (4, "one more"), (4, f"{item} again"), (4, "one more")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = retrieval.clean(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r["text"] for r in left) == ["a clean text", "another clean text", "one more", "one more"]
