"""Operator 3: nothing of a small sample is left out, and held-out texts are ranked by quality."""

from tenure.llm import queries, registry  # noqa: F401
from tenure.llm.compression import DICTIONARY_BYTES, Classifier

MEDIUM = "/root/testdata/sf0.01"


def test_small_samples_are_kept_whole():
    texts = [f"text number {i} " * 900 for i in range(12)]
    size = sum(map(len, texts))
    assert DICTIONARY_BYTES < size < 4 * DICTIONARY_BYTES
    assert len(Classifier(texts, ["bad"], []).dictionaries[0]) == size
    assert Classifier([], [], []).dictionaries == [b" ", b" "]


def test_held_out_texts_are_ranked(spark):
    scores = registry.QUERIES["op3_compression_quality"](spark, MEDIUM).filter("held_out")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "quality").filter("quality in (0, 1)")
    rows = scores.join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    better = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert len(bad) > 5 and better > 0.85
