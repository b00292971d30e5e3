"""Operator 10: licenses whose sentences are nearly the same."""

from pyspark.sql import functions as F

from tenure.llm import licenses


def test_neighbouring_licenses_are_told_apart(spark):
    rows = [
        ("gpl-2", "GNU General Public License version 2"), ("gpl-3", "GNU General Public License version 3"),
        ("gpl-2", "under the GNU General Public License, version 2.0 of it"), ("lgpl", "GNU Lesser General Public License version 3"),
        ("mpl-2", "Mozilla Public License, Version 2.0"), ("apache-2", "Licensed under the Apache License, Version 2.0"),
        ("cc-by", "Creative Commons Attribution 4.0 International License"),
        ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
        ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
        ("", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
        ("cc-by", "licensed under CC BY 4.0"), ("cc-by-sa", "licensed under CC BY-SA 4.0"),
        ("gpl-2,gpl-3", "GNU General Public License version 2 or GNU General Public License version 3"),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(rows))] == [x for x, _ in rows]


def test_texts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    df = spark.range(40).select(F.col("id").alias("doc_id"), F.udf(seen, "string")(F.lit("Under the MIT license, or CC BY NC")).alias("text"))
    assert {(r["n_base"], r["base_labels"]) for r in licenses.scan(df).collect()} == {(2, "cc-by-nc,mit")}
    assert read.value == 40
