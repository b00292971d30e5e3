"""License scans by diagonal voting (operator 10, DataFrame functions only).

Rolling word 3-gram hashes of every text are joined to the positions of the same
3-grams in license templates. A hit at text position p and template position t votes
for the diagonal p - t; neighbouring diagonals (a word added or left out) merge, and
a span counts if enough of its template's 3-grams voted and, verified on the words, the
span holds the words that tell the template from its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenure.llm.common import ascii_lower, stored, text_of, words

# What a word is, the phrases of the base rule and their labels.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Sentences by which public licenses are known, for the labels that the method adds; after the label the words, side by
# side, that tell it from its neighbours and must stand in a span.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2", "apache", "version 2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("gnu general public license version 3", "gpl-3", "gnu general", "version 3"),
    ("gnu general public license version 2", "gpl-2", "gnu general", "version 2"),
    ("gnu lesser general public license", "lgpl", "gnu lesser"),
    ("mozilla public license version 2 0", "mpl-2", "mozilla", "version 2"),
    ("licensed under cc by 4 0", "cc-by", "by 4"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "by sa 4"),
    ("creative commons attribution 4 0 international license", "cc-by", "attribution 4"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc", "attribution noncommercial 4"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa", "attribution sharealike 4"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)
K = 3


def template_grams(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """(gram hash, gram, template, label, base, place in the template, grams of the template); a fixed small table."""
    rows = []
    for number, (phrase, label, *needed) in enumerate([*base, *templates]):
        parts = phrase.split(" ")
        grams = [" ".join(parts[i : i + K]) for i in range(len(parts) - K + 1)]
        tells = lambda g: [k for k, x in enumerate(needed) if f" {x} " in f" {g} "]
        rows += [(*g.split(" "), number, label, number < len(base), i, len(grams), tells(g), len(needed)) for i, g in enumerate(grams)]
    made = spark.createDataFrame(
        rows, "a string, b string, c string, template int, label string, base boolean, place int, grams int, tells array<int>, telling int"
    )
    marker = spark.createDataFrame([(None, None, None, -1, None, False, 0, 0, [], 0)], made.schema)
    return made.unionAll(marker).select(
        F.when(F.col("template") < 0, F.lit(0)).otherwise(F.xxhash64("a", "b", "c")).alias("gram"),
        F.concat_ws(" ", "a", "b", "c").alias("gram_words"), "template", "label", "base", "place", "grams", "tells", "telling",
    )


def hits(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row per template 3-gram found in a text, and one marker row (template -1) per document.

    The marker keeps documents without any hit in the same single pass over the texts.
    Hashes that meet are compared by their words.
    """
    w = words(ascii_lower(F.col("_text")), LICENSE_WORD)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text")).select(
        "doc_id", F.xxhash64("_text").alias("text_key"), w.alias("_words")
    )
    n, a = F.size("_words"), F.col("_words")
    grams = F.when(
        n >= K, F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[F.get(a, i + j) for j in range(K)]))
    ).otherwise(F.array().cast("array<bigint>"))
    each = rows.select(
        "doc_id", "text_key", "_words", n.alias("n_words"), F.posexplode(F.concat(F.array(F.lit(0).cast("long")), grams)).alias("place_in", "gram")
    )
    table = F.broadcast(template_grams(docs.sparkSession, base, templates))  # the templates above, at any size of input
    met = each.join(table, "gram")
    marked = (F.col("template") < 0) & (F.col("place_in") == 0)
    same = (F.col("template") >= 0) & (F.col("place_in") > 0) & (F.array_join(F.slice("_words", F.col("place_in"), K), " ") == F.col("gram_words"))
    return met.filter(marked | same).select(
        "doc_id", "text_key", "n_words", "template", "label", "base", "place", "grams", "tells", "telling", (F.col("place_in") - 1).alias("position")
    )


def spans(found: DataFrame, slack: int = 2) -> DataFrame:
    """Votes merged over neighbouring diagonals: a row per span, with the share of its template's 3-grams that voted."""
    votes = found.filter("template >= 0").select(
        "doc_id", "text_key", "template", "label", "base", "grams", "telling", "tells", "position", "place", (F.col("position") - F.col("place")).alias("diagonal")
    ).distinct()
    # full matches of base phrases are counted by their own diagonal
    key = ["doc_id", "text_key", "template", "label", "base", "grams", "telling"]
    lines = votes.groupBy(*key, "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("position").alias("first"), F.max("position").alias("last"), F.collect_set("place").alias("places"), F.array_distinct(F.flatten(F.collect_set("tells"))).alias("told")
    )
    order = Window.partitionBy(*key).orderBy("diagonal")
    fresh = F.col("base") | (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(slack + 1)) > slack)
    group = F.sum(F.when(fresh, 1).otherwise(0)).over(order)
    return lines.withColumn("span", group).groupBy(*key, "span").agg(
        F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"), F.min("diagonal").alias("start"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("told")))) == F.col("telling")).alias("verified"),
    ).withColumn("score", F.col("covered") / F.col("grams"))


def scan(docs: DataFrame, min_score: float = 0.6, base=BASE, templates=TEMPLATES) -> DataFrame:
    """Licenses of every document.

    doc_id, n_words, n_base (places of base phrases), first_word and last_word (their
    smallest and largest start, else null), base_labels, labels (with the method's own),
    score (greatest share of a template found, 1 for a base phrase) and spans of the
    verified templates as (label, first, last, score).

    A null text counts as empty; a document without words or hits has zeros, nulls and
    empty strings; repeated rows give repeated results; an empty table gives an empty
    result. Only doc_id and text are read.
    """
    found = stored(hits(docs, base, templates), "license-hits")  # used twice; the texts are read once
    key = ["doc_id", "text_key"]
    full = F.col("base") & (F.col("score") == 1)
    good = full | (~F.col("base") & (F.col("score") >= min_score) & F.col("verified"))
    rows = found.filter("template < 0").select(*key, "n_words", *[F.lit(None).cast(t).alias(n) for n, t in (
        ("label", "string"), ("base", "boolean"), ("first", "int"), ("last", "int"), ("start", "int"), ("score", "double"), ("verified", "boolean"))])
    per_span = spans(found).select(*key, F.lit(None).cast("int").alias("n_words"), "label", "base", "first", "last", "start", "score", "verified")
    label_list = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    per_doc = rows.unionByName(per_span).groupBy(*key).agg(
        F.count("n_words").alias("copies"), F.max("n_words").cast("long").alias("n_words"),
        F.coalesce(F.sum(F.when(full, 1)), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(full, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(full, F.col("start"))).cast("long").alias("last_word"),
        label_list(full).alias("base_labels"), label_list(good).alias("labels"),
        F.coalesce(F.max(F.when(full, F.lit(1.0)).when(~F.col("base"), F.col("score"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(good, F.struct("label", "first", "last", "score")))).alias("spans"),
    )
    return per_doc.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_copy", "copies", "text_key")
