"""Quality rules with cross-document line frequency (operator 6, DataFrame functions only).

A line that many different documents of a host carry is furniture of the site. Lines
are hashed, different documents per host and line are counted, lines above the
limits are removed, and a document of which too little is left is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import NO_ID, SPACE, ascii_lower, doc_key, rest, restored, stored, text_of, words

# White space that is no part of a word, and the characters counted as symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _lines(text: Column) -> Column:
    """The lines with a word in them."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)


def line_key(line: Column) -> Column:
    """60 bits of the digest of a line without its outer white space, inner runs as one space, A-Z in lower case."""
    plain = ascii_lower(F.trim(F.regexp_replace(line, SPACE + "+", " ")))
    return F.conv(F.substring(F.md5(plain.cast("binary")), 1, 15), 16, 10).cast("long")


def repeated_words(rows: DataFrame, word_array: str, name: str) -> DataFrame:
    """Add the number of words that lie in a 3-word window found at least twice in the row.

    Windows are sorted by hash, equal neighbours marked, and the marked starts walked in
    order: a start adds the words that the one before it has not covered.
    """
    n, w = F.size(word_array), F.col(word_array)
    windows = F.when(
        n >= 3,
        F.sort_array(F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )),
    )
    sorted_rows = rows.withColumn("_windows", windows)
    s = F.col("_windows")
    twice = F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")),
        lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(3), i - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    return sorted_rows.withColumn(name, F.coalesce(covered, F.lit(0)).cast("long")).drop("_windows")


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """The base measures of every document, with its lines' keys and lengths; ``more`` names columns to carry."""
    text = text_of()
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("_host"),
        *[F.col(c) for c in more],
        text.alias("_text"),
    ).withColumn("_words", words(F.col("_text"))).withColumn("_lines", _lines(F.col("_text")))
    counted = repeated_words(read, "_words", "n_repeat_words")
    n = F.size("_words").cast("long")
    return counted.select(
        "doc_id", "_host", *more, "_text",
        n.alias("n_words"),
        F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"),
        F.transform("_lines", lambda x: F.struct(line_key(x).alias("key"), F.length(x).alias("chars"))).alias("_keys"),
    )


def site_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(host, key, first) of the lines found in ``min_docs`` different texts of a host or more.

    The limit does not grow with the host. Exact copies count once; ``first`` is the
    smallest (doc, text_key) that holds the line. Counts are combined per (host, line,
    text) before they move, so no host or line meets in one task.
    """
    each = _each_line(docs).groupBy("host", "key", "text_key").agg(F.min("doc").alias("doc"))
    found = each.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "text_key")).alias("first"))
    return found.filter(F.col("n") >= min_docs).select("host", "key", "first")


def _each_line(docs: DataFrame) -> DataFrame:
    keys = F.array_distinct(F.transform(_lines(text_of()), line_key))
    return docs.select(F.col("source").cast("string").alias("host"), *doc_key(), F.explode(keys).alias("key"))


def judge(docs: DataFrame, *more: str, min_docs: int = 10, least_left: float = 0.5) -> DataFrame:
    """One row per document: the base measures, line_chars, gone_chars and ``kept``.

    ``source`` is the host. A line is common from ``min_docs`` different texts of its host
    on, whatever the host's size; exact copies of a document count once. kept is false if
    the base rules fail, or if less than ``least_left`` of the characters of the document's
    lines is left without the common ones. A null text counts as empty (and fails); a null
    source is a host of its own; repeated rows are judged alike; an empty table gives an
    empty result. Only doc_id, source, text and the columns named in ``more`` are read. The
    texts without common lines are made by ``filtered``.

    Texts are read once; what moves are line keys and counts. They are combined per (host,
    line, text) and per document before they move, so no host or line meets in one task.
    """
    text_key = F.xxhash64("_text").alias("_text_key")
    rows = stored(measured(docs, *more).withColumn("_row", F.monotonically_increasing_id()).select("*", text_key).drop("_text"), "measured")
    lines = rows.select("_row", "_host", "_text_key", F.inline("_keys").alias("key", "chars"))
    each = lines.select("_host", "key", "_text_key").distinct().groupBy("_host", "key").agg(F.count(F.lit(1)).alias("n"))
    common = stored(each.filter(F.col("n") >= min_docs).select(F.col("_host").alias("_of"), F.col("key").alias("_key")), "common-lines")
    hit = lines.join(common, lines["_host"].eqNullSafe(common["_of"]) & (lines["key"] == common["_key"]))
    gone = hit.groupBy("_row").agg(F.sum("chars").cast("long").alias("_gone"))
    both = rows.join(gone, "_row", "left").withColumns({"line_chars": _line_chars(), "gone_chars": F.coalesce("_gone", F.lit(0)).cast("long")})
    return both.withColumn("kept", _kept(least_left)).drop("_keys", "_host", "_row", "_text_key", "_gone")


def _line_chars() -> Column:
    return F.aggregate("_keys", F.lit(0).cast("long"), lambda s, x: s + x["chars"])


def _kept(least_left: float) -> Column:
    return ~F.col("base_failed") & ((F.col("gone_chars") == 0) | (F.col("line_chars") - F.col("gone_chars") >= least_left * F.col("line_chars")))


def _judged(both: DataFrame, least_left: float) -> DataFrame:
    """The verdict on measured rows, whose column ``common`` has the keys of the lines to remove."""
    gone = F.when(
        F.col("common").isNotNull(),
        F.aggregate("_keys", F.lit(0).cast("long"), lambda s, x: s + F.when(F.array_contains("common", x["key"]), x["chars"]).otherwise(0)),
    ).otherwise(0)
    kept_text = F.when(
        F.col("gone_chars") > 0,
        F.array_join(F.filter(F.split("_text", "\n", -1), lambda x: ~F.array_contains("common", line_key(x))), "\n"),
    ).otherwise(F.col("_text"))
    return both.withColumn("line_chars", _line_chars()).withColumn("gone_chars", gone).withColumn("kept", _kept(least_left)).withColumn("kept_text", kept_text).drop("common", "_keys", "_text", "_host")


def filtered(docs: DataFrame, min_docs: int = 10, least_left: float = 0.5) -> DataFrame:
    """The documents that stay, without their host's common lines, in the columns of ``docs``.

    A line is common from ``min_docs`` different texts of its host on (``site_lines``). It
    goes everywhere but in the document that holds it first, so that the first of a group
    of near copies stays whole and the others are judged by what they have of their own.
    A document is rejected as in ``judge``. Each document carries its own common lines
    only, so nothing grows with the number of lines of a host.

    A null or wordless text fails the base rules; a null source is a host of its own; rows
    with the same doc_id (null is one) and text are judged alike and each stay or go; an
    empty table gives an empty result. Other columns pass through, whatever their names.

    Both sides of the join move, at any size: a plan that broadcasts small tables only would
    need more disk than they let expect.
    """
    common = stored(site_lines(docs, min_docs), "common-lines").select(F.col("host").alias("_of"), F.col("key").alias("_key"), "first")
    each = _each_line(docs)
    repeats = each.join(common, each["host"].eqNullSafe(common["_of"]) & (each["key"] == common["_key"])).filter(
        F.struct("doc", "text_key") != F.col("first")
    )
    per_doc = stored(repeats.groupBy("host", "doc", "text_key").agg(F.collect_set("key").alias("common")), "own-common-lines")
    carried = docs.select("doc_id", "source", "text", rest(docs, "doc_id", "text", "n_chars"))
    rows = measured(carried, "_rest").withColumns({"_doc": F.coalesce("doc_id", F.lit(NO_ID)), "_text_key": F.xxhash64("_text")})
    same = rows["_host"].eqNullSafe(per_doc["host"]) & (rows["_doc"] == per_doc["doc"]) & (rows["_text_key"] == per_doc["text_key"])
    both = rows.join(per_doc.hint("merge"), same, "left").drop("host", "doc", "text_key", "_doc", "_text_key")
    # one undivided condition: a part of it moved below the join would measure every text a second time
    kept = _judged(both, least_left).filter(F.when(F.col("gone_chars") >= 0, F.col("kept")).otherwise(False))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return restored(kept, docs, **made)
