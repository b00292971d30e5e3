"""Mixing sources to target weights along a curriculum that changes with time (operator 8).

Each source has a target number of words and a weight schedule over the training
time 0..1. The schedule, integrated and scaled to the target, is the source's
cumulative demand; a document's place in its source's word stream, put through
the inverse of that demand, is its training position. Sorting by range of
position gives the training order without one task that sees everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.common import WORD, ranked, row_keyed, stored, text_of

WEIGHTS = (3, 1, 2)
#: Weight over time, as (time, weight) knots with straight lines between, repeating like WEIGHTS.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.0), (0.5, 1.0), (1.0, 2.0)),
)
ROWS_PER_SLICE = 50_000


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size in words, the digest that orders a source's documents, and the columns named in ``more``."""
    return docs.select(
        *more,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("digest"),
    )


def targets(sources: DataFrame, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Add ``target`` to rows of (source_size, weight).

    All targets together are ``share`` of all sizes, by weight; what a source cannot
    give with ``repeats`` times its size goes to the others by their weights. Each
    round asks for one row of sums; a round caps at least one source or is the last.
    """
    cap = (F.col("source_size") * repeats).cast("long")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        capped = cap <= F.lit(level) * F.col("weight")
        given, open_weight = sources.agg(
            F.sum(F.when(capped, cap).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))
        ).first()
        if not open_weight:
            break
        higher = (share * total - given) / open_weight
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")))


def _segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """(start time, start weight, slope, demand share at start, at end) of each line of a schedule."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    whole, done, out = sum(areas), 0.0, []
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        out.append((t0, w0 / whole, (w1 - w0) / (t1 - t0) / whole, done / whole, (done + area) / whole))
        done += area
    return out


def time_of(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source with schedule ``kind`` has used ``share`` of its demand."""
    result = None
    for k, knots in enumerate(schedules):
        at = None
        for t0, w0, slope, low, _high in reversed(_segments(knots)):
            more = share - F.lit(low)
            step = more / F.lit(w0) if slope == 0 else (F.sqrt(F.lit(w0 * w0) + F.lit(2 * slope) * more) - F.lit(w0)) / F.lit(slope)
            here = F.lit(t0) + step
            at = here if at is None else F.when(share >= _high, at).otherwise(here)
        result = F.when(kind == k, at) if result is None else result.when(kind == k, at)
    return result


def mix(docs: DataFrame, share: float = 1.5, repeats: int = 2, weights=WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """One row per document, in the order of training.

    doc_id, source, size, source_size, target, taken (words the mix takes, repeats
    counted), position (time 0..1 of its first use; null if it is not used) and
    uses: (position, words) of each use.

    A null source is a source of its own, after all others; a null text has size 0;
    documents of size 0 are never used. Repeated rows are documents of their own.
    Only doc_id, source and text are read, so other columns may have any name. An
    empty table gives an empty result. Any order of files gives the same rows: a
    source's documents go by the digest of doc_id, then doc_id, then size.
    """
    rows = stored(sized(docs), "mix-sizes")
    return _mixed(rows, share, repeats, weights, schedules).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def sequence(docs: DataFrame, share: float = 1.5, repeats: int = 2, weights=WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """The documents that a mix uses, in the order of their first use: the columns of ``docs``, size, target, taken, position.

    Every row is a document of its own, also where doc_ids are null or repeated, and comes
    out at most once; other cases are as in ``mix``. A column of ``docs`` that has the name
    of an added one gives way to it. Rows are placed by narrow columns, and the place is
    joined back by the row's own key.
    """
    keyed = row_keyed(docs)
    rows = stored(sized(keyed, "_file", "_index"), "mix-sizes")
    added = ("size", "target", "taken", "position")
    plan = _mixed(rows, share, repeats, weights, schedules, "_file", "_index").filter("taken > 0").select("_file", "_index", *added)
    kept = [c for c in docs.columns if c not in added]
    used = keyed.select(*[F.col(f"`{c}`") for c in kept], "_file", "_index").join(stored(plan, "mix-plan").hint("merge"), ["_file", "_index"])
    return used.select(*[F.col(f"`{c}`") for c in kept], *added).orderBy("position", "doc_id")


def _mixed(rows: DataFrame, share: float, repeats: int, weights, schedules, *more: str) -> DataFrame:
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = ranked(sums, "source", "place").withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    )
    bits = F.ceil(F.log2(F.greatest(F.col("n") / ROWS_PER_SLICE, F.lit(1.0)))).cast("int")
    known = targets(sources, share, repeats).select(
        F.col("source").alias("_source"), "place", "source_size", "target", bits.alias("bits")
    )
    head = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    cut = rows.join(known, rows["source"].eqNullSafe(known["_source"])).drop("_source").withColumn(
        "slice", F.call_function("shiftright", head, 32 - F.col("bits"))
    )
    order = Window.partitionBy("place", "slice").orderBy("digest", "doc_id", "size", *more)
    inner = cut.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    ahead = Window.partitionBy("place").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # one row per slice, and a slice has about ROWS_PER_SLICE documents
    offsets = cut.groupBy("place", "slice").agg(F.sum("size").alias("slice_size")).select(
        "place", "slice", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)).alias("offset")
    )
    at = F.col("offset") + F.col("upto")
    quota = F.floor("target")
    uses = F.array(*[
        F.struct(
            time_of(F.try_divide(at + F.lit(k) * F.col("source_size"), quota), F.col("place") % len(schedules), schedules).alias("position"),
            F.greatest(F.lit(0), F.least(F.col("size"), quota - F.lit(k) * F.col("source_size") - at)).alias("words"),
        )
        for k in range(repeats)
    ])
    placed = inner.join(offsets, ["place", "slice"]).withColumn("uses", F.filter(uses, lambda u: u["words"] > 0))
    return placed.select(
        *more, "doc_id", "source", "size", "source_size", "target",
        F.aggregate("uses", F.lit(0).cast("long"), lambda s, u: s + u["words"]).alias("taken"),
        F.try_element_at(F.col("uses"), F.lit(1))["position"].alias("position"),
        "uses",
    )


def placements(mixed: DataFrame) -> DataFrame:
    """The training sequence: one row per use, sorted by range of position."""
    return mixed.select("doc_id", "source", F.inline("uses")).orderBy("position", "doc_id")
