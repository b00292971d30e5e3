"""Line dedup by a sorted stream of line hashes (operator 5).

Lines are hashed, dealt by range of (hash, document) and sorted by document and
position inside each range. A task streams its range once: it counts the documents of
the run of equal hashes under its hand and reports the positions to drop. A hot line
spans many ranges, because the document is part of the range key; only the first and
last run of a range can be cut, and those are settled from one row of counts each.
What is returned are compressed bitmaps per document, never text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import ascii_lower, doc_key, rest, restored, stored, text_of

# Fixed value: what is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"

_KEY = ("h", "g")
_ROW = ("doc", "text_key", "pos")
_SCHEMA = "doc long, text_key long, pos int, h long, g int, docs long, kind int"
_TYPES = {"doc": pa.int64(), "text_key": pa.int64(), "pos": pa.int32(), "h": pa.int64(), "g": pa.int32(), "docs": pa.int64(), "kind": pa.int32()}
_DROP, _OPEN, _EDGE = 0, 1, 2


def line_rows(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h, g, doc, text_key, pos) of every line whose key has ``min_chars`` code points."""
    key = ascii_lower(F.btrim(F.col("line"), F.lit(BLANKS)))
    return (
        docs.select(*doc_key(), F.posexplode(F.split(text_of(), "\n", -1)).alias("pos", "line"))
        .withColumn("key", key)
        .filter(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h"), F.hash("key").alias("g"), "doc", "text_key", "pos")
    )


class _Stream:
    """State of one sorted range: the open run's rows that are not decided yet, and its count so far."""

    def __init__(self, min_docs: int, keep_first: bool):
        self.min_docs, self.keep_first = min_docs, keep_first
        self.rows = None  # undecided rows of the open run
        self.docs = 0  # documents of the open run already reported
        self.last = None  # last document among those
        self.head = None  # first row of an open run that is being reported
        self.edge = True  # the open run is the range's first

    def _out(self, rows, kind, docs=None):
        n = len(rows["pos"])
        full = {**rows, "docs": np.zeros(n, np.int64) if docs is None else docs, "kind": np.full(n, kind, np.int32)}
        return pa.RecordBatch.from_arrays([pa.array(full[c], t) for c, t in _TYPES.items()], names=list(_TYPES))

    def _close(self, rows, docs, edge):
        """Report what is left of a run; ``docs`` is its count in this range."""
        head = self.head if self.head is not None else {c: v[:1] for c, v in rows.items()}
        rest = rows if self.head is not None else {c: v[1:] for c, v in rows.items()}
        if edge:
            yield self._out(head, _EDGE, np.array([docs], np.int64))
            yield self._out(head, _OPEN)
            yield self._out(rest, _DROP if docs >= self.min_docs else _OPEN)
        elif docs >= self.min_docs:
            if not self.keep_first:
                yield self._out(head, _DROP)
            yield self._out(rest, _DROP)

    def batch(self, new: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = new if self.rows is None else {c: np.concatenate([self.rows[c], new[c]]) for c in new}
        n = len(rows["pos"])
        fresh_run = np.ones(n, bool)
        fresh_run[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["g"][1:] != rows["g"][:-1])
        fresh_doc = fresh_run.copy()
        fresh_doc[1:] |= (rows["doc"][1:] != rows["doc"][:-1]) | (rows["text_key"][1:] != rows["text_key"][:-1])
        if self.last is not None:  # the open run was reported up to here
            if (rows["h"][0], rows["g"][0]) == self.last[:2]:
                fresh_doc[0] = (rows["doc"][0], rows["text_key"][0]) != self.last[2:]
            else:
                yield from self._close({c: v[:0] for c, v in rows.items()}, self.docs, self.edge)
                self.docs, self.last, self.head, self.edge = 0, None, None, False
        starts = np.flatnonzero(fresh_run)
        counts = np.add.reduceat(fresh_doc, starts, dtype=np.int64)
        counts[0] += self.docs
        ends = np.append(starts[1:], n)
        cut = lambda a, b: {c: v[a:b] for c, v in rows.items()}
        if len(starts) > 1:
            yield from self._close(cut(starts[0], ends[0]), counts[0], self.edge)
            self.docs, self.last, self.head, self.edge = 0, None, None, False
            inner = np.repeat(counts[1:-1] >= self.min_docs, np.diff(starts[1:]))
            if self.keep_first:
                inner &= ~fresh_run[starts[1] : starts[-1]]
            middle = cut(starts[1], starts[-1])
            if inner.any():
                yield self._out({c: v[inner] for c, v in middle.items()}, _DROP)
        open_rows = cut(starts[-1], n)
        if counts[-1] >= self.min_docs:
            if self.head is None:
                self.head, tail = {c: v[:1].copy() for c, v in open_rows.items()}, {c: v[1:] for c, v in open_rows.items()}
            else:
                tail = open_rows
            yield self._out(tail, _DROP)
            self.docs, self.rows = int(counts[-1]), None
            self.last = tuple(open_rows[c][-1] for c in ("h", "g", "doc", "text_key"))
        else:
            self.rows = {c: v.copy() for c, v in open_rows.items()}

    def end(self) -> Iterator[pa.RecordBatch]:
        """The last run of the range."""
        if self.rows is not None:
            fresh = np.ones(len(self.rows["pos"]), bool)
            fresh[1:] = (self.rows["doc"][1:] != self.rows["doc"][:-1]) | (self.rows["text_key"][1:] != self.rows["text_key"][:-1])
            yield from self._close(self.rows, int(fresh.sum()), True)
        elif self.head is not None:
            yield from self._close({c: v[:0] for c, v in self.head.items()}, self.docs, True)


def _streamed(min_docs: int, keep_first: bool):
    def run(batches):
        state = _Stream(min_docs, keep_first)
        for batch in batches:
            if batch.num_rows:
                yield from state.batch({c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*_KEY, *_ROW)})
        yield from state.end()

    return run


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc, text_key, pos) of every line to drop."""
    order = [*_KEY, "doc", "text_key"]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lines = line_rows(docs, min_chars).repartitionByRange(parts, *order).sortWithinPartitions(*order, "pos")
    seen = stored(lines.mapInArrow(_streamed(min_docs, keep_first), _SCHEMA), "line-runs")
    first = F.struct("doc", "text_key", "pos")
    cut = seen.filter(F.col("kind") == _EDGE).groupBy(*_KEY).agg(F.sum("docs").alias("all_docs"), F.min(first).alias("first"))
    settled = seen.filter(F.col("kind") == _OPEN).join(cut, list(_KEY)).filter(F.col("all_docs") >= min_docs)
    if keep_first:
        settled = settled.filter(first != F.col("first"))
    return seen.filter(F.col("kind") == _DROP).select(*_ROW).unionAll(settled.select(*_ROW))


def _bitmap(positions: np.ndarray) -> bytes:
    keep = np.ones((int(positions.max()) // 8 + 1) * 8, bool)
    keep[positions] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def _packed(batches):
    for b in batches:
        lists = b.column("positions")
        yield pa.RecordBatch.from_arrays(
            [b.column("doc"), b.column("text_key"), pa.array([_bitmap(np.asarray(x.values)) for x in lists], pa.binary())],
            names=["doc", "text_key", "keep_bitmap"],
        )


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Per document that loses a line: (doc, text_key, keep_bitmap).

    A line's key is the line without outer white space, A-Z in lower case; keys found in
    at least ``min_docs`` documents go, in every document, or with ``keep_first`` in every
    place but the first (by doc_id, then position). The bitmap is zlib over one bit per
    line, first line in the highest bit; lines behind its end stay.
    """
    # a document's positions are one row, as its text is
    lost = dropped_lines(docs, min_docs, min_chars, keep_first).distinct()
    return lost.groupBy("doc", "text_key").agg(F.collect_list("pos").alias("positions")).mapInArrow(
        _packed, "doc long, text_key long, keep_bitmap binary"
    )


def kept_lines(lines: list[str], bitmap: bytes | None) -> list[str]:
    if bitmap is None:
        return lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    return [x for i, x in enumerate(lines) if i >= len(keep) or keep[i]]


def _applied(schema: pa.Schema):
    def run(batches):
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, bitmap in zip(b.column("_text").to_pylist(), b.column("keep_bitmap").to_pylist(), strict=True):
                lines = text.split("\n")
                left = kept_lines(lines, bitmap)
                texts.append(text if bitmap is None else "\n".join(left))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            made = {"kept_text": pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[f] if f in made else b.column(f) for f in schema], names=list(schema))

    return run


def dedup(docs: DataFrame, *more: str, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, the columns named in ``more``, n_lines, n_dropped and kept_text of every document.

    A null or empty text is one empty line, whose key is too short to be dropped. Rows
    with the same doc_id and text count as one document and lose the same lines; a null
    doc_id is an id of its own. An empty table gives an empty result. Other columns are
    not read, so they may have any name.
    """
    bitmaps = keep_bitmaps(docs, min_docs, min_chars, keep_first)
    text_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in more], *doc_key(), text_of().alias("_text"))
    joined = text_rows.join(bitmaps.hint("merge"), ["doc", "text_key"], "left").select("doc_id", *more, "_text", "keep_bitmap")
    out = joined.select("doc_id", *more).withColumns(
        {"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long"), "kept_text": F.lit("")}
    ).schema
    return joined.mapInArrow(_applied(out.names), out)


def deduplicated(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """The documents, in their own columns, without the lines that ``min_docs`` documents repeat, at any size of the input.

    The first occurrence of such a line stays; a document of which nothing but white
    space is left, though it had lines, goes. A null or empty text stays as it is; rows with
    the same doc_id (null is one) and text lose the same lines. An empty table gives an empty
    result. Other columns pass through, whatever their names.
    """
    carried = docs.select("doc_id", "text", rest(docs, "doc_id", "text", "n_chars"), F.col("text").isNull().alias("_none"))
    done = dedup(carried, "_rest", "_none", min_docs=min_docs, keep_first=True)
    left = done.filter((F.col("n_dropped") == 0) | (F.length(F.btrim(F.col("kept_text"), F.lit(BLANKS))) > 0))
    kept = F.when(~F.col("_none"), F.col("kept_text"))
    return restored(left, docs, doc_id=F.col("doc_id"), text=kept, n_chars=F.length(kept).cast("long"))
