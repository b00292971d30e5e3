"""Removal of repeated word windows by prefix-partitioned suffix trees (operator 13).

A window of ``size`` words goes if its words also start earlier. Not every suffix of the
corpus enters a tree: each window holds one *place*, the smallest hash among its runs of
``gram`` words, and equal windows have it at the same offset. The suffixes that start at
places are split by prefixes of three lengths:

* the ``gram`` words at a place. A prefix that stands at one place only repeats nothing;
* all words of the windows that share a place (their span). Of equal spans the first is
  kept for the trees, the others lose all their windows at once, so a group of copies,
  however large, puts one span into a tree;
* the whole window, for a prefix with more spans than a task should hold: then the
  prefix is as deep as the wanted node, whose first leaf is a minimum.

What is left of a prefix of ``gram`` words is one memory-sized group. Its windows are
sorted and their common prefixes give the tree's internal nodes; the leaves of a node of
depth ``size`` are one repeat, and all but its first leaf go.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import NO_ID, stored, text_of

# Parameters of the method.
SIZE, GRAM = 20, 8
GROUP = 20_000  # spans of one prefix that one task sorts together
SALTS = 64  # parts of a prefix with more spans than that

_SEGMENT = 1 << 17  # words hashed together
_PIECE = 1 << 20  # bytes hashed together
_LONG_WORD = 1 << 16

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64))
_BYTE[_IS_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_BASE2 = 0xD1B54A32D192ED03


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(1, n), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTE_POWERS = _powers(_BASE, _LONG_WORD + 1)
_UP, _DOWN = ({b: _powers(x, _SEGMENT + 1) for b, x in ((1, _BASE), (2, _BASE2))} if up else
              {b: _powers(pow(x, -1, 1 << 64), _SEGMENT + 1) for b, x in ((1, _BASE), (2, _BASE2))} for up in (True, False))


def word_hashes(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of every word in UTF-8 bytes; a text begins at each of ``firsts``, where no word goes on."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = ~_IS_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    begin = firsts[firsts < len(data)]
    start[begin] = inside[begin]
    starts = np.flatnonzero(start)
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return starts, out
    words = np.add.reduceat(inside, starts, dtype=np.int64)  # bytes of each word
    long = np.flatnonzero(words > _LONG_WORD)
    for i in long:
        out[i] = int.from_bytes(blake2b(data[starts[i] : starts[i] + words[i]].tobytes(), digest_size=8).digest(), "little")
    cuts = np.unique(np.concatenate([np.searchsorted(starts, np.arange(0, len(data), _PIECE)), long, long + 1, [0, len(starts)]]))
    is_long = np.zeros(len(starts) + 1, bool)
    is_long[long] = True
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if is_long[a]:
            continue
        low, high = starts[a], starts[b - 1] + words[b - 1]
        at = starts[a:b] - low
        place = np.arange(high - low) - np.repeat(at, np.diff(np.append(at, high - low)))
        part = _BYTE[data[low:high]]
        part *= _BYTE_POWERS[np.minimum(place, _LONG_WORD)]
        out[a:b] = _mixed(np.add.reduceat(part, at) + words[a:b].astype(np.uint64))
    return starts, out


class _Sums:
    """Hashes of any run of words in constant time."""

    def __init__(self, hashes: np.ndarray, kind: int = 1):
        self.kind = kind
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * _UP[kind][: len(hashes)], out=self.sums[1:], dtype=np.uint64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[b] - self.sums[a]) * _DOWN[self.kind][a] + (b - a).astype(np.uint64))


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the first smallest value in each run of ``width`` values."""
    at, low, have = np.arange(len(values)), values, 1
    while have < width:
        step = min(have, width - have)
        n = len(low) - step
        right = low[step:] < low[:n]
        at, low = np.where(right, at[step:], at[:n]), np.where(right, low[step:], low[:n])
        have += step
    return at


def _batch_words(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, row of each word, number of the first word of each row) of a column of bytes."""
    col = batch.column(column)
    if pa.types.is_binary(col.type):
        ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    else:
        ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    held = col.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    starts, hashes = word_hashes(data, ends[:-1])
    row = np.searchsorted(ends[1:], starts, side="right")
    return hashes, row, np.searchsorted(starts, ends[:-1], side="left")


_SPAN_SCHEMA = "prefix long, span long, doc long, text_key int, low int, n int"


def _spans(size: int, gram: int):
    """Per place of a text: its prefix, its span, and the windows ``low`` to ``low + n - 1`` that hold it."""

    def run(batches):
        for batch in batches:
            hashes, row, first = _batch_words(batch)
            doc, key = batch.column("doc").to_numpy(), batch.column("text_key").to_numpy()
            for a in range(0, max(1, len(hashes) - size + 1), _SEGMENT - size + 1):
                h, r = hashes[a : a + _SEGMENT], row[a : a + _SEGMENT]
                n = len(h) - size + 1
                if n < 1:
                    continue
                sums = _Sums(h)
                grams = sums.of(np.arange(len(h) - gram + 1), np.arange(gram, len(h) + 1))
                place = _lowest(grams, size - gram + 1)
                here = np.flatnonzero(r[:n] == r[size - 1 :])
                if not len(here):
                    continue
                fresh = np.ones(len(here), bool)
                fresh[1:] = (place[here[1:]] != place[here[:-1]]) | (np.diff(here) != 1)
                at = np.flatnonzero(fresh)
                low, count = here[at], np.diff(np.append(at, len(here)))
                of = r[low]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[place[low]].view(np.int64)), pa.array(sums.of(low, low + count + size - 1).view(np.int64)),
                        pa.array(doc[of]), pa.array(key[of]), pa.array((low + a - first[of]).astype(np.int32)), pa.array(count.astype(np.int32)),
                    ],
                    names=["prefix", "span", "doc", "text_key", "low", "n"],
                )

    return run


_GONE, _KEEP, _FIRST = 0, 1, 2
_FOUND_SCHEMA = "kind int, prefix long, more long, doc long, text_key int, low int, n int"
_WHO = ("doc", "text_key", "low")


def _found(kind: int, rows: dict[str, np.ndarray], prefix: str = "prefix", more: str | None = None) -> pa.RecordBatch:
    n = len(rows["low"])
    arrays = [np.full(n, kind, np.int32), rows[prefix], rows[more] if more else np.zeros(n, np.int64), *(rows[c] for c in (*_WHO, "n"))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["kind", "prefix", "more", *_WHO, "n"])


def _changes(rows: dict[str, np.ndarray], columns, before: dict | None) -> np.ndarray:
    """Where a row differs from the one before it in ``columns``; ``before`` is the last row of the batch before."""
    out = np.zeros(len(rows["low"]), bool)
    for c in columns:
        out[1:] |= rows[c][1:] != rows[c][:-1]
    out[0] = before is None or any(before[c] != rows[c][0] for c in columns)
    return out


def _first_spans(batches) -> Iterator[pa.RecordBatch]:
    """A sorted range: of equal spans the first is kept if its prefix has another span, the others are gone.

    Where a prefix or a span may begin or go on in another range, its first span here is
    kept too; the trees then find what it repeats. One row is held between batches.
    """
    columns = ("prefix", "span", *_WHO, "n")
    before, waiting, edge = None, None, True  # last row; first span of the open prefix while it is the only one; open prefix is the range's first
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        new_prefix = _changes(rows, ("prefix",), before)
        new_span = new_prefix | _changes(rows, ("span",), before)
        gone = ~new_span & _changes(rows, _WHO, before)
        if gone.any():
            yield _found(_GONE, {c: v[gone] for c, v in rows.items()})
        # spans of each prefix in this batch; the first group goes on from the batch before unless a prefix starts here
        group = np.cumsum(new_prefix) - (1 if new_prefix[0] else 0)
        spans = np.bincount(group, weights=new_span).astype(np.int64)
        if not new_prefix[0]:
            open_more = waiting is None  # already has two
            if waiting is not None and spans[0]:
                yield _found(_KEEP, waiting)
                waiting, open_more = None, True
            if open_more:
                spans[0] += 2
        elif waiting is not None:
            if edge:
                yield _found(_KEEP, waiting)
            waiting = None
        if new_prefix[0] and before is not None:
            edge = False
        many = spans >= 2
        many[0] |= edge and len(spans) > 1  # the range's first prefix, closed in this batch
        keep = new_span & many[group]
        if keep.any():
            yield _found(_KEEP, {c: v[keep] for c, v in rows.items()})
        if len(spans) > 1:
            if waiting is not None and edge:
                yield _found(_KEEP, waiting)
            edge, waiting = False, None
            if not many[-1]:
                waiting = {c: v[new_span & (group == len(spans) - 1)] for c, v in rows.items()}
        elif spans[0] == 1 and new_prefix[0]:
            waiting = {c: v[new_span] for c, v in rows.items()}
        before = {c: v[-1] for c, v in rows.items()}
    if waiting is not None:
        yield _found(_KEEP, waiting)


_PLACED_SCHEMA = "prefix long, more long, doc long, text_key int, low int, n int, words binary"


def _with_words(size: int):
    """The words of each kept span as 64-bit hashes; of a split prefix, its windows as two hashes and no words."""

    def run(batches):
        for batch in batches:
            hashes, _, first = _batch_words(batch)
            lists = batch.column("places")
            per_row = np.diff(np.asarray(lists.offsets))
            at = lists.flatten()
            prefix, low, n, split = (at.field(c).to_numpy(zero_copy_only=False) for c in ("prefix", "low", "n", "split"))
            row = np.repeat(np.arange(batch.num_rows), per_row)
            doc, key = batch.column("doc").to_numpy()[row], batch.column("text_key").to_numpy()[row]
            begin = first[row] + low
            whole = np.flatnonzero(~split)
            for c in range(0, len(whole), 8192):
                x = whole[c : c + 8192]
                lens = n[x].astype(np.int64) + size - 1
                ends = np.concatenate([[0], np.cumsum(lens)])
                flat = hashes[np.repeat(begin[x] - ends[:-1], lens) + np.arange(ends[-1])]
                words = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((ends * 8).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix[x]), pa.array(np.zeros(len(x), np.int64)), pa.array(doc[x]), pa.array(key[x]), pa.array(low[x]), pa.array(n[x]), words],
                    names=["prefix", "more", *_WHO, "n", "words"],
                )
            parts = np.flatnonzero(split)
            for c in range(0, len(parts), 8192):
                x = np.repeat(parts[c : c + 8192], n[parts[c : c + 8192]])
                step = np.arange(len(x)) - np.repeat(np.concatenate([[0], np.cumsum(n[parts[c : c + 8192]])[:-1]]), n[parts[c : c + 8192]])
                full = hashes[(begin[x] + step)[:, None] + np.arange(size)]
                one, two = (_mixed((full * _UP[k][:size]).sum(axis=1, dtype=np.uint64)).view(np.int64) for k in (1, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), pa.array(doc[x]), pa.array(key[x]), pa.array((low[x] + step).astype(np.int32)),
                     pa.array(np.ones(len(x), np.int32)), pa.nulls(len(x), pa.binary())],
                    names=["prefix", "more", *_WHO, "n", "words"],
                )

    return run


def deep_nodes(suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, node) of suffixes, one row of words each: leaves in the tree's order, and for each the internal node of
    at least ``depth`` words it hangs under, -1 if there is none."""
    order = np.lexsort(suffixes.T[::-1])
    same = suffixes[order][1:] == suffixes[order][:-1]
    common = np.where(same.all(axis=1), suffixes.shape[1], same.argmin(axis=1)) if len(order) > 1 else np.zeros(0, np.int64)
    joins = np.concatenate([[False], common >= depth])  # with the leaf before it
    node = np.cumsum(~joins) - 1
    alone = ~joins & ~np.append(joins[1:], False)
    return order, np.where(alone, -1, node)


def _tree(rows: dict[str, np.ndarray], words: np.ndarray, ends: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """One group of spans: the windows that repeat an earlier one."""
    n = rows["n"].astype(np.int64)
    span = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(span)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    at = ends[:-1][span] + step
    order, node = deep_nodes(words[at[:, None] + np.arange(size)], size)
    leaf = order[node >= 0]
    if not len(leaf):
        return
    who = [rows["doc"][span[leaf]], rows["text_key"][span[leaf]], rows["low"][span[leaf]] + step[leaf]]
    by = np.lexsort([*who[::-1], node[node >= 0]])
    nodes, who = node[node >= 0][by], [x[by] for x in who]
    head = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
    first = np.repeat(head, np.diff(np.append(head, len(nodes))))
    gone = np.any([x != x[first] for x in who], axis=0)
    if gone.any():
        out = {c: x[gone] for c, x in zip(_WHO, who, strict=True)}
        out |= {"low": out["low"].astype(np.int32), "n": np.ones(len(out["low"]), np.int32), "prefix": np.zeros(len(out["low"]), np.int64)}
        yield _found(_GONE, out)


def _trees(size: int, group: int):
    def run(batches):
        columns = ("prefix", "more", "salt", *_WHO, "n")
        held: list[tuple[dict, np.ndarray, np.ndarray]] = []  # groups not built yet
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            part = batch.column("words").is_null().to_numpy(zero_copy_only=False)
            if part.any():  # whole windows of a split prefix, in order: the first of each is settled between the parts
                w = {c: v[part] for c, v in rows.items()}
                new = _changes(w, ("prefix", "more", "salt"), before)
                gone = ~new & _changes(w, _WHO, before)
                before = {c: v[-1] for c, v in w.items()}
                yield _found(_FIRST, {c: v[new] for c, v in w.items()}, "prefix", "more")
                if gone.any():
                    yield _found(_GONE, {c: v[gone] for c, v in w.items()})
            if part.all():
                continue
            rest = {c: v[~part] for c, v in rows.items()}
            flat = batch.column("words").filter(pa.array(~part))
            held.append((rest, np.frombuffer(b"".join(flat.to_pylist()), np.uint64), rest["n"].astype(np.int64) + size - 1))
            if sum(len(x["n"]) for x, _, _ in held) < group:
                continue
            rows = {c: np.concatenate([x[c] for x, _, _ in held]) for c in columns}
            words, lens = np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
            ends = np.concatenate([[0], np.cumsum(lens)])
            cut = int(np.searchsorted(rows["prefix"], rows["prefix"][-1]))  # the last prefix may go on
            if cut:
                yield from _tree({c: v[:cut] for c, v in rows.items()}, words, ends[: cut + 1], size)
            held = [({c: v[cut:] for c, v in rows.items()}, words[ends[cut] :], lens[cut:])]
        if held:
            rows = {c: np.concatenate([x[c] for x, _, _ in held]) for c in columns}
            ends = np.concatenate([[0], np.cumsum(np.concatenate([x for _, _, x in held]))])
            yield from _tree(rows, np.concatenate([x for _, x, _ in held]), ends, size)

    return run


def _keyed() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.hash(text_of()).alias("text_key"), text_of().cast("binary").alias("text")]


def repeated(docs: DataFrame, size: int = SIZE, gram: int = GRAM, group: int = GROUP, salts: int = SALTS) -> DataFrame:
    """(doc, text_key, low, n): windows ``low`` to ``low + n - 1`` of a document repeat an earlier one.

    ``group`` bounds the spans that are sorted together; it changes the work, never the result.
    """
    gram = min(gram, size)
    texts = docs.select(*_keyed())
    order = ["prefix", "span", *_WHO]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spans = texts.mapInArrow(_spans(size, gram), _SPAN_SCHEMA).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    seen = stored(spans.mapInArrow(_first_spans, _FOUND_SCHEMA), "spans")
    kept = seen.filter(F.col("kind") == _KEEP)
    hot = stored(kept.groupBy("prefix").count().filter(F.col("count") > group).select("prefix", F.lit(True).alias("split")), "split-prefixes")
    places = (
        kept.join(hot, "prefix", "left")
        .groupBy("doc", "text_key")
        .agg(F.collect_list(F.struct("prefix", "low", "n", F.coalesce("split", F.lit(False)).alias("split"))).alias("places"))  # at most one for each word of the text
    )
    held = texts.join(places.hint("merge"), ["doc", "text_key"]).mapInArrow(_with_words(size), _PLACED_SCHEMA)
    salt = F.when(F.col("words").isNull(), F.pmod(F.hash("doc", "low"), F.lit(salts))).otherwise(0)
    dealt = held.withColumn("salt", salt).repartition("prefix", "more", "salt").sortWithinPartitions("prefix", "more", "salt", *_WHO)
    found = stored(dealt.mapInArrow(_trees(size, group), _FOUND_SCHEMA), "repeats")
    firsts = found.filter(F.col("kind") == _FIRST)
    who = F.struct(*_WHO)
    least = firsts.groupBy("prefix", "more").agg(F.min(who).alias("first"))  # one row for each part of a prefix
    later = firsts.join(least, ["prefix", "more"]).filter(who != F.col("first"))
    out = [*_WHO, "n"]
    return seen.filter(F.col("kind") == _GONE).select(*out).unionAll(found.filter(F.col("kind") == _GONE).select(*out)).unionAll(later.select(*out))


def _cut(size: int, names: list[str]):
    def run(batches):
        for b in batches:
            made = {"n_words": [], "n_removed": [], "spans": [], "kept_text": []}
            for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                words = text.split()
                spans: list[list[int]] = []
                for low, n in sorted((g["low"], g["n"]) for g in gone or ()):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], low + n + size - 1)
                    else:
                        spans.append([low, low + n + size - 1])
                left, at = [], 0
                for low, end in spans:
                    left += words[at:low]
                    at = end
                left += words[at:]
                made["n_words"].append(len(words))
                made["n_removed"].append(len(words) - len(left))
                made["spans"].append(spans)
                made["kept_text"].append(b" ".join(left))
            types = {"n_words": pa.int64(), "n_removed": pa.int64(), "spans": pa.list_(pa.list_(pa.int32())), "kept_text": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(made[c], types[c]) if c in made else b.column(c) for c in names], names=names)

    return run


def removed(docs: DataFrame, size: int = SIZE, **more) -> DataFrame:
    """doc_id, n_words, n_removed, spans ([from, to) of the removed words) and kept_text of every document.

    Words are runs of other than white space, compared as they are; kept words are joined
    by one space. A null or empty text has no words. Rows with the same doc_id and text
    are one document and lose the same words; rows with the same doc_id and different
    texts follow each other in the order of a hash of the text. A null doc_id comes before
    all others. Shorter texts than ``size`` words lose nothing. Other columns are not read,
    so they may have any name. An empty table gives an empty result.
    """
    gone = repeated(docs, size, **more).groupBy("doc", "text_key").agg(F.collect_list(F.struct("low", "n")).alias("gone"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keyed())
    joined = texts.join(gone.hint("merge"), ["doc", "text_key"], "left").select("doc_id", "text", "gone")
    out = joined.select("doc_id").withColumns(
        {"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "spans": F.lit(None).cast("array<array<int>>"), "kept_text": F.lit(b"")}
    ).schema
    return joined.mapInArrow(_cut(size, out.names), out).withColumn("kept_text", F.col("kept_text").cast("string"))

