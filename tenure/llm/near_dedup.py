"""Near-dedup by SuperMinHash (operator 1).

A set's element draws one random permutation of the m buckets and walks it; in step j
it offers j plus a fraction to the bucket it stands on, and a bucket keeps its minimum.
Ranks of one element are therefore correlated, every bucket gets one of each rank, and a
step is only needed while some bucket of the set is empty: all later offers are larger
than what lies there.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.common import row_keyed, stored
from tenure.llm.components import components

_MULTIPLY = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))
# Shingles signed at a time and words remembered: what bounds a Python worker's memory besides its batch.
_CHUNK = 50_000
_KNOWN = 100_000
# Members not grouped with their leader, up to which the pairs of a bucket are listed; where there are more, it gets a leader again.
LISTED = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hash of each word seen, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, size: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; one for all words if there are fewer than ``size``."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    width = min(size, len(parts))
    n = len(parts) - width + 1
    total = np.full(n, width, np.uint64)
    for j in range(width):
        total += hashed[j : j + n] * _MULTIPLY[j]
    return np.unique(_mix(total))


def superminhash(values: np.ndarray, owner: np.ndarray, sets: int, m: int) -> np.ndarray:
    """Signatures (sets x m) of the sets whose elements are ``values``; ``owner`` says which set each belongs to."""
    none = np.uint64(2**64 - 1)
    out = np.full(sets * m, none, np.uint64)
    perm = None
    for j in range(m):
        drawn = _mix(values + np.uint64((j + 1) * int(_MULTIPLY[0]) % 2**64))
        k = j + ((drawn >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            bucket = k
        else:
            at = np.arange(len(values))
            bucket = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
        np.minimum.at(out, owner * m + bucket, (np.uint64(j) << np.uint64(32)) | (drawn & np.uint64(0xFFFFFFFF)))
        going = (out.reshape(sets, m) == none).any(axis=1)[owner]
        if not going.any():
            break
        if perm is None:
            k, values, owner = k[going], values[going], owner[going]
            perm = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(values), m)).copy()
            perm[np.arange(len(values)), k] = 0
        elif not going.all():
            values, owner, perm = values[going], owner[going], perm[going]
    return out.reshape(sets, m)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band."""
    parts = signatures.reshape(len(signatures), bands, rows)
    total = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _MULTIPLY[7], parts.shape[:2]).copy()
    for j in range(rows):
        total = _mix(total + parts[:, :, j] * _MULTIPLY[j % 7])
    return total.view(np.int64)


def _signed(size: int, bands: int, rows: int):
    m = bands * rows

    def run(batches):
        known = _Words()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            start = 0
            while start < len(texts):
                sets, total = [], 0
                while start + len(sets) < len(texts) and total < _CHUNK:
                    sets.append(shingles(texts[start + len(sets)], size, known))
                    total += len(sets[-1])
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                keys = np.empty((len(sets), bands), np.int64)
                if len(full):
                    owner = np.repeat(np.arange(len(full)), n[full])
                    keys[full] = band_keys(superminhash(np.concatenate([sets[i] for i in full]), owner, len(full), m), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, len(sets)),
                        pa.array(n, pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([k if c else None for k, c in zip(keys, n, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "bands"],
                )
                start += len(sets)

    return run


def _sets(size: int):
    def run(batches):
        known = _Words()
        for batch in batches:
            made = [shingles(t, size, known).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], names=["id", "shingles"])

    return run


def _shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which elements of ``right`` are in ``left``, both sorted."""
    if not len(left):
        return np.zeros(len(right), bool)
    at = np.searchsorted(left, right)
    at[at == len(left)] = 0
    return left[at] == right


def _compared(percent: int):
    def run(batches):
        last, left = None, None
        for batch in batches:
            out = []
            for u, a, b in zip(*(batch.column(c) for c in ("u", "a", "b")), strict=True):
                if last != u:
                    last, left = u, np.frombuffer(a.as_buffer(), np.uint64)
                right = np.frombuffer(b.as_buffer(), np.uint64)
                both = int(_shared(left, right).sum())
                out.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(out, pa.bool_())], names=["u", "v", "linked"])

    return run


def _differing(percent: int):
    """How each set b differs from its reference a: what is new in it, and what it lost if that can decide (see ``_buckets``)."""

    def listed(found):
        ends = np.cumsum([0, *map(len, found)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64), pa.int64()))

    def run(batches):
        for batch in batches:
            numbers, fresh, lost = [], [], []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                left, right = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                fresh.append(right[~_shared(left, right)])
                gone = left[~_shared(right, left)]
                numbers.append((len(right), len(fresh[-1]), len(gone)))
                lost.append(gone if 100 * len(fresh[-1]) <= (100 - percent) * len(right) else gone[:0])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("group", "u", "v")], *[pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)],
                    listed(fresh), listed(lost),
                ],
                names=["group", "u", "v", "size", "new", "gone", "fresh", "lost"],
            )

    return run


def _elements(batches):
    """(group, element) of (group, shingles)."""
    for batch in batches:
        for group, held in zip(batch.column("group").to_pylist(), batch.column("shingles"), strict=True):
            found = np.frombuffer(held.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), group), pa.int64()), pa.array(found, pa.int64())], names=["group", "element"])


def _packed(batches):
    """Elements as a set is stored: sorted, in bytes."""
    for batch in batches:
        made = [np.sort(np.array(e, np.int64).view(np.uint64)).tobytes() for e in batch.column("elements").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], names=["id", "shingles"])


def _middles(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, shingles) for every group of ``rows`` (group, v): the elements that more than half of its members have."""
    held = rows.join(sets, F.col("v") == F.col("id")).select("group", "shingles").mapInArrow(_elements, "group long, element long")
    most = rows.groupBy("group").agg(F.count(F.lit(1)).alias("members"))
    common = held.groupBy("group", "element").agg(F.count(F.lit(1)).alias("have")).join(most, "group").filter("2 * have > members")
    lists = most.join(common.groupBy("group").agg(F.collect_list("element").alias("elements")), "group", "left")
    return lists.select(F.col("group").alias("id"), F.coalesce("elements", F.array().cast("array<bigint>")).alias("elements")).mapInArrow(
        _packed, "id long, shingles binary"
    )


def _named(sets: DataFrame, end: str, name: str) -> DataFrame:
    return sets.select(F.col("id").alias(end), F.col("shingles").alias(name))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) compared on their full sets: linked or not."""
    both = pairs.join(_named(sets, "v", "b"), "v").join(_named(sets, "u", "a"), "u").select("u", "v", "a", "b")
    return stored(both.mapInArrow(_compared(percent), "u long, v long, linked boolean"), "links")


def _differences(rows: DataFrame, sets: DataFrame, references: DataFrame, percent: int) -> DataFrame:
    """Rows (group, u, v) with the size of v and how it differs from the reference of its group: elements ``new`` and ``gone``."""
    both = rows.join(_named(sets, "v", "b"), "v").join(_named(references, "group", "a"), "group").select("group", "u", "v", "a", "b")
    columns = "group long, u long, v long, size long, new long, gone long, fresh array<long>, lost array<long>"
    return stored(both.mapInArrow(_differing(percent), columns), "differences")


def _lacking(percent: int) -> Column:
    """By how much a row's differences are too many: two rows of a group for which this adds up to 0 at most are linked."""
    return (100 + percent) * (F.col("new") + F.col("gone")) - (100 - percent) * F.col("size")


def _sure(view: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that the differences from a group's reference show by their numbers alone.

    x ^ y holds at most what x and y differ in from the reference, so ``_lacking`` of both
    decides. Whatever it links in a group it also links with the row where it is smallest.
    """
    rows = view.select("group", "v", _lacking(percent).alias("lacking"))
    near = rows.groupBy("group").agg(F.min(F.struct("lacking", "v")).alias("near"))
    found = rows.join(near, "group").filter((F.col("lacking") + F.col("near.lacking") <= 0) & (F.col("v") != F.col("near.v")))
    return found.select(F.col("near.v").alias("u"), "v")


def _undecided(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (group, u, v) of groups that hold several labels, one of them other than the leader's; ``open``: not with the leader."""
    named = lambda end, name: labels.select(F.col("id").alias(end), F.col("component").alias(name))
    found = rows.join(named("v", "label"), "v", "left").join(named("u", "hub"), "u", "left")
    found = found.withColumn("label", F.coalesce("label", "v")).withColumn("open", F.col("label") != F.coalesce("hub", "u")).drop("hub")
    several = found.groupBy("group").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low < _high").select("group")
    return found.join(several, "group")


def _buckets(view: DataFrame, percent: int) -> DataFrame:
    """Buckets (key) of rows that may be linked though their labels differ.

    Seen from any set, x ^ y is what only one of x and y differs in from it. Take x and y
    that ``_sure`` does not link (seen from the leader's own set: one of them not linked to
    it). If they are linked, they differ from the reference in a common element.

    Either they share new elements. At most (100 - percent) % of x is not in y, so in any
    order that all rows of the group use, the first shared one is among the first so many
    and one more of the new elements of x, and of y likewise. Or they share none: then no
    more than so many are new in either, and they lack common ones. At most
    (100 - percent) / percent of its size tell x from y, its new elements with them, so the
    first that both lack is among the first so many that are left and one more of what x
    lacks. The order puts first what makes the fewest pairs: elements of one row, of one
    label or of rows with the leader's label make none.

    A bucket is one element of a group; ``opened`` is the number of its open rows, ``members``
    that of all, ``rest`` the number of elements of this kind that a row has from this one
    on. Keys are hashes: buckets that meet only become larger.
    """
    ends = view.select("group", "v", "open", "label", F.explode("fresh").alias("element"), F.lit(True).alias("is_new"))
    each = ends.unionAll(view.select("group", "v", "open", "label", F.explode("lost").alias("element"), F.lit(False).alias("is_new")))
    makes = (F.col("opened") > 0) & (F.col("_low") < F.col("_high"))
    counts = [F.count_if("open").alias("opened"), F.count(F.lit(1)).alias("members"), F.min("label").alias("_low"), F.max("label").alias("_high")]
    costs = each.groupBy("group", "element").agg(*counts).filter(makes).select("group", "element", (F.col("opened") * F.col("members")).alias("cost"))
    row = Window.partitionBy("group", "v", "is_new")
    rest = F.count(F.lit(1)).over(row) - F.row_number().over(row.orderBy("cost", "element")) + 1
    heads = each.select("group", "v", "element", "is_new").join(costs, ["group", "element"]).withColumn("rest", rest).join(view.drop("fresh", "lost"), ["group", "v"])
    size, new = F.col("size"), F.col("new")
    place = F.when(F.col("is_new"), new).otherwise(F.col("gone")) - F.col("rest")
    heads = heads.filter(place <= F.when(F.col("is_new"), F.floor((100 - percent) * size / 100)).otherwise(F.floor((100 - percent) * size / percent) - new))
    rows = stored(heads.select(
        F.xxhash64("group", "element").alias("key"), "group", "v", "size", "new", "gone", "label", "open", "is_new", "rest"
    ), "heads")
    return stored(rows.join(rows.groupBy("key").agg(*counts).filter(makes).drop("_low", "_high"), "key"), "beside")


def _listed(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of the buckets, an open row in each, whose labels differ and whose numbers allow a link.

    A pair is judged as if the bucket's element were the first that it shares: from there on
    either row has ``rest`` elements that both can share, besides what both have of the reference.
    """
    rows = buckets.select("key", "v", "size", "label", "open", "is_new", "rest", (F.col("size") - F.col("new")).alias("kept"), _lacking(percent).alias("lacking"))
    named = lambda df, end: df.select("key", *[F.col(c).alias(f"{c}_{end}") for c in df.columns if c != "key"])
    x, y = named(rows, "x"), named(rows.filter("open"), "y")
    apart = (F.col("label_x") != F.col("label_y")) & (100 * F.least("size_x", "size_y") >= percent * F.greatest("size_x", "size_y"))
    rest = F.least("rest_x", "rest_y")
    enough = F.when(F.col("is_new_x"), (100 + percent) * (F.least("kept_x", "kept_y") + rest) >= percent * (F.col("size_x") + F.col("size_y")))
    enough = enough.otherwise(2 * (100 + percent) * rest >= F.col("lacking_x") + F.col("lacking_y"))
    met = y.join(x, (y["key"] == x["key"]) & (~F.col("open_x") | (F.col("v_x") < F.col("v_y"))) & apart & enough)
    return met.select(F.least("v_x", "v_y").alias("u"), F.greatest("v_x", "v_y").alias("v"))


def _led(buckets: DataFrame) -> DataFrame:
    """(group, u, v): each bucket gets a leader u of its own, the most central of its members.

    That is the one that has most of what buckets share and else differs least from what
    they were seen from. Buckets of one group that have the same leader become one group.
    """
    central = buckets.groupBy("group", "v").agg((2 * F.count(F.lit(1)) - F.first("new") - F.first("gone")).alias("central"))
    tops = buckets.join(central, ["group", "v"]).groupBy("key").agg(F.max_by("v", F.struct("central", -F.col("v"))).alias("u"))
    return buckets.join(tops, "key").filter("u <> v").select(F.xxhash64("group", "u").alias("group"), "u", "v").distinct()


def _cost(buckets: DataFrame) -> int:
    """Rows that a listing of the buckets' pairs would make at most."""
    return buckets.filter("open").agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]


def signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _signed(size, bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>"
    )


def groups(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 35, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links) of every document.

    Documents are linked if 100 * intersection >= ``percent`` * union of their shingle
    sets. A link is missed only if no band agrees: with the defaults, at exactly the
    limit, one time in a million, and less often above it.

    1. Equal sets are one class from the start, so exact copies cost one row each.
    2. Each bucket (equal band keys) has a leader: the class with the most company in its
       buckets, or the one that leads that class elsewhere. All members are compared with
       it only.
    3. What a leader does not link may still be linked with each other: smaller buckets are
       made of it (``_buckets``), each of one element in which members differ from the leader
       alike, rare ones first. Where few members are not grouped with the leader, the pairs
       that their numbers allow are compared. Any other bucket gets a leader again, its most
       central member, and is seen from its middle, what more than half of its members have;
       members near the middle are linked by that alone; then step 3 is done over. So copies
       around one text cost their number, not their pairs, whichever copy led them. Where
       this does not take a quarter off the pairs to be listed, they are listed. No pair of
       a bucket stays undecided.

    Texts are compared as A-Z lower-cased words between ASCII white space; a text with
    fewer words than ``size`` is one shingle; a null or wordless text is linked with
    nothing. doc_id should tell documents apart: rows of one doc_id are taken as one. A
    null doc_id has no component and leads nobody. Only doc_id and text are read.
    """
    signs = stored(signed(docs, size, bands, rows), "signatures")
    classes = signs.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    ).filter(F.col("id").isNotNull())
    exploded = classes.select("id", "n", F.explode("bands").alias("key"))
    crowded = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("company")).filter(F.col("company") > 1)
    members = stored(exploded.join(crowded, "key"), "buckets")
    weights = members.groupBy("id").agg(F.sum("company").alias("weight"))
    heaviest = lambda c: F.max_by(F.struct(F.col(c).alias("id"), F.col("weight").alias("weight")), F.struct("weight", -F.col(c)))
    first = stored(members.join(weights, "id").groupBy("key").agg(heaviest("id").alias("top")).select("key", F.col("top.id").alias("top"), "top.weight"), "leaders")
    above = members.join(first, "key").groupBy("id").agg(heaviest("top").alias("boss")).select(F.col("id").alias("top"), F.col("boss.id").alias("u"))
    leaders = first.select("key", "top").join(above, "top").select("key", "u")
    pairs = members.join(leaders, "key").select("u", F.col("id").alias("v")).filter("u <> v").distinct()

    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(
        weights.select("id"), "id", "left_semi"
    ).distinct()  # a text of many rows is one set; compared row by row it would cost the product of its rows and the other's
    sets = stored(wanted.mapInArrow(_sets(size), "id long, shingles binary"), "shingles")
    led = _verified(pairs, sets, percent)
    links = led.filter("linked").select("u", "v")
    labels = components(links)
    rows = _undecided(led.select(F.col("u").alias("group"), "u", "v"), labels).select("group", "u", "v")
    beside = _buckets(_undecided(_differences(rows, sets, sets, percent), labels), percent)
    listed = [_listed(beside.filter(F.col("opened") <= LISTED), percent)]
    many = beside.filter(F.col("opened") > LISTED)
    cost = _cost(many)
    while cost:
        again = stored(_led(many), "led")
        led = _verified(again.select("u", "v").distinct(), sets, percent)
        view = _differences(again, sets, _middles(again.select("group", "v"), sets), percent)
        links = links.unionAll(led.filter("linked").select("u", "v")).unionAll(_sure(view, percent))
        beside = _buckets(_undecided(view, components(links)), percent)
        before, cost = cost, _cost(beside)
        if 4 * cost > 3 * before:
            listed.append(_listed(beside if cost < before else many, percent))
            break
        listed.append(_listed(beside.filter(F.col("opened") <= LISTED), percent))
        many = beside.filter(F.col("opened") > LISTED)
        cost = _cost(many)
    found = _verified(reduce(DataFrame.unionAll, listed).distinct(), sets, percent)
    label_of = components(links.unionAll(found.filter("linked").select("u", "v")))
    class_of = classes.select("set_key", "id").join(label_of, "id", "left").select(
        F.col("set_key").alias("_set"), F.coalesce("component", F.col("id")).alias("component_id")
    )
    return signs.select("doc_id", "n_shingles", "set_key").join(class_of, F.col("set_key") == F.col("_set"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", F.col("doc_id")).alias("component_id")
    )


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, in the columns of ``docs``.

    Groups are told by the texts (a 64-bit hash stands for each), so rows with a null or
    repeated doc_id are judged each by its own. The row with the smallest doc_id stays, null
    after all others, of equal rows any one; texts without words stay all. An empty table
    gives an empty result.
    """
    keyed = row_keyed(docs)
    key = F.xxhash64(F.col("text").cast("string"))
    found = stored(groups(docs.select(key.alias("doc_id"), "text"), size, percent).filter("n_shingles > 0").distinct(), "text-groups")
    narrow = keyed.select(key.alias("_text_key"), F.col("doc_id").cast("long").alias("_doc"), "_file", "_index")
    place = F.struct(F.col("_doc").isNull().alias("none"), "_doc", "_file", "_index")
    group = narrow.join(found, F.col("_text_key") == F.col("doc_id")).groupBy("component_id").agg(F.min(place).alias("first"))
    first = group.select(F.col("first._file").alias("_file"), F.col("first._index").alias("_index"))
    wordless = narrow.join(found, F.col("_text_key") == F.col("doc_id"), "left_anti").select("_file", "_index")
    kept = stored(first.unionAll(wordless), "kept-rows")
    return keyed.join(kept.hint("merge"), ["_file", "_index"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
