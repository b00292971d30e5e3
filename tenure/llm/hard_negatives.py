"""Hard-negative mining by cover trees over norm-augmented vectors (operator 12).

One more component gives all vectors of a chunk the same length, so that the largest
inner products with a query are the nearest neighbours. Chunks hold what lies near one
pivot; each becomes a cover tree: the centres of a level are farther apart than its
radius, all vectors below a centre lie within it, and the radius halves from level to
level. Inner product and covering radius bound all products below a node from both
sides. A query opens nodes best first, leaves out those outside its window and compares
the vectors of a leaf exactly, as integers.

Queries meet chunks in blocks, once for the positives and once for the windows they
open. Only the few best per query and chunk leave a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.common import NO_ID, stored

# Parameters of the method.
PIVOTS = 256  # chosen from as many sampled rows times 16
CHUNK = 8192  # vectors of one tree
BLOCK = 256  # queries that meet a tree together
LEAF = 48  # vectors of a node that is not divided further
SCALE = 256

_ROW = "vec long, label int, part binary"


def _read(batches):
    """(vec, label, part) of the rows that take part; ``part`` holds the integer components as doubles."""
    for b in batches:
        lists = b.column("embedding")
        ends = np.asarray(lists.offsets)
        x = np.floor(np.float64(SCALE) * lists.values.to_numpy(zero_copy_only=False).astype(np.float64))  # a null is not finite
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        good = np.flatnonzero((bad[ends[1:]] == bad[ends[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False) & b.column("label").is_valid().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [b.column("vec").take(pa.array(good)), b.column("label").take(pa.array(good)), pa.array([x[ends[i] : ends[i + 1]].tobytes() for i in good], pa.binary())],
            names=["vec", "label", "part"],
        )


def _matrix(parts: list[bytes], width: int | None = None) -> np.ndarray:
    """Rows of doubles; shorter ones are filled up with zeros, and cut at ``width`` where that is given."""
    lens = {len(p) for p in parts}
    width = max(lens, default=0) // 8 if width is None else width
    if lens == {8 * width}:
        return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), width)
    out = np.zeros((len(parts), width))
    for i, p in enumerate(parts):
        x = np.frombuffer(p, np.float64)[:width]
        out[i, : len(x)] = x
    return out


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec, label, part) of the rows that take part, exact repeats once."""
    v = F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID))
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    rows = embeddings.select(v.alias("vec"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_read, _ROW).dropDuplicates()


def _pivots(rows: DataFrame, most: int) -> np.ndarray:
    """Vectors far apart from each other, out of a bounded sample; they decide what lies together, never a result."""
    sample = [r["part"] for r in rows.orderBy(F.xxhash64("vec", "part"), "vec").limit(16 * most).select("part").collect()]
    x = _matrix([bytes(p) for p in sample])
    if len(x) <= 1:
        return x
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _near(pivots: np.ndarray):
    def run(batches):
        size = (pivots**2).sum(axis=1)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("part").to_pylist(), pivots.shape[1])
            near = (size - 2 * x @ pivots.T).argmin(axis=1) if pivots.size else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec", "label", "part")), pa.array(near.astype(np.int32))], names=["vec", "label", "part", "pivot"])

    return run


class CoverTree:
    """Cover tree over the rows of ``x``; nodes are numbered level by level, a node's rows are a range of ``order``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.norm2 = float((x**2).sum(axis=1).max(initial=0))
        lift = np.sqrt(np.maximum(0, self.norm2 - (x**2).sum(axis=1)))
        y = np.hstack([x, lift[:, None]])
        order = np.arange(len(y))
        top = np.sqrt(((y - y[0]) ** 2).sum(axis=1))
        self.center, self.radius, self.low, self.high, self.child, self.children = [0], [float(top.max())], [0], [len(y)], [0], [0]
        level = [(0, float(top.max()))]
        while level:
            below = []
            for node, r in level:
                a, b = self.low[node], self.high[node]
                if b - a <= leaf or r <= 0:
                    continue
                rest, parts = order[a:b], []
                first = self.center[node]
                while len(rest):
                    c = first if not parts else int(rest[0])  # a node is its own first child
                    d = np.sqrt(((y[rest] - y[c]) ** 2).sum(axis=1))
                    near = d <= r / 2
                    near[rest == c] = True
                    parts.append((c, rest[near], float(d[near].max())))
                    rest = rest[~near]
                parts = self._joined(y, parts, leaf)
                self.child[node], self.children[node] = len(self.low), len(parts)
                for c, members, wide in parts:
                    order[a : a + len(members)] = members
                    below.append((len(self.low), wide))
                    self.center.append(c)
                    self.radius.append(wide)
                    self.low.append(a)
                    a += len(members)
                    self.high.append(a)
                    self.child.append(0)
                    self.children.append(0)
            level = below
        self.order = order

    @staticmethod
    def _joined(y, parts, leaf):
        """Small neighbours become one leaf below the first one's centre, with the radius that covers them."""
        out, open_ = [], None
        for c, members, wide in parts:
            if len(members) > leaf // 2:
                out.append((c, members, wide))
            elif open_ is not None and len(open_[1]) + len(members) <= leaf:
                both = np.concatenate([open_[1], members])
                open_ = (open_[0], both, float(np.sqrt(((y[both] - y[open_[0]]) ** 2).sum(axis=1)).max()))
            else:
                if open_ is not None:
                    out.append(open_)
                open_ = (c, members, wide)
        return out if open_ is None else [*out, open_]


def _grown(rows: pa.Table) -> pa.Table:
    x = _matrix(rows.column("part").to_pylist())
    tree = CoverTree(x)
    order = tree.order
    packed = {
        "vec": rows.column("vec").to_numpy()[order].astype(np.int64), "label": rows.column("label").to_numpy()[order].astype(np.int64),
        "x": x[order], "center": x[np.array(tree.center)], "radius": np.array(tree.radius), "low": np.array(tree.low), "high": np.array(tree.high),
        "child": np.array(tree.child), "children": np.array(tree.children),
    }
    out = {k: pa.array([v.tobytes()], pa.binary()) for k, v in packed.items()}
    chunk = rows.column("chunk")[0].as_py()
    return pa.table({"chunk": pa.array([chunk], pa.int32()), "width": pa.array([x.shape[1]], pa.int32()), "norm2": pa.array([tree.norm2], pa.float64()), **out})


_TREE = "chunk int, width int, norm2 double, vec binary, label binary, x binary, center binary, radius binary, low binary, high binary, child binary, children binary"


class _Packed:
    """A stored tree, ready for queries."""

    def __init__(self, row: dict):
        self.width = row["width"]
        whole = lambda c: np.frombuffer(row[c], np.int64)
        self.vec, self.label = whole("vec"), whole("label")
        self.low, self.high, self.child, self.children = (whole(c).tolist() for c in ("low", "high", "child", "children"))
        self.x = np.frombuffer(row["x"], np.float64).reshape(len(self.vec), self.width)
        self.radius = np.frombuffer(row["radius"], np.float64)
        self.center = np.frombuffer(row["center"], np.float64).reshape(len(self.radius), self.width)
        self.norm2 = row["norm2"]

    def bounds(self, q: np.ndarray) -> tuple[list[float], list[float]]:
        """(lowest, highest) inner product below every node, a little wide against rounding."""
        size = float(q @ q)
        d = np.sqrt(np.maximum(0, size + self.norm2 - 2 * (self.center @ q)))
        slack = 1 + 1e-9 * (size + self.norm2)
        high = (size + self.norm2 - np.maximum(0, d - self.radius) ** 2) / 2 + slack
        low = (size + self.norm2 - (d + self.radius) ** 2) / 2 - slack
        return low.tolist(), high.tolist()

    def best(self, q: np.ndarray, bounds, allowed, most: int, least: float = -np.inf, upper: float = np.inf) -> list[tuple[int, int]]:
        """The ``most`` best of the rows that ``allowed`` lets through with a product in [least, upper]: (-score, vec)."""
        low, high = bounds
        found: list[tuple[int, int]] = []
        heap = [(-high[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if len(found) == most and -bound < -found[-1][0]:
                break
            if -bound < least or low[node] > upper:
                continue
            if self.children[node]:
                for k in range(self.child[node], self.child[node] + self.children[node]):
                    if high[k] >= least and low[k] <= upper and not (len(found) == most and high[k] < -found[-1][0]):
                        heapq.heappush(heap, (-high[k], k))
                continue
            a, b = self.low[node], self.high[node]
            score = self.x[a:b] @ q
            good = np.flatnonzero((score >= least) & (score <= upper) & allowed[a:b])
            if len(found) == most:
                good = good[score[good] >= -found[-1][0]]
            if len(good):
                found = sorted([*found, *((-int(score[i]), int(self.vec[a + i])) for i in good)])[:most]
        return found


def _first_pass(most: int):
    """(anchor, key, vec, score): the best of the anchor's label in one tree, the anchor itself left out."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                tree = _Packed(row)
                anchors = row["queries"]
                q = _matrix([a["part"] for a in anchors], tree.width)
                rows = []
                for a, v in zip(anchors, q, strict=True):
                    allowed = (tree.label == a["label"]) & (tree.vec != a["vec"])
                    rows += [(a["vec"], a["key"], vec, -s) for s, vec in tree.best(v, tree.bounds(v), allowed, most)]
                yield _batch(rows, ("anchor", "key", "vec", "score"))

    return run


def _second_pass(most: int):
    """(anchor, key, positive, positive_score, vec, score): the best of other labels in each window of one tree."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                tree = _Packed(row)
                anchors = row["queries"]
                q = _matrix([a["part"] for a in anchors], tree.width)
                rows = []
                for a, v in zip(anchors, q, strict=True):
                    bounds, allowed, seen = tree.bounds(v), tree.label != a["label"], {}
                    for p in a["windows"]:
                        score = p["positive_score"]
                        least, upper = -((-30 * score) // 100), (90 * score) // 100
                        if least > upper:
                            continue
                        if score not in seen:
                            seen[score] = tree.best(v, bounds, allowed, most, least, upper)
                        rows += [(a["vec"], a["key"], p["positive"], score, vec, -s) for s, vec in seen[score]]
                yield _batch(rows, ("anchor", "key", "positive", "positive_score", "vec", "score"))

    return run


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(names))


def _chunks(rows: DataFrame, pivots: int, chunk: int) -> tuple[DataFrame, int]:
    """Rows with the number of their chunk, and the number of chunks; what lies near one pivot is cut evenly."""
    near = stored(rows.mapInArrow(_near(_pivots(rows, pivots)), f"{_ROW}, pivot int"), "near")
    counts = {r["pivot"]: r["count"] for r in near.groupBy("pivot").count().collect()}  # one row for each pivot
    # pivots with few rows go together, in their order; those with many are cut
    first, cuts, number, room = {}, {}, 0, 0
    for p in sorted(counts):
        n = counts[p]
        parts = -(-n // chunk)
        if parts == 1 and n <= room:
            first[p], cuts[p], room = number - 1, 1, room - n
        else:
            first[p], cuts[p], number = number, parts, number + parts
            room = chunk - n if parts == 1 else 0
    if not counts:
        return near.withColumn("chunk", F.lit(0)), 0
    starts = F.create_map(*[F.lit(x) for p in counts for x in (p, first[p])])
    sizes = F.create_map(*[F.lit(x) for p in counts for x in (p, cuts[p])])
    at = starts[F.col("pivot")] + F.pmod(F.xxhash64("vec", "part"), sizes[F.col("pivot")]).cast("int")
    return near.withColumn("chunk", at.cast("int")), number


def _blocks(queries: DataFrame, names: list[str], count: int, block: int, chunks: int) -> DataFrame:
    """Queries in lists of about ``block``, each list once for every chunk."""
    blocks = max(1, -(-count // block))
    lists = queries.groupBy(F.pmod(F.xxhash64("vec", "key"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct(*names)).alias("queries"))
    return lists.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(max(0, chunks - 1))))).drop("block")


def mine(embeddings: DataFrame, positives: int = 5, negatives: int = 10, every: int = 100, pivots: int = PIVOTS, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label, a null vector or a null or non-finite component take no part,
    exact repeats take part once; rows that share a vec_id but nothing else are rows of
    their own, and "other" rows are those with another vec_id. A null vec_id is no anchor;
    among equal scores it stands first. Shorter vectors count as filled up with zeros. Scores
    are exact while they stay below 2^53. An empty table gives an empty result. Other
    columns are not read, so they may have any name.

    ``pivots``, ``chunk`` and ``block`` change the work, never the result.
    """
    rows = stored(vectors(embeddings), "vectors")
    placed, n_chunks = _chunks(rows, pivots, chunk)
    trees = stored(placed.select("vec", "label", "part", "chunk").groupBy("chunk").applyInArrow(_grown, _TREE), "cover-trees")
    parts = max(1, int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few rows, each with much to do
    key = F.xxhash64("vec", "label", "part").alias("key")
    anchors = rows.filter((F.col("vec") % every == 0) & (F.col("vec") != NO_ID)).select("vec", "label", "part", key)
    count = anchors.count()
    asked = _blocks(anchors, ["vec", "label", "key", "part"], count, block, n_chunks)
    near = stored(trees.repartition(parts, "chunk").join(asked.repartition(parts, "chunk"), "chunk").mapInArrow(_first_pass(positives), "anchor long, key long, vec long, score long"), "positives")
    best = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "vec")
    chosen = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    windows = chosen.groupBy("anchor", "key").agg(F.collect_list(F.struct(F.col("vec").alias("positive"), F.col("score").alias("positive_score"))).alias("windows"))
    again = anchors.join(windows.withColumnRenamed("anchor", "vec"), ["vec", "key"])
    asked = _blocks(again, ["vec", "label", "key", "part", "windows"], count, block, n_chunks)
    found = stored(
        trees.repartition(parts, "chunk").join(asked.repartition(parts, "chunk"), "chunk").mapInArrow(_second_pass(negatives), "anchor long, key long, positive long, positive_score long, vec long, score long"), "negatives"
    )
    top = Window.partitionBy("anchor", "key", "positive", "positive_score").orderBy(F.desc("score"), "vec")
    id_of = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= negatives).select(
        F.col("anchor").alias("anchor_id"), id_of("positive").alias("positive_id"), "rank", id_of("vec").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
