"""Ranked lexical search by branch and bound over document FP-trees (operator 11).

Documents are cut down to the terms that the items of a block ask for. Each task puts
its documents into FP-trees: a document's terms, the most frequent first, are a path
from the root, and documents share the paths of their common beginnings. A node knows,
of all documents below it, the largest tf of each term and the smallest m, which bound
every score below it. Each item goes down depth first, the best child before the others,
and leaves out what cannot reach its ten best; small subtrees are scored document by
document. Ten documents per item and task are all that is left to compare.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.common import NO_ID, stored, text_of

# Parameters of the method.
BLOCK_TERMS = 500_000  # terms with repeats of the items that are searched in one pass over the corpus
TREE_DOCS = 5_000  # documents of one tree
TREE_TERMS = 1_000_000  # and their terms
LEAF_DOCS = 32  # documents of a subtree that is not divided further
LONGEST = 64  # a longer term is kept as its digest

# Upper case and separators as they are read; all other bytes belong to terms.
_READ = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]),
    b"abcdefghijklmnopqrstuvwxyz" + b" " * (0x30 + 7 + 6 + 5),
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_READ).split()


def _known(term: bytes) -> bytes:
    return term if len(term) <= LONGEST else b"\x00" + blake2b(term, digest_size=32).digest()


def item_blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[list[tuple[int | None, dict[bytes, int]]]]:
    """Items as (item_id, count of each term), in lists of about ``most`` terms; an item is never cut."""
    ordered = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().cast("binary").alias("text")).orderBy("item_id", "text")
    block: list[tuple[int | None, dict[bytes, int]]] = []
    size = 0
    for item, text in ordered.toLocalIterator():
        new = not block or block[-1][0] != item
        if new and size >= most:
            yield block
            block, size = [], 0
        if new:
            block.append((item, {}))
        for t in terms(bytes(text)):
            t = _known(t)
            block[-1][1][t] = block[-1][1].get(t, 0) + 1
            size += 1
    if block:
        yield block


def _vectors(place: dict[bytes, int]):
    """(doc, n, terms, tfs) of every document with a term; ``terms`` holds the places of those that are asked for."""

    def run(batches):
        longest = max(map(len, place), default=0) > LONGEST or any(t.startswith(b"\x00") for t in place)
        for b in batches:
            docs, sizes, found, counts, ends = [], [], [], [], [0]
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
                ws = terms(text)
                if not ws:
                    continue
                if longest:
                    ws = [_known(w) for w in ws]
                tf: dict[int, int] = {}
                for w in ws:
                    p = place.get(w)
                    if p is not None:
                        tf[p] = tf.get(p, 0) + 1
                docs.append(doc)
                sizes.append(len(ws))
                found += tf.keys()
                counts += tf.values()
                ends.append(len(found))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))],
                names=["doc", "n", "terms", "tfs"],
            )

    return run


def _gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """FP-tree over documents whose terms are places in the order of frequency, the most frequent first."""

    def __init__(self, docs: np.ndarray, m: np.ndarray, ends: np.ndarray, terms_: np.ndarray, tfs: np.ndarray, leaf: int = LEAF_DOCS):
        row = np.repeat(np.arange(len(docs)), np.diff(ends))
        by = np.lexsort([terms_, row])
        terms_, tfs = terms_[by], tfs[by]
        paths = [terms_[a:b].astype(">i4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        order = np.array(sorted(range(len(docs)), key=lambda i: (paths[i], docs[i])), np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.docs, self.m = docs[order], m[order]
        # postings of the sorted documents, by term
        at = place[row]
        by = np.lexsort([at, terms_])
        self.post_term, self.post_doc, self.post_tf = terms_[by].astype(np.int64), at[by], tfs[by].astype(np.int64)
        self.width = len(docs)
        self.post_key = self.post_term * self.width + self.post_doc
        # length of the path each document shares with the one before it
        shared = np.zeros(len(order) + 1, np.int64)
        for i in range(1, len(order)):
            a, b = paths[order[i - 1]], paths[order[i]]
            k = min(len(a), len(b))
            if a[:k] == b[:k]:
                shared[i] = k // 4
            else:
                x, y = np.frombuffer(a, np.int32, k // 4), np.frombuffer(b, np.int32, k // 4)
                shared[i] = int((x != y).argmax())
        self.low, self.high, self.child, self.children = [0], [len(order)], [0], [0]
        todo = [0]
        while todo:  # a node's children stand side by side
            node = todo.pop()
            a, b = self.low[node], self.high[node]
            if b - a <= leaf:
                continue
            depth = shared[a + 1 : b].min()
            cuts = [a, *(np.flatnonzero(shared[a + 1 : b] == depth) + a + 1).tolist(), b]
            parts = self._joined(cuts, leaf)
            if len(parts) < 2:
                continue
            self.child[node], self.children[node] = len(self.low), len(parts)
            for c, d in parts:
                todo.append(len(self.low))
                self.low.append(c)
                self.high.append(d)
                self.child.append(0)
                self.children.append(0)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.child, self.children = np.array(self.child), np.array(self.children)
        self._bound()

    @staticmethod
    def _joined(cuts: list[int], leaf: int) -> list[tuple[int, int]]:
        """Branches as ranges; neighbours that are small together are one leaf."""
        out: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if out and b - out[-1][0] <= leaf:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def _bound(self) -> None:
        """Largest tf of each term and smallest m below each node, from the leaves up."""
        nodes = len(self.low)
        self.nodes = nodes
        self.m_least = np.full(nodes, np.iinfo(np.int64).max)
        leaves = np.flatnonzero(self.children == 0)
        leaves = leaves[np.argsort(self.low[leaves])]
        self.m_least[leaves] = np.minimum.reduceat(self.m, self.low[leaves])
        of = leaves[np.searchsorted(self.low[leaves], self.post_doc, side="right") - 1]
        parent = np.zeros(nodes, np.int64)
        depth = np.zeros(nodes, np.int64)
        for node in np.flatnonzero(self.children):  # parents have smaller numbers than their children
            c = slice(self.child[node], self.child[node] + self.children[node])
            parent[c], depth[c] = node, depth[node] + 1
        keys, best = self._most(self.post_term * nodes + of, self.post_tf)
        levels = depth[keys % nodes]
        all_keys, all_best, up, most = [], [], keys[:0], best[:0]
        for level in range(int(depth.max(initial=0)), -1, -1):
            mine = levels == level
            here = np.flatnonzero(depth == level)
            up, most = self._most(np.concatenate([keys[mine], up]), np.concatenate([best[mine], most]))
            all_keys.append(up)
            all_best.append(most)
            if level:
                np.minimum.at(self.m_least, parent[here], self.m_least[here])
                up = up // nodes * nodes + parent[up % nodes]
        self.key, self.most = self._most(np.concatenate(all_keys), np.concatenate(all_best))

    @staticmethod
    def _most(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(keys, kind="stable")
        keys, values = keys[by], values[by]
        if not len(keys):
            return keys, values
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[head], np.maximum.reduceat(values, head)

    @staticmethod
    def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(wanted.shape, np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0)

    def _scores(self, asked: np.ndarray, weight: np.ndarray, a: int, b: int) -> np.ndarray:
        tf = self._looked_up(self.post_key, self.post_tf, asked[:, None] * self.width + np.arange(a, b))
        return weight @ _gain(tf, self.m[a:b])

    def _bounds(self, asked: np.ndarray, weight: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        tf = self._looked_up(self.key, self.most, asked[:, None] * self.nodes + nodes)
        return weight @ _gain(tf, self.m_least[nodes])

    def best(self, asked: np.ndarray, weight: np.ndarray, top: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The ``top`` best of ``known`` and this tree's documents as (-score, doc), the best first."""
        found = sorted(known)[:top]
        stack = [(self._bounds(asked, weight, np.zeros(1, np.int64))[0], 0)]
        while stack:
            bound, node = stack.pop()
            # at an equal score a smaller doc still counts
            if bound <= 0 or len(found) == top and bound < -found[-1][0]:
                continue
            if self.children[node]:
                below = np.arange(self.child[node], self.child[node] + self.children[node])
                bounds = self._bounds(asked, weight, below)
                least = max(1, -found[-1][0]) if len(found) == top else 1
                good = np.flatnonzero(bounds >= least)
                stack += [(bounds[i], below[i]) for i in good[np.argsort(bounds[good], kind="stable")]]
                continue
            a, b = self.low[node], self.high[node]
            scores = self._scores(asked, weight, a, b)
            good = np.flatnonzero(scores >= (max(1, -found[-1][0]) if len(found) == top else 1))
            if len(good) > top:  # the best of a leaf are enough
                good = good[np.lexsort([self.docs[a:b][good], -scores[good]])[:top]]
            if len(good):
                found = sorted([*found, *((-int(scores[i]), int(self.docs[a + i])) for i in good)])[:top]
        return found


def _searched(items: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_all: int, top: int, tree_docs: int):
    """(item, doc, score): the best documents of a task for each item, numbered within the block."""

    def run(batches):
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        held: list[tuple] = []

        def build():
            docs, sizes, tf_ends, places, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            m = 25 + (75 * sizes * n_docs) // n_all
            tree = Tree(docs, m, np.concatenate([[0], np.cumsum(tf_ends)]), places, tfs)
            for i, (asked, weight) in enumerate(items):
                if len(asked):
                    best[i] = tree.best(asked, weight, top, best[i])

        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("terms")
            held.append((
                b.column("doc").to_numpy(), b.column("n").to_numpy(), np.diff(np.asarray(lists.offsets)),
                lists.flatten().to_numpy(), b.column("tfs").flatten().to_numpy(),
            ))
            if sum(len(x[0]) for x in held) >= tree_docs or sum(len(x[3]) for x in held) >= TREE_TERMS:
                build()
        if held:
            build()
        rows = [(i, doc, -score) for i, found in enumerate(best) for score, doc in found]
        if rows:
            i, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, top: int = 10, block_terms: int = BLOCK_TERMS, tree_docs: int = TREE_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each item.

    Every row of ``docs`` is a document; one without a term is in no count and no result.
    The terms of all rows of ``items`` with one item_id (null is an id of its own) belong
    to one item. Equal scores go by doc_id; a null doc_id stands before all others, rows
    with the same doc_id and score follow each other. Items without terms, or whose terms
    no document holds, have no rows. Other columns are not read, so they may have any
    name. Empty tables give an empty result.

    Items come in blocks of ``block_terms`` terms, each a pass over the corpus; what a
    task gets to know of them is bounded by that.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_of().cast("binary").alias("text"))
    spark = docs.sparkSession
    out = None
    for block in item_blocks(items, block_terms):
        vocabulary = sorted({t for _, counts in block for t in counts})
        place = {t: i for i, t in enumerate(vocabulary)}
        vectors = stored(texts.mapInArrow(_vectors(place), "doc long, n long, terms array<int>, tfs array<int>"), "vectors")
        n_docs, n_all = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r[0]: r[1] for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # of the block's terms
        if not df:
            continue
        # terms numbered by frequency, so that a sorted vector is a path from the frequent to the rare
        order = sorted(df, key=lambda t: (-df[t], vocabulary[t]))
        number = np.zeros(len(vocabulary), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in order}
        asked = []
        for _, counts in block:
            held = sorted((int(number[place[t]]), k * weight[place[t]]) for t, k in counts.items() if place[t] in df)
            asked.append((np.array([x for x, _ in held], np.int64), np.array([w for _, w in held], np.int64)))
        numbered = vectors.mapInArrow(_renumbered(number), vectors.schema)
        found = stored(numbered.mapInArrow(_searched(asked, n_docs, n_all, top, tree_docs), "item int, doc long, score long"), "best")
        best = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
        ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item int, item_id long")
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).join(ids, "item").select(
            "item_id", "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score"
        )
        out = ranked if out is None else out.unionAll(ranked)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _renumbered(number: np.ndarray):
    def run(batches):
        for b in batches:
            lists = b.column("terms")
            new = pa.ListArray.from_arrays(pa.array(np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]), pa.array(number[lists.flatten().to_numpy()]))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("n"), new, b.column("tfs")], names=["doc", "n", "terms", "tfs"])

    return run
