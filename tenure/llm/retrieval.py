"""Benchmark decontamination by latent semantic retrieval (operator 4).

The benchmark is the query set and is worked on in blocks of bounded size. Its passages
get TF-IDF weights, with document frequencies counted over the whole corpus; a randomised
SVD, whose products are made by tasks over the passages, gives the latent space. Every
window of every document is put into that space; windows near a passage are candidates,
and the longest common subsequence of words, with a check for the end of the item,
decides. All candidates of a window are compared; none is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm.common import text_of

PASSAGE, PASSAGE_STEP = 32, 16
WINDOW_STEP = 32  # windows are two steps long, so every passage lies whole in one
BLOCK_WORDS = 20_000
# Axes of a block: at least AXES, and one for so many passages, so that a larger block keeps as much of them.
AXES, PASSAGES_PER_AXIS = 128, 3
ANSWER, ANSWER_SPAN = 5, 8
_TOKENS = 40_000


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, without the punctuation at their ends."""
    return [x for w in (text or "").encode("utf-8", "surrogatepass").lower().split() if (x := w.strip(b".,;:!?\"'()[]"))]


def blocks(benchmark: DataFrame, most_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items as (item_id, words) in lists of about ``most_words`` words; an item is never cut."""
    rows, count = [], 0
    ordered = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null").orderBy("item_id")
    for item, text in ordered.toLocalIterator():
        words = tokens(text)
        if words:
            rows.append((item, words))
            count += len(words)
        if count >= most_words:
            yield rows
            rows, count = [], 0
    if rows:
        yield rows


def passages(words: list, size: int = PASSAGE, step: int = PASSAGE_STEP) -> list[tuple[int, int]]:
    """(from, to) of overlapping passages that cover all words."""
    starts = list(range(0, max(1, len(words) - size + 1), step))
    if starts[-1] + size < len(words):
        starts.append(len(words) - size)
    return [(s, min(len(words), s + size)) for s in starts]


def _counted(vocabulary):
    def run(batches):
        known, found = vocabulary.value, np.zeros(len(vocabulary.value), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                here = {known.get(w, -1) for w in tokens(text)}
                here.discard(-1)
                if here:
                    found[list(here)] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], names=["word", "docs"])

    return run


def _products(basis):
    """One task's share of A'A times the basis; a row of the result per word that its passages hold."""

    def run(batches):
        q, out = basis.value, {}
        for batch in batches:
            for at, weights in zip(batch.column("at"), batch.column("weights"), strict=True):
                i, w = np.asarray(at.values), np.asarray(weights.values)
                seen = w @ q[i]
                for k, x in zip(i.tolist(), w.tolist(), strict=True):
                    out[k] = out.get(k, 0) + x * seen
        ids = list(out)
        for s in range(0, len(ids), 1000):
            part = ids[s : s + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([out[k].tolist() for k in part], pa.list_(pa.float64()))], names=["word", "v"])

    return run


def randomised_svd(spark: SparkSession, rows: list[tuple[list[int], list[float]]], width: int, rank: int, rounds: int = 2) -> np.ndarray:
    """Leading right singular vectors (width x rank) of the sparse rows.

    Each round multiplies A'A with the basis in tasks over the rows, sums per word in a
    shuffle, and makes the result, whose size is bounded by the block, orthogonal here.
    """
    frame = spark.createDataFrame(rows, "at array<long>, weights array<double>").repartition(max(1, min(64, len(rows) // 100)))
    q, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((width, min(width, rank))))
    for _ in range(rounds + 1):
        shared = spark.sparkContext.broadcast(q)
        each = frame.mapInArrow(_products(shared), "word long, v array<double>").select("word", F.posexplode("v").alias("k", "x"))
        summed = each.groupBy("word", "k").agg(F.sum("x").alias("x")).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v"))
        z = np.zeros_like(q)
        for word, v in summed.select("word", F.col("v.x")).collect():
            z[word] = v
        small = q.T @ z
        shared.unpersist()
        if _ < rounds:
            q, _r = np.linalg.qr(z)
    _values, turned = np.linalg.eigh((small + small.T) / 2)
    return q @ turned[:, ::-1]


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, one machine word of ``a`` at a time."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for x in b:
        if hit := where.get(x, 0) & state:
            state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def closest_span(a: list, b: list, width: int) -> tuple[int, int]:
    """(length, start) of the longest common subsequence of ``a`` and ``width`` neighbouring words of ``b``."""
    known, best = set(a), (0, 0)
    for start in range(len(b)):
        if b[start] in known:
            best = max(best, (common_subsequence(a, b[start : start + width]), -start))
            if best[0] == len(a) or start + width >= len(b):
                break
    return best[0], -best[1]


class Index:
    """One block of items in latent space."""

    def __init__(self, spark: SparkSession, items, docs: DataFrame):
        self.items = items
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
        shared = spark.sparkContext.broadcast(self.vocabulary)
        counts = docs.select(text_of().alias("text")).mapInArrow(_counted(shared), "word long, docs long")
        df = np.zeros(len(self.vocabulary))
        for word, n in counts.groupBy("word").agg(F.sum("docs")).collect():  # at most one row per word of the block
            df[word] = n
        idf = np.log((2 + docs.count()) / (1 + df))
        self.cut = [(i, a, b) for i, (_, words) in enumerate(items) for a, b in passages(words)]
        rows = []
        for i, a, b in self.cut:
            at, n = np.unique([self.vocabulary[w] for w in items[i][1][a:b]], return_counts=True)
            weights = n * idf[at]
            rows.append((at.tolist(), (weights / max(np.linalg.norm(weights), 1e-12)).tolist()))
        axes = randomised_svd(spark, rows, len(self.vocabulary), min(max(AXES, -(-len(rows) // PASSAGES_PER_AXIS)), len(rows)))
        self.words = (axes * idf[:, None]).astype(np.float32)
        latent = np.zeros((len(rows), axes.shape[1]), np.float32)
        for r, (i, a, b) in enumerate(self.cut):
            at, n = np.unique([self.vocabulary[w] for w in items[i][1][a:b]], return_counts=True)
            latent[r] = n @ self.words[at]
        self.squared = np.maximum((latent**2).sum(1), 1e-9)
        self.unit = latent / np.sqrt(self.squared)[:, None]


def _searched(index, min_cover: float, min_match: float, min_paraphrase: float, paraphrase_cosine: float):
    def run(batches):
        one: Index = index.value
        known, vectors, unit, length = one.vocabulary, one.words, one.unit, np.sqrt(one.squared)
        words_of = [[known[w] for w in one.items[i][1][a:b]] for i, a, b in one.cut]
        ends = [[known[w] for w in words[-ANSWER:]] for _, words in one.items]

        def judged(ids: np.ndarray, near: list[tuple[int, int]]) -> dict[int, tuple]:
            """The best span of each item among the candidates (window, passage) of one document."""
            best: dict[int, tuple] = {}
            for window, p in near:
                item, start, _end = one.cut[p]
                low, high = max(0, (window - 1) * WINDOW_STEP), (window + 3) * WINDOW_STEP
                here, size = ids[low:high].tolist(), len(words_of[p])
                at_most = common_subsequence(words_of[p], here) / size  # in a longer span, so no span has more
                if at_most < min_paraphrase or (item in best and best[item][0] >= at_most):
                    continue
                width = -(-3 * size // 2)
                found, at = closest_span(words_of[p], here, width)
                share, at = found / size, low + at
                if share < min_paraphrase or (item in best and best[item][0] >= share):
                    continue
                span = ids[at : at + width]
                state = vectors[span[span >= 0]].sum(0)
                cosine = float(state @ unit[p] / max(float(np.sqrt((state**2).sum())), 1e-9))
                rest = ids[at : at - (-3 * (len(one.items[item][1]) - start) // 2)].tolist()
                answer = closest_span(ends[item], rest, ANSWER_SPAN)[0] / len(ends[item])
                if share >= min_match or (answer >= 0.8 and cosine >= paraphrase_cosine):
                    best[item] = (share, cosine, answer, low)
            return best

        def answers(docs: list[tuple[int, np.ndarray]]):
            """Look up the documents (id, word ids) together."""
            steps = [-(-len(ids) // WINDOW_STEP) for _, ids in docs]
            first = np.cumsum([0, *steps])
            every = np.concatenate([ids for _, ids in docs])
            block = np.concatenate([np.arange(len(ids)) // WINDOW_STEP + f for (_, ids), f in zip(docs, first, strict=False)])
            has = np.flatnonzero(every >= 0)
            sums = np.zeros((first[-1] + 1, vectors.shape[1]), np.float32)
            if len(has):
                at = block[has]
                starts = np.flatnonzero(np.diff(at, prepend=-1))
                sums[at[starts]] = np.add.reduceat(vectors[every[has]], starts, axis=0)
            whole = sums[:-1].copy()
            inner = np.ones(first[-1], bool)
            inner[first[1:] - 1] = False  # a document's last step has none after it
            whole[inner] += sums[1:][inner]
            dots = whole @ unit.T
            near = dots >= min_cover * length
            window, passage = np.nonzero(near)
            owner = np.searchsorted(first, window, side="right") - 1
            for d in np.unique(owner):
                mine = owner == d
                cases = [(int(w - first[d]), int(p)) for w, p in zip(window[mine], passage[mine], strict=True)]
                for item, (share, cosine, answer, low) in judged(docs[d][1], cases).items():
                    yield docs[d][0], one.items[item][0], share, cosine, answer, low

        names = ["doc_id", "item_id", "match", "cosine", "answer", "near_word"]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        for batch in batches:
            held, count, out = [], 0, []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = tokens(text)
                if words:
                    held.append((doc, np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))))
                    count += len(words)
                if count >= _TOKENS:
                    out += answers(held)
                    held, count = [], 0
            if held:
                out += answers(held)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


_FOUND = "doc_id long, item_id long, match double, cosine double, answer double, near_word long"


def contaminated(
    docs: DataFrame, benchmark: DataFrame, min_cover: float = 0.35, min_match: float = 0.8,
    min_paraphrase: float = 0.6, paraphrase_cosine: float = 0.6,
) -> DataFrame:
    """One row per document and benchmark item that it holds.

    doc_id, item_id, match (longest common subsequence as a share of the item's passage, in
    a span of 1.5 times its length), cosine (of span and passage in latent space), answer
    (how much of the item's last five words follow in order within eight), near_word (where
    the searched window begins).

    A window is a candidate for a passage if it holds ``min_cover`` of the passage's weight,
    whatever else stands in it. A candidate counts with ``min_match``, or with
    ``min_paraphrase``, its answer (0.8 of it) and ``paraphrase_cosine``.

    Null or empty texts, on either side, hold nothing; items with a null id are left out;
    a null doc_id is reported as null; repeated rows are reported each. Empty tables give
    an empty result. Only doc_id, text and item_id are read.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    for items in blocks(benchmark):
        index = spark.sparkContext.broadcast(Index(spark, items, docs))  # bounded by the block
        found = rows.mapInArrow(_searched(index, min_cover, min_match, min_paraphrase, paraphrase_cosine), _FOUND)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], _FOUND) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, in their own columns.

    Leaks are told by the text, so rows with a null or repeated doc_id are judged each by its own.
    """
    key = F.xxhash64(text_of())
    leaks = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, key == leaks["_leak"], "left_anti")
