"""Quality classifier by compression (operator 3).

Two zstandard dictionaries are built, one from good and one from bad labelled text. A
text is compressed in blocks with either; what the bad dictionary costs more, as a share
of the text's size, is its evidence, and a monotone map fitted on other labelled texts
turns that into a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import text_of

DICTIONARY_BYTES = 112_640
BLOCK = 1024
LEVEL = 3


def held_out(folds: int = 5, fold: int = 0):
    """Whether a document is kept from training: crc32 of its id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class Classifier:
    """Dictionaries of both classes and the map from evidence to probability."""

    def __init__(self, good: list[str], bad: list[str], calibration: list[tuple[str, int]]):
        self.dictionaries = [self._trained(good), self._trained(bad)]
        self._made = None
        evidence = np.array([self.evidence(t) for t, _ in calibration] or [0.0])
        wanted = np.array([float(q) for _, q in calibration] or [0.5])
        self.at, self.score = _monotone(evidence, wanted)
        self._made = None

    @staticmethod
    def _trained(texts: list[str]) -> bytes:
        samples = [b for t in texts for b in _blocks(t.encode("utf-8", "surrogatepass"))]
        joined = b"".join(samples)
        if len(samples) > 20 and len(joined) > 4 * DICTIONARY_BYTES:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        return joined or b" "  # too little to choose from: all of it

    def _compressors(self):
        if self._made is None:
            self._made = []
            for raw in self.dictionaries:
                made = zstandard.ZstdCompressionDict(raw)
                made.precompute_compress(level=LEVEL)
                self._made.append(zstandard.ZstdCompressor(dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False))
        return self._made

    def evidence(self, text: str | None) -> float:
        """(size with the bad dictionary - size with the good one) / bytes, over all blocks of the text."""
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            return 0.0
        good, bad = self._compressors()
        return sum(len(bad.compress(b)) - len(good.compress(b)) for b in _blocks(data)) / len(data)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.interp([self.evidence(t) for t in texts], self.at, self.score)

    def __getstate__(self):
        return {**self.__dict__, "_made": None}


def _monotone(x: np.ndarray, y: np.ndarray, least: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps of y over x (pooled until none falls), as points for interpolation; each pools ``least`` texts or more."""
    order = np.argsort(x, kind="stable")
    x, y, pools = x[order], y[order], []
    for i in range(0, len(x), least):
        pools.append([x[i : i + least].mean(), y[i : i + least].mean(), len(x[i : i + least])])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            (xa, ya, na), (xb, yb, nb) = pools[-2:]
            pools[-2:] = [[(xa * na + xb * nb) / (na + nb), (ya * na + yb * nb) / (na + nb), na + nb]]
    points = np.array(pools)
    return points[:, 0], np.clip(points[:, 1], 0.001, 0.999)


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 600, calibration: int = 1500, folds: int = 5, fold: int = 0) -> Classifier:
    """A classifier from a bounded sample of the labelled documents that are not held out.

    The sample is the first ``per_class`` rows of either label for the dictionaries and
    the first ``calibration`` other rows, whatever their label, for the map, in the order
    of a hash of doc_id; larger inputs do not enlarge it. Only these rows of ``labels``
    are joined to ``docs``.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(
        "doc_id is not null and quality in (0, 1)"
    ).filter(~held_out(folds, fold)).dropDuplicates(["doc_id"])
    order = F.xxhash64("doc_id")
    mixed = rows.filter(F.pmod(order, F.lit(2)) == 0).orderBy(order).limit(calibration).withColumn("use", F.lit("map"))
    rest = rows.filter(F.pmod(order, F.lit(2)) == 1)
    chosen = mixed
    for q in (0, 1):
        chosen = chosen.unionAll(rest.filter(F.col("quality") == q).orderBy(order).limit(per_class).withColumn("use", F.lit("words")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    got = texts.orderBy("doc_id", "text").collect()  # bounded by the sample
    pick = lambda q: [r["text"] for r in got if r["use"] == "words" and r["quality"] == q]
    return Classifier(pick(1), pick(0), [(r["text"], r["quality"]) for r in got if r["use"] == "map"])


def _scored(model):
    def run(batches):
        made: Classifier = model.value
        for b in batches:
            scores = made.scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better) and predicted (1 if score >= ``limit``) of every document.

    Whole texts are scored and nothing but the text enters a score. A null or empty text
    has no evidence either way and gets the score of that; so does every text if there are
    no labels. A null doc_id is never held out; repeated rows are scored each; an empty
    table gives an empty result. Only doc_id, text and quality are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))  # two dictionaries and a map of fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    scored = rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= limit).cast("int"))
