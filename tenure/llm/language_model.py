"""Language-model scores of whole texts (operator 7).

Words are counted over all training documents; the counts give the base score and, over
the subwords of the words, the frequencies and pairs that the attention model is mixed
with. One pass cuts every text into subword ids, which are written; training and scoring
read them. The model is trained where the data is: each task runs over its share of the
training windows from the same start, and the results are averaged; further rounds would
start there. Then one pass scores every text.
"""

from __future__ import annotations

import base64
import math
import uuid
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm import attention
from tenure.llm.common import stored, text_of

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Stands for the end of a text; no word holds white space.
END = "\n"
#: Words at least as frequent as one in so many tokens are sent to every task: by arithmetic there are no more of them than this.
HEAD_WORDS = 1_000_000
ROUNDS, RATE = 1, 0.1
#: Windows in a training step: few at first, so that little text makes steps too, then many, which cost less each.
FIRST_BATCH, MORE, BATCH = 64, 8, 512
#: Training texts of about so many words share a task, where files are smaller than that.
TASK_WORDS = 200_000
#: Subword ids that a training task holds at a time.
TRAIN_IDS = 400_000
#: Bytes of texts that a task counts, cuts into ids or scores at a time; one text at least.
COUNTED, CUT, SCORED = 32_000_000, 4_000_000, 500_000
_PART = 4096
_KEPT_WORDS = 1_200_000


def held_out(folds: int = 7, fold: int = 2):
    """Whether a document is kept from training: crc32 of its id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def _pieces(values: pa.Array, most: int):
    """(start, number) of runs of the values, of about ``most`` bytes together; a value is never cut."""
    ends, start = np.cumsum(np.asarray(pc.binary_length(values), np.int64)), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop - start
        start = stop


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after the other, A-Z in lower case, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found, sizes = parts.flatten(), np.asarray(pc.list_value_length(parts), np.int64)
    some = np.asarray(pc.binary_length(found)) > 0  # white space at an end of a text leaves an empty part there
    if not some.all():
        sizes = np.bincount(np.repeat(np.arange(len(texts)), sizes)[some], minlength=len(texts))
        found = found.filter(pa.array(some))
    return found, sizes


def _bytes(found: pa.Array) -> np.ndarray:
    """The strings as bytes objects."""
    return found.cast(pa.binary()).to_numpy(zero_copy_only=False)


def _counted(batches):
    for b in batches:
        texts = b.column("text")
        for start, n in _pieces(texts, COUNTED):
            found = _words(texts.slice(start, n))[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "c"])
        yield pa.RecordBatch.from_pydict({"word": [END], "c": [b.num_rows]}, pa.schema({"word": pa.string(), "c": pa.int64()}))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the documents; every text ends with END."""
    return docs.select(text_of().alias("text")).mapInArrow(_counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Subwords:
    """Ranks of the subword ids of a word; made in each task from the vocabulary's bytes."""

    def __init__(self, ranks: dict[bytes, int], by_count: list[int] | None = None):
        self.ranks, self.end, self.size = ranks, len(ranks), len(ranks) + 1
        self.rank = {i: r for r, i in enumerate(by_count)} if by_count is not None else None
        self.kind = np.uint16 if self.size < 2**16 else np.int32  # holds every place
        self._made = None

    def __getstate__(self):
        return {**self.__dict__, "_made": None}

    def ids(self, word: bytes) -> list[int]:
        if word == b"\n":
            return [self.end]
        if self._made is None:
            self._made = tiktoken.Encoding("subwords", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        return self._made._encode_single_piece(b" " + word)

    def places(self, word: bytes) -> list[int]:
        return [self.rank.get(i, len(self.rank)) for i in self.ids(word)]


def vocabulary(path: str = TOKENIZER) -> dict[bytes, int]:
    """Subword bytes to ids, from a public vocabulary file that the driver can read."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _pair_counts(subwords, most: int = 20_000):
    """Counts of neighbours (before, after) in words; -1 stands before a word's first subword and after its last."""

    def run(batches):
        cut: Subwords = subwords.value
        for b in batches:
            for start in range(0, b.num_rows, most):
                found = [cut.ids(w) for w in _bytes(b.column("word").slice(start, most))]
                sizes = np.array([len(ids) for ids in found], np.int64)
                flat = np.fromiter(chain.from_iterable(found), np.int64, sizes.sum())
                ends = np.cumsum(sizes + 1)  # each word's ids stand between marks
                marked = np.full(ends[-1] + 1, -1, np.int64)
                inner = np.ones(len(marked), bool)
                inner[0] = inner[ends] = False
                marked[inner] = flat
                pairs = (marked[:-1] + 1) * (cut.size + 1) + marked[1:] + 1
                counts = np.repeat(np.asarray(b.column("c").slice(start, most)), sizes + 1)
                pairs, place = np.unique(pairs, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pairs // (cut.size + 1) - 1, pa.int64()), pa.array(pairs % (cut.size + 1) - 1, pa.int64()),
                        pa.array(_sums(place, counts, len(pairs)), pa.int64()),
                    ],
                    names=["before", "after", "n"],
                )

    return run


def _sums(place: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers by place."""
    out = np.zeros(size, np.int64)
    np.add.at(out, place, counts)
    return out


def subword_tables(counts: DataFrame, ranks: dict[bytes, int]) -> tuple[Subwords, np.ndarray, np.ndarray]:
    """Subwords by rank, their counts and the shares of pairs among the first ranks, from word counts."""
    spark = counts.sparkSession
    plain = spark.sparkContext.broadcast(Subwords(ranks))
    pairs = stored(counts.mapInArrow(_pair_counts(plain), "before long, after long, n long").groupBy("before", "after").agg(F.sum("n").alias("n")), "pairs")
    found = pairs.filter("after >= 0").groupBy("after").agg(F.sum("n").alias("n")).collect()  # one per subword of the vocabulary
    order = sorted(found, key=lambda r: (-r["n"], r["after"]))
    cut = Subwords(ranks, [r["after"] for r in order] or [len(ranks)])
    own = spark.createDataFrame([(i, r) for i, r in [(-1, -1), *((x["after"], k) for k, x in enumerate(order[: attention.OWN]))]], "id long, rank int")
    ranked = pairs
    for end in ("before", "after"):
        named = F.broadcast(own.select(F.col("id").alias(end), F.col("rank").alias(f"{end}_rank")))  # OWN rows
        ranked = ranked.join(named, end, "left").withColumn(f"{end}_rank", F.coalesce(f"{end}_rank", F.lit(attention.OWN)))
    among = ranked.groupBy("before_rank", "after_rank").agg(F.sum("n").alias("n")).toArrow()  # OWN x OWN rows at most
    before, after, n = (among.column(c).to_numpy() for c in ("before_rank", "after_rank", "n"))
    return cut, np.array([r["n"] for r in order] or [0], float), attention.pair_shares(before, after, n.astype(float))


def _sequences(cut: Subwords, texts: list[str | None], known: dict[bytes, list[int]]) -> list[np.ndarray]:
    out = []
    for text in texts:
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
        for w in parts:
            if w not in known:
                if len(known) > 200_000:
                    known.clear()
                known[w] = cut.places(w)
        out.append(np.array([*chain.from_iterable(known.get(w) or cut.places(w) for w in parts), *cut.places(b"\n")], np.int32))
    return out


def _chunks(cut: Subwords, batches, most: int = TRAIN_IDS):
    """The texts, or the ids they were cut into, as lists of sequences of about ``most`` ids together; no text is left out."""
    known: dict[bytes, list[int]] = {}
    held, size = [], 0
    for b in batches:
        is_cut = "ids" in b.schema.names
        for value in b.column("ids" if is_cut else "text"):
            held += [np.frombuffer(value.as_buffer(), cut.kind)] if is_cut else _sequences(cut, [value.as_py()], known)
            size += len(held[-1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _trained(shared):
    """One task's training: all windows of its texts once, chunk by chunk in a random order."""

    def run(batches):
        _SEEN.clear()
        start, cut, counts, pairs, seed = shared.value
        worker = attention.Trainer(attention.unpacked(start), counts, cut.size, pairs, RATE)
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        steps, learned = np.arange(attention.WINDOW), 0
        for chunk in _chunks(cut, batches):
            inputs, targets, starts, _ = attention.windows(chunk, cut.places(b"\n")[0])
            order, at = rng.permutation(len(starts)), 0
            while at < len(order):
                most = min(BATCH, FIRST_BATCH + MORE * worker.steps)
                place = starts[order[at : at + most], None] + steps
                worker.step(inputs[place], targets[place[:, attention.BACK :]])
                at += most
            learned += len(starts)
        if not learned:
            return
        flat = attention.packed(worker.p).astype(np.float64) * learned
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(-(-len(flat) // _PART)), pa.int32()),
                pa.array([part] * -(-len(flat) // _PART), pa.int32()),
                pa.array([float(learned)] * -(-len(flat) // _PART), pa.float64()),
                pa.array([flat[i : i + _PART].tobytes() for i in range(0, len(flat), _PART)], pa.binary()),
            ],
            names=["slice", "part", "weight", "flat"],
        )

    return run


def _added(table: pa.Table) -> pa.Table:
    """Sum of the rows of a group, in the order of their tasks."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    flat = sum(np.frombuffer(r["flat"]) for r in rows)
    return pa.table({
        "slice": pa.array([rows[0]["slice"]], pa.int32()), "part": pa.array([rows[0]["part"]], pa.int32()),
        "weight": pa.array([sum(r["weight"] for r in rows)], pa.float64()), "flat": pa.array([flat.tobytes()], pa.binary()),
    })


_SLICES = "slice int, part int, weight double, flat binary"


def trained(docs: DataFrame, cut: Subwords, counts: np.ndarray, pairs: np.ndarray, n_words: int, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after ``rounds`` of training on all documents, so the work grows with the corpus."""
    return _learned(docs.select(text_of().alias("text")), cut, counts, pairs, n_words, rounds)


def _learned(texts: DataFrame, cut: Subwords, counts: np.ndarray, pairs: np.ndarray, n_words: int, rounds: int = ROUNDS) -> np.ndarray:
    """The same from rows of ``text``, or of ``ids`` as ``_encoded`` makes them."""
    spark = texts.sparkSession
    flat = attention.packed(attention.started())
    texts = texts.coalesce(max(1, n_words // TASK_WORDS))
    for seed in range(rounds):
        shared = spark.sparkContext.broadcast((flat, cut, counts, pairs, seed))
        # two levels, so that no group holds a row of every task
        some = texts.mapInArrow(_trained(shared), _SLICES).groupBy("slice", F.col("part") % 16).applyInArrow(lambda t: _added(t), _SLICES)
        got = some.groupBy("slice").applyInArrow(lambda t: _added(t), _SLICES).collect()  # one copy of the parameters
        if got:
            flat = np.concatenate([np.frombuffer(r["flat"]) / r["weight"] for r in sorted(got, key=lambda r: r["slice"])]).astype(np.float32)
        shared.unpersist()
    return flat


class _Seen(dict):
    """What is known of each word: a number under which its values lie in the arrays."""

    def __init__(self, head: dict[bytes, int], cut: Subwords):
        super().__init__()
        self.head, self.cut = head, cut
        self.reset()

    def reset(self):
        self.clear()
        self.logs, self.hashes = array("d"), array("q")
        self.first, self.many, self.places = array("q"), array("i"), array("i")

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.logs)
        c = self.head.get(word)
        self.logs.append(math.nan if c is None else math.log10(c + 1))
        h = xxhash.xxh64_intdigest(word, 42)
        self.hashes.append(h - 2**64 if h >= 2**63 else h)
        places = self.cut.places(word)
        self.first.append(len(self.places))
        self.many.append(len(places))
        self.places.extend(places)
        return number


#: What a process keeps between the tasks of a pass.
_SEEN: dict[str, _Seen] = {}
_MODEL: dict[str, attention.Scorer] = {}


def _encoded(shared, key: str):
    """Each text's sums over frequent words, its other words, and its subwords' places as bytes of ``Subwords.kind``."""

    def run(batches):
        if key not in _SEEN:
            cut, head = shared.value
            _SEEN.clear()  # the words seen stay for the next task of this process
            _SEEN[key] = _Seen(head, cut)
        seen, row = _SEEN[key], TaskContext.get().partitionId() << 40
        kind = np.dtype(seen.cut.kind)
        for b in batches:
            texts = b.column("text")
            for start, n in _pieces(texts, CUT):
                found, sizes = _words(texts.slice(start, n))
                if len(seen) > _KEPT_WORDS:
                    seen.reset()
                coded = found.dictionary_encode()
                numbers = np.fromiter(map(seen.__getitem__, _bytes(coded.dictionary)), np.int64, len(coded.dictionary))
                sizes = sizes + 1
                last = np.cumsum(sizes) - 1
                flat, is_word = np.full(last[-1] + 1, seen[b"\n"], np.int64), np.ones(last[-1] + 1, bool)
                is_word[last] = False
                flat[is_word] = numbers[np.asarray(coded.indices)]
                owner = np.repeat(np.arange(n), sizes)
                logs = np.frombuffer(seen.logs)[flat]
                rare = np.isnan(logs)
                base = np.bincount(owner, np.where(rare, 0, logs), n)
                frequent = np.bincount(owner[~rare], minlength=n)
                hashes = np.frombuffer(seen.hashes, np.int64)[flat[rare]]
                cuts = np.searchsorted(owner[rare], np.arange(n + 1))
                many = np.frombuffer(seen.many, np.int32)[flat].astype(np.int64)
                ends = np.cumsum(many)
                places = np.frombuffer(seen.places, np.int32)[np.arange(ends[-1]) + np.repeat(np.frombuffer(seen.first, np.int64)[flat] - ends + many, many)]
                bounds = np.append(0, ends[last]) * kind.itemsize
                ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(places.astype(kind))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n), pa.int64()),
                        b.column("doc_id").slice(start, n), b.column("held_out").slice(start, n),
                        pa.array(sizes, pa.int64()), pa.array(frequent, pa.int64()), pa.array(base, pa.float64()), ids,
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(hashes, pa.int64())),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_frequent", "frequent_log", "ids", "others"],
                )
                row += n

    return run


def _scored(shared, key: str):
    """Each text's probability by the model in place of its ids, which come last."""

    def run(batches):
        if key not in _MODEL:
            flat, cut, counts, pairs = shared.value
            _SEEN.clear()
            _MODEL.clear()  # one model at a time
            _MODEL[key] = attention.Scorer(attention.unpacked(flat), counts, cut.size, pairs)
        cut = shared.value[1]
        end = cut.places(b"\n")[0]
        for b in batches:
            ids = b.column("ids")
            for start, n in _pieces(ids, SCORED):
                docs = [np.frombuffer(x.as_buffer(), cut.kind) for x in ids.slice(start, n)]
                score = pa.array(_MODEL[key].score(docs, end) / math.log(10), pa.float64())
                some = b.slice(start, n)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], score], names=[*some.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, tokenizer: str = TOKENIZER, folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    Tokens are A-Z lower-cased words between ASCII white space and one end per text.
    base_score is the log10 probability by add-one word counts of the training documents,
    score that by the model, which reads the subwords of the same tokens. Words that are
    frequent (see HEAD_WORDS) are looked up in the task, all others in a join.

    A null or empty text is one end mark. Without training documents every count is 0 and
    the model is untrained. A null doc_id belongs to training. Repeated rows are scored
    each; an empty table gives an empty result. Only doc_id and text are read.
    """
    spark: SparkSession = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(folds, fold).alias("held_out"), text_of().alias("text"))
    train = rows.filter(~F.col("held_out"))
    counts = stored(word_counts(train), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()

    ranks = vocabulary(tokenizer)
    cut, subword_counts, pairs = subword_tables(counts, ranks)
    limit = max(1, -(-n // HEAD_WORDS))
    head = {r["word"].encode("utf-8", "surrogatepass"): r["c"] for r in counts.filter(F.col("c") >= limit).toLocalIterator()} if limit > 1 else {}
    kept = "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, frequent_log double"
    shared = context.broadcast((cut, head))
    encoded = stored(rows.mapInArrow(_encoded(shared, uuid.uuid4().hex), f"{kept}, ids binary, others array<long>"), "encoded")
    shared.unpersist()

    flat = _learned(encoded.filter(~F.col("held_out")).select("ids"), cut, subword_counts, pairs, n)
    shared = context.broadcast((flat, cut, subword_counts, pairs))
    scored = stored(encoded.drop("others").mapInArrow(_scored(shared, uuid.uuid4().hex), f"{kept}, score double"), "scored")
    shared.unpersist()
    others = encoded.select("row", F.explode("others").alias("h"))
    rare = counts.filter((F.col("c") < limit) | F.lit(limit == 1)).select(F.xxhash64("word").alias("h"), "c")
    sums = others.join(rare, "h").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("log"), F.count(F.lit(1)).alias("known"))
    zero = F.lit(0)
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_frequent") + F.coalesce("known", zero)).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("frequent_log") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        "score",
    )
