"""Operator 7: the model itself, and that it learns from every training text."""

import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tenure.llm import attention as a
from tenure.llm import language_model as m
from tenure.llm.common import written


def _pairs(seed, ids):
    """Shares of pairs from words of one to four random ids."""
    rng, found = np.random.default_rng(seed), collections.Counter()
    for _ in range(400):
        word = [-1, *rng.integers(0, ids, rng.integers(1, 5)).tolist(), -1]
        found.update(zip(word, word[1:], strict=False))
    before, after = (np.array(x) for x in zip(*found, strict=True))
    return a.pair_shares(before, after, np.array(list(found.values()), float))


def test_pair_shares_leave_room_for_the_unseen():
    before, after = np.array([-1, 0, 0, 1, -1, 2]), np.array([0, 1, -1, -1, 2, -1])
    shares = a.pair_shares(before, after, np.array([10.0, 4, 6, 4, 5, 5]))
    first = np.array([10, 0, 5]) / 15
    assert np.allclose(shares[0, :3], ([0, 4 - 0.75, 0] + 6 * first) / 10)
    assert np.allclose(shares[1, :3], first) and np.allclose(shares[2, :3], first)
    assert not shares[a.OWN].any() and not shares[:, a.OWN].any()
    assert (_pairs(1, 60).sum(1) < 1 + 1e-6).all()
    nothing = np.array([], int)
    assert not a.pair_shares(nothing, nothing, np.array([])).any()


def test_gradients():
    rng, pairs = np.random.default_rng(0), _pairs(2, 300).astype(float)
    p, uni = {n: x.astype(float) for n, x in a.started().items()}, a.frequencies(1000 / np.arange(1, 300), 4000)
    x, y = rng.integers(0, 300, (4, a.WINDOW)), rng.integers(-1, 400, (4, a.SCORED))
    x[0, :5] = -1
    _, g = a.gradients(p, x, y, uni, pairs, pairs.sum(1))
    for n in a.SHAPES:
        i = np.unravel_index(np.abs(g[n]).argmax(), g[n].shape)
        moved = []
        for step in (1e-5, -1e-5):
            q = {k: v.copy() for k, v in p.items()}
            q[n][i] += step
            moved.append(a.gradients(q, x, y, uni, pairs, pairs.sum(1))[0])
        assert abs((moved[0] - moved[1]) / 2e-5 - g[n][i]) < 2e-5 + 0.01 * abs(g[n][i])


def test_probabilities_sum_to_one():
    counts = np.array([50.0, 30, 20, 10])
    scorer = a.Scorer(a.started(), counts, 5, _pairs(3, 4))  # one id of the five was never seen
    whole = sum(np.exp(scorer.score([np.array([2, z])], 0)[0]) for z in range(5))
    assert abs(whole / np.exp(scorer.score([np.array([2])], 0)[0]) - 1) < 1e-3


def _plain(p, counts, vocabulary, pairs, doc, end):
    """Log probability of a document, place by place."""
    uni, read, total = a.frequencies(counts, vocabulary), [end, *doc[:-1]], 0.0
    w = p["w"][: len(uni) - 1] * np.sqrt(uni[:-1, None])
    for t, y in enumerate(doc):
        first = max(0, t // a.SCORED * a.SCORED - a.BACK)
        e = p["e"][read[first : t + 1]]
        s = (e @ p["k"]) @ (e[-1] @ p["q"]) / np.sqrt(a.WIDTH) + p["d"][: len(e)][::-1]
        pre = np.exp(s) / np.exp(s).sum() @ (e @ p["v"]) + e[-1] @ p["r"]
        g = np.append(pre / (1 + np.abs(pre)), 1)
        weights = uni[:-1] * 0 + (w @ g) ** 2 + np.exp(p["a"][0]) * uni[:-1]
        model = weights[y] / (((w @ g) ** 2).sum() + np.exp(p["a"][0]))
        gate = 1 / (1 + np.exp(-p["gate"][read[t]]))
        total += np.log(gate * pairs[read[t], y] + (1 - gate * pairs[read[t]].sum()) * model)
    return total


def test_scores_equal_a_plain_forward_pass():
    rng, pairs, counts = np.random.default_rng(5), _pairs(4, 59), 100 / np.arange(1, 60)
    worker = a.Trainer(a.started(), counts, 60, pairs)
    for _ in range(5):
        worker.step(rng.integers(-1, 59, (64, a.WINDOW)), rng.integers(0, 59, (64, a.SCORED)))
    docs = [rng.integers(0, 59, n) for n in (1, a.SCORED - 1, a.SCORED, a.SCORED + 1, 5 * a.SCORED + 3)]
    scorer = a.Scorer(worker.p, counts, 60, pairs)
    assert np.allclose(scorer.score(docs, 0), [_plain(worker.p, counts, 60, pairs, d.tolist(), 0) for d in docs], rtol=1e-4)
    changed = docs[-1].copy()
    changed[-1] = (changed[-1] + 1) % 59  # the last place changes nothing before it
    assert np.isclose(scorer.score([docs[-1][:-1]], 0)[0], scorer.score([changed[:-1]], 0)[0])


def test_every_text_reaches_the_model(spark):
    ranks = m.vocabulary()
    start = a.packed(a.started())
    rows = spark.createDataFrame([(i, f"red green blue number {i} red green") for i in range(3)], "doc_id long, text string")
    cut, counts, pairs = m.subword_tables(m.word_counts(rows), ranks)
    for i in range(3):
        one = rows.filter(F.col("doc_id") == i)
        assert not np.array_equal(m.trained(one, cut, counts, pairs, 8, rounds=1), start)


def test_tables_come_from_all_words(spark):
    ranks = m.vocabulary()
    texts = ["unbelievable red red", "red unbelievably x", ""]
    words = m.word_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    cut, counts, pairs = m.subword_tables(words, ranks)
    found, before, after, n = collections.Counter(), [], [], []
    for t in texts:
        for w in [*t.encode().split(), b"\n"]:
            found.update(cut.places(w))
            ids = cut.places(w)
            for x, y in zip([-1, *ids], [*ids, -1], strict=True):
                before.append(x), after.append(y), n.append(1.0)
    assert counts.tolist() == [found[r] for r in range(len(counts))]
    merged = collections.Counter(zip(before, after, strict=True))
    want = a.pair_shares(*(np.array(x) for x in zip(*merged, strict=True)), np.array(list(merged.values()), float))
    assert np.allclose(pairs, want)


def test_training_betters_held_out_scores(spark):
    ranks, rng = m.vocabulary(), np.random.default_rng(1)
    topics = [["iron", "steel", "forge", "hammer"], ["river", "boat", "harbor", "sail"], ["bread", "flour", "oven", "yeast"]]
    texts = [" ".join(rng.choice(topics[i % 3], 60)) for i in range(700)]
    rows = spark.createDataFrame([(t,) for t in texts[:600]], "text string")
    words = m.word_counts(rows)
    cut, counts, pairs = m.subword_tables(words, ranks)
    learned = a.unpacked(m.trained(rows, cut, counts, pairs, 36_600))
    held = m._sequences(cut, texts[600:], {})
    c = {r["word"]: r["c"] for r in words.collect()}
    base = sum(np.log((c[w] + 1) / (36_600 + len(c) + 1)) for t in texts[600:] for w in [*t.split(), m.END])
    assert a.Scorer(learned, counts, cut.size, pairs).score(held, cut.places(b"\n")[0]).sum() > 0.9 * base  # some 16 steps


def test_chunks_hold_every_text_whole():
    cut = m.Subwords(m.vocabulary(), [0])
    batches = [pa.RecordBatch.from_pydict({"text": [f"a b {i}" for i in range(7)]}), pa.RecordBatch.from_pydict({"text": [None]})]
    sizes = [[len(x) for x in c] for c in m._chunks(cut, batches, most=9)]
    assert len(sizes) > 1 and [n for c in sizes for n in c] == [len(m._sequences(cut, [t], {})[0]) for t in [*(f"a b {i}" for i in range(7)), None]]


def test_texts_are_cut_once(spark):
    texts = ["Red green  BLUE\x0b", None, "unbelievable \x00 é ü\x1f red", "", " \n\t", *(f"red number {i} green" for i in range(40))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    before = written(spark)
    m.score(rows).collect()
    made = spark.read.parquet(*[p for p in written(spark)[len(before) :] if "/encoded-" in p])
    train = rows.filter(~m.held_out())
    words = m.word_counts(train)
    cut, counts, pairs = m.subword_tables(words, m.vocabulary())
    got = {r["doc_id"]: np.frombuffer(r["ids"], cut.kind).tolist() for r in made.collect()}
    assert got == {i: x.tolist() for i, x in enumerate(m._sequences(cut, texts, {}))}
    n = words.agg(F.sum("c")).first()[0]
    learned = m._learned(made.filter(~F.col("held_out")).select("ids"), cut, counts, pairs, n)
    assert np.array_equal(learned, m.trained(train, cut, counts, pairs, n))


def test_words_and_pieces():
    texts = [" a  B ", "", "   ", "x\x1cy z\x0bq\x00 É k\x85 K \x1f", "\n\t\r\x0c", "one TWO"]
    found, sizes = m._words(pa.array(texts))
    want = [t.encode().lower().split() for t in texts]
    assert list(m._bytes(found)) == [w for ws in want for w in ws] and sizes.tolist() == [len(ws) for ws in want]
    assert list(m._pieces(pa.array(["aaaaaaaaaa", "b", "c", "dddd"]), 4)) == [(0, 1), (1, 2), (3, 1)]
    assert list(m._pieces(pa.array([], pa.string()), 4)) == []


def test_blocks_change_no_gradient(monkeypatch):
    rng, pairs = np.random.default_rng(3), _pairs(2, 300).astype(float)
    p, uni = {n: x.astype(float) for n, x in a.started().items()}, a.frequencies(1000 / np.arange(1, 300), 4000)
    x, y, found, space = rng.integers(-1, 300, (11, a.WINDOW)), rng.integers(-1, 400, (11, a.SCORED)), [], {}
    for block in (64, 4, 3):
        monkeypatch.setattr(a, "_BLOCK", block)
        found.append(a.gradients(p, x, y, uni, pairs, pairs.sum(1), space))
    for loss, g in found[1:]:
        assert np.isclose(loss, found[0][0]) and all(np.allclose(g[n], found[0][1][n]) for n in a.SHAPES)


def test_high_scores_stay_finite():
    p = a.started()
    p["q"] *= 1000
    q, k = a._tables(p)[:2]
    assert not a._low(q, k, a._distance(p)) and a._low(*a._tables(a.started())[:2], a._distance(p))
    x, pairs = np.arange(2 * a.WINDOW).reshape(2, -1) % 50, _pairs(4, 59)
    loss, g = a.gradients(p, x, x[:, a.BACK :], a.frequencies(100 / np.arange(1, 60), 60).astype(np.float32), pairs, pairs.sum(1))
    assert np.isfinite(loss) and all(np.isfinite(v).all() for v in g.values())
