"""Ranked search, hard negatives and substring dedup against brute force, hot groups and odd rows among them."""

import collections
import math
import random
import re

import numpy as np
import pytest

from tenure.llm import hard_negatives, lexical, repeats

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, doc string, text_key string, n string, terms string, prefix string, low string"
VECTORS = "vec_id long, embedding array<double>, label int, vec string, key string, part string, chunk string, pivot string"


def _docs(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, *"abcdef") for i, t in rows], DOCS).repartition(parts)


def _lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def _texts(seed, n):
    rng = random.Random(seed)
    words = [f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(5_000)]
    out = [" ".join(rng.choices(words, k=rng.choice((1, 5, 30, 200)))) for _ in range(n)]
    return out + [out[0]] * (n // 3)  # a third are copies


def _ranked(docs, items, top=10):
    ws = [(i, TERM.findall(_lower(t))) for i, t in docs]
    ws = [(i, collections.Counter(w), len(w)) for i, w in ws if w]
    n, total = len(ws), sum(x[2] for x in ws)
    df = collections.Counter(t for _, c, _ in ws for t in c)
    asked = collections.defaultdict(collections.Counter)
    for item, text in items:
        asked[item].update(TERM.findall(_lower(text)))
    out = set()
    for item, terms in asked.items():
        scores = []
        for i, tf, size in ws:
            m = 25 + (75 * size * n) // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, k in terms.items() if t in tf)
            if s > 0:
                scores.append((-s, -1 if i is None else i, i))
        out |= {(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:top])}
    return out


@pytest.mark.parametrize(("block", "tree"), [(500_000, 5_000), (40, 50)])
def test_search_equals_brute_force_in_any_blocks_and_trees(spark, block, tree):
    docs = list(enumerate(_texts(1, 240)))
    docs += [(900, None), (901, ""), (902, "?! --"), (None, docs[3][1]), (903, "T1 t2 É1 漢字 t1"), (904, "x" * 300 + " t7 ends")]
    items = [(k, " ".join(f"t{(7 * k + j) % 60}" for j in range(1 + k % 9))) for k in range(25)]
    items += [(30, None), (31, "nothing here holds that"), (32, "É1 t2 t2 t2"), (None, "t1 t5"), (33, "x" * 300), (32, "t9")]
    got = lexical.search(_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_terms=block, tree_docs=tree)
    assert {tuple(r) for r in got.collect()} == _ranked(docs, items)


def test_search_skips_subtrees():
    """The bounds keep a search away from most leaves, and lose nothing by it."""
    rng = np.random.default_rng(3)
    docs, ends, terms, tfs = np.arange(2_000), [0], [], []
    for i in range(2_000):
        own = np.unique(np.concatenate([rng.integers(0, 20, 8), [20 + i // 40, 80 + i % 7]]))
        terms.append(own)
        tfs.append(rng.integers(1, 4, len(own)))
        ends.append(ends[-1] + len(own))
    tree = lexical.Tree(docs, rng.integers(30, 200, 2_000), np.array(ends), np.concatenate(terms).astype(np.int32), np.concatenate(tfs), leaf=16)
    asked, weight = np.array([3, 33, 82]), np.array([50, 4_000, 900])
    opened = []
    tree._scores = lambda *a, plain=tree._scores: opened.append(a[2:]) or plain(*a)
    found = tree.best(asked, weight, 10, [])
    leaves = int((tree.children == 0).sum())
    every = np.concatenate([lexical.Tree._scores(tree, asked, weight, a, b) for a, b in sorted({(0, 2_000)})])
    best = sorted((-int(s), int(d)) for s, d in zip(every, tree.docs, strict=True) if s > 0)[:10]
    assert found == best and len(opened) < leaves * 0.7


def test_search_of_empty_tables(spark):
    none = _docs(spark, [])
    items = spark.createDataFrame([(1, "t1")], "item_id long, text string")
    assert lexical.search(none, items).collect() == []
    assert lexical.search(_docs(spark, [(1, "t1")]), items.filter("1 = 0")).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(_docs(spark, [(1, "t1")]), items).count() == 1


def _mined(rows):
    seen = {(v, None if y is None else (y + 1) % 10 if v is not None and v % 7 == 0 else y, tuple(x)) for v, x, y in rows if x is not None and y is not None and all(c is not None and math.isfinite(c) for c in x)}
    data = [(v, y, np.floor(256 * np.array(x)).astype(int)) for v, y, x in seen]
    order = lambda s, v: (-s, -1 if v is None else v)
    out = []
    for a, y, q in data:
        if a is None or a % 100:
            continue
        dot = [(int((q[: len(x)] * x[: len(q)]).sum()), v, z) for v, z, x in data]
        for ps, p, _ in sorted((d for d in dot if d[2] == y and d[1] != a), key=lambda d: order(*d[:2]))[:5]:
            window = sorted((d for d in dot if d[2] != y and 30 * ps <= 100 * d[0] <= 90 * ps), key=lambda d: order(*d[:2]))[:10]
            out += [(a, p, r + 1, v, ps, s) for r, (s, v, _) in enumerate(window)]
    return sorted(out, key=str)


def _vector_rows(seed, n, dims=8, centres=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    x = middle[rng.integers(0, centres, n)] + 0.4 * rng.normal(size=(n, dims))
    return [(int(i), [float(c) for c in v], int(y)) for i, (v, y) in enumerate(zip(x, rng.integers(0, 10, n), strict=True))]


@pytest.mark.parametrize(("pivots", "chunk", "block"), [(256, 8192, 256), (3, 60, 2)])
def test_negatives_equal_brute_force_in_any_chunks(spark, pivots, chunk, block):
    rows = _vector_rows(5, 700)
    rows += [(1_000 + i, rows[0][1], i % 3) for i in range(150)]  # one vector in many rows, with anchors among them
    rows += [(2_000, None, 1), (2_001, [float("nan")] * 8, 1), (2_002, [1.0, None] * 4, 2), (2_003, [math.inf] * 8, 2), (2_004, rows[5][1], None)]
    rows += [(None, rows[9][1], 3), rows[200], (3_000, [], 4), (3_100, [0.5, -0.25], 5)]
    df = spark.createDataFrame([(*r, *"abcde") for r in rows], VECTORS).repartition(4)
    got = hard_negatives.mine(df, pivots=pivots, chunk=chunk, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == _mined(rows)


def test_negatives_of_an_empty_table(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).collect() == []


def test_cover_tree_covers_and_separates():
    x = np.array([r[1] for r in _vector_rows(8, 900)] + [[0.25] * 8] * 100)
    tree = hard_negatives.CoverTree(x, leaf=8)
    y = np.hstack([x, np.sqrt(np.maximum(0, tree.norm2 - (x**2).sum(axis=1)))[:, None]])
    assert sorted(tree.order) == list(range(len(x)))
    for node, (c, r, a, b) in enumerate(zip(tree.center, tree.radius, tree.low, tree.high, strict=True)):
        assert (np.sqrt(((y[tree.order[a:b]] - y[c]) ** 2).sum(axis=1)) <= r + 1e-9).all()
        below = range(tree.child[node], tree.child[node] + tree.children[node])
        assert not tree.children[node] or sum(tree.high[k] - tree.low[k] for k in below) == b - a


def _cut(rows, size=20):
    docs = sorted({(-1 if i is None else i, t or "") for i, t in rows})
    seen, gone = set(), collections.defaultdict(set)
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        for s in range(len(w) - size + 1):
            g = tuple(w[s : s + size])
            if g in seen:
                gone[i, t].update(range(s, s + size))
            seen.add(g)
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        left = [x for k, x in enumerate(w) if k not in gone[-1 if i is None else i, t or ""]]
        out.append((i, len(w), len(w) - len(left), " ".join(left)))
    return sorted(out, key=str)


def _passages(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common, line, text = fresh(60), fresh(9), fresh(150)
    rows = []
    for i in range(120):
        w = fresh(rng.choice((5, 25, 80)))
        if i % 3 == 0:
            w = fresh(3) + line + w  # too short to be a repeat, but a prefix of many places
        if i % 4 == 0:
            a = rng.randrange(0, 30)
            w += common[a : a + rng.choice((19, 20, 21, 30))] + fresh(7)
        if i % 5 == 0:
            near = list(text)
            near[rng.randrange(len(near))] = "other"
            w = near
        if i % 7 == 0:
            w = w + ["la"] * rng.choice((19, 20, 45))
        rows.append((i, rng.choice((" ", "\n", "\t ")).join(w)))
    rows += [(500 + i, " ".join(text)) for i in range(60)]
    rows += [(700, None), (701, ""), (702, " \n"), (None, " ".join(text)), (703, "é 漢字 \x00 " * 30), (704, "x" * 70_000 + " " + " ".join(common))]
    return rows


@pytest.mark.parametrize("group", [20_000, 4])
def test_repeats_equal_brute_force_with_hot_prefixes(spark, group):
    rows = _passages(11)
    got = repeats.removed(_docs(spark, rows, 7), group=group, salts=3).select("doc_id", "n_words", "n_removed", "kept_text")
    assert sorted(map(tuple, got.collect()), key=str) == _cut(rows)


def test_repeated_rows_are_one_document(spark):
    """Its windows repeat nothing; another document with them loses them."""
    text = " ".join(f"w{i}" for i in range(40))
    got = repeats.removed(_docs(spark, [(1, text), (1, text), (2, "a " + text)], 3)).select("doc_id", "n_removed", "spans").collect()
    assert sorted(got) == [(1, 0, []), (1, 0, []), (2, 40, [[1, 41]])]
    assert repeats.removed(_docs(spark, [])).collect() == []


@pytest.mark.parametrize(("size", "gram"), [(3, 2), (6, 3), (5, 8)])
def test_other_window_sizes(spark, size, gram):
    rng = random.Random(size)
    rows = [(i, " ".join(rng.choices("abcd", k=rng.randrange(30)))) for i in range(60)]
    got = repeats.removed(_docs(spark, rows), size, gram=gram).select("doc_id", "n_words", "n_removed", "kept_text")
    assert sorted(map(tuple, got.collect()), key=str) == _cut(rows, size)


def test_long_texts_are_hashed_in_pieces():
    """Equal words have equal hashes wherever pieces and segments are cut."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(500)}" for _ in range(300_000)] + ["y" * 70_000, "end"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, hashes = repeats.word_hashes(data, np.array([0]))
    assert len(starts) == len(words) and len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))


def test_deep_nodes():
    rows = np.array([[1, 2, 3], [9, 9, 9], [1, 2, 3], [1, 2, 4], [1, 2, 3]], np.uint64)
    order, node = repeats.deep_nodes(rows, 3)
    assert order.tolist() == [0, 2, 4, 3, 1] and node.tolist()[:3] == [0, 0, 0] and node.tolist()[3:] == [-1, -1]
    order, node = repeats.deep_nodes(rows, 2)
    assert node.tolist() == [0, 0, 0, 0, -1]
