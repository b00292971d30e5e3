"""Groups of near copies whose links do not go through their leader, against brute force."""

import random

import pytest

from tenure.llm import near_dedup


def _components(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {" ".join(w[k : k + size]) for k in range(len(w) - size + 1)} or {t}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def _hub(seed, n, words, inserts):
    """Copies of one text, each with one of a few passages put in and some words changed: the passages join members, not the text."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    passages = [[f"p{k}x{i}" for i in range(inserts)] for k in range(5)]
    out = {}
    for i in range(n):
        w = list(base)
        if i % 4:
            at = words // 4 * (i % 4)
            w[at:at] = passages[i % 5]
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        if i % 9 == 0:
            w = w[: words - rng.randrange(words // 5)]
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize(("seed", "words", "inserts", "percent"), [(1, 100, 18, 85)])
def test_links_beside_the_leader_are_all_found(spark, seed, words, inserts, percent):
    texts = _hub(seed, 150, words, inserts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(df, 3, percent, bands=29, rows=4).collect()}
    assert got == _components(texts, 3, percent)
    assert len(set(got.values())) > 1


def test_copies_led_by_a_copy_cost_their_number(spark, monkeypatch):
    """Edited copies of a text that is not there: whichever leads them lacks something that all others share."""
    rng = random.Random(5)
    base, n = [f"b{i}" for i in range(150)], 200
    texts = {}
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    compared, verified = [], near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *a, **k: compared.append(pairs.count()) or verified(pairs, *a, **k))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(df, 5, 80).collect()}
    assert got == _components(texts, 5, 80)
    assert 1 < len(set(got.values())) < n
    assert sum(compared) < 20 * n


def test_rows_of_one_text_are_compared_once(spark, monkeypatch):
    """Two texts that are alike, each on many rows of one id, as the pipeline's text hashes are: one pair, not rows times rows."""
    base = [f"b{i}" for i in range(60)]
    texts = {1: " ".join(base), 2: " ".join([*base[:50], *(f"e{i}" for i in range(10))]), 3: " ".join([*base, "end"])}
    compared, verified = [], near_dedup._verified

    def counted(*a, **k):
        found = verified(*a, **k)
        compared.append(found.count())
        return found

    monkeypatch.setattr(near_dedup, "_verified", counted)
    df = spark.createDataFrame([row for row in texts.items() for _ in range(20)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(df, 5, 80).collect()}
    assert got == _components(texts, 5, 80)
    assert sum(compared) <= 3


def test_a_passage_that_many_share_lists_few_pairs(spark, monkeypatch):
    """Near copies and other texts with one passage: it joins all of them, but what is rare in them decides."""
    rng = random.Random(8)
    base, passage, n = [f"b{i}" for i in range(80)], [f"p{i}" for i in range(30)], 150
    texts = {}
    for i in range(n):
        w = list(base) if i % 2 else [f"o{i}x{k}" for k in range(rng.randrange(40, 120))]
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        at = rng.randrange(len(w))
        texts[i] = " ".join([*w[:at], *passage, *w[at:]])
    listed, pairs = [], near_dedup._listed
    monkeypatch.setattr(near_dedup, "_listed", lambda *a: listed.append(pairs(*a).count()) or pairs(*a))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(df, 5, 80).collect()}
    assert got == _components(texts, 5, 80)
    assert sum(listed) < 2 * n
