"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tenure.llm import compression, html_text, language_model, licenses, line_dedup, line_frequency, mixing, near_dedup, preferences, retrieval

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, label int, position double, h long, u long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t \n", None, None, 5), (4, LONG, "en", "a", len(LONG)),
    (5, "one two three four five six", "en", "b", 27), (5, "one two three four five six", "en", "b", 27),
    (6, "One two THREE four five six", "en", "a", 27), (None, "a row without an id", "en", "b", 19), (8, "é ü 漢字 \x00 end", "de", "c", 12),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "k", 1, 0.5, 9, 9) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, ""), (None, "x y z")], "item_id long, text string")


def _all(docs, labels, benchmark):
    turns = docs.select(F.col("doc_id").alias("pair_id"), F.lit("chosen").alias("side"), F.lit(1).alias("turn"), "lang", "text", F.col("source").alias("role"))
    return {
        "near": near_dedup.groups(docs), "html": html_text.extract(docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "key")),
        "quality": compression.score(docs, labels), "lines": line_dedup.dedup(docs, min_docs=2), "rules": line_frequency.judge(docs),
        "lm": language_model.score(docs), "mix": mixing.mix(docs), "pairs": preferences.format_pairs(turns), "licenses": licenses.scan(docs),
        "leaks": retrieval.contaminated(docs, benchmark),
    }


def test_odd_rows_give_one_result_each(docs, labels, benchmark):
    for name, df in _all(docs, labels, benchmark).items():
        rows = df.collect()
        if name == "leaks":
            assert sorted(str(r["doc_id"]) for r in rows) == ["5", "5", "6"] and {r["item_id"] for r in rows} == {1}
        elif name == "pairs":
            assert len(rows) == len({r[0] for r in ROWS})
        else:
            assert len(rows) == len(ROWS), name


def test_empty_tables(docs, labels, benchmark):
    none = docs.filter("1 = 0")
    for name, df in _all(none, labels.filter("1 = 0"), benchmark.filter("1 = 0")).items():
        assert df.collect() == [], name


def test_near_copies_and_ties(docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.groups(docs, size=3, percent=85).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 4, 5), (6, 4, 5)} <= got
    assert (4, 29_998, 4) in got and len(near_dedup.first_of_each(docs, 3, 85).filter("doc_id = 6").collect()) == 0


def test_lines_of_odd_texts(spark):
    rows = [(i, f"Same line \nown {i}\n same LINE") for i in range(12)] + [(20, None), (21, "\n"), (22, "same line")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup(df, min_docs=10).collect()}
    assert got[3] == (3, 2, "own 3") and got[20] == (1, 0, "") and got[21] == (2, 0, "\n") and got[22] == (1, 1, "")
    first = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup(df, min_docs=10, keep_first=True).collect()}
    assert first[0] == "Same line \nown 0" and first[1] == "own 1"


def test_line_stream_against_brute_force():
    import collections

    import numpy as np

    rng = np.random.default_rng(5)
    for trial in range(200):
        n, keep = int(rng.integers(1, 200)), bool(trial % 2)
        rows = sorted(zip(rng.integers(0, 6, n).tolist(), rng.integers(0, 12, n).tolist(), range(n), strict=True))
        arr = {c: np.array([r[i] for r in rows], t) for c, i, t in (("h", 0, np.int64), ("doc", 1, np.int64), ("pos", 2, np.int32))}
        arr |= {"g": np.zeros(n, np.int32), "text_key": np.zeros(n, np.int64)}
        cuts, state, out = sorted({0, n, *rng.integers(0, n + 1, 3).tolist()}), line_dedup._Stream(4, keep), []
        for a, b in zip(cuts, cuts[1:], strict=False):
            out += [r for rb in state.batch({c: v[a:b] for c, v in arr.items()}) for r in rb.to_pylist()]
        out += [r for rb in state.end() for r in rb.to_pylist()]
        total, first = collections.Counter(), {}
        for r in out:
            if r["kind"] == 2:
                total[r["h"]] += r["docs"]
                first[r["h"]] = min(first.get(r["h"], (99, 0)), (r["doc"], r["pos"]))
        got = {(r["doc"], r["pos"]) for r in out if r["kind"] == 0 or (r["kind"] == 1 and total[r["h"]] >= 4 and not (keep and (r["doc"], r["pos"]) == first[r["h"]]))}
        by = collections.defaultdict(list)
        for h, d, p in rows:
            by[h].append((d, p))
        want = {x for v in by.values() if len({d for d, _ in v}) >= 4 for x in sorted(v)[keep:]}
        assert got == want


def test_main_text():
    page = (
        "<html><head><title>T</title><script>var a = '<p>no</p>';</script></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>"
        "<div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; more</h1><p><b>one  two<br>three<p>x &lt; y</p><ul><li>a<li>b</ul>"
        "<div class=comments><p>nice</p></div></article><div id=sidebar>side</div><form>form</form><footer>foot</footer></body></html><p"
    )
    assert html_text.main_text(page) == "Head & more\none two three\nx < y\na\nb"
    assert html_text.main_text("<body><div><p>only text here</p></div><aside>no</aside>") == "only text here"
    assert html_text.main_text(None) == "" == html_text.main_text("<") and html_text.main_text("plain") == "plain"


def test_licenses(spark):
    rows = [
        (1, "It is under the MIT license. Under-the MIT license!"), (2, "Licensed under the Apache License, Version 2.0"), (3, "CC BY-NC 4.0"),
        (4, "Redistribution and use in source and also binary forms, with or without modification, are permitted"), (5, "under the license of mit"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["score"]) == (2, 2, 6, "mit", 1.0)
    assert got[2]["base_labels"] == "apache-2" == got[2]["labels"] and got[3]["labels"] == "cc-by-nc"
    assert got[4]["base_labels"] == "" and got[4]["labels"] == "bsd" and 0.6 <= got[4]["score"] < 1
    assert (got[5]["n_base"], got[5]["labels"], got[5]["first_word"]) == (0, "", None)


def test_preference_prefix_and_spans(spark):
    t = lambda p, s, i, r, x: (p, s, i, r, x)
    rows = [t(1, s, i, r, x) for s in ("chosen", "rejected") for i, r, x in ((0, "system", "be kind"), (1, "user", "hi <|end|>"))]
    rows += [t(1, "chosen", 2, "assistant", "hello"), t(1, "rejected", 2, "assistant", "no"), t(1, "rejected", 3, "user", "why"), t(2, "chosen", 0, None, None)]
    got = {r["pair_id"]: r for r in preferences.format_pairs(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")).collect()}
    one = got[1]
    assert one["n_prompt_turns"] == 2 and one["prompt"] == "<|system|>\nbe kind<|end|>\n<|user|>\nhi < |end|><|end|>\n"
    assert [one["chosen"][s["first"]:s["last"]] for s in one["chosen_spans"]] == ["hello<|end|>\n"]
    assert [one["rejected"][s["first"]:s["last"]] for s in one["rejected_spans"]] == ["no<|end|>\n"]
    assert got[2]["prompt"] == "" and got[2]["chosen"] == "<|unknown|>\n<|end|>\n" and got[2]["rejected"] == ""
