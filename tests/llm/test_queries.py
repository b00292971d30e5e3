"""Queries against their SQL, and against brute force where there is none, on the smallest tables."""

import collections
import math
import zlib

import duckdb
import pytest

import corpus_pipeline
from tenure.llm import queries, registry  # noqa: F401
from tenure.llm.retrieval import common_subsequence, tokens

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def sql(small):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def _texts(sql):
    return dict(sql.execute("SELECT doc_id, text FROM documents").fetchall())


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, small, sql, name):
    df = registry.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    asked = sql.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in asked.description]
    plain = lambda r: tuple(repr(round(r[c], 8) if isinstance(r[c], float) else r[c]) for c in cols)
    assert sorted(names) == cols
    assert sorted(plain(r.asDict()) for r in df.collect()) == sorted(plain(dict(zip(names, r, strict=True))) for r in asked.fetchall())


def test_base_scores(spark, small, sql):
    words = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in _texts(sql).items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    c = collections.Counter(w for i, ws in words.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in registry.QUERIES["op7_attention_scores"](spark, small).collect():
        ws = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0


def test_leaks_against_brute_force(spark, small, sql):
    items = {i: tokens(t) for i, t in sql.execute("SELECT item_id, text FROM benchmark").fetchall()}
    planted = {(d, i) for d, t in _texts(sql).items() for i, w in items.items() if b" ".join(w) in b" ".join(tokens(t))}
    found = {(r["doc_id"], r["item_id"]) for r in registry.QUERIES["op4_latent_decontamination"](spark, small).collect()}
    assert planted and planted <= found and len(found - planted) <= 1
    assert common_subsequence(list("abcde"), list("xaybzce")) == 4


def test_quality_on_held_out(spark, small, sql):
    label = dict(sql.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = registry.QUERIES["op3_compression_quality"](spark, small).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    good = [r["score"] for r in rows if label.get(r["doc_id"]) == 1]
    bad = [r["score"] for r in rows if label.get(r["doc_id"]) == 0]
    assert sum(g > b for g in good for b in bad) > 0.7 * len(good) * len(bad)


def test_licenses_against_brute_force(spark, small, sql):
    import re

    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in registry.QUERIES["op10_license_scan"](spark, small).collect():
        t = (_texts(sql)[r["doc_id"]] or "").translate({c: c + 32 for c in range(65, 91)})
        ws = word.findall(t)
        at = [(i, k) for k, p in phrases.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(ws), len(at), ",".join(sorted({k for _, k in at})))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))


def test_pages_keep_article_text(spark, small, sql):
    import html
    import re

    for r in registry.QUERIES["op2_main_text"](spark, small).collect():
        page = sql.execute("SELECT html FROM pages WHERE page_id = ?", [r["page_id"]]).fetchall()[0][0]
        inside = re.sub(r"<[^<>]*$", "", page.split("<article>")[1].split("</article>")[0].split("<footer")[0])
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_pipeline_by_stage(spark, small):
    """Each stage against its own rule: what it removes is gone from its result, and clean documents stay."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    out = corpus_pipeline.run(spark, small).collect()
    kept = {r["doc_id"] for r in out}
    assert kept and kept < before and len(kept) == len(out)
    assert [r["position"] for r in out] == sorted(r["position"] for r in out)
    from tenure.llm import near_dedup, retrieval

    left = spark.createDataFrame([(r["doc_id"], r["text"]) for r in out], "doc_id long, text string")
    assert all(r["doc_id"] == r["component_id"] for r in near_dedup.groups(left, 5, 80).collect())
    assert retrieval.contaminated(left, spark.read.parquet(f"{small}/benchmark.parquet")).count() == 0
