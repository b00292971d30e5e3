"""The registered query of each operator, with SQL beside it where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.llm import (
    compression, hard_negatives, html_text, language_model, lexical, licenses, line_dedup, line_frequency, mixing, near_dedup, preferences, repeats, retrieval,
)
from tenure.llm.registry import query, table

_WS = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
  s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END)) AS g FROM w),
  n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
  links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
  c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
  SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)"""


@query("op1_superminhash_near_dedup", _OP1)
def _(spark, sf):
    found = near_dedup.groups(table(spark, sf, "documents"), size=3, percent=85, bands=29, rows=6)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@query("op2_main_text")
def _(spark, sf):
    return html_text.extract(table(spark, sf, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op3_compression_quality")
def _(spark, sf):
    return compression.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op4_latent_decontamination")
def _(spark, sf):
    return retrieval.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_OP5 = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
  k AS (SELECT *, {_LOW.format(f"trim(line, {_BLANKS})")} AS key FROM l),
  f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM f)) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM f)), '')) AS kept_sha256 FROM k GROUP BY doc_id"""


@query("op5_line_dedup", _OP5)
def _(spark, sf):
    done = line_dedup.dedup(table(spark, sf, "documents"), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_NORM = _LOW.format(f"trim(regexp_replace(line, '{_WS}+', ' ', 'g'))")
_OP6 = f"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
  g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
  r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY doc_id),
  l AS (SELECT doc_id, source, line, ('0x' || substr(md5({_NORM}), 1, 15))::BIGINT AS key FROM (SELECT doc_id, source, unnest(string_split(x, chr(10))) AS line FROM t)
    WHERE regexp_matches(line, '{_WORD}')),
  c AS (SELECT source, key, true AS common FROM l JOIN (SELECT doc_id, x FROM t) USING (doc_id) GROUP BY ALL HAVING count(DISTINCT x) >= 10),
  d AS (SELECT doc_id, sum(length(line)) AS line_chars, coalesce(sum(length(line)) FILTER (common), 0)::BIGINT AS gone, count(*) - count(DISTINCT line) AS dup
    FROM l LEFT JOIN c ON l.key = c.key AND l.source IS NOT DISTINCT FROM c.source GROUP BY doc_id),
  m AS (SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(x) - length(translate(x, '#*$%&|<>', '')) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(gone, 0) AS gone_chars, coalesce(line_chars, 0) AS line_chars
    FROM t LEFT JOIN r USING (doc_id) LEFT JOIN d USING (doc_id))
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (gone_chars = 0 OR line_chars - gone_chars >= 0.5 * line_chars) AS kept, gone_chars FROM m"""


@query("op6_line_frequency_rules", _OP6)
def _(spark, sf):
    return line_frequency.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "gone_chars"
    )


@query("op7_attention_scores")
def _(spark, sf):
    return language_model.score(table(spark, sf, "documents"))


_OP8 = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
  s AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
  w AS (SELECT *, [3, 1, 2][place % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
  o AS (SELECT *, cap / weight AS ratio, (1.5::DOUBLE * (SELECT sum(source_size) FROM w)::BIGINT
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
      / (sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM w),
  v AS (SELECT max(level) AS level FROM o WHERE level <= ratio AND level > 0),
  g AS (SELECT source, place, source_size, least(cap::DOUBLE, level * weight) AS target FROM w, v),
  p AS (SELECT doc_id, d.size, place, source_size, target, floor(target)::BIGINT AS quota,
      (sum(d.size) OVER (PARTITION BY place ORDER BY digest, doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
  q AS (SELECT *, greatest(0, least(size, quota - before)) + greatest(0, least(size, quota - source_size - before)) AS taken, before / quota AS u FROM p)
  SELECT doc_id, size, source_size, target, taken, CASE WHEN taken = 0 THEN NULL
    WHEN place % 3 = 0 THEN 0.0::DOUBLE + (sqrt(2.25::DOUBLE + -2.0::DOUBLE * (u - 0.0::DOUBLE)) - 1.5::DOUBLE) / -1.0::DOUBLE
    WHEN place % 3 = 1 THEN 0.0::DOUBLE + (u - 0.0::DOUBLE) / 1.0::DOUBLE
    WHEN u >= 0.25::DOUBLE THEN 0.5::DOUBLE + (sqrt(1.0::DOUBLE + 4.0::DOUBLE * (u - 0.25::DOUBLE)) - 1.0::DOUBLE) / 2.0::DOUBLE
    ELSE 0.0::DOUBLE + (sqrt(0.0::DOUBLE + 4.0::DOUBLE * (u - 0.0::DOUBLE)) - 0.0::DOUBLE) / 2.0::DOUBLE END AS position FROM q"""


@query("op8_curriculum_mix", _OP8)
def _(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


_SAFE = "replace({}, '<|', '< |')"
_RENDER = f"'<|' || {_SAFE.format('t.r')} || '|>' || chr(10) || {_SAFE.format('t.x')} || '<|end|>' || chr(10)"
_SIDE = "array_to_string([" + _RENDER + " FOR t IN {}], '')"
_OP9 = f"""WITH t AS (SELECT conv_id, {{'turn': turn, 'r': coalesce(role, 'unknown'), 'x': coalesce(text, '')}} AS t FROM conversations),
  v AS (SELECT conv_id, list_sort(list(t)) AS c FROM t GROUP BY conv_id),
  o AS (SELECT xor(conv_id, 1) AS conv_id, c[len(c)].x AS reply FROM v),
  p AS (SELECT v.conv_id AS pair_id, c, list_sort([CASE WHEN t.turn = c[len(c)].turn THEN {{'turn': t.turn, 'r': t.r, 'x': coalesce(reply, '')}} ELSE t END FOR t IN c]) AS r
    FROM v LEFT JOIN o ON v.conv_id = o.conv_id),
  n AS (SELECT *, least(len(c), len(r)) AS most FROM p),
  q AS (SELECT *, coalesce(list_min([i - 1 FOR i IN range(1, most + 1) IF c[i].r <> r[i].r OR c[i].x <> r[i].x]), most) AS k FROM n),
  z AS (SELECT pair_id, k, c[1:k] AS head, c[k + 1:] AS c, r[k + 1:] AS r FROM q)
  SELECT pair_id, k AS n_prompt_turns, len(c) AS n_chosen_turns, len(r) AS n_rejected_turns, {_SIDE.format("head")} AS prompt,
    {_SIDE.format("c")} AS chosen, {_SIDE.format("r")} AS rejected,
    coalesce(list_sum([length({_SAFE.format("t.x")}) + 8 FOR t IN c IF t.r = 'assistant']), 0)::BIGINT AS chosen_trained_chars,
    coalesce(list_sum([length({_SAFE.format("t.x")}) + 8 FOR t IN r IF t.r = 'assistant']), 0)::BIGINT AS rejected_trained_chars FROM z"""


@query("op9_preference_pairs", _OP9)
def _(spark, sf):
    """The table has no preference labels: a conversation is chosen, the same with another's last reply rejected."""
    turns = preferences.swapped_replies(table(spark, sf, "conversations"))
    trained = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return preferences.format_pairs(turns).select(
        "pair_id", "n_prompt_turns", "n_chosen_turns", "n_rejected_turns", "prompt", "chosen", "rejected",
        trained("chosen_spans").alias("chosen_trained_chars"), trained("rejected_spans").alias("rejected_trained_chars"),
    )


@query("op10_license_scan")
def _(spark, sf):
    return licenses.scan(table(spark, sf, "documents")).drop("spans")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OP11 = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_TERM}') AS w FROM documents),
  s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
  i AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_TERM}')) AS t FROM benchmark) GROUP BY ALL),
  v AS (SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
  g AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM v, s GROUP BY t, docs),
  m AS (SELECT row, doc_id, 25 + (75 * len(w) * docs) // total AS m FROM d, s),
  r AS (SELECT item_id, row, doc_id, sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM i JOIN v USING (t) JOIN g USING (t) JOIN m USING (row) GROUP BY ALL)
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10"""


@query("op11_fp_tree_search", _OP11)
def _(spark, sf):
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_OP12 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum([p[1] * p[2] FOR p IN list_zip(a.x, b.x)])::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id,
    positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10"""


@query("op12_cover_tree_negatives", _OP12)
def _(spark, sf):
    return hard_negatives.mine(table(spark, sf, "embeddings"))


_OP13 = f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
  g AS (SELECT doc_id, unnest([array_to_string(w[i:i + 19], ' ') FOR i IN range(1, len(w) - 18)]) AS g, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20),
  f AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
  r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f),
  x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t),
  k AS (SELECT x.doc_id, count(*) AS n_words, count(r.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (r.p IS NULL) AS kept
    FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.p = r.p GROUP BY x.doc_id)
  SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)"""


@query("op13_suffix_tree_dedup", _OP13)
def _(spark, sf):
    done = repeats.removed(table(spark, sf, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
