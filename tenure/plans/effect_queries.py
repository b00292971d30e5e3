"""Queries over idempotent effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.functions import scalars
from tenure.operators import effects, tasks
from tenure.plans import views as v
from tenure.plans.registry import query
from tenure.plans.step_queries import _CHECKED
from tenure.plans.views import with_views
from tenure.session import scratch_path
from tenure.sources.hash_tree import HashTree

_ID = "substr(sha256({0}), 1, 8) || '-' || substr(sha256({0}), 9, 4) || '-' || substr(sha256({0}), 13, 4) || '-' || substr(sha256({0}), 17, 4) || '-' || substr(sha256({0}), 21, 12)"

_FIRST = (
    """entries AS (
        SELECT idempotency_key, 0 AS rank, TIMESTAMP '1900-01-01' AS ts, 0 AS seq, effect_type, request, result FROM v_effect_store
        UNION ALL SELECT idempotency_key, 1, ts, seq, effect_type, request,
          '{"effectId":"' || """
    + _ID.format("idempotency_key")
    + """ || '","value":' || json_extract_string(request, '$.value') || '}' FROM v_effect_requests)""",
    """winners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY rank, ts, seq) AS rn FROM entries)
        WHERE rn = 1)""",
    """outcomes AS (SELECT r.*, CASE WHEN w.rank = 1 AND w.ts = r.ts AND w.seq = r.seq THEN 'APPLIED'
          WHEN w.effect_type = r.effect_type AND w.request = r.request THEN 'REUSED' ELSE 'CONFLICT' END AS outcome, w.result AS stored
        FROM v_effect_requests r JOIN winners w USING (idempotency_key))""",
)


def _outcomes(spark, sf):
    return effects.apply_effects(v.effect_requests(spark, sf), v.effect_store(spark, sf), v.EFFECT_ORDER)


@query(
    "ide1_apply_effects",
    with_views(
        """SELECT idempotency_key, seq, outcome, CASE WHEN outcome <> 'CONFLICT' THEN stored END AS result FROM outcomes""", *_FIRST
    ),
)
def _(spark, sf):
    return _outcomes(spark, sf).select("idempotency_key", "seq", "outcome", "result")


@query(
    "ide1_new_store_rows",
    with_views(
        """SELECT idempotency_key, effect_type, request, stored AS result, ts AS created_at FROM outcomes WHERE outcome = 'APPLIED'""",
        *_FIRST,
    ),
)
def _(spark, sf):
    return effects.new_store_rows(_outcomes(spark, sf))


_KEY = "'step:' || lower(step_id) || ':demo_receipt'"
_UUID = "regexp_matches(step_id, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')"


@query("ide2_effect_key", with_views(f"SELECT step_id, CASE WHEN {_UUID} THEN {_KEY} END AS effect_key FROM v_tasks"))
def _(spark, sf):
    return v.tasks(spark, sf).select("step_id", scalars.effect_key(F.col("step_id")).alias("effect_key"))


@query("ide3_effect_id", with_views(f"SELECT idempotency_key, {_ID.format('idempotency_key')} AS effect_id FROM v_effect_requests"))
def _(spark, sf):
    return v.effect_requests(spark, sf).select("idempotency_key", scalars.effect_id(F.col("idempotency_key")).alias("effect_id"))


@query(
    "ide4_effect_consistency",
    with_views("""
        SELECT * FROM (
          SELECT o.step_id, count(*) AS observations, count(*) FILTER (applied) AS applied,
            count(*) FILTER (applied) <> 1 AS not_applied_once, count(DISTINCT o.effect_id) > 1 AS several_ids,
            bool_or(o.effect_id <> s.effect_id) AS differs_from_store
          FROM v_observations o JOIN v_stored_ids s USING (step_id) GROUP BY o.step_id)
        WHERE not_applied_once OR several_ids OR differs_from_store"""),
)
def _(spark, sf):
    return effects.effect_consistency(v.observations(spark, sf), v.stored_ids(spark, sf))


_RESULTS = (
    """held AS (SELECT o_orderkey AS step_id, CASE WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' ELSE 'RUNNING' END AS status,
        'k' || (o_orderkey - CASE WHEN o_orderkey % 40 = 1 THEN 1 ELSE 0 END) AS idempotency_key,
        '{"effectId":"e' || (o_orderkey + CASE WHEN o_custkey % 9 = 0 THEN 1 ELSE 0 END) || '"}' AS result FROM orders)""",
    """kept AS (SELECT 'k' || l_orderkey || CASE WHEN l_linenumber > 1 AND l_orderkey % 7 > 0 THEN '-' || l_linenumber ELSE '' END AS idempotency_key,
        '{"effectId":"e' || l_orderkey || '"}' AS result FROM lineitem)""",
    """counted AS (SELECT idempotency_key, count(*) AS n, min(json_extract_string(result, '$.effectId')) AS stored FROM kept GROUP BY 1)""",
)


@query(
    "ide5_reconcile_results",
    with_views(
        """SELECT step_id, idempotency_key, 'NO_EFFECT' AS finding FROM held LEFT JOIN counted USING (idempotency_key) WHERE n IS NULL
        UNION ALL SELECT step_id, idempotency_key, CASE WHEN json_extract_string(result, '$.effectId') = stored THEN 'MATCHING' ELSE 'DIFFERENT' END
          FROM held JOIN counted USING (idempotency_key) WHERE status = 'SUCCEEDED'
        UNION ALL SELECT step_id, idempotency_key, 'KEY_REPEATED' FROM held JOIN counted USING (idempotency_key) WHERE n > 1""",
        *_RESULTS,
    ),
)
def _(spark, sf):
    """Every line keeps an effect: the first of an order under the order's key, later ones under their own or, now and then, the same."""
    o, li = v.table(spark, sf, "orders"), v.table(spark, sf, "lineitem")
    steps = o.select(
        F.col("o_orderkey").alias("step_id"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' ELSE 'RUNNING' END").alias("status"),
        F.expr("concat('k', o_orderkey - CASE WHEN o_orderkey % 40 = 1 THEN 1 ELSE 0 END)").alias("idempotency_key"),
        F.expr("""concat('{"effectId":"e', o_orderkey + CASE WHEN o_custkey % 9 = 0 THEN 1 ELSE 0 END, '"}')""").alias("result"),
    )
    store = li.select(
        F.expr("concat('k', l_orderkey, CASE WHEN l_linenumber > 1 AND l_orderkey % 7 > 0 THEN concat('-', l_linenumber) ELSE '' END)").alias("idempotency_key"),
        F.expr("""concat('{"effectId":"e', l_orderkey, '"}')""").alias("result"),
    )
    return effects.reconcile_results(steps, store)


@query(
    "ide6_fingerprint",
    with_views("""
        SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(md5(
          '{"effect_type":"' || effect_type || '","idempotency_key":"' || idempotency_key || '","request":"'
            || replace(request, '"', '\\"') || '","seq":' || seq || '}'), 1, 8)) AS BIGINT)) AS VARCHAR) AS checksum
        FROM v_effect_requests"""),
)
def _(spark, sf):
    rows = v.effect_requests(spark, sf).select("idempotency_key", "effect_type", "request", "seq")
    return effects.fingerprint(rows).withColumn("checksum", F.col("checksum").cast("string"))


@query(
    "ide6_differences",
    with_views(
        """SELECT coalesce(a.step_id, b.step_id) AS step_id, CASE WHEN a.step_id IS NULL THEN 'ADDED' WHEN b.step_id IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change
        FROM (SELECT step_id, status, lease_version FROM v_steps) a FULL JOIN moved b ON a.step_id = b.step_id
        WHERE a.step_id IS NULL OR b.step_id IS NULL OR a.status <> b.status OR a.lease_version <> b.lease_version""",
        """moved AS (SELECT CASE WHEN step_id % 997 = 1 THEN -step_id ELSE step_id END AS step_id, CASE WHEN step_id % 499 = 2 THEN 'CANCELLED' ELSE status END AS status,
          lease_version + CASE WHEN step_id % 751 = 3 THEN 1 ELSE 0 END AS lease_version FROM v_steps)""",
    ),
)
def _(spark, sf):
    """Two versions of the steps, the later with a few keys renamed and rows changed."""
    s = v.steps(spark, sf).select("step_id", "status", "lease_version")
    key = F.col("step_id")
    moved = s.select(
        F.when(key % 997 == 1, -key).otherwise(key).alias("step_id"),
        F.when(key % 499 == 2, "CANCELLED").otherwise(F.col("status")).alias("status"),
        (F.col("lease_version") + F.when(key % 751 == 3, 1).otherwise(0)).alias("lease_version"),
    )
    trees = [HashTree(scratch_path(spark, f"version-{i}"), ["step_id"]) for i in range(2)]
    for tree, rows in zip(trees, (s, moved), strict=True):
        tree.write(rows)
    return trees[0].diff(spark, trees[1])


_REQUESTS = """asked AS (SELECT lower(step_id) AS id, available_at, step_id, 'step:' || lower(step_id) || ':demo_receipt' AS idempotency_key,
    json_extract_string(payload, '$.value') AS val FROM checked WHERE task_type = 'idempotent_effect' AND invalid IS NULL AND runtime IS NULL)"""


@query(
    "tsk3_effect_tasks",
    with_views(
        """SELECT step_id, a.idempotency_key, '{"stepId":"' || id || '","value":"' || a.val || '"}' AS request,
          CASE WHEN s.idempotency_key IS NULL THEN 'APPLIED' WHEN s.val = a.val THEN 'REUSED' ELSE 'CONFLICT' END AS outcome,
          CASE WHEN s.idempotency_key IS NULL THEN '{"effectId":"' || """
        + _ID.format("a.idempotency_key")
        + """ || '","value":"' || a.val || '"}' WHEN s.val = a.val THEN '{"effectId":"kept"}' END AS result
        FROM asked a LEFT JOIN kept s USING (idempotency_key)""",
        _CHECKED,
        _REQUESTS,
        """kept AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'step:abcdef01-0000-4000-8000-' ELSE 'step:abcdef02-0000-4000-8000-' END || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || ':demo_receipt' AS idempotency_key,
            'val-' || (o_orderkey + CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END) AS val FROM orders)""",
    ),
)
def _(spark, sf):
    """A third of the stored receipts belong to the tasks' steps, the others to steps of somebody else."""
    o = v.table(spark, sf, "orders")
    step_id = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "abcdef01-0000-4000-8000-").otherwise("abcdef02-0000-4000-8000-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    value = F.concat(F.lit("val-"), (F.col("o_orderkey") + F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(0)).cast("string"))
    store = o.select(
        scalars.effect_key(step_id).alias("idempotency_key"),
        F.lit("demo_receipt").alias("effect_type"),
        F.to_json(F.struct(value.alias("value"), step_id.alias("stepId"))).alias("request"),
        F.lit('{"effectId":"kept"}').alias("result"),
        F.col("o_orderdate").alias("created_at"),
    )
    return tasks.run_effect_tasks(v.tasks(spark, sf), store)
