"""Queries over steps: validation, scalars, selection, recovery, tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.functions import fixed, scalars
from tenure.operators import recover, select, tasks, validate
from tenure.operators.history import event_data
from tenure.plans import views as v
from tenure.plans.registry import query
from tenure.plans.views import AS_OF, with_views
from tenure.session import scratch_path
from tenure.sources.relations import read_relation, synthetic_steps

_ORDER = "ORDER BY priority DESC, available_at ASC, step_id ASC"
_CLAIMABLE = f"""SELECT * FROM v_steps
    WHERE status = 'READY' AND available_at <= TIMESTAMP '{AS_OF}' AND attempt_count < max_attempts"""
_SHORT = "step_id, priority, available_at"


@query(
    "src1_read_relation",
    with_views("""SELECT CAST(step_id AS VARCHAR) AS step_id, status, priority, available_at, current_worker_id, lease_version, attempt_count, max_attempts,
        last_error, lease_expires_at, task_type, payload, result, CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at FROM v_steps"""),
)
def _(spark, sf):
    """Steps from files that lack two columns of the relation and hold the others in another order."""
    path = scratch_path(spark, "steps")
    s = v.steps(spark, sf).withColumn("step_id", F.col("step_id").cast("string"))
    s.select(*sorted(s.columns)).write.parquet(path)
    return read_relation(spark, path, "steps")


@query(
    "src3_synthetic_steps",
    with_views("""
        SELECT s.step_id, '{"input":"bench-' || step_id || '","failuresBeforeSuccess":0}' AS payload, 'READY' AS status,
          3 AS max_attempts, s.available_at
        FROM v_steps s"""),
)
def _(spark, sf):
    """One generated step for every order, next to the order's own availability."""
    o = v.steps(spark, sf).select("step_id", "available_at")
    # As many steps as there are orders: the table decides how many are generated.
    made = synthetic_steps(spark, o.count(), fixed.FAIL_THEN_HASH, AS_OF)
    number = F.regexp_extract("payload", "bench-([0-9]+)", 1).cast("bigint") - 1
    made = made.select(
        number.alias("step_id"),
        F.concat(F.lit('{"input":"bench-'), number.cast("string"), F.lit('","failuresBeforeSuccess":0}')).alias("payload"),
        "status",
        "max_attempts",
    )
    return made.join(o, "step_id")


@query(
    "val1_audit_steps",
    with_views("""
        SELECT step_id, 'running_requires_owner' AS rule FROM v_steps
        WHERE status = 'RUNNING' AND (current_worker_id IS NULL OR lease_expires_at IS NULL OR lease_version <= 0)
        UNION ALL SELECT step_id, 'attempt_count_nonnegative' FROM v_steps WHERE attempt_count < 0
        UNION ALL SELECT step_id, 'max_attempts_positive' FROM v_steps WHERE max_attempts < 1"""),
)
def _(spark, sf):
    return validate.audit_steps(v.steps(spark, sf))


@query(
    "val2_audit_vocabulary",
    with_views("""
        SELECT step_id, task_type FROM v_tasks
        WHERE task_type IS NULL OR task_type NOT IN ('hash_after_delay', 'fail_then_hash', 'idempotent_effect')"""),
)
def _(spark, sf):
    return validate.audit_vocabulary(v.tasks(spark, sf), "task_type", fixed.TASK_TYPES).select("step_id", "task_type")


@query(
    "val3_is_terminal",
    with_views("""
        SELECT status, status IN ('SUCCEEDED', 'DEAD_LETTERED', 'CANCELLED') AS terminal, count(*) AS n
        FROM v_steps GROUP BY 1, 2"""),
)
def _(spark, sf):
    s = v.steps(spark, sf)
    return s.groupBy("status", scalars.is_terminal(F.col("status")).alias("terminal")).agg(F.count("*").alias("n"))


_AFTER = """CASE event_type WHEN 'STEP_CLAIMED' THEN 'RUNNING' WHEN 'STEP_SUCCEEDED' THEN 'SUCCEEDED'
    WHEN 'STEP_RETRY_SCHEDULED' THEN 'RETRY_WAIT' WHEN 'STEP_DEAD_LETTERED' THEN 'DEAD_LETTERED' ELSE 'READY' END"""
_EDGES = ", ".join(f"('{a}', '{b}')" for a, b in fixed.LEGAL_EDGES)


@query(
    "val4_audit_transitions",
    with_views(
        """
        SELECT step_id, seq, from_status, to_status FROM chained
        WHERE from_status IS NOT NULL AND (from_status, to_status) NOT IN (SELECT (a, b) FROM edges)""",
        f"edges(a, b) AS (VALUES {_EDGES})",
        f"""chained AS (SELECT step_id, id AS seq, {_AFTER} AS to_status,
              lag({_AFTER}) OVER (PARTITION BY step_id ORDER BY created_at, id) AS from_status FROM v_plain_events)""",
    ),
)
def _(spark, sf):
    e = v.plain_events(spark, sf)
    h = e.select("step_id", F.col("created_at").alias("ts"), F.col("id").alias("seq"), scalars.status_after(F.col("event_type")).alias("status"))
    return validate.audit_transitions(h)


@query(
    "val4_legal_transitions",
    with_views(
        """
        SELECT from_status, to_status, count(*) AS n, (from_status, to_status) IN (SELECT (a, b) FROM edges) AS legal
        FROM chained WHERE from_status IS NOT NULL GROUP BY 1, 2""",
        f"edges(a, b) AS (VALUES {_EDGES})",
        """chained AS (SELECT a.status AS from_status, b.status AS to_status
              FROM v_steps a JOIN v_steps b ON b.step_id = a.step_id + 1)""",
    ),
)
def _(spark, sf):
    a = v.steps(spark, sf).select((F.col("step_id") + 1).alias("step_id"), F.col("status").alias("from_status"))
    b = v.steps(spark, sf).select("step_id", F.col("status").alias("to_status"))
    counted = a.join(b, "step_id").groupBy("from_status", "to_status").agg(F.count("*").alias("n"))
    return counted.withColumn("legal", scalars.is_legal_transition(F.col("from_status"), F.col("to_status")))


_UUID_SQL = "regexp_matches(step_id, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')"


def _message(texts: dict[str, str], value: str) -> str:
    got = f"coalesce(CAST({value} AS VARCHAR), 'undefined')"
    whens = " ".join(f"WHEN '{t}' THEN '{m}'" + (f" || {got}" if m.endswith("got ") else "") for t, m in texts.items())
    return f"CASE task_type {whens} END"


def _picked(fields: dict[str, str]) -> str:
    return "CASE task_type " + " ".join(f"WHEN '{t}' THEN json_extract(payload, '$.{f}')" for t, f in fields.items()) + " END"


_TEXT_VALUE = _picked({"hash_after_delay": "input", "fail_then_hash": "input", "idempotent_effect": "value"})
_NUMBER_VALUE = _picked(
    {"hash_after_delay": "delayMs", "fail_then_hash": "failuresBeforeSuccess", "idempotent_effect": "delayAfterEffectMs"}
)
_CHECKED = f"""checked AS (
    SELECT *, CASE
      WHEN task_type NOT IN ('hash_after_delay', 'fail_then_hash', 'idempotent_effect') THEN '{fixed.ERROR_TASK_TYPE}"' || task_type || '"'
      WHEN attempt_count < 1 THEN '{fixed.ERROR_ATTEMPT}'
      WHEN json_type(payload) NOT IN ('OBJECT', 'ARRAY') THEN {_message(fixed.ERROR_OBJECT, "payload")}
      WHEN task_type = 'idempotent_effect' AND json_exists(payload, '$.idempotencyKey') THEN '{fixed.ERROR_OWN_KEY}'
      WHEN NOT coalesce(json_type(txt) = 'VARCHAR' AND length(json_extract_string(txt, '$')) > 0, false)
        THEN {_message(fixed.ERROR_TEXT, "txt")}
      WHEN NOT coalesce(json_type(num) IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND dbl = floor(dbl) AND dbl BETWEEN 0 AND
          CASE task_type WHEN 'fail_then_hash' THEN {fixed.MAX_SAFE_INTEGER} ELSE {fixed.MAX_TASK_DELAY_MS} END, false)
        THEN {_message(fixed.ERROR_NUMBER, "num")}
      WHEN task_type = 'idempotent_effect' AND NOT {_UUID_SQL} THEN '{fixed.ERROR_STEP_ID}' END AS invalid,
      CASE WHEN task_type = 'fail_then_hash' AND attempt_count <= dbl THEN '{fixed.ERROR_DELIBERATE}' || attempt_count END AS runtime
    FROM (SELECT *, TRY_CAST(CAST(num AS VARCHAR) AS DOUBLE) AS dbl
      FROM (SELECT *, {_TEXT_VALUE} AS txt, {_NUMBER_VALUE} AS num FROM v_tasks)))"""
_CLASS = "CASE WHEN invalid IS NOT NULL THEN 'INVALID' WHEN runtime IS NOT NULL THEN 'RUNTIME' END AS error_class"


@query(
    "val5_validate_tasks",
    with_views(f"SELECT step_id, task_type, attempt_count, {_CLASS}, coalesce(invalid, runtime) AS error FROM checked", _CHECKED),
)
def _(spark, sf):
    return validate.validate_tasks(v.tasks(spark, sf)).select("step_id", "task_type", "attempt_count", "error_class", "error")


_HASHED = """CASE WHEN task_type IN ('hash_after_delay', 'fail_then_hash') AND invalid IS NULL AND runtime IS NULL
    THEN '{"hash":"' || sha256(json_extract_string(payload, '$.input')) || '"}' END AS result"""


@query("tsk1_tsk2_run_tasks", with_views(f"SELECT step_id, task_type, {_CLASS}, {_HASHED} FROM checked", _CHECKED))
def _(spark, sf):
    return tasks.run_tasks(v.tasks(spark, sf)).select("step_id", "task_type", "error_class", "result")


@query(
    "val6_audit_keys",
    with_views("""
        SELECT id, 'worker_id_blank' AS rule FROM keyed WHERE trim(worker_id) = ''
        UNION ALL SELECT id, 'idempotency_key_blank' FROM keyed WHERE trim(idempotency_key) = ''
        UNION ALL SELECT id, 'idempotency_key_too_long' FROM keyed WHERE length(idempotency_key) > 200
        UNION ALL SELECT id, 'effect_type_blank' FROM keyed WHERE trim(effect_type) = ''""",
        """keyed AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 9 = 0 THEN '  ' ELSE 'w' || o_custkey END AS worker_id,
              repeat('k', o_custkey % 203) AS idempotency_key, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'receipt' END AS effect_type
            FROM orders)"""),
)
def _(spark, sf):
    o = v.table(spark, sf, "orders")
    keyed = o.select(
        F.col("o_orderkey").alias("id"),
        F.expr("CASE WHEN o_custkey % 9 = 0 THEN '  ' ELSE concat('w', o_custkey) END").alias("worker_id"),
        F.expr("repeat('k', CAST(o_custkey % 203 AS INT))").alias("idempotency_key"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'receipt' END").alias("effect_type"),
    )
    return validate.audit_keys(keyed).select("id", "rule")


@query(
    "fil1_unfinished",
    with_views("""SELECT status, count(*) AS n FROM v_steps
        WHERE status NOT IN ('SUCCEEDED', 'DEAD_LETTERED', 'CANCELLED') GROUP BY status"""),
)
def _(spark, sf):
    return select.unfinished(v.steps(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@query("fil1_by_status", with_views("SELECT step_id, status FROM v_steps WHERE status IN ('READY', 'RUNNING')"))
def _(spark, sf):
    return select.by_status(v.steps(spark, sf), "READY", "RUNNING").select("step_id", "status")


@query(
    "fil1_busy_probe",
    with_views("SELECT EXISTS (SELECT 1 FROM v_steps WHERE status IN ('READY', 'RUNNING')) AS busy"),
)
def _(spark, sf):
    return select.any_in_status(v.steps(spark, sf), "READY", "RUNNING")


_LEFT = f"(epoch_us(lease_expires_at) - epoch_us(TIMESTAMP '{AS_OF}')) / 1000000.0"


@query(
    "fil2_expired",
    with_views(f"""SELECT step_id, lease_expires_at FROM v_steps
        WHERE status = 'RUNNING' AND lease_expires_at <= TIMESTAMP '{AS_OF}'"""),
)
def _(spark, sf):
    return select.expired(v.steps(spark, sf), AS_OF).select("step_id", "lease_expires_at")


@query(
    "fil2_lease_clock",
    with_views(f"""SELECT step_id, status, round({_LEFT}, 1) AS lease_remaining_s,
        lease_expires_at <= TIMESTAMP '{AS_OF}' AS deadline_passed FROM v_steps"""),
)
def _(spark, sf):
    return select.lease_clock(v.steps(spark, sf), AS_OF)


@query("top1_claimable", with_views(f"SELECT {_SHORT} FROM ({_CLAIMABLE})"))
def _(spark, sf):
    return select.claimable(v.steps(spark, sf), AS_OF).select("step_id", "priority", "available_at")


@query("top2_next_claimable", with_views(f"SELECT {_SHORT} FROM ({_CLAIMABLE}) {_ORDER} LIMIT 100"))
def _(spark, sf):
    return select.next_claimable(v.steps(spark, sf), AS_OF, 100).select("step_id", "priority", "available_at")


@query(
    "top3_next_claimable_per",
    with_views(f"""SELECT {_SHORT}, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY attempt_count {_ORDER}) AS INTEGER) AS rank FROM ({_CLAIMABLE})) WHERE rank <= 10"""),
)
def _(spark, sf):
    rows = select.next_claimable_per(v.steps(spark, sf), AS_OF, 10, "attempt_count")
    return rows.select("step_id", "priority", "available_at", "rank")


@query(
    "top4_excluding_busy",
    with_views(f"""SELECT {_SHORT} FROM ({_CLAIMABLE})
        WHERE step_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) {_ORDER} LIMIT 50"""),
)
def _(spark, sf):
    busy = v.table(spark, sf, "lineitem").where(F.col("l_linenumber") == 7).select(F.col("l_orderkey").alias("step_id"))
    rows = select.next_claimable(select.excluding_busy(v.steps(spark, sf), busy), AS_OF, 50)
    return rows.select("step_id", "priority", "available_at")


_K = 8


def _assigned(workers: str, bound: str = "") -> str:
    return with_views(
        f"""SELECT c.step_id, 'RUNNING' AS status, w.worker_id AS current_worker_id, lease_version + 1 AS lease_version,
          attempt_count + 1 AS attempt_count, TIMESTAMP '{AS_OF}' + INTERVAL 30 SECOND AS lease_expires_at,
          '{{"leaseVersion":' || (lease_version + 1) || ',"attemptCount":' || (attempt_count + 1) || '}}' AS data
        FROM (SELECT *, row_number() OVER ({_ORDER}) AS slot FROM ({_CLAIMABLE})) c
        JOIN (SELECT worker_id, row_number() OVER (ORDER BY worker_id) AS slot FROM {workers}) w USING (slot) {bound}"""
    )


def _claims(claimed):
    told = claimed.withColumns({"event_worker_id": F.col("worker_id"), "reason": F.lit(None).cast("string")})
    columns = ("step_id", "status", "current_worker_id", "lease_version", "attempt_count", "lease_expires_at")
    return told.select(*columns, event_data().alias("data"))


@query("asg1_assign_batch", _assigned("v_workers", f"WHERE slot <= {_K}"))
def _(spark, sf):
    return _claims(select.assign_batch(v.steps(spark, sf), v.workers(spark, sf), AS_OF, fixed.DEFAULT_LEASE_MS, _K))


@query("asg1_assign_all", _assigned("(SELECT DISTINCT 'c' || l_suppkey || ':' || l_linenumber AS worker_id FROM lineitem)"))
def _(spark, sf):
    """Every worker there is, here one for each supplier and line number, gets a step while there are any."""
    crew = v.table(spark, sf, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey"), F.lit(":"), F.col("l_linenumber")).alias("worker_id"))
    return _claims(select.assign_batch(v.steps(spark, sf), crew, AS_OF, fixed.DEFAULT_LEASE_MS))


_RECOVERED = """
    SELECT step_id, CASE WHEN attempt_count < max_attempts THEN 'READY' ELSE 'DEAD_LETTERED' END AS status,
      CAST(NULL AS VARCHAR) AS current_worker_id, lease_version, attempt_count,
      CASE WHEN attempt_count < max_attempts THEN 'LEASE_RECOVERED' ELSE 'STEP_DEAD_LETTERED' END AS event_type,
      current_worker_id AS event_worker_id,
      '{"leaseVersion":' || lease_version || ',"attemptCount":' || attempt_count || ',"previousWorkerId":"' || current_worker_id || '"'
        || CASE WHEN attempt_count < max_attempts THEN '}' ELSE ',"reason":"lease_expired_attempt_budget_exhausted"}' END AS data
"""
_PROMOTED = """
    SELECT step_id, 'READY' AS status, current_worker_id, lease_version, attempt_count, 'RETRY_READY' AS event_type,
      CAST(NULL AS VARCHAR) AS event_worker_id,
      '{"leaseVersion":' || lease_version || ',"attemptCount":' || attempt_count || '}' AS data
"""
_EXPIRED_SQL = f"FROM v_steps WHERE status = 'RUNNING' AND lease_expires_at <= TIMESTAMP '{AS_OF}'"
_DUE_SQL = f"FROM v_steps WHERE status = 'RETRY_WAIT' AND available_at <= TIMESTAMP '{AS_OF}'"


def _with_data(rows):
    columns = ("step_id", "status", "current_worker_id", "lease_version", "attempt_count", "event_type", "event_worker_id")
    return rows.select(*columns, event_data().alias("data"))


@query("rec1_recover_expired", with_views(f"{_RECOVERED} {_EXPIRED_SQL} ORDER BY lease_expires_at, step_id LIMIT 100"))
def _(spark, sf):
    return _with_data(recover.recover_expired(v.steps(spark, sf), AS_OF))


@query("rec1_drain_expired", with_views(f"{_RECOVERED} {_EXPIRED_SQL}"))
def _(spark, sf):
    return _with_data(recover.recover_expired(v.steps(spark, sf), AS_OF, limit=None))


@query("rec2_promote_due", with_views(f"{_PROMOTED} {_DUE_SQL} ORDER BY available_at, step_id LIMIT 100"))
def _(spark, sf):
    return _with_data(recover.promote_due(v.steps(spark, sf), AS_OF))


@query("rec3_sweep", with_views(f"{_RECOVERED} {_EXPIRED_SQL} UNION ALL {_PROMOTED} {_DUE_SQL}"))
def _(spark, sf):
    return _with_data(recover.sweep(v.steps(spark, sf), AS_OF))


@query(
    "bkf1_backoff_ms",
    """SELECT o_orderkey AS step_id, CAST(o_orderkey % 9 AS INTEGER) AS attempt,
        CAST(500 * power(2, least(greatest(o_orderkey % 9 - 1, 0), 3)) AS BIGINT) AS backoff_ms FROM orders""",
)
def _(spark, sf):
    o = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("step_id"), (F.col("o_orderkey") % 9).cast("int").alias("attempt"))
    return o.withColumn("backoff_ms", scalars.backoff_ms(F.col("attempt")))


@query(
    "bud1_attempt_budget",
    with_views("""SELECT step_id, attempt_count AS claims_used, greatest(max_attempts - attempt_count, 0) AS claims_left,
        attempt_count >= max_attempts AS exhausted FROM v_steps"""),
)
def _(spark, sf):
    return recover.attempt_budget(v.steps(spark, sf))


@query(
    "str1_str4_ids",
    with_views(f"""SELECT step_id, {_UUID_SQL} AS is_uuid, substr(step_id, 1, 8) AS short_id FROM v_tasks"""),
)
def _(spark, sf):
    return v.tasks(spark, sf).select(
        "step_id", scalars.is_uuid(F.col("step_id")).alias("is_uuid"), scalars.short_id(F.col("step_id")).alias("short_id")
    )


@query(
    "str2_error_excerpt",
    """SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 199) || '…' END AS excerpt FROM documents""",
)
def _(spark, sf):
    d = v.prepare(spark).read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", scalars.error_excerpt(F.col("text")).alias("excerpt"))


@query("str3_clock_part", "SELECT event_id, strftime(ts, '%H:%M:%S.%g') AS clock FROM events")
def _(spark, sf):
    e = v.table(spark, sf, "events")
    return e.select("event_id", scalars.clock_part(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("clock"))


@query(
    "fn_paced_rate",
    """SELECT o_orderkey AS id, greatest(100, CAST(floor(o_totalprice * 0.5 / 100) * 100 AS BIGINT)) AS rate FROM orders""",
)
def _(spark, sf):
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), scalars.paced_rate(F.col("o_totalprice")).alias("rate"))


@query(
    "fn_canonical_json",
    "SELECT event_id, '{\"a\":' || json_extract_string(props, '$.k') || ',\"b\":1}' AS canonical FROM events",
)
def _(spark, sf):
    k = F.get_json_object("props", "$.k")
    shuffled = F.concat(F.lit('{ "b" : 1.0, "a" : '), k, F.lit("}"))
    return v.table(spark, sf, "events").select("event_id", scalars.canonical_json(shuffled).alias("canonical"))
