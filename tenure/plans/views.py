"""The given tables seen as the relations of the library: in Spark, and as SQL text.

Each view exists twice, as a DataFrame and as ANSI SQL with the same rows, so
that every query can be checked against plain SQL over the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions import fixed
from tenure.functions.scalars import floor_bucket, plus_ms
from tenure.operators.history import xid_slice
from tenure.operators.ordered import Running, running
from tenure.session import prepare

AS_OF = "1999-01-01 00:00:00"
EVENTS_START = "2024-01-01 00:00:00"
EVENTS_END = "2024-01-31 00:00:00"
LEASE_MS = 12 * 3_600_000
# Small logs, small slices: so that even they have several.
LOG_SLICE = 2_048
STEP_LEASE_MS = 10 * 86_400_000

# Timestamps in the files carry no zone; read as UTC instants they still prune row groups.
_TABLES = {
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "orders": """
        o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP,
        o_orderpriority STRING
    """,
    "lineitem": """
        l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,
        l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,
        l_shipdate TIMESTAMP
    """,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.schema(_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _k(column: str = "props"):
    return F.get_json_object(column, "$.k").cast("int")


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- steps from orders -------------------------------------------------------

_STATUS = """
    CASE o_orderstatus
      WHEN 'F' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'DEAD_LETTERED' ELSE 'SUCCEEDED' END
      WHEN 'O' THEN CASE o_orderkey % 3 WHEN 0 THEN 'READY' WHEN 1 THEN 'RETRY_WAIT' ELSE 'PENDING' END
      ELSE 'RUNNING'
    END
"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, cust, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    attempts = (key % 4).cast("int")
    busy = F.col("o_orderstatus") == "P"
    return o.select(
        key.alias("step_id"),
        F.expr(_STATUS).alias("status"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        day.alias("available_at"),
        F.when(busy, _text("w", cust % 16)).alias("current_worker_id"),
        (attempts + (cust % 2).cast("int")).alias("lease_version"),
        attempts.alias("attempt_count"),
        F.lit(3).alias("max_attempts"),
        F.lit(None).cast("string").alias("last_error"),
        F.when(busy, plus_ms(day, (key % 60) * 86_400_000)).alias("lease_expires_at"),
        F.lit(fixed.FAIL_THEN_HASH).alias("task_type"),
        _text('{"input":"bench-', key, '","failuresBeforeSuccess":', cust % 4, "}").alias("payload"),
        F.lit(None).cast("string").alias("result"),
    )


_V_STEPS = f"""
    SELECT o_orderkey AS step_id, {_STATUS} AS status,
      CAST(6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS priority,
      o_orderdate AS available_at,
      CASE WHEN o_orderstatus = 'P' THEN 'w' || (o_custkey % 16) END AS current_worker_id,
      CAST(o_orderkey % 4 + o_custkey % 2 AS INTEGER) AS lease_version,
      CAST(o_orderkey % 4 AS INTEGER) AS attempt_count, 3 AS max_attempts, CAST(NULL AS VARCHAR) AS last_error,
      CASE WHEN o_orderstatus = 'P' THEN o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)) END AS lease_expires_at,
      'fail_then_hash' AS task_type,
      '{{"input":"bench-' || o_orderkey || '","failuresBeforeSuccess":' || (o_custkey % 4) || '}}' AS payload,
      CAST(NULL AS VARCHAR) AS result
    FROM orders
"""


def finished_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``steps`` whose SUCCEEDED rows have a result; every seventh customer's is wrong."""
    good = F.sha2(_text("bench-", F.col("step_id")), 256)
    wrong = F.sha2(_text("other-", F.col("step_id")), 256)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step_id"), (F.col("o_custkey") % 7 == 0).alias("bad"))
    result = F.to_json(F.struct(F.when(F.col("bad"), wrong).otherwise(good).alias("hash")))
    s = steps(spark, sf_dir).drop("result").join(o, "step_id")
    return s.withColumn("result", F.when(F.col("status") == "SUCCEEDED", result)).drop("bad")


_V_FINISHED = """
    SELECT s.* EXCLUDE (result),
      CASE WHEN status = 'SUCCEEDED' THEN '{"hash":"' ||
        sha256(CASE WHEN o_custkey % 7 = 0 THEN 'other-' ELSE 'bench-' END || step_id) || '"}' END AS result
    FROM v_steps s JOIN orders ON o_orderkey = step_id
"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of every task type, with valid payloads and one of each kind of invalid one."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        F.when(cust % 13 == 0, key.cast("string")).otherwise(_uuid(key)).alias("step_id"),
        F.expr(_TASK_TYPE).alias("task_type"),
        (key % 4).cast("int").alias("attempt_count"),
        F.col("o_orderdate").alias("available_at"),
        F.expr(_TASK_PAYLOAD).alias("payload"),
    )


def _uuid(key):
    digits = F.lpad(key.cast("string"), 12, "0")
    return F.concat(F.lit("ABCDEF01-0000-4000-8000-"), digits)


_TASK_TYPE = """
    CASE o_orderkey % 7 WHEN 0 THEN 'hash_after_delay' WHEN 1 THEN 'hash_after_delay' WHEN 2 THEN 'fail_then_hash'
      WHEN 3 THEN 'fail_then_hash' WHEN 6 THEN 'mystery' ELSE 'idempotent_effect' END
"""
_TASK_PAYLOAD = """
    CASE
      WHEN o_custkey % 11 = 0 THEN '"just text"'
      WHEN o_custkey % 11 = 1 THEN '{"input":"","value":""}'
      WHEN o_custkey % 11 = 2 THEN '{"input":7,"value":7}'
      WHEN o_custkey % 11 = 3 THEN '{"input":"a","value":"b","delayMs":60001,"delayAfterEffectMs":-1,"failuresBeforeSuccess":1.5}'
      WHEN o_custkey % 11 = 4 THEN '{"input":"a","value":"b","idempotencyKey":"mine","delayMs":"5","delayAfterEffectMs":0}'
      ELSE '{"input":"in-' || o_orderkey || '","value":"val-' || o_orderkey
        || '","delayMs":' || (o_custkey % 60001) || ',"delayAfterEffectMs":0,"failuresBeforeSuccess":' || (o_custkey % 3) || '}'
    END
"""
_V_TASKS = f"""
    SELECT CASE WHEN o_custkey % 13 = 0 THEN CAST(o_orderkey AS VARCHAR)
        ELSE 'ABCDEF01-0000-4000-8000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') END AS step_id,
      {_TASK_TYPE} AS task_type, CAST(o_orderkey % 4 AS INTEGER) AS attempt_count, o_orderdate AS available_at,
      {_TASK_PAYLOAD} AS payload
    FROM orders
"""


# --- events ------------------------------------------------------------------

_EVENT_TYPE = """
    CASE event_type WHEN 'signup' THEN 'STEP_CLAIMED' WHEN 'purchase' THEN 'STEP_SUCCEEDED'
      WHEN 'error' THEN 'STEP_RETRY_SCHEDULED' WHEN 'view' THEN 'LEASE_RECOVERED' WHEN 'click' THEN 'RETRY_READY' END
"""


def plain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log without generations."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        (F.col("event_id") + _k() % 20).alias("xid"),
        F.col("user_id").alias("step_id"),
        _text("w", F.col("event_id") % 8).alias("worker_id"),
        F.expr(_EVENT_TYPE).alias("event_type"),
        F.col("ts").alias("created_at"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log; the generation is the number of claims of the step so far."""
    claimed = F.when(F.col("event_type") == fixed.STEP_CLAIMED, 1).otherwise(0)
    counted = running(
        plain_events(spark, sf_dir),
        keys=["step_id"],
        order=["xid", "id"],
        slice_by=xid_slice(LOG_SLICE),
        lease_version=Running("sum", claimed),
    ).withColumn("lease_version", F.col("lease_version").cast("int"))
    data = F.to_json(F.struct(F.col("lease_version").alias("leaseVersion"), F.col("lease_version").alias("attemptCount")))
    return counted.withColumn("data", data)


_V_PLAIN_EVENTS = f"""
    SELECT event_id AS id, event_id + CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS xid,
      user_id AS step_id, 'w' || (event_id % 8) AS worker_id, {_EVENT_TYPE} AS event_type, ts AS created_at
    FROM events
"""
_V_EVENTS = """
    SELECT *, '{"leaseVersion":' || lease_version || ',"attemptCount":' || lease_version || '}' AS data FROM (
      SELECT *, CAST(sum(CASE WHEN event_type = 'STEP_CLAIMED' THEN 1 ELSE 0 END)
        OVER (PARTITION BY step_id ORDER BY xid, id) AS INTEGER) AS lease_version
      FROM v_plain_events)
"""


def line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history per order: claims, completions and retries from its lines."""
    li = table(spark, sf_dir, "lineitem")
    at = plus_ms(F.col("l_shipdate"), F.col("l_partkey") * 1000 + F.col("l_suppkey"))
    return li.select(
        F.col("l_orderkey").alias("step_id"), F.expr(_LINE_EVENT).alias("event_type"), at.alias("created_at")
    )


_LINE_EVENT = """
    CASE l_linenumber % 3 WHEN 1 THEN 'STEP_CLAIMED' WHEN 2 THEN 'STEP_SUCCEEDED' ELSE 'STEP_RETRY_SCHEDULED' END
"""
_V_LINE_EVENTS = f"""
    SELECT l_orderkey AS step_id, {_LINE_EVENT} AS event_type,
      l_shipdate + to_milliseconds(l_partkey * 1000 + l_suppkey) AS created_at
    FROM lineitem
"""


def user_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step per user: claims counted from the log, off by one for every fifth user."""
    e = plain_events(spark, sf_dir)
    claims = F.count_if(F.col("event_type") == fixed.STEP_CLAIMED)
    off = F.when(F.col("step_id") % 5 == 0, 1).otherwise(0)
    last = F.max_by("event_type", "id")
    grouped = e.groupBy("step_id").agg(claims.alias("claims"), last.alias("last"), F.min("created_at").alias("available_at"))
    pairs = [F.lit(x) for pair in fixed.STATUS_AFTER_EVENT.items() for x in pair]
    return grouped.select(
        "step_id",
        F.create_map(*pairs)[F.col("last")].alias("status"),
        (F.col("claims") + off).cast("int").alias("attempt_count"),
        F.col("claims").cast("int").alias("lease_version"),
        "available_at",
    )


_V_USER_STEPS = """
    SELECT step_id,
      CASE arg_max(event_type, id) WHEN 'STEP_CLAIMED' THEN 'RUNNING' WHEN 'STEP_SUCCEEDED' THEN 'SUCCEEDED'
        WHEN 'STEP_RETRY_SCHEDULED' THEN 'RETRY_WAIT' ELSE 'READY' END AS status,
      CAST(count(*) FILTER (event_type = 'STEP_CLAIMED') + CASE WHEN step_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS attempt_count,
      CAST(count(*) FILTER (event_type = 'STEP_CLAIMED') AS INTEGER) AS lease_version,
      min(created_at) AS available_at
    FROM v_plain_events GROUP BY step_id
"""


# --- owner writes ------------------------------------------------------------

_OP = "CASE event_type WHEN 'signup' THEN 'CLAIM' WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAIL' ELSE 'RENEW' END"


def _writes(spark: SparkSession, sf_dir: str, step_id) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumns({"step_id": step_id, "k": _k(), "op": F.expr(_OP)})
    counted = running(
        e.select("event_id", "ts", "step_id", "k", "op", "user_id"),
        keys=["step_id"],
        order=["ts", "event_id"],
        slice_by=floor_bucket(F.col("ts"), 3_600),
        claims=Running("sum", F.when(F.col("op") == "CLAIM", 1).otherwise(0)),
    )
    claim = F.col("op") == "CLAIM"
    return counted.select(
        F.col("event_id").alias("seq"),
        "step_id",
        _text("w", (F.col("user_id") + F.when(F.col("k") % 10 == 0, 1).otherwise(0)) % 8).alias("worker_id"),
        (F.col("claims") - F.when(~claim & (F.col("k") % 7 == 0), 1).otherwise(0)).cast("int").alias("lease_version"),
        "op",
        "ts",
        (F.col("k") % 5 != 0).alias("retryable"),
        F.when(F.col("op") == "FAIL", _text("failure ", F.col("k"))).alias("error"),
        F.when(F.col("op") == "COMPLETE", _text('{"value":', F.col("k"), "}")).alias("result"),
    )


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner writes with claims as facts, a step per user."""
    return _writes(spark, sf_dir, F.col("user_id"))


def fold_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner writes to be replayed, a step per user and three days."""
    return _writes(spark, sf_dir, F.col("user_id") * 100 + F.floor((F.dayofmonth("ts") - 1) / 3))


def _v_writes(step_id: str) -> str:
    return f"""
    SELECT event_id AS seq, step_id,
      'w' || ((user_id + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) % 8) AS worker_id,
      CAST(claims - CASE WHEN op <> 'CLAIM' AND k % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS lease_version,
      op, ts, k % 5 <> 0 AS retryable,
      CASE WHEN op = 'FAIL' THEN 'failure ' || k END AS error,
      CASE WHEN op = 'COMPLETE' THEN '{{"value":' || k || '}}' END AS result
    FROM (
      SELECT *, sum(CASE WHEN op = 'CLAIM' THEN 1 ELSE 0 END) OVER (PARTITION BY step_id ORDER BY ts, event_id) AS claims
      FROM (SELECT *, {step_id} AS step_id, {_OP} AS op, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
"""


def step_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner writes against ``steps``: a line of an order writes as its owner, or nearly."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    c = F.col
    off = F.when(c("l_suppkey") % 5 == 0, 1).otherwise(0)
    stale = F.when(c("l_partkey") % 6 == 0, 1).otherwise(0)
    return joined.select(
        (c("l_suppkey") * 10**12 + c("l_partkey") * 10**4 + c("l_linenumber") * 100 + c("l_quantity").cast("bigint")).alias("seq"),
        c("l_orderkey").alias("step_id"),
        _text("w", (c("o_custkey") + off) % 16).alias("worker_id"),
        (c("o_orderkey") % 4 + c("o_custkey") % 2 - stale).cast("int").alias("lease_version"),
        F.expr(_LINE_OP).alias("op"),
        plus_ms(c("o_orderdate"), c("l_quantity").cast("bigint") * 86_400_000).alias("ts"),
        (c("l_returnflag") != "R").alias("retryable"),
        F.repeat(F.lit("broken "), (c("l_partkey") % 60).cast("int")).alias("error"),
        _text('{"part":', c("l_partkey"), "}").alias("result"),
    )


_LINE_OP = "CASE l_linenumber % 3 WHEN 0 THEN 'RENEW' WHEN 1 THEN 'COMPLETE' ELSE 'FAIL' END"
_V_STEP_WRITES = f"""
    SELECT l_suppkey * 1000000000000 + l_partkey * 10000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS seq,
      l_orderkey AS step_id,
      'w' || ((o_custkey + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END) % 16) AS worker_id,
      CAST(o_orderkey % 4 + o_custkey % 2 - CASE WHEN l_partkey % 6 = 0 THEN 1 ELSE 0 END AS INTEGER) AS lease_version,
      {_LINE_OP} AS op, o_orderdate + to_days(CAST(l_quantity AS INTEGER)) AS ts, l_returnflag <> 'R' AS retryable,
      repeat('broken ', l_partkey % 60) AS error, '{{"part":' || l_partkey || '}}' AS result
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
"""


# --- effects -----------------------------------------------------------------

EFFECT_ORDER = ("ts", "seq")


def effect_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    c = F.col
    return li.select(
        _text("step:", c("l_orderkey"), ":", c("l_linenumber")).alias("idempotency_key"),
        c("l_linestatus").alias("effect_type"),
        _text('{"flag":"', c("l_returnflag"), '","value":', c("l_linenumber"), "}").alias("request"),
        c("l_shipdate").alias("ts"),
        (c("l_suppkey") * 10**12 + c("l_partkey") * 10**4 + c("l_linenumber") * 100 + c("l_quantity").cast("bigint")).alias("seq"),
    )


def effect_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects applied earlier, with their request's keys in another order; only every fifth has a key that is asked for."""
    o = table(spark, sf_dir, "orders")
    key = _text(F.when(F.col("o_orderkey") % 5 == 0, "step:").otherwise("other:"), F.col("o_orderkey"), ":1")
    return o.select(
        key.alias("idempotency_key"),
        F.lit("O").alias("effect_type"),
        F.lit('{"value": 1.0, "flag": "N"}').alias("request"),
        _text('{"effectId":"old-', F.col("o_orderkey"), '"}').alias("result"),
        F.col("o_orderdate").alias("created_at"),
    )


_V_EFFECT_REQUESTS = """
    SELECT 'step:' || l_orderkey || ':' || l_linenumber AS idempotency_key, l_linestatus AS effect_type,
      '{"flag":"' || l_returnflag || '","value":' || l_linenumber || '}' AS request, l_shipdate AS ts,
      l_suppkey * 1000000000000 + l_partkey * 10000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS seq
    FROM lineitem
"""
# In the form requests have, so that texts can be compared.
_V_EFFECT_STORE = """
    SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'step:' ELSE 'other:' END || o_orderkey || ':1' AS idempotency_key, 'O' AS effect_type, '{"flag":"N","value":1}' AS request,
      '{"effectId":"old-' || o_orderkey || '"}' AS result, o_orderdate AS created_at
    FROM orders
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    number = F.col("l_orderkey") * 10 + F.when(F.col("l_partkey") % 50 == 0, 1).otherwise(0)
    return li.select(
        F.col("l_orderkey").alias("step_id"), (F.col("l_linenumber") == 1).alias("applied"), _text("e", number).alias("effect_id")
    )


def stored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("step_id"), _text("e", F.col("o_orderkey") * 10).alias("effect_id"))


_V_OBSERVATIONS = """
    SELECT l_orderkey AS step_id, l_linenumber = 1 AS applied,
      'e' || (l_orderkey * 10 + CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END) AS effect_id
    FROM lineitem
"""
_V_STORED_IDS = "SELECT o_orderkey AS step_id, 'e' || (o_orderkey * 10) AS effect_id FROM orders"


# --- grants and workers ------------------------------------------------------


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        _text("c", F.col("l_suppkey")).alias("claimer_id"),
        F.col("l_orderkey").alias("step_id"),
        F.col("l_linenumber").alias("lease_version"),
        F.col("l_linenumber").alias("attempt_count"),
    )


_V_GRANTS = """
    SELECT 'c' || l_suppkey AS claimer_id, l_orderkey AS step_id, l_linenumber AS lease_version,
      l_linenumber AS attempt_count
    FROM lineitem
"""


def grant_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events for the same generations: some no claims, some extra, some by another worker."""
    li = table(spark, sf_dir, "lineitem")
    shift = F.when(F.col("l_partkey") % 11 == 0, 1).otherwise(0)
    return li.select(
        F.col("l_orderkey").alias("step_id"),
        (F.col("l_linenumber") + F.when(F.col("l_partkey") % 17 == 0, 7).otherwise(0)).alias("lease_version"),
        _text("c", F.col("l_suppkey") + shift).alias("worker_id"),
        F.when(F.col("l_partkey") % 9 == 0, fixed.LEASE_RECOVERED).otherwise(fixed.STEP_CLAIMED).alias("event_type"),
    )


_V_GRANT_EVENTS = """
    SELECT l_orderkey AS step_id, l_linenumber + CASE WHEN l_partkey % 17 = 0 THEN 7 ELSE 0 END AS lease_version,
      'c' || (l_suppkey + CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END) AS worker_id,
      CASE WHEN l_partkey % 9 = 0 THEN 'LEASE_RECOVERED' ELSE 'STEP_CLAIMED' END AS event_type
    FROM lineitem
"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per claimer: attempts, empty claims, errors, from the lines it has."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(_text("c", F.col("l_suppkey") + F.when(F.col("l_partkey") % 400 == 0, 10**6).otherwise(0)).alias("claimer_id")).agg(
        F.sum((F.col("l_linenumber") + 1).cast("bigint")).alias("attempts"),
        F.sum(F.col("l_linenumber").cast("bigint")).alias("empty"),
        F.count_if(F.col("l_tax") == 0).alias("consistency_errors"),
        F.count_if(F.col("l_discount") == 0).alias("other_errors"),
    )


_V_COUNTERS = """
    SELECT 'c' || (l_suppkey + CASE WHEN l_partkey % 400 = 0 THEN 1000000 ELSE 0 END) AS claimer_id,
      sum(l_linenumber + 1) AS attempts, sum(l_linenumber) AS empty,
      count(*) FILTER (l_tax = 0) AS consistency_errors, count(*) FILTER (l_discount = 0) AS other_errors
    FROM lineitem GROUP BY 1
"""


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the sign-ups register a worker that beats, the others one that never does."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return e.select(_text(F.when(_k() >= 50, "w").otherwise("n"), F.col("user_id") % 200).alias("worker_id"), "ts")


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") != "signup")
    return e.select(_text("w", F.col("user_id") % 200).alias("worker_id"), "ts", F.col("event_id").alias("seq"))


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(_text("w", F.col("user_id") % 8).alias("worker_id")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_heartbeat_at")
    )


_V_REGISTRATIONS = """
    SELECT CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 THEN 'w' ELSE 'n' END || (user_id % 200) AS worker_id, ts
    FROM events WHERE event_type = 'signup'
"""
_V_BEATS = "SELECT 'w' || (user_id % 200) AS worker_id, ts, event_id AS seq FROM events WHERE event_type <> 'signup'"
_V_WORKERS = "SELECT 'w' || (user_id % 8) AS worker_id, min(ts) AS started_at, max(ts) AS last_heartbeat_at FROM events GROUP BY 1"


# --- SQL texts ---------------------------------------------------------------

# In an order in which each view only needs earlier ones.
SQL_VIEWS = {
    "v_steps": _V_STEPS,
    "v_finished": _V_FINISHED,
    "v_tasks": _V_TASKS,
    "v_plain_events": _V_PLAIN_EVENTS,
    "v_events": _V_EVENTS,
    "v_line_events": _V_LINE_EVENTS,
    "v_user_steps": _V_USER_STEPS,
    "v_writes": _v_writes("user_id"),
    "v_fold_writes": _v_writes("user_id * 100 + (day(ts) - 1) // 3"),
    "v_step_writes": _V_STEP_WRITES,
    "v_effect_requests": _V_EFFECT_REQUESTS,
    "v_effect_store": _V_EFFECT_STORE,
    "v_observations": _V_OBSERVATIONS,
    "v_stored_ids": _V_STORED_IDS,
    "v_grants": _V_GRANTS,
    "v_grant_events": _V_GRANT_EVENTS,
    "v_counters": _V_COUNTERS,
    "v_registrations": _V_REGISTRATIONS,
    "v_beats": _V_BEATS,
    "v_workers": _V_WORKERS,
}


def with_views(sql: str, *ctes: str, recursive: bool = False) -> str:
    """``sql`` behind a WITH clause of the views it names, followed by ``ctes``."""
    body = " ".join([*ctes, sql])
    needed: list[str] = []
    for name in reversed(SQL_VIEWS):
        texts = [body, *[SQL_VIEWS[n] for n in needed]]
        if any(_names(text, name) for text in texts):
            needed.insert(0, name)
    parts = [f"{name} AS ({SQL_VIEWS[name]})" for name in needed] + list(ctes)
    if not parts:
        return sql
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {sql}"


def _names(text: str, view: str) -> bool:
    return view in "".join(c if c.isalnum() or c == "_" else " " for c in text).split()
