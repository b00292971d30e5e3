"""Constraint, vocabulary, transition, task and key checks. Each is one narrow pass."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions import fixed
from tenure.functions.scalars import floor_bucket, is_legal_transition, is_uuid
from tenure.operators.ordered import Running, running

_REQUIRED = (
    "step_id", "status", "priority", "available_at", "lease_version", "attempt_count", "max_attempts", "task_type", "payload",
    "created_at", "updated_at",
)


def audit_steps(steps: DataFrame) -> DataFrame:
    """(step_id, rule) for every broken table rule, of the columns that ``steps`` has."""
    c = F.col
    broken = [
        (c("attempt_count") < 0, "attempt_count_nonnegative"),
        (c("max_attempts") < 1, "max_attempts_positive"),
        (
            (c("status") == "RUNNING")
            & (
                c("current_worker_id").isNull()
                | c("lease_expires_at").isNull()
                | ~F.coalesce(c("lease_version") > 0, F.lit(False))
            ),
            "running_requires_owner",
        ),
        *[(c(name).isNull(), f"{name}_not_null") for name in _REQUIRED if name in steps.columns],
    ]
    rules = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for test, rule in broken]))
    return steps.select("step_id", F.explode(rules).alias("rule"))


def audit_vocabulary(df: DataFrame, column: str, allowed: Iterable[str]) -> DataFrame:
    """Rows whose value is outside the vocabulary; null counts as unknown."""
    return df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def audit_transitions(history: DataFrame, slice_s: int = 3_600) -> DataFrame:
    """Status changes that are no edge of the graph.

    ``history`` has step_id, ts, seq and status; the first row of a step has no
    predecessor and is never a violation.
    """
    chained = running(
        history.select("step_id", "ts", "seq", "status"),
        keys=["step_id"],
        order=["ts", "seq"],
        slice_by=floor_bucket(F.col("ts"), slice_s),
        previous_status=Running("last", F.col("status"), inclusive=False),
    )
    return chained.where(
        F.col("previous_status").isNotNull() & ~is_legal_transition(F.col("previous_status"), F.col("status"))
    ).select("step_id", "seq", F.col("previous_status").alias("from_status"), F.col("status").alias("to_status"))


# The text and the number each task type needs, with the number's upper bound.
_TEXT_FIELD = {fixed.HASH_AFTER_DELAY: "input", fixed.FAIL_THEN_HASH: "input", fixed.IDEMPOTENT_EFFECT: "value"}
_NUMBER_FIELD = {
    fixed.HASH_AFTER_DELAY: ("delayMs", fixed.MAX_TASK_DELAY_MS),
    fixed.FAIL_THEN_HASH: ("failuresBeforeSuccess", fixed.MAX_SAFE_INTEGER),
    fixed.IDEMPOTENT_EFFECT: ("delayAfterEffectMs", fixed.MAX_TASK_DELAY_MS),
}


def validate_tasks(steps: DataFrame) -> DataFrame:
    """``steps`` plus error_class (INVALID, RUNTIME or null) and error.

    Checks run in a fixed order: task type, attempt count, payload object, then
    the fields of the task type. Only a deliberate failure is RUNTIME, hence
    worth a retry.
    """
    # The payload is parsed once per row: inside ``transform`` it is a variable,
    # where columns on top of columns would be parsed again at each use.
    parsed = F.array(F.try_parse_json("payload"))
    verdict = F.transform(parsed, lambda p: F.transform(F.array(_fields(p)), lambda f: _verdict(p, f))[0])[0]
    checked = steps.withColumn("__verdict", verdict)
    invalid, runtime = F.col("__verdict.invalid"), F.col("__verdict.runtime")
    return checked.select(
        *[F.col(name) for name in steps.columns],
        F.when(invalid.isNotNull(), F.lit("INVALID")).when(runtime.isNotNull(), F.lit("RUNTIME")).alias("error_class"),
        F.coalesce(invalid, runtime).alias("error"),
    )


def _by_task(values: dict[str, Column]) -> Column:
    picked = F.lit(None)
    for name, value in values.items():
        picked = F.when(F.col("task_type") == name, value).otherwise(picked)
    return picked


def _fields(payload: Column) -> Column:
    """The one text and the one number the row's task type asks for."""
    return F.struct(
        _by_task({t: F.try_variant_get(payload, f"$.{f}", "variant") for t, f in _TEXT_FIELD.items()}).alias("text"),
        _by_task({t: F.try_variant_get(payload, f"$.{f}", "variant") for t, (f, _) in _NUMBER_FIELD.items()}).alias("number"),
        _by_task({t: F.lit(limit) for t, (_, limit) in _NUMBER_FIELD.items()}).alias("limit"),
    )


def _verdict(payload: Column, fields: Column) -> Column:
    task, attempt = F.col("task_type"), F.col("attempt_count")
    kind, text, number = F.schema_of_variant(payload), fields["text"], fields["number"]
    value = F.try_variant_get(number, "$", "double")
    # Arrays pass the object test of the rules and fail at the first field.
    is_object = kind.rlike("^(OBJECT|ARRAY)")
    own_key = (task == fixed.IDEMPOTENT_EFFECT) & F.try_variant_get(payload, "$.idempotencyKey", "variant").isNotNull()
    has_text = (F.schema_of_variant(text) == "STRING") & (F.length(F.try_variant_get(text, "$", "string")) > 0)
    numeric = F.schema_of_variant(number).rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")
    has_number = numeric & (value == F.floor(value)) & (value >= 0) & (value <= fields["limit"])

    def fails(test: Column) -> Column:
        return ~F.coalesce(test, F.lit(False))

    def message(texts: dict[str, str], found: Column) -> Column:
        got = F.coalesce(F.to_json(found), F.lit("undefined"))
        return _by_task({t: F.concat(F.lit(m), got) if m.endswith("got ") else F.lit(m) for t, m in texts.items()})

    quoted = F.coalesce(F.concat(F.lit('"'), task, F.lit('"')), F.lit("null"))
    invalid = (
        F.when(fails(task.isin(*fixed.TASK_TYPES)), F.concat(F.lit(fixed.ERROR_TASK_TYPE), quoted))
        .when(fails(attempt >= 1), F.lit(fixed.ERROR_ATTEMPT))
        .when(fails(is_object), message(fixed.ERROR_OBJECT, payload))
        .when(own_key, F.lit(fixed.ERROR_OWN_KEY))
        .when(fails(has_text), message(fixed.ERROR_TEXT, text))
        .when(fails(has_number), message(fixed.ERROR_NUMBER, number))
        .when((task == fixed.IDEMPOTENT_EFFECT) & ~is_uuid(F.col("step_id").cast("string")), F.lit(fixed.ERROR_STEP_ID))
    )
    deliberate = F.when(
        (task == fixed.FAIL_THEN_HASH) & (attempt <= value), F.concat(F.lit(fixed.ERROR_DELIBERATE), attempt.cast("string"))
    )
    return F.struct(invalid.alias("invalid"), deliberate.alias("runtime"))


def _blank(column: Column) -> Column:
    return F.coalesce(F.trim(column) == "", F.lit(True))


def audit_keys(df: DataFrame) -> DataFrame:
    """``df`` exploded to one row per broken rule, in column ``rule``.

    Checks whichever of worker_id, idempotency_key and effect_type ``df`` has.
    """
    tests = []
    if "worker_id" in df.columns:
        tests.append((_blank(F.col("worker_id")), "worker_id_blank"))
    if "idempotency_key" in df.columns:
        key = F.col("idempotency_key")
        tests.append((_blank(key), "idempotency_key_blank"))
        tests.append((F.length(key) > fixed.MAX_KEY_CHARS, "idempotency_key_too_long"))
    if "effect_type" in df.columns:
        tests.append((_blank(F.col("effect_type")), "effect_type_blank"))
    rules = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for test, rule in tests]))
    return df.select("*", F.explode(rules).alias("rule"))
