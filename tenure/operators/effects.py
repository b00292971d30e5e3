"""Side effects made idempotent by key: the first request of a key wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions import fixed
from tenure.functions.scalars import canonical_json, effect_id, effect_key
from tenure.operators.ordered import salt


# Bins that requests are counted in, and how many requests of one bin a task may take.
_BINS = 65_536
HOT_ROWS = 200_000


def effect_result(key: Column, request: Column) -> Column:
    """Result minted for a new effect: its id and the request's value."""
    value = F.try_variant_get(F.try_parse_json(request), "$.value", "variant")
    return F.to_json(F.struct(effect_id(key).alias("effectId"), value.alias("value")))


def _invalid() -> Column:
    key, kind = F.col("idempotency_key"), F.col("effect_type")
    return (
        F.when(F.coalesce(F.trim(key) == "", F.lit(True)), F.lit("blank key"))
        .when(F.length(key) > fixed.MAX_KEY_CHARS, F.lit("key too long"))
        .when(F.coalesce(F.trim(kind) == "", F.lit(True)), F.lit("blank effect type"))
        .when(F.try_parse_json("request").isNull(), F.lit("request is not JSON"))
    )


def _decide(rows: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``columns`` plus outcome and result of rows that know their key's first entry, ``__first``."""
    winner, request = F.col("__first"), F.col("request")
    same_type = winner["effect_type"] == F.col("effect_type")
    is_first = (winner["rank"] == 1) & (winner["at"] == F.struct(*[F.col(c) for c in order]))
    # Equal texts are equal requests; only the others are compared as JSON values, which costs most: a branch of its own.
    outcome = (
        F.when(F.col("__invalid").isNotNull(), F.lit("INVALID"))
        .when(is_first, F.lit("APPLIED"))
        .when(same_type & (winner["request"] == request), F.lit("REUSED"))
        .when(~F.coalesce(same_type, F.lit(False)), F.lit("CONFLICT"))
        .when(canonical_json(winner["request"]) == canonical_json(request), F.lit("REUSED"))
        .otherwise(F.lit("CONFLICT"))
    )
    minted = effect_result(F.col("idempotency_key"), winner["request"])
    result = F.when(F.col("outcome").isin("APPLIED", "REUSED"), F.coalesce(winner["result"], minted))
    return rows.withColumn("outcome", outcome).select(*columns, "outcome", result.alias("result"))


def _entry(stored: bool, *at: Column) -> Column:
    return F.struct(
        F.lit(0 if stored else 1).alias("rank"),
        F.struct(*at).alias("at"),
        F.col("effect_type"),
        F.col("request"),
        (F.col("result") if stored else F.lit(None).cast("string")).alias("result"),
    )


def _whole_keys(checked: DataFrame, store: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keys of which any one fits a task: requests and stored rows move once, by key, and meet in one window."""
    nothing = [F.lit(None).cast(checked.schema[c].dataType) for c in order]
    # An invalid request has no part in its key, which may be missing; it is spread by its own values.
    part = F.when(F.col("__invalid").isNotNull(), salt(*order)).otherwise(F.lit(-1).cast("bigint"))
    asked = checked.select(*columns, "__invalid", part.alias("__part"), _entry(False, *[F.col(c) for c in order]).alias("__e"))
    known = {"idempotency_key": F.col("idempotency_key"), "__part": F.lit(-1).cast("bigint"), "__e": _entry(True, *[x.alias(c) for x, c in zip(nothing, order, strict=True)])}
    kept = store.select(*[known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in asked.schema.fields])
    key = Window.partitionBy("idempotency_key", "__part").orderBy("__e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = asked.unionByName(kept).withColumn("__first", F.first("__e").over(key))
    return _decide(rows.where(F.col("__e.rank") == 1), columns, order)


def _spread_keys(checked: DataFrame, store: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keys with too many requests for a task: cut to one row per part before they move, and every
    part gets the key's first entry back, so a key has at most that many rows here, and its row in the store."""
    checked = checked.withColumn("__part", salt(*order))
    asked = checked.where(F.col("__invalid").isNull()).select("idempotency_key", "__part", _entry(False, *[F.col(c) for c in order]).alias("e"))
    empty = [F.lit(None).cast(checked.schema[c].dataType).alias(c) for c in order]
    kept = store.select("idempotency_key", _entry(True, *empty).alias("e"))
    parts = asked.groupBy("idempotency_key", "__part").agg(F.min("e").alias("e"))
    entries = kept.withColumn("__part", F.lit(-1).cast("bigint")).unionByName(parts)
    firsts = entries.withColumn("__first", F.min("e").over(Window.partitionBy("idempotency_key")))
    firsts = firsts.where(F.col("__part") >= 0).select("idempotency_key", "__part", "__first")
    return _decide(checked.join(firsts, ["idempotency_key", "__part"], "left"), columns, order)


def apply_effects(requests: DataFrame, store: DataFrame, order: Sequence[str] = ("ts", "seq"), hot_rows: int = HOT_ROWS) -> DataFrame:
    """``requests`` plus outcome and result.

    APPLIED: the first valid request of a key that is not stored yet. REUSED:
    same type and equal request; it gets the stored result. CONFLICT: anything
    else under a used key. INVALID: bad key, type or JSON. ``order`` must be a
    total order within a key.

    Requests are counted in bins of their keys' hashes first. A bin with more than
    ``hot_rows``, and more than eight times the mean, has a key that no task should
    see whole; its requests are spread. The bins decide the cost, never the result.
    """
    bin_ = F.pmod(F.xxhash64("idempotency_key"), F.lit(_BINS))
    bins = requests.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    total, full = bins.agg(F.sum("n"), F.collect_list(F.when(F.col("n") > hot_rows, F.struct("bin", "n")))).first()
    hot = [b.bin for b in full if b.n > 8 * total / _BINS]
    columns = requests.columns
    checked = requests.withColumn("__invalid", _invalid())
    if (total or 0) <= hot_rows:
        # Of the store only the keys asked for move on; a small batch is broadcast to it by Spark's size check.
        store = store.join(requests.select("idempotency_key"), "idempotency_key", "left_semi")
    if not hot:
        return _whole_keys(checked, store, columns, order)
    is_hot = F.coalesce(bin_.isin(hot), F.lit(False))
    whole = _whole_keys(checked.where(~is_hot), store.where(~is_hot), columns, order)
    return whole.unionByName(_spread_keys(checked.where(is_hot), store.where(is_hot), columns, order))


def new_store_rows(outcomes: DataFrame, created_at: str = "ts") -> DataFrame:
    """Rows to append to the store: one per applied effect, never changed later."""
    return outcomes.where(F.col("outcome") == "APPLIED").select(
        "idempotency_key", "effect_type", "request", "result", F.col(created_at).alias("created_at")
    )


def receipt_requests(steps: DataFrame, order: Sequence[str] = ("available_at", "step_id")) -> DataFrame:
    """The request each effect task makes: one receipt per step, whatever the attempt."""
    step = F.col("step_id").cast("string")
    value = F.get_json_object("payload", "$.value")
    return steps.where(F.col("task_type") == fixed.IDEMPOTENT_EFFECT).select(
        effect_key(step).alias("idempotency_key"),
        F.lit(fixed.RECEIPT_EFFECT_TYPE).alias("effect_type"),
        F.to_json(F.struct(F.lower(step).alias("stepId"), value.alias("value"))).alias("request"),
        *order,
    )


def effect_consistency(observations: DataFrame, store: DataFrame) -> DataFrame:
    """Keys whose observations disagree among themselves or with the store.

    ``observations``: step_id, applied, effect_id; ``store``: step_id, effect_id.
    Least and greatest id and the number of missing ones tell whether there are several,
    a missing id being one of its own; no ids are collected.
    """
    seen = observations.groupBy("step_id").agg(
        F.count("*").alias("observations"),
        F.count_if("applied").alias("applied"),
        F.min("effect_id").alias("least"),
        F.max("effect_id").alias("greatest"),
        F.count_if(F.col("effect_id").isNull()).alias("missing"),
    )
    joined = seen.join(store.select("step_id", F.col("effect_id").alias("stored")), "step_id", "left")
    flags = joined.select(
        "step_id",
        "observations",
        "applied",
        (F.col("applied") != 1).alias("not_applied_once"),
        ((F.col("missing") > 0) & F.col("least").isNotNull() | ~F.col("least").eqNullSafe(F.col("greatest"))).alias("several_ids"),
        (
            F.col("stored").isNotNull()
            & ((F.col("missing") > 0) | ~F.col("least").eqNullSafe(F.col("stored")) | ~F.col("greatest").eqNullSafe(F.col("stored")))
        ).alias("differs_from_store"),
    )
    return flags.where(F.col("not_applied_once") | F.col("several_ids") | F.col("differs_from_store"))


def reconcile_results(steps: DataFrame, store: DataFrame) -> DataFrame:
    """One row per step and finding: MATCHING, DIFFERENT, NO_EFFECT; and per key: KEY_REPEATED.

    ``store`` is joined on idempotency_key; ``steps`` has idempotency_key too.
    """
    counted = store.groupBy("idempotency_key").agg(
        F.count("*").alias("rows"),
        F.min(F.get_json_object("result", "$.effectId")).alias("stored_id"),
    )
    joined = steps.join(counted, "idempotency_key", "left")
    own = F.get_json_object("result", "$.effectId")
    succeeded = F.col("status") == "SUCCEEDED"
    findings = F.array_compact(
        F.array(
            F.when(F.col("rows").isNull(), F.lit("NO_EFFECT")),
            F.when(F.col("rows").isNotNull() & succeeded, F.when(own == F.col("stored_id"), F.lit("MATCHING")).otherwise(F.lit("DIFFERENT"))),
            F.when(F.col("rows") > 1, F.lit("KEY_REPEATED")),
        )
    )
    return joined.select("step_id", "idempotency_key", F.explode(findings).alias("finding"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Count and an order-free checksum: equal before and after means nothing changed."""
    row = F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    number = F.conv(F.substring(row, 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(number.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("checksum"))
