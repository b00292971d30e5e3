"""The whole lifecycle of every step, replayed from its owner writes.

A step takes at most ``max_attempts`` claims, and an owner write can only count
in the generation it names. So a replay needs no row-by-row loop over a step:
round ``g`` finds each step's next claim (a minimum) and settles generation
``g`` from the writes that name it (two minima, see
:func:`tenure.operators.lease.settle_generations`). Each owner write is read in
one round only, and a step with most of all writes is spread over its slices.

Rules. Before a write at ``ts``: a RUNNING step with deadline <= ts is recovered
at its deadline, a RETRY_WAIT step with available_at <= ts becomes READY at
available_at. A claim counts if the step is READY with attempts left; a renewal,
completion or failure if worker and generation match and the deadline is later
than ``ts``. Recovery happens here at the deadline itself; a periodic sweep does
it up to one period later, so a claim in between may differ, an owner write
never: its authority ends at the deadline either way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions import fixed
from tenure.functions.scalars import backoff_ms, instant, plus_ms
from tenure.operators.lease import SLICE_S, OWNER_OPS, position, settle_generations
from tenure.session import written


_EVER = "0001-01-01 00:00:00"
_READY = ("step_id", "lease_version", "attempt_count", "max_attempts", "ready_at")


def _held(steps: DataFrame) -> DataFrame:
    """Leases held at the start; what is null there was decided before."""
    return steps.where(F.col("status") == "RUNNING").select(
        "step_id", "lease_version", "attempt_count", "max_attempts", F.col("current_worker_id").alias("worker_id"),
        F.lit(None).cast("timestamp").alias("claimed_at"), F.lit(None).cast("bigint").alias("claim_seq"), F.col("lease_expires_at").alias("deadline0"),
    )


def _waiting(steps: DataFrame, like: DataFrame) -> DataFrame:
    """Steps that wait for a retry at the start, as rows of a settled generation."""
    facts = {
        "step_id": F.col("step_id"), "lease_version": F.col("lease_version"), "attempt_count": F.col("attempt_count"), "max_attempts": F.col("max_attempts"),
        "renewals": F.lit(0), "outcome": F.lit("RETRY_WAIT"), "ready_at": F.col("available_at"), "given": F.lit(True),
    }
    rows = steps.where(F.col("status") == "RETRY_WAIT")
    return rows.select(*[facts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def _settled(opened: DataFrame, rows: DataFrame, now, lease_ms: int, slice_s: int) -> DataFrame:
    """One row per generation: how it went, and when the step can be claimed again."""
    settled = settle_generations(opened, rows, lease_ms, slice_s)
    left = F.col("attempt_count") < F.col("max_attempts")
    failed = F.col("end_op") == "FAIL"
    retry = failed & F.coalesce(F.col("end_retryable"), F.lit(False)) & left
    lapsed = F.col("end_op").isNull() & F.coalesce(F.col("deadline") <= now, F.lit(False))
    outcome = (
        F.when(F.col("end_op") == "COMPLETE", "SUCCEEDED")
        .when(retry, "RETRY_WAIT")
        .when(failed | (lapsed & ~left), "DEAD_LETTERED")
        .when(lapsed, "RECOVERED")
        .otherwise("RUNNING")
    )
    ready_at = F.when(retry, plus_ms(F.col("end_ts"), backoff_ms(F.col("attempt_count")))).when(lapsed & left, F.col("deadline"))
    made = settled.withColumns({"outcome": outcome, "ready_at": ready_at, "given": F.lit(False)}).drop("deadline0")
    return written(made, "settled")


def lifecycle_fold(
    writes: DataFrame,
    as_of,
    lease_ms: int = fixed.DEFAULT_LEASE_MS,
    max_attempts: int = fixed.DEFAULT_MAX_ATTEMPTS,
    slice_s: int = SLICE_S,
    steps: DataFrame | None = None,
) -> DataFrame:
    """One row per generation: how it ended, and when the step was ready again.

    outcome: SUCCEEDED, RETRY_WAIT, DEAD_LETTERED, RECOVERED, or RUNNING at ``as_of``.
    ``steps`` are rows of steps as they were before the writes, each with its own
    ``max_attempts``; a step that is not among them begins READY and unclaimed, with the
    budget given here. Leases held at the start have no ``claimed_at``; a wait for a retry
    that began earlier is a row with ``given``.

    The owner writes are written once, by the round that can read them, so a round opens
    its own only. Every round's claims and outcomes, one row per step at most, are written
    too: a round does not replay the earlier ones, and both sides of its joins are plain
    shuffles, which the adaptive skew join can split where one step has most of the writes.
    """
    now = instant(as_of)
    seen = writes.where(F.col("ts") <= now)
    claims = seen.where(F.col("op") == "CLAIM").select("step_id", "ts", "seq", "worker_id")
    owned = seen.where(F.col("op").isin(*OWNER_OPS))
    rounds: list[DataFrame] = []
    if steps is None:
        most = max_attempts
        owned = owned.withColumn("round", F.col("lease_version"))
    else:
        left = F.col("max_attempts") - F.col("attempt_count")
        most = max(max_attempts, steps.agg(F.max(left)).first()[0] or 0)
        begun = steps.select("step_id", F.col("lease_version").alias("__base"))
        owned = owned.join(begun, "step_id", "left").withColumn("round", F.col("lease_version") - F.coalesce("__base", F.lit(0))).drop("__base")
    owned = written(owned.where(F.col("round").between(0, most)), "owner-writes", "round")

    if steps is None:
        fresh = [F.lit(x).alias(name) for x, name in ((0, "lease_version"), (0, "attempt_count"), (max_attempts, "max_attempts"))]
        able = claims.select("step_id", *fresh, "ts", "seq", "worker_id")
    else:
        opened = written(_held(steps), "held")
        rows = owned.where(F.col("round") == 0).drop("round").join(opened, ["step_id", "lease_version", "worker_id"])
        first = _settled(opened, rows.select(*writes.columns, "deadline0"), now, lease_ms, slice_s)
        rounds += [first, written(_waiting(steps, first), "waiting")]
        unknown = seen.select("step_id").distinct().join(steps.select("step_id"), "step_id", "left_anti")
        given = steps.where(F.col("status") == "READY").withColumn("ready_at", F.col("available_at")).select(*_READY)
        new = unknown.select(
            "step_id", F.lit(0).alias("lease_version"), F.lit(0).alias("attempt_count"), F.lit(max_attempts).alias("max_attempts"),
            F.lit(_EVER).cast("timestamp").alias("ready_at"),
        )
        begin = written(reduce(DataFrame.unionByName, [given, new, *[r.select(*_READY) for r in rounds]]), "ready")
        able = _claimable(claims, begin)
    for number in range(1, most + 1):
        if rounds and number > 1:
            able = _claimable(able.select("step_id", "ts", "seq", "worker_id"), rounds[-1])
        first = able.groupBy("step_id", "lease_version", "attempt_count", "max_attempts").agg(F.min(F.struct("ts", "seq", "worker_id")).alias("c"))
        opened = written(
            first.select(
                "step_id",
                (F.col("lease_version") + 1).alias("lease_version"),
                (F.col("attempt_count") + 1).alias("attempt_count"),
                "max_attempts",
                F.col("c.worker_id").alias("worker_id"),
                F.col("c.ts").alias("claimed_at"),
                F.col("c.seq").alias("claim_seq"),
                plus_ms(F.col("c.ts"), lease_ms).alias("deadline0"),
            ),
            "opened",
        )
        if number > 1 and opened.isEmpty():
            break
        rows = owned.where(F.col("round") == number).drop("round").join(opened, ["step_id", "lease_version", "worker_id"])
        after = F.struct(F.col("claimed_at").alias("ts"), F.col("claim_seq").alias("seq")) < position()
        rounds.append(_settled(opened, rows.where(after).select(*writes.columns, "deadline0"), now, lease_ms, slice_s))
    return reduce(DataFrame.unionByName, rounds)


def _claimable(claims: DataFrame, ready: DataFrame) -> DataFrame:
    """Claims of steps that are ready by then and have attempts left."""
    open_ = ready.where(F.col("ready_at").isNotNull() & (F.col("attempt_count") < F.col("max_attempts"))).select(*_READY)
    return claims.join(open_, "step_id").where(F.col("ts") >= F.col("ready_at")).drop("ready_at")


def fold_events(generations: DataFrame, as_of) -> DataFrame:
    """The events of a replay up to ``as_of``, with their place in the step's history."""
    c = F.col
    no_text = F.lit(None).cast("string")

    def event(kind, at, worker, place: int, reason=no_text, error=no_text):
        return F.struct(
            F.lit(kind).alias("event_type") if isinstance(kind, str) else kind.alias("event_type"),
            at.alias("created_at"),
            worker.alias("worker_id"),
            (c("lease_version") * 4 + place).alias("place"),
            reason.alias("reason"),
            error.alias("error"),
        )

    dead = c("outcome") == "DEAD_LETTERED"
    by_write = c("end_op").isNotNull()
    ended_as = (
        F.when(c("outcome") == "SUCCEEDED", fixed.STEP_SUCCEEDED)
        .when(c("outcome") == "RETRY_WAIT", fixed.STEP_RETRY_SCHEDULED)
        .when(dead, fixed.STEP_DEAD_LETTERED)
        .when(c("outcome") == "RECOVERED", fixed.LEASE_RECOVERED)
    )
    reason = F.when(dead & ~by_write, fixed.REASON_LEASE_BUDGET).when(
        dead, F.when(c("end_retryable"), fixed.REASON_BUDGET).otherwise(fixed.REASON_NON_RETRYABLE)
    )
    listed = F.array_compact(
        F.array(
            F.when(c("claimed_at").isNotNull(), event(fixed.STEP_CLAIMED, c("claimed_at"), c("worker_id"), 0)),
            F.when(
                (c("outcome") != "RUNNING") & ~c("given"),
                event(ended_as, F.when(by_write, c("end_ts")).otherwise(c("deadline")), c("worker_id"), 1, reason, c("end_error")),
            ),
            F.when(
                (c("outcome") == "RETRY_WAIT") & (c("ready_at") <= instant(as_of)),
                event(fixed.RETRY_READY, c("ready_at"), no_text, 2),
            ),
        )
    )
    exploded = generations.select("step_id", "lease_version", "attempt_count", F.explode(listed).alias("e"))
    return exploded.select("step_id", "lease_version", "attempt_count", "e.*")


_KEPT = ("status", "lease_version", "attempt_count", "available_at", "last_error", "result")


def fold_state(writes: DataFrame, generations: DataFrame, as_of, steps: DataFrame | None = None) -> DataFrame:
    """The row of every step at ``as_of``; steps without an accepted claim are as they began, or READY."""
    now = instant(as_of)
    known = writes.where(F.col("ts") <= now).select("step_id").distinct()
    if steps is not None:
        begun = steps.select("step_id", F.struct(*_KEPT).alias("b"))
        known = known.join(begun, "step_id", "full")
    else:
        types = ("string", "int", "int", "timestamp", "string", "string")
        known = known.withColumn("b", F.struct(*[F.lit(None).cast(t).alias(name) for name, t in zip(_KEPT, types, strict=True)]))
    facts = F.struct("lease_version", "attempt_count", "outcome", "worker_id", "deadline", "ready_at", "end_result")
    failure = F.when(F.col("end_op") == "FAIL", F.struct("lease_version", "end_error"))
    last = generations.groupBy("step_id").agg(F.max(facts).alias("g"), F.max(failure).alias("f"))
    joined = known.join(last, "step_id", "left")
    g, b = F.col("g"), F.col("b")
    waiting = (g["outcome"] == "RETRY_WAIT") & (g["ready_at"] > now)
    running = g["outcome"] == "RUNNING"
    status = F.when(waiting, "RETRY_WAIT").when(g["outcome"].isin("SUCCEEDED", "DEAD_LETTERED", "RUNNING"), g["outcome"]).when(g.isNotNull(), "READY")
    return joined.select(
        "step_id",
        F.coalesce(status, b["status"], F.lit("READY")).alias("status"),
        F.coalesce(g["lease_version"], b["lease_version"], F.lit(0)).alias("lease_version"),
        F.coalesce(g["attempt_count"], b["attempt_count"], F.lit(0)).alias("attempt_count"),
        F.when(running, g["worker_id"]).alias("current_worker_id"),
        F.when(running, g["deadline"]).alias("lease_expires_at"),
        F.coalesce(F.when(g["outcome"] == "RETRY_WAIT", g["ready_at"]), b["available_at"]).alias("available_at"),
        F.coalesce(F.col("f.end_error"), b["last_error"]).alias("last_error"),
        F.coalesce(F.when(g["outcome"] == "SUCCEEDED", g["end_result"]), b["result"]).alias("result"),
    )


def fold_decisions(writes: DataFrame, generations: DataFrame, as_of) -> DataFrame:
    """``writes`` up to ``as_of`` plus accepted, as the replay decided."""
    seen = writes.where(F.col("ts") <= instant(as_of))
    claimed = generations.where(F.col("claim_seq").isNotNull()).select("step_id", F.col("claim_seq").alias("seq"), F.lit(True).alias("accepted"))
    claims = seen.where(F.col("op") == "CLAIM").join(claimed, ["step_id", "seq"], "left")
    claims = claims.select(*writes.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))
    held = generations.select(
        "step_id",
        "lease_version",
        F.col("worker_id").alias("__worker"),
        F.struct(F.col("claimed_at").alias("ts"), F.col("claim_seq").alias("seq")).alias("__from"),
        F.when(F.col("end_op").isNotNull(), F.struct(F.col("end_ts").alias("ts"), F.col("end_seq").alias("seq"))).alias("__to"),
        F.col("deadline").alias("__deadline"),
    )
    rows = seen.where(F.col("op").isin(*OWNER_OPS)).join(held, ["step_id", "lease_version"], "left")
    accepted = (
        (F.col("worker_id") == F.col("__worker"))
        & (F.col("__from.ts").isNull() | (F.col("__from") < position()))
        & (F.col("ts") < F.col("__deadline"))
        & (F.col("__to").isNull() | (position() <= F.col("__to")))
    )
    rows = rows.select(*writes.columns, F.coalesce(accepted, F.lit(False)).alias("accepted"))
    return claims.unionByName(rows)
