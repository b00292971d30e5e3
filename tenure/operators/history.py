"""Writing and reading the append-only event history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tenure.functions import fixed
from tenure.functions.scalars import error_excerpt, instant, status_after
from tenure.operators.ordered import Running, join_one, running

# Commit numbers per slice: how far a hot step or the whole log is cut up.
XID_SLICE = 65_536


def xid_slice(width: int = XID_SLICE) -> Column:
    return F.floor(F.col("xid") / F.lit(width)).cast("bigint")


def event_data() -> Column:
    """The JSON an event carries, from the columns of a transition.

    Absent entries are left out, as ``to_json`` leaves out nulls.
    """
    event = F.col("event_type")
    scheduled = event == fixed.STEP_RETRY_SCHEDULED
    dead = event == fixed.STEP_DEAD_LETTERED
    recovered = (event == fixed.LEASE_RECOVERED) | (F.col("reason") == fixed.REASON_LEASE_BUDGET)
    return F.to_json(
        F.struct(
            F.col("lease_version").alias("leaseVersion"),
            F.col("attempt_count").alias("attemptCount"),
            F.when(scheduled, F.date_format("available_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("availableAt"),
            F.when(F.coalesce(recovered, F.lit(False)), F.col("event_worker_id")).alias("previousWorkerId"),
            F.when(dead, F.col("reason")).alias("reason"),
            F.when(
                scheduled | (dead & ~F.coalesce(recovered, F.lit(False))), error_excerpt(F.col("last_error"))
            ).alias("error"),
        )
    )


def emit_events(transitions: DataFrame) -> DataFrame:
    """One event per accepted transition; rejected rows have no event_type and give none."""
    return transitions.where(F.col("event_type").isNotNull()).select(
        "step_id",
        F.col("event_worker_id").alias("worker_id"),
        "event_type",
        event_data().alias("data"),
        F.col("event_at").alias("created_at"),
    )


@dataclass(frozen=True)
class Cursor:
    """Position in the (xid, id) order."""

    xid: int = 0
    id: int = 0


START = Cursor()


def page_limit(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError(f"limit must be a positive integer, got {limit!r}")
    return min(limit, fixed.MAX_PAGE)


def page(
    events: DataFrame, after: Cursor = START, watermark: int | None = None, limit: int = fixed.DEFAULT_PAGE, step_id=None
) -> DataFrame:
    """The next events in (xid, id) order that no running transaction can still precede."""
    size = page_limit(limit)
    xid, id_ = F.col("xid"), F.col("id")
    # The comparison on xid alone prunes row groups; the rest settles ties.
    rows = events.where((xid >= after.xid) & ((xid > after.xid) | (id_ > after.id)))
    if watermark is not None:
        rows = rows.where(xid < watermark)
    if step_id is not None:
        rows = rows.where(F.col("step_id") == step_id)
    return rows.orderBy("xid", "id").limit(size)


def next_cursor(rows: list[Row], after: Cursor) -> Cursor:
    """Where to go on after a fetched page; an empty page stays where it was."""
    return Cursor(rows[-1]["xid"], rows[-1]["id"]) if rows else after


def resolve_cursor(events: DataFrame, event_id: int) -> Cursor | None:
    """Position of an event id; None if there is no such event, and the caller must not restart."""
    if event_id <= 0:
        return START
    found = cursor_of(events, event_id).take(1)
    return Cursor(found[0]["xid"], found[0]["id"]) if found else None


def cursor_of(events: DataFrame, event_id: int) -> DataFrame:
    return events.where(F.col("id") == event_id).select("xid", "id")


def commit_watermark(in_flight: DataFrame, events: DataFrame) -> DataFrame:
    """One row, ``watermark``: the oldest running write, else one past the newest commit."""
    newest = events.agg((F.max("xid") + 1).alias("w"), F.lit(1).alias("rank"))
    oldest = in_flight.agg(F.min("xid").alias("w"), F.lit(0).alias("rank"))
    both = oldest.unionByName(newest).where(F.col("w").isNotNull())
    return both.agg(F.coalesce(F.min_by("w", "rank"), F.lit(0)).cast("bigint").alias("watermark"))


def missed_by_id_cursor(events: DataFrame, slice_width: int = XID_SLICE) -> DataFrame:
    """Events a plain ``id > cursor`` reader loses: a higher id was committed before them."""
    seen = running(
        events.select("id", "xid"),
        keys=[],
        order=["xid", "id"],
        slice_by=xid_slice(slice_width),
        highest_before=Running("max", F.col("id"), inclusive=False),
    )
    return seen.where(F.col("id") < F.col("highest_before"))


def history_segments(events: DataFrame, text: Column, slice_width: int = XID_SLICE) -> DataFrame:
    """(step_id, segment, history): ordered text per step and slice of commits."""
    listed = events.groupBy("step_id", xid_slice(slice_width).alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("xid", "id", text.alias("entry")))).alias("entries")
    )
    joined = F.array_join(F.transform("entries", lambda e: e["entry"]), " ")
    return listed.select("step_id", "segment", joined.alias("history"))


def history(events: DataFrame, text: Column | None = None, slice_width: int = XID_SLICE) -> DataFrame:
    """``TYPE:vN`` entries of each step in (xid, id) order, one text per step.

    The text of a step is one cell by definition. Steps with very long
    histories are better read as :func:`history_segments`.
    """
    text = F.concat(F.col("event_type"), F.lit(":v"), F.col("lease_version").cast("string")) if text is None else text
    segments = history_segments(events, text, slice_width)
    ordered = F.array_sort(F.collect_list(F.struct("segment", "history")))
    listed = segments.groupBy("step_id").agg(ordered.alias("s"))
    return listed.select("step_id", F.array_join(F.transform("s", lambda x: x["history"]), " ").alias("history"))


def conformance(events: DataFrame, expected: str, slice_width: int = XID_SLICE) -> DataFrame:
    """Steps whose history is not ``expected``, with their number of events.

    Only steps with exactly the expected number of events can match, so only
    their (short) histories are put together.
    """
    length = len(expected.split(" "))
    counted = events.groupBy("step_id").agg(F.count("*").alias("n_events"))
    candidates = counted.where(F.col("n_events") == length)
    # By slices, since a plain join would move all events of a hot step to one task to drop them there.
    short = history(join_one(events, candidates.select("step_id"), ["step_id"], xid_slice(slice_width)), slice_width=slice_width)
    good = short.where(F.col("history") == expected).select("step_id")
    return counted.join(good, "step_id", "left_anti")


def succession(events: DataFrame, slice_width: int = XID_SLICE) -> DataFrame:
    """Every event with its predecessor in the step and whether it may follow it.

    A claim must raise the generation by one; any other event must keep it.
    """
    chained = running(
        events.select("step_id", "xid", "id", "event_type", "lease_version"),
        keys=["step_id"],
        order=["xid", "id"],
        slice_by=xid_slice(slice_width),
        before=Running("last", F.struct("event_type", "lease_version"), inclusive=False),
    )
    pairs = [f"{a or ''}>{b}" for a, b in fixed.EVENT_SUCCESSORS]
    pair = F.concat(F.coalesce(F.col("before.event_type"), F.lit("")), F.lit(">"), F.col("event_type"))
    step_up = F.when(F.col("event_type") == fixed.STEP_CLAIMED, 1).otherwise(0)
    version_ok = F.col("lease_version") == F.coalesce(F.col("before.lease_version"), F.lit(0)) + step_up
    return chained.select(
        "step_id",
        "xid",
        "id",
        "event_type",
        F.col("before.event_type").alias("previous_type"),
        F.coalesce(pair.isin(*pairs) & version_ok, F.lit(False)).alias("legal"),
    )


def lifecycle_conformance(events: DataFrame, slice_width: int = XID_SLICE) -> DataFrame:
    """Per step: events, events that may not follow their predecessor, and whether it has ended."""
    checked = succession(events, slice_width)
    last = F.max_by("event_type", F.struct("xid", "id"))
    return checked.groupBy("step_id").agg(
        F.count("*").alias("n_events"),
        F.count_if(~F.col("legal")).alias("illegal_events"),
        last.isin(*fixed.TERMINAL_EVENT_TYPES).alias("finished"),
    )


def reconcile_state(steps: DataFrame, events: DataFrame) -> DataFrame:
    """Steps whose counters or status disagree with their history."""
    seen = events.groupBy("step_id").agg(
        F.count_if(F.col("event_type") == fixed.STEP_CLAIMED).alias("claims"),
        F.max_by("event_type", F.struct("xid", "id")).alias("last_event"),
    )
    joined = steps.select("step_id", "status", "attempt_count").join(seen, "step_id", "left")
    claims = F.coalesce("claims", F.lit(0))
    claims_agree = F.col("attempt_count") == claims
    # Without any event a step has never been claimed or ended.
    unclaimed = F.col("status").isin("PENDING", "READY", "CANCELLED")
    status_agrees = F.when(F.col("last_event").isNull(), unclaimed).otherwise(
        status_after(F.col("last_event")) == F.col("status")
    )
    return joined.select(
        "step_id",
        "status",
        "attempt_count",
        claims.alias("claims"),
        "last_event",
        claims_agree.alias("claims_agree"),
        F.coalesce(status_agrees, F.lit(False)).alias("status_agrees"),
    ).where(~(F.col("claims_agree") & F.col("status_agrees")))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def completions_by_worker(events: DataFrame) -> DataFrame:
    """Steps each worker completed: only STEP_SUCCEEDED counts, one for each step and generation."""
    done = events.where(F.col("event_type") == fixed.STEP_SUCCEEDED).select("worker_id", "step_id", "lease_version").distinct()
    return done.groupBy("worker_id").agg(F.count("*").alias("completed")).orderBy("worker_id")


def per_interval(events: DataFrame, t0, width_s: int = 1, chunk: int = 3600) -> DataFrame:
    """Terminal events per elapsed interval since ``t0``, zeros included."""
    ended = events.where(F.col("event_type").isin(*fixed.TERMINAL_EVENT_TYPES))
    elapsed = F.unix_micros("created_at") - F.unix_micros(instant(t0))
    slot = F.floor(elapsed / F.lit(width_s * 1_000_000)).cast("bigint")
    counted = ended.groupBy(slot.alias("second")).agg(F.count("*").alias("n"))
    last = counted.agg(F.max("second").alias("last")).where(F.col("last") >= 0)
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last") / chunk).cast("bigint"))
    # Whole chunks are spread out first, so no task writes the full axis.
    spread = last.select("last", F.explode(chunks).alias("c")).repartition("c")
    seconds = F.sequence(F.col("c") * chunk, F.least(F.col("c") * chunk + (chunk - 1), F.col("last")))
    axis = spread.select(F.explode(seconds).alias("second"))
    return axis.join(counted, "second", "left").select("second", F.coalesce("n", F.lit(0)).alias("n"))


def latest(events: DataFrame, n: int = fixed.LATEST_EVENTS) -> DataFrame:
    """The newest events, newest first."""
    return events.orderBy(F.desc("xid"), F.desc("id")).limit(n)


def duplicate_transitions(events: DataFrame, event_type: str) -> DataFrame:
    """Generations with more than one event of a type."""
    of_type = events.where(F.col("event_type") == event_type)
    return of_type.groupBy("step_id", "lease_version").agg(F.count("*").alias("n")).where(F.col("n") > 1)
