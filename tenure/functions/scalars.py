"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenure.functions import fixed


def instant(value: datetime | str | Column) -> Column:
    """``as_of`` as a timestamp literal; columns pass through."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp")


def plus_ms(ts: Column, ms: Column | int) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(ms).cast("bigint") * 1000)


def ms_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1000.0)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1000000.0)


def tenth(value: Column) -> Column:
    """Round to one decimal, halves away from zero."""
    return F.signum(value) * F.floor(F.abs(value) * 10 + 0.5) / 10


def floor_bucket(ts: Column, width_s: float) -> Column:
    """Number of the time slice an instant falls in."""
    return F.floor(F.unix_micros(ts) / F.lit(int(width_s * 1_000_000))).cast("bigint")


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(*fixed.TERMINAL_STATUSES), F.lit(False))


def is_legal_transition(source: Column, target: Column) -> Column:
    edges = [f"{a}>{b}" for a, b in fixed.LEGAL_EDGES]
    return F.coalesce(F.concat(source, F.lit(">"), target).isin(*edges), F.lit(False))


def status_after(event_type: Column) -> Column:
    pairs = [F.lit(x) for pair in fixed.STATUS_AFTER_EVENT.items() for x in pair]
    return F.create_map(*pairs)[event_type]


def backoff_ms(attempt: Column) -> Column:
    doublings = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(fixed.BACKOFF_MAX_DOUBLINGS))
    return (F.lit(fixed.BACKOFF_BASE_MS) * F.pow(F.lit(2.0), doublings)).cast("bigint")


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(fixed.UUID_PATTERN), F.lit(False))


def error_excerpt(text: Column) -> Column:
    """At most 200 characters (code points); longer texts end in an ellipsis."""
    cut = F.concat(F.substring(text, 1, fixed.MAX_ERROR_CHARS - 1), F.lit(fixed.ELLIPSIS))
    return F.when(F.length(text) <= fixed.MAX_ERROR_CHARS, text).otherwise(cut)


def clock_part(text: Column) -> Column:
    """``HH:MM:SS.mmm`` out of a timestamp text; the text itself when it has none."""
    found = F.regexp_extract(text, fixed.CLOCK_PATTERN, 1)
    return F.when(found != "", found).otherwise(text)


def short_id(text: Column) -> Column:
    return F.substring(text, 1, 8)


def effect_key(step_id: Column) -> Column:
    """Stable key of a step's receipt; null for anything but a UUID."""
    key = F.concat(F.lit(fixed.EFFECT_KEY_PREFIX), F.lower(step_id), F.lit(fixed.EFFECT_KEY_SUFFIX))
    return F.when(is_uuid(step_id), key)


def effect_id(key: Column) -> Column:
    """A UUID-shaped digest of the key, so that a re-run task mints the same id."""
    digest = F.sha2(key, 256)
    parts = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def paced_rate(capacity: Column) -> Column:
    hundreds = F.floor(capacity * fixed.PACED_SHARE / fixed.PACED_STEP) * fixed.PACED_STEP
    return F.greatest(F.lit(fixed.PACED_STEP).cast("bigint"), hundreds.cast("bigint"))


def canonical_json(text: Column) -> Column:
    """One text per JSON value: keys sorted, spaces gone, ``1.0`` as ``1``; null if not JSON."""
    return F.to_json(F.try_parse_json(text))
