"""Histories against a pattern: a parallel automaton over the event log.

A pattern is a deterministic automaton given as data: states and moves. An event maps
every state to the next one, and such maps compose associatively, so a history need not
be walked from its start: each task reduces the part of a step that lies in its range of
(step, xid, id) to one map, and the maps of a step's parts, one per range at most, are
composed. A step of any length is checked without ever being collected, and one with
most of the log is spread over as many tasks as its events fill.

Along with the map goes, for every state a part may begin in, the first event that has no
move, and whether generations follow the claims; both compose in the same way.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tenure.functions import fixed

DEAD = "illegal"
_NONE = -1


@dataclass(frozen=True)
class Automaton:
    """``moves``: (state, event, next state). A missing move leads to a state that is never left."""

    start: str
    accepting: tuple[str, ...]
    moves: tuple[tuple[str, str, str], ...]

    def __post_init__(self):
        if len({m[:2] for m in self.moves}) != len(self.moves):
            raise ValueError("two moves from one state on one event")
        if DEAD in self.states:
            raise ValueError(f"{DEAD!r} is the state of histories without a move")

    @property
    def states(self) -> tuple[str, ...]:
        named = [self.start, *self.accepting, *(s for a, _, b in self.moves for s in (a, b))]
        return tuple(dict.fromkeys(named))

    def table(self) -> dict[str, np.ndarray]:
        """For each event the next state's number for every state's, the dead state last."""
        number = {s: i for i, s in enumerate(self.states)}
        dead = len(number)
        out = {event: np.full(dead + 1, dead, np.int32) for _, event, _ in self.moves}
        for a, event, b in self.moves:
            out[event][number[a]] = number[b]
        return out


def lifecycle(max_attempts: int | None = None) -> Automaton:
    """Every legal history of a step that has ended, with any crashes and retries, or up to ``max_attempts`` claims."""
    if max_attempts is None:
        moves = [(a or "new", b, b) for a, b in fixed.EVENT_SUCCESSORS]
    else:
        moves = []
        for a, b in fixed.EVENT_SUCCESSORS:
            for claims in [0] if a is None else range(1, max_attempts + 1):
                after = claims + (b == fixed.STEP_CLAIMED)
                if after <= max_attempts:
                    moves.append((f"{a} {claims}" if a else "new", b, f"{b} {after}"))
    ends = tuple(dict.fromkeys(s for _, event, s in moves if event in fixed.TERMINAL_EVENT_TYPES))
    return Automaton("new", ends, tuple(moves))


def sequence(events: Iterable[str]) -> Automaton:
    """Exactly these events."""
    listed = list(events)
    return Automaton("0", (str(len(listed)),), tuple((str(i), e, str(i + 1)) for i, e in enumerate(listed)))


@dataclass
class _Parts:
    """Parts of histories, one a row: what each does to every state."""

    n: np.ndarray
    to: np.ndarray  # next state for each state
    bad: np.ndarray  # id of the first event without a move, for each state
    claims: np.ndarray
    base: np.ndarray  # claims before the part, as its first generation says
    steady: np.ndarray  # its other generations agree with that

    def pick(self, rows) -> _Parts:
        return _Parts(*(x[rows] for x in vars(self).values()))

    def then(self, other: _Parts) -> _Parts:
        later = np.take_along_axis(other.bad, self.to, axis=1)
        return _Parts(
            self.n + other.n,
            np.take_along_axis(other.to, self.to, axis=1),
            np.where(self.bad != _NONE, self.bad, later),
            self.claims + other.claims,
            self.base,
            self.steady & other.steady & (other.base == self.base + self.claims),
        )

    @staticmethod
    def joined(parts: list[_Parts]) -> _Parts:
        return _Parts(*(np.concatenate(x) for x in zip(*(vars(p).values() for p in parts), strict=True)))


def _reduced(parts: _Parts, starts: np.ndarray) -> _Parts:
    """One part for each run of rows beginning at ``starts``, composed pairwise."""
    sizes = np.diff(np.append(starts, len(parts.n)))
    while len(sizes) and sizes.max() > 1:
        begin = np.cumsum(sizes) - sizes
        place = np.arange(len(parts.n)) - np.repeat(begin, sizes)
        left = np.flatnonzero(place % 2 == 0)
        paired = place[left] + 1 < np.repeat(sizes, (sizes + 1) // 2)
        both = parts.pick(left[paired]).then(parts.pick(left[paired] + 1))
        order = np.argsort(np.concatenate([left[paired], left[~paired]]), kind="stable")
        parts = _Parts.joined([both, parts.pick(left[~paired])]).pick(order)
        sizes = (sizes + 1) // 2
    return parts


_PART = "xid long, id long, n long, to array<int>, bad array<long>, claims long, base long, steady boolean"


def _batch(step, xid, id_, parts: _Parts) -> pa.RecordBatch:
    k = parts.to.shape[1]
    ends = pa.array(np.arange(len(parts.n) + 1, dtype=np.int32) * k)
    return pa.RecordBatch.from_arrays(
        [step, pa.array(xid), pa.array(id_), pa.array(parts.n), pa.ListArray.from_arrays(ends, pa.array(parts.to.ravel())),
         pa.ListArray.from_arrays(ends, pa.array(parts.bad.ravel())), pa.array(parts.claims), pa.array(parts.base), pa.array(parts.steady)],
        names=["step_id", "xid", "id", "n", "to", "bad", "claims", "base", "steady"],
    )


def _composed(read):
    """Sorted rows, each a part, reduced to one part per step; only the last step's part is held between batches."""

    def run(batches):
        held = None  # (step, xid, id, parts) of the open step
        for b in batches:
            if not b.num_rows:
                continue
            step, xid, id_, parts = b.column("step_id"), b.column("xid").to_numpy(), b.column("id").to_numpy(), read(b)
            if held is not None:
                step = pa.concat_arrays([held[0], step])
                xid, id_ = np.concatenate([held[1], xid]), np.concatenate([held[2], id_])
                parts = _Parts.joined([held[3], parts])
            plain = step.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
            step, xid, id_, parts = step.take(pa.array(starts)), xid[starts], id_[starts], _reduced(parts, starts)
            held = (step[-1:], xid[-1:], id_[-1:], parts.pick(slice(-1, None)))
            if len(starts) > 1:
                yield _batch(step[:-1], xid[:-1], id_[:-1], parts.pick(slice(0, -1)))
        if held is not None:
            yield _batch(*held)

    return run


def _of_events(table: dict[str, np.ndarray], width: int):
    symbols = list(table)
    maps = np.array([*table.values(), np.full(width, width - 1)], np.int32).reshape(-1, width)  # any other event has no move

    def read(b: pa.RecordBatch) -> _Parts:
        known = pc.index_in(b.column("symbol"), value_set=pa.array(symbols, pa.string()))
        to = maps[known.fill_null(len(symbols)).to_numpy(zero_copy_only=False)]
        id_ = b.column("id").to_numpy()
        dead = width - 1
        fresh = (to == dead) & (np.arange(width) != dead)
        claims = b.column("claim").to_numpy(zero_copy_only=False).astype(np.int64)
        named = b.column("lease_version").fill_null(np.iinfo(np.int32).min).to_numpy(zero_copy_only=False).astype(np.int64)
        return _Parts(np.ones(len(id_), np.int64), to, np.where(fresh, id_[:, None], _NONE), claims, named - claims, np.ones(len(id_), bool))

    return read


def _of_parts(width: int):
    def read(b: pa.RecordBatch) -> _Parts:
        wide = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        plain = lambda c: b.column(c).to_numpy(zero_copy_only=False)
        return _Parts(plain("n"), wide("to"), wide("bad"), plain("claims"), plain("base"), plain("steady"))

    return read


def matches(events: DataFrame, pattern: Automaton, symbol: Column | None = None, parts: int | None = None) -> DataFrame:
    """Each step's history in (xid, id) order against ``pattern``.

    n_events; state after the last event; accepted; first_illegal_id, the event that had
    no move, null if all had one; generations_ok, whether every event's generation is the
    number of claims so far. ``symbol`` is what a move reads, the event type by default;
    a null or unknown one has no move. Events without a step are left out; ids are not
    negative. ``parts`` ranges share the work; it changes no result.
    """
    key = StructField("step_id", events.schema["step_id"].dataType)
    schema = StructType([key, *StructType.fromDDL(_PART).fields])
    table, width = pattern.table(), len(pattern.states) + 1
    rows = events.where(F.col("step_id").isNotNull()).select(
        "step_id", "xid", "id", (F.col("event_type") if symbol is None else symbol).alias("symbol"),
        F.coalesce(F.col("event_type") == fixed.STEP_CLAIMED, F.lit(False)).alias("claim"), F.col("lease_version").cast("int").alias("lease_version"),
    )
    order = ["step_id", "xid", "id"]
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    cut = dealt.sortWithinPartitions(*order).mapInArrow(_composed(_of_events(table, width)), schema)
    # One row for each step and range that holds some of it.
    whole = cut.repartition("step_id").sortWithinPartitions(*order).mapInArrow(_composed(_of_parts(width)), schema)
    states = F.array(*[F.lit(s) for s in (*pattern.states, DEAD)])
    state = F.element_at(states, F.col("to")[0] + 1)
    return whole.select(
        "step_id",
        F.col("n").alias("n_events"),
        state.alias("state"),
        F.coalesce(state.isin(*pattern.accepting), F.lit(False)).alias("accepted"),
        F.when(F.col("bad")[0] != _NONE, F.col("bad")[0]).alias("first_illegal_id"),
        (F.col("steady") & (F.col("base") == 0)).alias("generations_ok"),
    )
