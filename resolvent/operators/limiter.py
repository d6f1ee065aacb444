"""Anchored windows over event streams, in batch: a window opens at a key's first event and restarts at the first event
that comes a whole width later.  Each key's events are folded once, in order of time and id.

``window()`` and session windows are something else (aligned to the epoch, or closed by gaps).  A key's events must meet
in order.  Keys of up to ``busy`` events stream through sorted partitions in Arrow batches, and only the state of a batch's last
key is carried to the next.  Within a batch all keys are folded together in numpy: a round of the loop jumps every key to its
next window's first event.  Busier keys are folded in many tasks each (``anchored``), with the same result.  A check that comes
later sees only the events that earlier ones admit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchored

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000
#: Start of a window that is not open.
_NONE = -(1 << 62)


@dataclass(frozen=True)
class Limits:
    """Limits of the chain; times in microseconds.  A limit of None switches a check off."""

    transport: tuple[tuple[str, int, int], ...] = (("transport_per_minute", MINUTE, 120), ("transport_per_hour", HOUR, 1200), ("transport_per_day", DAY, 6000))
    counters: tuple[tuple[str, int, int], ...] = (("per_minute", MINUTE, 10), ("per_hour", HOUR, 60), ("per_day", DAY, 150))
    members: tuple[str, int, int] | None = ("unique_botanicals", HOUR, 30)
    cells: tuple[str, int, int] | None = ("enumeration", HOUR, 12)
    formats: tuple[str, int, int] | None = ("candidate_enumeration", HOUR, 3)


#: Limits of the cheap check in front of the central one: the same fold with the keyed counters and members alone.
PRE_CHECK = Limits(transport=(), cells=None, formats=None)


def _window_starts(first: np.ndarray, t: np.ndarray, width: int, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For events sorted by group and time: at which event each event's window begins (-1: the window that was open), and
    its start.  ``first`` has the groups' beginnings and the end, ``open_`` the open windows' starts (``_NONE``: none)."""
    n, groups = len(t), len(first) - 1
    begins = np.zeros(n, bool)
    begins[first[:-1][open_ == _NONE]] = True
    base = int(t.min()) if n else 0
    span = int(t.max()) - base + 1 if n else 1
    now = np.where(open_ == _NONE, t[first[:-1]] if n else 0, open_)
    live = np.arange(groups)
    flat = np.repeat(np.arange(groups), np.diff(first)) * span + (t - base) if span < (1 << 62) // max(groups, 1) else None
    while live.size:
        due = np.clip(now[live] + width - base, 0, span)
        if flat is not None:
            at = np.searchsorted(flat, live * span + due)
        else:
            at = np.array([first[g] + np.searchsorted(t[first[g] : first[g + 1]], base + d) for g, d in zip(live, due)], np.int64)
        keep = at < first[live + 1]
        live, at = live[keep], at[keep]
        begins[at] = True
        now[live] = t[at]
    where = np.maximum.accumulate(np.where(begins, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    group = np.repeat(np.arange(groups), np.diff(first))
    where[where < first[:-1][group]] = -1
    start = np.where(where >= 0, t[np.maximum(where, 0)], open_[group]) if n else t
    return where, start


class Fold:
    """Windows of one check, with what is open of the last key: counters as (start, n), sets as (start, members)."""

    def __init__(self, width: int):
        self.width, self.open = width, {}

    def _groups(self, group: np.ndarray, names) -> tuple[np.ndarray, np.ndarray, list]:
        first = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64), len(group)).astype(np.int64)
        held = [self.open.get(names[g]) for g in group[first[:-1]].tolist()] if self.open else [None] * (len(first) - 1)
        return first, np.array([h[0] if h else _NONE for h in held], np.int64), held

    def _last(self, group: np.ndarray, first: np.ndarray, carried) -> list[int]:
        return np.flatnonzero(carried(group[first[:-1]])).tolist()

    def count(self, group: np.ndarray, names, t: np.ndarray, carried) -> np.ndarray:
        """Which event of its window each one is, for events sorted by group and time.  The state of the groups for whose
        codes ``carried`` holds goes on to the next batch."""
        first, open_, held = self._groups(group, names)
        where, start = _window_starts(first, t, self.width, open_)
        own = np.repeat(np.arange(len(first) - 1), np.diff(first))
        before = np.array([h[1] if h else 0 for h in held], np.int64)[own]
        n = np.arange(len(t)) - np.where(where >= 0, where, first[:-1][own]) + 1 + np.where(where < 0, before, 0)
        for g in self._last(group, first, carried):
            e = first[g + 1] - 1
            self.open[names[int(group[e])]] = (int(start[e]), int(n[e]))
        return n

    def distinct(self, group: np.ndarray, names, t: np.ndarray, member: np.ndarray, members: list, carried) -> np.ndarray:
        """How many different members its window has had up to each event."""
        first, open_, held = self._groups(group, names)
        where, start = _window_starts(first, t, self.width, open_)
        own = np.repeat(np.arange(len(first) - 1), np.diff(first))
        window = np.where(where >= 0, where + len(first), own)
        new = np.zeros(len(t), bool)
        new[np.unique(window * max(1, len(members)) + member, return_index=True)[1]] = True
        for i in np.flatnonzero(new & (where < 0)).tolist():
            new[i] = members[member[i]] not in held[own[i]][1]
        so_far, begin = np.cumsum(new), np.where(where >= 0, where, first[:-1][own])
        before = np.array([len(h[1]) if h else 0 for h in held], np.int64)[own]
        size = so_far - so_far[begin] + new[begin] + np.where(where < 0, before, 0)
        for g in self._last(group, first, carried):
            e = int(first[g + 1]) - 1
            seen, at = (held[g][1], int(first[g])) if where[e] < 0 else (set(), int(where[e]))
            seen.update(members[m] for m in member[at : e + 1][new[at : e + 1]].tolist())
            self.open[names[int(group[e])]] = (int(start[e]), seen)
        return size

    def keep(self, wanted) -> None:
        """Forget the state of every other group."""
        self.open = {k: v for k, v in self.open.items() if wanted(k)}


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """Codes of a string column (null: -1) and their values."""
    d = column.dictionary_encode()
    return np.asarray(d.indices.fill_null(-1)).astype(np.int64), d.dictionary.to_pylist()


def _sorted_by(events: DataFrame, key: str, order: tuple[str, ...], columns: list[str]) -> DataFrame:
    return events.select(F.col(key).cast("string").alias("_key"), *columns).repartition("_key").sortWithinPartitions("_key", *order)


def _mapped(rows: DataFrame, columns: list[str], out: str, folded) -> DataFrame:
    """``folded(batch) -> column`` over the sorted batches; the column is named and typed by ``out``."""
    name, kind = out.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = folded()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[1:], fold(b)], [*columns, name])

    return rows.mapInArrow(run, rows.drop("_key").withColumn(name, F.lit(None).cast(kind)).schema)


def check_batch(state: dict, b: pa.RecordBatch, checks: list[tuple]) -> pa.Array:
    """Reason (null: admitted) of each event of a batch sorted by key and time.

    ``checks`` are (reason, width, most, member column or None, group column or None) in order; an event that a check
    rejects does not reach the later ones.  ``state`` holds a ``Fold`` for each check.
    """
    key, names = _codes(b.column(0).fill_null("\0"))
    t = np.asarray(b.column(1)).astype(np.int64)
    reason = np.full(b.num_rows, -1)
    last = names[key[-1]]
    for k, (_, width, most, member, by) in enumerate(checks):
        fold = state.setdefault(k, Fold(width))
        at = np.flatnonzero(reason < 0)
        code, values = _codes(b.column(member)) if member is not None else (None, None)
        if member is not None:
            at = at[code[at] >= 0]
        group, own, carried = key, names, lambda g: g == key[-1]
        if by is not None:
            inner, inner_names = _codes(b.column(by))
            at = at[inner[at] >= 0]
            group = key * max(1, len(inner_names)) + inner
            own, carried = _Pairs(names, inner_names), lambda g, w=max(1, len(inner_names)): g // w == key[-1]
            at = at[np.argsort(group[at], kind="stable")]
        n = fold.count(group[at], own, t[at], carried) if member is None else fold.distinct(group[at], own, t[at], code[at], values, carried)
        reason[at[n > most]] = k
        fold.keep((lambda x: x[0] == last) if by is not None else (lambda x: x == last))
    return pa.array([checks[r][0] if r >= 0 else None for r in reason.tolist()], pa.string())


class _Pairs:
    """Names of groups that are a key and something else."""

    def __init__(self, keys: list, inner: list):
        self.keys, self.inner = keys, inner

    def __getitem__(self, code: int) -> tuple:
        return self.keys[code // len(self.inner)], self.inner[code % len(self.inner)]


def keyed_checks(limits: Limits) -> list[tuple]:
    """The keyed checks in order; columns 2, 3 and 4 are the member, the cell and the code."""
    out = [(name, width, most, None, None) for name, width, most in limits.counters]
    if limits.members:
        out.append((*limits.members, 2, None))
    if limits.cells:
        out.append((*limits.cells, 3, None))
    if limits.formats:
        out.append((*limits.formats, 4, 3))
    return out


def transport_checks(limits: Limits) -> list[tuple]:
    return [(name, width, most, None, None) for name, width, most in limits.transport]


def micros(c: str = "ts"):
    """Microseconds of a timestamp, with or without time zone."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def _both_ways(rows: DataFrame, key: str, busy: int, calm, hot) -> DataFrame:
    """``calm`` over the rows of keys with at most ``busy`` rows, ``hot`` over the others, as one table."""
    few, many = anchored.split_busy(rows, key, busy)
    return calm(few) if many is None else calm(few).unionByName(hot(many))


def anchored_counter(events: DataFrame, key: str, width: int, ident: str = "event_id", ts: str = "ts", busy: int = anchored.BUSY) -> DataFrame:
    """Adds ``n``: how many events the key's current window has had, this one included (rejected ones count too)."""
    columns = ["_t", *events.columns]

    def folded():
        fold = Fold(width)

        def one(b: pa.RecordBatch) -> pa.Array:
            group, names = _codes(b.column(0).fill_null("\0"))
            n = fold.count(group, names, np.asarray(b.column(1)).astype(np.int64), lambda g: g == group[-1])
            fold.keep(lambda x: x == names[group[-1]])
            return pa.array(n, pa.int64())

        return one

    rows = events.withColumn("_t", micros(ts)).select(*columns)
    calm = lambda few: _mapped(_sorted_by(few, key, ("_t", ident), columns), columns, "n long", folded)
    return _both_ways(rows, key, busy, calm, lambda many: anchored.counted(many, key, width, (ident,), "n", busy)).drop("_t")


def anchored_set(events: DataFrame, key: str, member: str, width: int, ident: str = "event_id", ts: str = "ts", busy: int = anchored.BUSY) -> DataFrame:
    """Adds ``size``: how many different members the key's current window has had; a null member is one of them."""
    columns = ["_t", "_m", *events.columns]

    def folded():
        fold = Fold(width)

        def one(b: pa.RecordBatch) -> pa.Array:
            group, names = _codes(b.column(0).fill_null("\0"))
            code, members = _codes(b.column(2).fill_null("\0"))
            n = fold.distinct(group, names, np.asarray(b.column(1)).astype(np.int64), code, members, lambda g: g == group[-1])
            fold.keep(lambda x: x == names[group[-1]])
            return pa.array(n, pa.int64())

        return one

    rows = events.withColumn("_t", micros(ts)).withColumn("_m", F.col(member).cast("string")).select(*columns)
    calm = lambda few: _mapped(_sorted_by(few, key, ("_t", ident), columns), columns, "size long", folded)
    return _both_ways(rows, key, busy, calm, lambda many: anchored.distinct(many, key, "_m", width, (ident,), "size", busy)).drop("_t", "_m")


def _checked(rows: DataFrame, key: str, ident: str, columns: list[str], checks: list[tuple], busy: int) -> DataFrame:
    def folded():
        state: dict = {}
        return lambda b: check_batch(state, b, checks)

    calm = lambda few: _mapped(_sorted_by(few, key, ("_t", ident), columns), columns, "reason string", folded)
    return _both_ways(rows.select(*columns), key, busy, calm, lambda many: anchored.checked(many, key, (ident,), checks, ("_m", "_c", "_f"), busy))


def limiter_chain(events: DataFrame, limits: Limits, key: str, transport: str | None, member: str | None, cell: str | None, code: str | None, ident: str = "event_id", ts: str = "ts", busy: int = anchored.BUSY) -> DataFrame:
    """Adds ``reason`` (null: admitted).  Transport checks run first, by transport; only what they admit reaches the keyed
    checks, by key, so a transport rejection leaves the key's state untouched."""
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = events.withColumns({"_t": micros(ts), "_m": F.lower(F.trim(text(member))), "_c": text(cell), "_f": text(code)})
    own = ["_t", "_m", "_c", "_f", *events.columns]
    rejected = None
    if transport and limits.transport:
        first = _checked(rows, transport, ident, own, transport_checks(limits), busy)
        rejected = first.where("reason is not null")
        rows = first.where("reason is null").drop("reason")
    out = _checked(rows, key, ident, own, keyed_checks(limits), busy)
    out = out if rejected is None else out.unionByName(rejected)
    return out.drop("_t", "_m", "_c", "_f").withColumn("challenge", F.col("reason").eqNullSafe(limits.cells[0] if limits.cells else None))


def fan_out(events: DataFrame, transport: str, key: str, ident: str = "event_id", ts: str = "ts", bucket: int = HOUR) -> DataFrame:
    """Adds ``n_keys``: how many different keys a transport has shown so far.  A key counts at its first event.

    First events are found by an aggregate; the running number is that of earlier time buckets of ``bucket`` microseconds,
    of which a transport has few, and a running sum inside the bucket, so a busy transport is many tasks.
    """
    from pyspark.sql import Window

    place = F.struct(micros(ts).alias("t"), F.col(ident).cast("long").alias("i"))
    firsts = events.groupBy(F.col(transport).alias("_tr"), F.col(key).alias("_k")).agg(F.min(place).alias("_at"))
    same = events[transport].eqNullSafe(firsts["_tr"]) & events[key].eqNullSafe(firsts["_k"])
    rows = events.join(firsts, same, "left").withColumn("_first", (F.col("_at") == place).cast("int")).withColumn("_b", F.floor(micros(ts) / bucket)).drop("_tr", "_k", "_at")
    sums = rows.groupBy(F.col(transport).alias("_tr"), F.col("_b").alias("_bb")).agg(F.sum("_first").alias("_n"))
    earlier = Window.partitionBy("_tr").orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_tr", "_bb", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    running = Window.partitionBy(transport, "_b").orderBy(micros(ts), F.col(ident).cast("long")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(base, rows[transport].eqNullSafe(base["_tr"]) & (rows["_b"] == base["_bb"]))
    return out.withColumn("n_keys", F.col("_base") + F.sum("_first").over(running)).select(*events.columns, "n_keys")


def fresh_events(events: DataFrame, event: str, arrival: str, window_seconds: int = 60) -> DataFrame:
    """Events whose own time lies within the window of their arrival, both ways."""
    return events.where(F.abs(micros(event) - micros(arrival)) <= window_seconds * 1_000_000)
