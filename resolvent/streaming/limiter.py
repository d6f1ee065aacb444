"""The limits as stateful streams, in order of arrival or in order of event time.

A query has one pass by transport and one by key: the transport pass writes its result, a table or files, and the keyed pass is
a stream of it.  State is kept check by check in RocksDB: the open window of a group of a check (start and number) in one map,
and for sets the members with the start of the window they belong to in another.  Only entries that an event touches are read
and written; a member whose start is not the open one belongs to a window that is over, so a new window clears nothing.

``limited_stream`` and ``transport_stream`` trust the order of arrival, as the published limits do: rows of an Arrow batch of a
key are folded by time and id, batches as they come.  Every entry has a time to live of its own window's width since its last
change, which bounds the store by what is active; no eviction by number of keys is needed, as the store spills to disk.

``settled_stream`` trusts event time: events wait in a list until the watermark has passed them, a timer wakes the key, and what
is due is folded in order of time and id, so arrival in any order within the watermark's delay gives the batch result.  Events
behind the watermark touch no state and come out as ``late``.  There, windows that are over go when the key wakes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.limiter import Limits, keyed_checks, micros, transport_checks

#: Columns of a check's member and group, by their place in batch rows (see ``limiter.keyed_checks``).
_FIELD = {2: "m", 3: "c", 4: "f"}
LATE = "late"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def durable_store(spark: SparkSession) -> None:
    """State in RocksDB, which these streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class Windows:
    """Windows of the checks of one kind of key, over state maps that the handle gives."""

    def __init__(self, handle: StatefulProcessorHandle, checks: list[tuple], live: bool):
        self.checks = checks
        ttl = lambda width: max(1, width // 1000) if live else None
        self.open = [handle.getMapState(f"open{i}", "g string", "start long, n long", ttl(w)) for i, (_, w, *_) in enumerate(checks)]
        self.seen = [handle.getMapState(f"seen{i}", "g string, m string", "start long", ttl(c[1])) if c[3] is not None else None for i, c in enumerate(checks)]
        self.begin()

    def begin(self) -> None:
        """Forget what was read of another key."""
        self.windows: dict[tuple[int, str], tuple[int, int]] = {}
        self.members: dict[tuple[int, str, str], int | None] = {}
        self.changed: set = set()

    def _window(self, i: int, group: str) -> tuple[int, int] | None:
        if (i, group) not in self.windows:
            own = self.open[i].getValue((group,))
            if own is None:
                return None
            self.windows[i, group] = (int(own[0]), int(own[1]))
        return self.windows[i, group]

    def _is_new(self, i: int, group: str, member: str, start: int) -> bool:
        if (i, group, member) not in self.members:
            own = self.seen[i].getValue((group, member))
            self.members[i, group, member] = None if own is None else int(own[0])
        return self.members[i, group, member] != start

    def reason(self, t: int, row: dict) -> str | None:
        """The first check that fails, in order; later ones are not touched."""
        for i, (name, width, most, member, by) in enumerate(self.checks):
            value = row[_FIELD[member]] if member is not None else None
            group = row[_FIELD[by]] if by is not None else ""
            if (member is not None and value is None) or group is None:
                continue
            own = self._window(i, group)
            start, n = own if own is not None and t - own[0] < width else (t, 0)
            if member is None:
                n += 1
            elif self._is_new(i, group, value, start):
                n += 1
                self.members[i, group, value] = start
                self.changed.add((i, group, value))
            if own != (start, n):
                self.windows[i, group] = (start, n)
                self.changed.add((i, group))
            if n > most:
                return name
        return None

    def save(self) -> None:
        """Write the entries that have changed."""
        for key in self.changed:
            if len(key) == 2:
                self.open[key[0]].updateValue((key[1],), self.windows[key])
            else:
                self.seen[key[0]].updateValue(key[1:], (self.members[key],))
        self.changed.clear()

    def drop_over(self, now: int) -> None:
        """Remove the windows, and their members, that no event at ``now`` or later can be in."""
        for i, (_, width, _, member, _) in enumerate(self.checks):
            for key, own in list(self.open[i].iterator()):
                if now - own[0] >= width:
                    self.open[i].removeKey(key)
            for key, own in list(self.seen[i].iterator()) if member is not None else []:
                if now - own[0] >= width:
                    self.seen[i].removeKey(key)


def _records(frame: pd.DataFrame) -> Iterator[dict]:
    for r in frame.sort_values(["t", "id"], kind="stable").to_dict("records"):
        yield {k: (None if v is None or v is pd.NA or v != v else v) for k, v in r.items()}


def _frame(events: list, reasons: list) -> pd.DataFrame:
    return pd.DataFrame({"event": pd.Series(events, dtype="object"), "reason": pd.Series(reasons, dtype="object")})


class Arriving(StatefulProcessor):
    """Folds events as they arrive."""

    def __init__(self, checks: list[tuple]):
        self.checks = checks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.own = Windows(handle, self.checks, live=True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.own.begin()
        for frame in rows:
            events, reasons = [], []
            for r in _records(frame):
                events.append(r["event"])
                reasons.append(r["reason"] if r["reason"] is not None else self.own.reason(int(r["t"]), r))
            yield _frame(events, reasons)
        self.own.save()

    def close(self) -> None:
        pass


class Settled(StatefulProcessor):
    """Folds events when the watermark has passed them."""

    _ROW = "t long, id long, m string, c string, f string, reason string, event string"
    _NAMES = ["t", "id", "m", "c", "f", "reason", "event"]

    def __init__(self, checks: list[tuple]):
        self.checks = checks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.own = handle, Windows(handle, self.checks, live=False)
        self.waiting = handle.getListState("waiting", self._ROW)
        self.due = handle.getValueState("due", "at long")

    def _wake(self, at: int) -> None:
        """One timer a key, at the earliest event that waits."""
        held = self.due.get() if self.due.exists() else None
        if held is None or at < held[0]:
            if held is not None:
                self.handle.deleteTimer(int(held[0]))
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        earliest, late = None, []
        for frame in rows:
            for r in _records(frame):
                at = int(r["t"]) // 1000
                if at < passed:
                    late.append(r["event"])
                else:
                    self.waiting.appendValue(tuple(r[c] for c in self._NAMES))
                    earliest = at if earliest is None else min(at, earliest)
        if earliest is not None:
            self._wake(earliest + 1)
        yield _frame(late, [LATE] * len(late))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [dict(zip(self._NAMES, r)) for r in self.waiting.get()]
        ready = sorted((r for r in held if r["t"] // 1000 < passed), key=lambda r: (r["t"], r["id"]))
        rest = [r for r in held if r["t"] // 1000 >= passed]
        self.own.begin()
        reasons = [r["reason"] if r["reason"] is not None else self.own.reason(int(r["t"]), r) for r in ready]
        self.own.save()
        self.own.drop_over(passed * 1000)
        self.due.clear()
        if rest:
            self.waiting.put([tuple(r[c] for c in self._NAMES) for r in rest])
            self._wake(min(r["t"] for r in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        yield _frame([r["event"] for r in ready], reasons)

    def close(self) -> None:
        pass


def _passed(events: DataFrame, by: str, processor: StatefulProcessor, mode: str, member: str | None, cell: str | None, code: str | None, reason: str | None, ident: str, ts: str) -> DataFrame:
    """``(ident, reason)`` and the other columns of the events after one pass; what has a reason already touches no state."""
    durable_store(events.sparkSession)
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = events.select(F.coalesce(F.col(by).cast("string"), F.lit("\0")).alias("k"), F.col(ident).cast("long").alias("id"), micros(ts).alias("t"), F.lower(F.trim(text(member))).alias("m"), text(cell).alias("c"), text(code).alias("f"), text(reason).alias("reason"), F.to_json(F.struct(*events.columns)).alias("event"))
    out = rows.groupBy("k").transformWithStateInPandas(processor, "event string, reason string", "Append", mode)
    kept = [c for c in events.columns if c != reason]
    return out.select(F.from_json("event", events.schema).alias("e"), "reason").select(*[F.col(f"e.{c}").alias(c) for c in kept], "reason")


def transport_stream(events: DataFrame, limits: Limits, transport: str, ident: str = "event_id", ts: str = "ts") -> DataFrame:
    """The events with the ``reason`` of the transport checks (null: admitted)."""
    return _passed(events, transport, Arriving(transport_checks(limits)), "ProcessingTime", None, None, None, None, ident, ts)


def limited_stream(events: DataFrame, limits: Limits, key: str, member: str | None = None, cell: str | None = None, code: str | None = None, reason: str | None = None, ident: str = "event_id", ts: str = "ts") -> DataFrame:
    """The events with the ``reason`` of the keyed checks, by key; those that the column ``reason`` of an earlier pass rejects
    keep theirs and leave the key's state untouched."""
    return _passed(events, key, Arriving(keyed_checks(limits)), "ProcessingTime", member, cell, code, reason, ident, ts)


def settled_stream(events: DataFrame, limits: Limits, key: str, delay: str, member: str | None = None, cell: str | None = None, code: str | None = None, reason: str | None = None, transport: bool = False, ident: str = "event_id", ts: str = "ts") -> DataFrame:
    """As ``limited_stream`` (``transport_stream`` with ``transport``), but in order of event time: an event comes out once the
    watermark, ``delay`` behind the newest one, has passed it; one that arrives behind the watermark comes out as ``late``."""
    stamped = events.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", delay).drop("__at")
    checks = transport_checks(limits) if transport else keyed_checks(limits)
    return _passed(stamped, key, Settled(checks), "EventTime", member, cell, code, reason, ident, ts)


def counted_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Watermarked event-time counts, for monitoring beside the limits; events later than ``late`` are dropped."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return stamped.groupBy(F.window("_ts", width), key).count().select(F.col("window.start").alias("start"), key, F.col("count").alias("n"))
