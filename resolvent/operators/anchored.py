"""Anchored windows of busy keys: where each window starts is found by a parallel prefix over time, so that a key's events are
folded in as many tasks as they fill.

The next window of a start ``s`` begins at the first event at ``s + width`` or later, so every event points to another one, and
the windows that are really open are the path from the key's first event.  Time is cut into cells of one width from there on; a path has one
event in a cell at most.  Groups of 1, 2, 4 ... cells are composed level by level: an event that may be the first of the path
in its group points to the first one behind the group.  Only events of a group's first cell, and the first event behind that
cell, can be such, and in a key's first group only its first event, so each level has about half the rows of the one before and
the last one a row a key.  When a key's pointers are few enough for one task its
path over the large groups is walked there, and the levels are gone back to fill in what lies inside the groups.

With the starts known a counter is a running number and a set the running number of first members, both by ``scan``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import scan

#: Most events of a key that one task folds; keys with more take the way of this module.
BUSY = 1_000_000


def split_busy(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of keys with at most ``most`` rows, and those of the others, or None if there are none.  A null key is a key."""
    busy = cut_lineage(rows.groupBy(F.col(key).alias("__busy")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select("__busy"))
    if busy.isEmpty():
        return rows, None
    same = rows[key].eqNullSafe(busy["__busy"])
    return rows.join(busy, same, "left_anti"), rows.join(busy, same, "left_semi")


def _cell(t: Column, width: int, level: int = 0) -> Column:
    """Number of the group of ``2 ** level`` cells that a time lies in."""
    size = F.lit(width << level)
    return ((t - F.pmod(t, size)) / size).cast("long")


def _pointers(times: DataFrame, width: int, partitions: int | None) -> DataFrame:
    """``times(k, t)``, distinct -> ``(k, t, p)``: the first time at ``t + width`` or later of the same key."""
    events = times.select("k", F.col("t").alias("x"), F.lit(0).alias("kind"))
    asked = times.select("k", (F.col("t") + width).alias("x"), F.lit(1).alias("kind"))
    rows = scan.ordered(events.unionByName(asked), ["k"], [F.col("x").desc(), "kind"], partitions)
    seen = scan.carried(rows, ["k"], F.when(F.col("kind") == 0, F.col("x")), "p")
    return seen.where("kind = 1").select("k", (F.col("x") - width).alias("t"), "p")


def _walk(top: DataFrame) -> DataFrame:
    """``top(k, t, p, first)``, few rows a key -> ``(k, t)``: the path from the key's first event."""

    def one(table: pa.Table) -> pa.Table:
        to = dict(zip(table["t"].to_pylist(), table["p"].to_pylist()))
        at, path = table["first"][0].as_py(), []
        while at is not None:
            path.append(at)
            at = to[at]
        return pa.table({"k": pa.array([table["k"][0].as_py()] * len(path), pa.string()), "t": pa.array(path, pa.int64())})

    return top.groupBy("k").applyInArrow(one, "k string, t long")


def window_starts(times: DataFrame, width: int, most: int = BUSY, partitions: int | None = None) -> DataFrame:
    """``times(k string, t long)`` -> ``(k, t)``: the times at which a window of ``width`` opens.

    ``most`` is the number of pointers of a key that one task walks along."""
    distinct = times.distinct()
    firsts = distinct.groupBy("k").agg(F.min("t").alias("first"))
    levels = [cut_lineage(_pointers(distinct, width, partitions).join(firsts, "k").select("k", "t", "p", "first"))]
    since = lambda c: F.col(c) - F.col("first")
    while True:
        now, level = levels[-1], len(levels)
        if (now.groupBy("k").count().agg(F.max("count")).first()[0] or 0) <= most:
            break
        group = _cell(since("t"), width, level)
        head = F.pmod(_cell(since("t"), width), F.lit(1 << level)) == 0
        behind = now.where(~head).groupBy("k", group.alias("g")).agg(F.min("t").alias("b"))
        entry = F.when(F.col("g") == 0, F.col("t") == F.col("first")).otherwise(head | F.coalesce(F.col("t") == F.col("b"), F.lit(False)))
        entries = now.withColumn("g", group).join(behind, ["k", "g"], "left").where(entry).select("k", "t", "p", "first")
        on = now.select(F.col("k").alias("fk"), F.col("t").alias("f"), F.col("p").alias("far"))
        inside = _cell(since("p"), width, level) == group
        joined = entries.join(on, (F.col("k") == F.col("fk")) & (F.col("p") == F.col("f")), "left")
        levels.append(cut_lineage(joined.select("k", "t", F.when(inside, F.col("far")).otherwise(F.col("p")).alias("p"), "first")))
    starts = cut_lineage(_walk(levels[-1]))
    for level in range(len(levels) - 1, 0, -1):
        below = starts.join(levels[level - 1], ["k", "t"])
        inner = below.where(_cell(since("p"), width, level) == _cell(since("t"), width, level)).select("k", F.col("p").alias("t"))
        starts = cut_lineage(starts.unionByName(inner))
    return starts


def opened(events: DataFrame, key: str, width: int, order: tuple[str, ...], most: int = BUSY, partitions: int | None = None) -> DataFrame:
    """Adds ``__start``, when the event's window opened; in the order of key, ``_t`` and ``order``, many tasks a key."""
    own = events.withColumn("__k", F.coalesce(F.col(key).cast("string"), F.lit("\0")))
    starts = window_starts(own.select(F.col("__k").alias("k"), F.col("_t").alias("t")), width, most, partitions)
    marks = starts.select(F.col("k").alias("__k"), F.col("t").alias("_t"), F.lit(0).alias("__event"))
    both = own.withColumn("__event", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    rows = scan.ordered(both, ["__k"], ["_t", "__event", *order], partitions)
    return scan.carried(rows, ["__k"], F.when(F.col("__event") == 0, F.col("_t")), "__start")


def counted(events: DataFrame, key: str, width: int, order: tuple[str, ...], name: str, most: int = BUSY, partitions: int | None = None) -> DataFrame:
    """Adds ``name``: how many events the window has had, the event included."""
    rows = opened(events, key, width, order, most, partitions)
    return scan.carried(rows, ["__k", "__start"], "__event", name, "sum").where("__event = 1").select(*events.columns, name)


def distinct(events: DataFrame, key: str, member: str, width: int, order: tuple[str, ...], name: str, most: int = BUSY, partitions: int | None = None) -> DataFrame:
    """Adds ``name``: how many different members the window has had; a null member is one of them."""
    rows = cut_lineage(opened(events, key, width, order, most, partitions).where("__event = 1").withColumn("__u", F.monotonically_increasing_id()))
    firsts = rows.groupBy("__k", "__start", F.col(member).alias("__m")).agg(F.min("__u").alias("__u")).select("__u", F.lit(1).alias("__new"))
    again = scan.ordered(rows.join(firsts, "__u", "left"), ["__k", "__start"], ["__u"], partitions)
    return scan.carried(again, ["__k", "__start"], "__new", name, "sum").select(*events.columns, name)


def checked(events: DataFrame, key: str, order: tuple[str, ...], checks: list[tuple], columns: tuple[str, ...], most: int = BUSY, partitions: int | None = None) -> DataFrame:
    """Adds ``reason`` as ``limiter.check_batch`` does: the first check that an event fails; later checks do not see it.

    ``checks`` are (reason, width, most, member, by) with places in batch rows; ``columns`` are the names of places 2, 3 and 4."""
    rest, out = events, []
    for reason, width, limit, member, by in checks:
        seen, skipped = rest, None
        needed = [columns[i - 2] for i in (member, by) if i is not None]
        if needed:
            has = F.lit(True)
            for c in needed:
                has = has & F.col(c).isNotNull()
            seen, skipped = rest.where(has), rest.where(~has)
        own = seen.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit("\0")))
        if by is not None:
            own = own.withColumn("__key", F.to_json(F.struct(F.col("__key").alias("k"), F.col(columns[by - 2]).alias("c"))))
        n = counted(own, "__key", width, order, "__n", most, partitions) if member is None else distinct(own, "__key", columns[member - 2], width, order, "__n", most, partitions)
        n = cut_lineage(n.drop("__key"))
        out.append(n.where(F.col("__n") > limit).drop("__n").withColumn("reason", F.lit(reason)))
        rest = n.where(F.col("__n") <= limit).drop("__n")
        rest = rest if skipped is None else rest.unionByName(skipped)
    done = rest.withColumn("reason", F.lit(None).cast("string"))
    for x in out:
        done = done.unionByName(x)
    return done
