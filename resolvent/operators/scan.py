"""Scans over an order: carry-forward, running sums and numbering of rows that lie in many tasks.

A Spark window brings each of its partitions into one task, so one long file, one busy key or the whole table would be a single
task.  Here rows are range-partitioned by key and order and written once; each partition then says in one row what it begins
and ends with, the driver combines these rows (one for each partition) into what enters each partition, and a second pass fills
every partition on its own.  No task holds more than a batch and what is carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Names of the helper columns; ``PART`` stays in the frames of ``ordered`` and says which partition a row was dealt to.
_VALUE, PART = "__value", "__part"


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence, partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by keys and order, and cut from its lineage, so that its partitions stay what they are.

    The order should tell rows apart, since equal rows are never split.  Adds ``PART``, which ``carried`` needs."""
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return cut_lineage(dealt.sortWithinPartitions(*by).withColumn(PART, F.spark_partition_id()))


def _segments(columns: Sequence[pa.Array], n: int) -> np.ndarray:
    """Which rows of a batch differ from the row before in one of the key columns; nulls are equal.  The first row does not."""
    new = np.zeros(n, bool)
    for c in columns:
        codes = np.asarray(c.dictionary_encode(null_encoding="encode").indices)
        new[1:] |= codes[1:] != codes[:-1]
    return new


class _Last:
    """Carries the last value that is not null."""

    @staticmethod
    def empty():
        return None

    @staticmethod
    def join(before, own):
        return before if own is None else own

    @staticmethod
    def fill(values: pa.Array, begin: np.ndarray, carried) -> tuple[pa.Array, object]:
        """Filled values, and what the last segment carries on; ``begin`` says at which row each row's segment begins, -1 for
        the one that is open at the first row."""
        n = len(values)
        at = np.where(values.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1)
        at = np.maximum.accumulate(at)
        at[at < begin] = -1
        out = values.take(pa.array(np.where(at < 0, 0, at), mask=at < 0))
        if carried is not None:
            out = pc.if_else(pa.array((at < 0) & (begin < 0)), pa.scalar(carried, values.type), out)
        return out, out[n - 1].as_py()


class _Sum:
    """Carries the sum of a long column; a null counts as zero."""

    @staticmethod
    def empty():
        return 0

    @staticmethod
    def join(before, own):
        return before + own

    @staticmethod
    def fill(values: pa.Array, begin: np.ndarray, carried) -> tuple[pa.Array, object]:
        x = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(x)
        base = np.where(begin > 0, total[np.maximum(begin, 1) - 1], 0)
        out = total - base + np.where(begin < 0, carried, 0)
        return pa.array(out, pa.int64()), int(out[-1])


_KINDS = {"last": _Last, "sum": _Sum}


class _Run:
    """State of one partition's scan: the key of its open segment and what is carried in it."""

    def __init__(self, kind: str, carried=None, known: bool = False):
        self.op, self.key = _KINDS[kind], None
        self.started = False
        self.carried = carried if known else self.op.empty()
        self.first_key, self.single = None, True

    def step(self, keys: Sequence[pa.Array], values: pa.Array) -> pa.Array:
        n = len(values)
        new = _segments(keys, n)
        head = tuple(k[0].as_py() for k in keys)
        if self.started and head != self.key:
            new[0] = True
        if not self.started:
            self.first_key, self.started = head, True
        begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        self.single &= not new.any()
        out, self.carried = self.op.fill(values, begin, self.carried)
        self.key = tuple(k[n - 1].as_py() for k in keys)
        return out


def _entering(ends: Sequence, kind: str, parts: int) -> list:
    """What enters each partition: ``ends`` has (part, first key, last key, single, carried) of those with rows."""
    op = _KINDS[kind]
    out, key, carried = [op.empty()] * parts, None, op.empty()
    known = False
    for part, first, last, single, own in sorted(ends, key=lambda e: e[0]):
        enters = carried if known and first == key else op.empty()
        out[part] = enters
        carried = op.join(enters, own) if single else own
        key, known = last, True
    return out


def carried(rows: DataFrame, keys: Sequence[str], value, name: str, kind: str = "last") -> DataFrame:
    """Adds ``name`` to ``rows``, a frame of ``ordered`` (or a projection of one) sorted by ``keys`` first.

    ``last``: the last value, up to and with the row itself, that is not null within the row's keys; null before the first one.
    ``sum``: the running sum of the value within the keys.  Without keys the whole table is one segment.  An empty table stays
    empty; null keys are a key of their own.
    """
    source = rows.withColumn(_VALUE, F.col(value) if isinstance(value, str) else value)
    if kind == "sum":
        source = source.withColumn(_VALUE, F.col(_VALUE).cast("long"))
    columns = rows.columns
    at, part = [columns.index(k) for k in keys], columns.index(PART)
    types = {f.name: f.dataType for f in source.schema}
    ddl = [f"__f{i} {types[k].simpleString()}, __l{i} {types[k].simpleString()}" for i, k in enumerate(keys)]
    carries = types[_VALUE].simpleString()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last = _Run(kind), None
        for b in batches:
            if b.num_rows:
                run.step([b.column(i) for i in range(len(at))], b.column(len(at)))
                last = b
        if last is not None:
            cols = [last.column(len(at) + 1)[:1], pa.array([run.single]), pa.array([run.carried], last.column(len(at)).type)]
            names = [PART, "__single", _VALUE]
            for i in range(len(at)):
                cols += [pa.array([run.first_key[i]], last.schema.field(i).type), pa.array([run.key[i]], last.schema.field(i).type)]
                names += [f"__f{i}", f"__l{i}"]
            yield pa.RecordBatch.from_arrays(cols, names)

    told = source.select(*keys, _VALUE, PART).mapInArrow(ends, ", ".join([f"{PART} int, __single boolean, {_VALUE} {carries}", *ddl])).collect()
    k = len(keys)
    gathered = [(r[PART], tuple(r[f"__f{i}"] for i in range(k)), tuple(r[f"__l{i}"] for i in range(k)), r["__single"], r[_VALUE]) for r in told]
    enters = rows.sparkSession.sparkContext.broadcast(_entering(gathered, kind, 1 + max((g[0] for g in gathered), default=0)))
    width = len(columns)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = None
        for b in batches:
            if b.num_rows:
                run = run or _Run(kind, enters.value[b.column(part)[0].as_py()], True)
                out = run.step([b.column(i) for i in at], b.column(width))
                yield pa.RecordBatch.from_arrays([*b.columns[:width], out], [*columns, name])

    return source.mapInArrow(fill, rows.withColumn(name, F.lit(None).cast(carries)).schema)


def numbered(df: DataFrame, order: Sequence, name: str = "place", partitions: int | None = None) -> DataFrame:
    """Adds each row's place, from 1, in the order of the whole table: no task sees more than its own range."""
    return carried(ordered(df, [], order, partitions), [], F.lit(1), name, "sum").drop(PART)
