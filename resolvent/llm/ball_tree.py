"""Centroid clustering by filtering centroids through ball trees.

Vectors become integers once.  Each task turns its vectors, a block at a time, into ball trees: a ball has its count, the
integer sum of its vectors, and the radius around its mean that holds them all.  The trees are written once and stay where they
are; a round sends the centroids to them and gets sums and counts back.  By the triangle inequality a centroid that is farther
from a ball's mean than the nearest one by more than twice the radius owns none of its vectors.  A ball with one centroid left
is assigned whole, by its sum and count; a leaf with several is decided exactly, vector by vector, in integers.

Distances to balls are floating-point numbers with a margin for rounding; only strictly farther centroids are left out, so ties
are always decided exactly.  Components of at most ``NARROW`` in size are exact in 64-bit floating point through every product
and sum; vectors with larger ones are kept beside the trees and compared in Python's integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import tune, written

#: Most vectors of a tree, and of a leaf whose vectors differ.
BLOCK, LEAF = 4096, 16
#: Largest size of a component, centroids included, for which 64-bit floating point is exact.
NARROW = 1 << 22
#: Components of this size and beyond cannot come from 32-bit floats and count as not finite.
TOO_LARGE = 2.0**140
#: Sums travel as signed limbs of LIMB bits each.
LIMB, LIMBS = 40, 6
LONG_MAX = (1 << 63) - 1


def build(q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ball tree of the rows of ``q`` -> (order, start, end, left, right, radius, sums).

    Balls are numbered top-down; a leaf has no children (-1).  A ball is split in halves along the line between two vectors far
    apart; a ball of equal vectors stays a leaf of any size.
    """
    order = np.arange(len(q))
    start, end, left, right, radius, total = [], [], [], [], [], []
    todo = [(0, len(q), -1, 0)]
    while todo:
        i, j, parent, side = todo.pop()
        me = len(start)
        if parent >= 0:
            (left if side == 0 else right)[parent] = me
        own = q[order[i:j]].astype(np.float64)
        s = own.sum(axis=0)
        away = ((own - s / (j - i)) ** 2).sum(axis=1)
        start.append(i), end.append(j), left.append(-1), right.append(-1), radius.append(float(np.sqrt(away.max()))), total.append(s)
        if j - i <= LEAF or (own == own[0]).all():
            continue
        a = own[int(away.argmax())]
        b = own[int(((own - a) ** 2).sum(axis=1).argmax())]
        along = own @ (b - a)
        half = (j - i) // 2
        order[i:j] = order[i:j][np.argpartition(along, half)]
        todo += [(i + half, j, me, 1), (i, i + half, me, 0)]
    return order, *(np.array(x, np.int32) for x in (start, end, left, right)), np.array(radius), np.array(total).astype(np.int64)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each centroid, exact: int64, or Python integers where they may not fit."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), np.int64)
    if q.dtype != object and c.dtype != object:
        x, y = q.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]).astype(np.int64)
    x, y = q.astype(object), c.astype(object)
    return np.stack([((x - y[k]) ** 2).sum(axis=1) for k in range(len(y))], axis=1)


def nearest(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; of equally near ones the smaller number."""
    d = _exact(q, c)
    k = d.argmin(axis=1) if len(q) else np.zeros(0, np.int64)
    return k.astype(np.int64), d[np.arange(len(q)), k]


class Tree:
    """A stored ball tree; ``q`` holds its vectors in tree order."""

    def __init__(self, q, start, end, left, right, radius, sums):
        self.q, self.start, self.end, self.left, self.right, self.radius, self.sums = q, start, end, left, right, radius, sums
        self.count = end - start

    def filtered(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(balls, centroid) of the balls that are assigned whole, and the leaves that several centroids may share."""
        y = c.astype(np.float64)
        mean = self.sums / self.count[:, None]
        d2 = (mean * mean).sum(axis=1)[:, None] - 2 * (mean @ y.T) + (y * y).sum(axis=1)[None, :]
        slack = 1e-9 * ((mean * mean).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] + 1)
        low, high = np.sqrt(np.maximum(d2 - slack, 0)), np.sqrt(np.maximum(d2, 0) + slack)
        r = self.radius[:, None] * (1 + 1e-9) + 1e-9
        alive = np.zeros(low.shape, bool)
        whole, owner, leaves = [], [], []
        level = np.array([0])
        alive[0] = True
        while level.size:
            near = np.where(alive[level], high[level], np.inf).min(axis=1)
            own = alive[level] & (low[level] - r[level] <= near[:, None] + r[level])
            one = own.sum(axis=1) == 1
            whole.append(level[one])
            owner.append(own[one].argmax(axis=1))
            rest, own = level[~one], own[~one]
            inner = self.left[rest] >= 0
            leaves.append(rest[~inner])
            alive[self.left[rest[inner]]] = own[inner]
            alive[self.right[rest[inner]]] = own[inner]
            level = np.concatenate([self.left[rest[inner]], self.right[rest[inner]]])
        return np.concatenate(whole), np.concatenate(owner), np.concatenate(leaves)

    def members(self, balls: np.ndarray) -> np.ndarray:
        """Places in ``q`` of the vectors of some balls, ball by ball."""
        n = self.count[balls].astype(np.int64)
        return np.arange(n.sum()) + np.repeat(self.start[balls] - (np.cumsum(n) - n), n)

    def assign(self, c: np.ndarray) -> np.ndarray:
        """Nearest centroid of each vector."""
        out = np.zeros(len(self.q), np.int64)
        whole, owner, leaves = self.filtered(c)
        out[self.members(whole)] = np.repeat(owner, self.count[whole])
        at = self.members(leaves)
        out[at] = nearest(self.q[at], c)[0]
        return out

    def totals(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, sums) by centroid: whole balls by what they store, the rest exactly."""
        n, s = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        whole, owner, leaves = self.filtered(c)
        np.add.at(n, owner, self.count[whole])
        np.add.at(s, owner, self.sums[whole])
        at = self.members(leaves)
        k, _ = nearest(self.q[at], c)
        np.add.at(n, k, 1)
        np.add.at(s, k, self.q[at].astype(np.int64))
        return n, s


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


_TREE = "ids array<long>, q array<int>, start array<int>, end array<int>, left array<int>, right array<int>, radius array<double>, sums array<long>, wide_ids array<long>, wide array<double>"


def trees(vectors: DataFrame, column: str, name: str, dims: int) -> DataFrame:
    """One row per block of vectors: its ball tree, and beside it the vectors with components beyond ``NARROW``."""

    def blocks(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK:
                yield from _cut(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from _cut(pa.Table.from_batches(held))

    def _cut(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in t.combine_chunks().to_batches(max_chunksize=BLOCK):
            yield _tree_row(b)

    def _tree_row(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.floor(64.0 * b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dims)
        narrow = np.abs(x).max(axis=1) <= NARROW
        q = x[narrow].astype(np.int32)
        ids, wide_ids = b.column(0).filter(pa.array(narrow)), b.column(0).filter(pa.array(~narrow))
        order, start, end, left, right, radius, sums = build(q) if len(q) else (np.zeros(0, np.int64), *(np.zeros(0, np.int32),) * 4, np.zeros(0), np.zeros((0, dims), np.int64))
        listed = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        cols = [listed(ids.take(pa.array(order))), _lists(q[order].ravel(), pa.int32()), *(_lists(v, pa.int32()) for v in (start, end, left, right)), _lists(radius, pa.float64()), _lists(sums.ravel(), pa.int64()), listed(wide_ids), _lists(x[~narrow].ravel(), pa.float64())]
        return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in _TREE.split(", ")])

    return kept(vectors, column, name, dims).mapInArrow(blocks, _TREE)


def kept(vectors: DataFrame, column: str, name: str, dims: int) -> DataFrame:
    """``(id, v array<double>)`` of the vectors with exactly ``dims`` components, none null or not finite."""
    v = vectors[column].cast("array<double>")
    sound = F.forall(v, lambda x: F.coalesce(F.abs(x) < TOO_LARGE, F.lit(False)))  # NaN is larger than any number
    return vectors.where((F.size(v) == dims) & sound).select(vectors[name].cast("long").alias("id"), v.alias("v"))


def _stored(b: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, Tree | None, pa.Array, np.ndarray]]:
    """(ids, tree, ids of wide vectors, wide vectors) of each row."""
    for r in range(b.num_rows):
        one = {f: b.column(k)[r].values for k, f in enumerate(b.schema.names)}
        num = {f: np.asarray(one[f]) for f in one if f not in ("ids", "wide_ids")}
        tree = Tree(num["q"].reshape(-1, dims), *(num[f] for f in ("start", "end", "left", "right", "radius")), num["sums"].reshape(-1, dims)) if len(num["q"]) else None
        wide = np.array([int(x) for x in num["wide"].tolist()], object).reshape(-1, dims)
        yield one["ids"], tree, one["wide_ids"], wide


def _matrix(centroids: Sequence[Sequence[int]]) -> np.ndarray:
    """Centroids as integers of 64 bits where arithmetic with them is exact, else as Python's."""
    small = all(abs(x) <= NARROW for c in centroids for x in c)
    return np.array(centroids, np.int64 if small else object)


def _assigned(tree: Tree, c: np.ndarray) -> np.ndarray:
    return tree.assign(c) if c.dtype != object else nearest(tree.q, c)[0]


def _limbs(x: int) -> list[int]:
    """Signed limbs, lowest first."""
    sign, x = (-1, -x) if x < 0 else (1, x)
    return [sign * (x >> LIMB * k & (1 << LIMB) - 1) for k in range(LIMBS)]


def _totals(stored: DataFrame, centroids: list[list[int]], dims: int) -> dict[int, tuple[int, list[int]]]:
    """Count and exact sum of each non-empty cluster: at most ``LIMBS`` numbers for each component of a centroid reach
    the driver."""
    held = stored.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c, n, s = _matrix(held.value), [0] * len(held.value), np.zeros((len(held.value), dims), object)
        for b in batches:
            for _, tree, _, wide in _stored(b, dims):
                if tree is not None:
                    if c.dtype != object:
                        own, sums = tree.totals(c)
                    else:
                        k = nearest(tree.q, c)[0]
                        own, sums = np.bincount(k, minlength=len(c)), np.zeros(c.shape, np.int64)
                        np.add.at(sums, k, tree.q.astype(np.int64))
                    n = [x + int(y) for x, y in zip(n, own.tolist())]
                    s = s + sums.astype(object)
                for k, v in zip(nearest(wide, c)[0].tolist(), wide):
                    n[k] += 1
                    s[k] = s[k] + v
        rows = [(k, -1, n[k]) for k in range(len(n)) if n[k]]
        rows += [(k, d * LIMBS + i, y) for k, _, _ in list(rows) for d in range(dims) for i, y in enumerate(_limbs(int(s[k][d]))) if y]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["k", "at", "v"])

    out: dict[int, tuple[int, list[int]]] = {}
    for r in stored.mapInArrow(run, "k int, at int, v long").groupBy("k", "at").agg(F.sum("v").alias("v")).orderBy("k", "at").collect():
        if r["at"] < 0:
            out[r["k"]] = r["v"], [0] * dims
        else:
            out[r["k"]][1][r["at"] // LIMBS] += r["v"] << LIMB * (r["at"] % LIMBS)
    return out


def first_centroids(vectors: DataFrame, column: str, name: str, dims: int, k: int) -> list[list[int]]:
    """The ``k`` kept vectors of smallest sha256 of ``1:<id>``; of equal ids the smaller vector, a null id written as nothing."""
    shown = F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = kept(vectors, column, name, dims).select(F.sha2(shown, 256).alias("h"), "v").orderBy("h", "v").limit(k)
    return [[int(np.floor(64.0 * x)) for x in r["v"]] for r in rows.collect()]


def clusters(vectors: DataFrame, column: str = "embedding", name: str = "vec_id", dims: int = 64, k: int = 16, rounds: int = 3) -> DataFrame:
    """Per kept vector: its id in column ``name``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256`` after ``rounds`` rounds and a last assignment.

    Vectors of other than ``dims`` components, or with a null, not finite or too large one, are left out; fewer than ``k`` kept
    ones are all centroids, and none give no rows.  Components become ``floor(64 * x)``.  Ties go to the smaller number, empty
    centroids stay.  Repeated rows and ids count each, a null id stays null, other columns are ignored.  Distances and sums that
    do not fit in a long are given as the largest one.
    """
    spark = vectors.sparkSession
    tune(spark)
    centroids = first_centroids(vectors, column, name, dims, k)
    stored, _ = written(trees(vectors, column, name, dims), "trees")
    for _ in range(rounds):
        for i, (n, s) in _totals(stored, centroids, dims).items():
            centroids[i] = [x // n for x in s]
    final = spark.sparkContext.broadcast(centroids)

    def inertia(batches):
        c = _matrix(final.value)
        out = [0] * len(c)
        for b in batches:
            for _, tree, _, wide in _stored(b, dims):
                for q, own in ((tree.q, _assigned(tree, c)) if tree is not None else (wide[:0], []), (wide, nearest(wide, c)[0])):
                    for i, d in zip(np.asarray(own).tolist(), _distances(q, c, own)):
                        out[i] += d
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array([Decimal(min(x, 10**37)) for x in out], pa.decimal128(38, 0))], ["k", "d"])

    sums = {r["k"]: int(r["d"]) for r in stored.mapInArrow(inertia, "k int, d decimal(38,0)").groupBy("k").agg(F.sum("d").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = min(sum(sums.values()), LONG_MAX)

    def assign(batches):
        c = _matrix(final.value)
        own_sum, sha = np.array([min(sums.get(i, 0), LONG_MAX) for i in range(len(c))], np.int64), np.array(digests, object)
        for b in batches:
            for ids, tree, wide_ids, wide in _stored(b, dims):
                for own_ids, q, k in ((ids, tree.q, _assigned(tree, c)) if tree is not None else (ids, wide[:0], np.zeros(0, np.int64)), (wide_ids, wide, nearest(wide, c)[0])):
                    d = [min(x, LONG_MAX) for x in _distances(q, c, k)]
                    yield pa.RecordBatch.from_arrays([own_ids, pa.array(k.astype(np.int32)), pa.array(d, pa.int64()), pa.array(own_sum[k]), pa.array(np.full(len(k), total)), pa.array(sha[k], pa.string())], [name, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return stored.mapInArrow(assign, f"`{name}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def _distances(q: np.ndarray, c: np.ndarray, k: Sequence[int]) -> list[int]:
    """Exact squared distance of each row to its own centroid."""
    if not len(q):
        return []
    wide = q.dtype == object or c.dtype == object
    x, y = (q.astype(object), c.astype(object)) if wide else (q.astype(np.int64), c)
    return ((x - y[np.asarray(k)]) ** 2).sum(axis=1).tolist()
