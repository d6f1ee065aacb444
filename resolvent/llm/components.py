"""Connected components of an edge list by alternating large-star and small-star rounds.

Every round is two partial aggregations and two equi-joins, so a hub with a third of all edges is
pre-aggregated and its join is split by AQE.  State is cut through the shared checkpoint folder, and only two
numbers of it ever reach the driver.  Once at most ``FINISH`` edges are left, one task finishes them with the
same hooking in memory, which is bounded by that parameter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import durable, tidy

#: Edges that one task finishes alone: 16 bytes each.
FINISH = 1_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star (over larger neighbours) or small-star (over smaller ones) round; edges have a > b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # Cut, so that both sides of the join are plain shuffles and AQE can split a hub's.
    least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def hook(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of the edges that is not itself the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        p, q = parent[x], parent[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def _finish(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(np.asarray(b.column(0)).astype(np.int64), np.asarray(b.column(1)).astype(np.int64)) for b in batches]
        if parts:
            node, root = hook(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    return edges.coalesce(1).mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``: every node of an edge with the smallest node reachable.

    Loops and repeated or reversed edges are allowed, but a node without any other edge is left out; edges with a null
    end are ignored; no edges give no rows.
    """
    state = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        if now[0] <= finish:
            state = durable(_finish(state))
            break
        seen = now
        state = durable(_star(_star(state, True), False))
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
