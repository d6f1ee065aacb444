"""Labels, folds and calibration shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def training_labels(labels: DataFrame, column: str, modulus: int, held: int, most: int) -> tuple[DataFrame, dict[int, float]]:
    """``labels(doc_id, <column>)`` -> at most ``most`` training rows ``(doc_id, y)`` of each class, chosen by hash, and
    how many labelled training rows each chosen row of a class stands for.

    Null ids and labels are left out; a doc_id labelled twice counts once, with the larger label.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col(column) > 0).cast("int")).alias("y"))
    rows = rows.where(fold(F.col("doc_id"), modulus) != held)
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    parts, weight = [], {}
    for y, k in sorted(n.items()):
        own = rows.where(F.col("y") == y)
        if k > most:
            own = own.where(draw < 1.1 * most / k).orderBy(draw, "doc_id").limit(most)
        parts.append(own)
        weight[y] = max(1.0, k / most)
    if not parts:
        return rows.limit(0), weight
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out, weight


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last for the constant) of a logistic regression, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (y - p)) - penalty * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        beta += step
        if np.abs(step).max() < 1e-7:
            break
    return beta


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and non-decreasing values of the weighted fit of y by x."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # first x, last x, mean, weight
    for i in order.tolist():
        blocks.append([x[i], x[i], y[i], w[i]])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            b, a = blocks.pop(), blocks.pop()
            n = a[3] + b[3]
            blocks.append([a[0], b[1], (a[2] * a[3] + b[2] * b[3]) / n, n])
    knots = np.array([v for b in blocks for v in b[:2]])
    values = np.array([v for b in blocks for v in (b[2], b[2])])
    return knots, values
