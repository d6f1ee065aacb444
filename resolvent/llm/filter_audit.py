"""How filters interact: the multilinear extension of each part's removals, and exact Shapley values from it.

Each document fails some of the filters; the counts of these failure masks are all that an audit needs.  For filters applied
with probabilities x, a document with mask M is removed with probability 1 - prod over M of (1 - x_i), so a part's expected
removals are a polynomial, linear in each x_i.  Its value at a corner is what that set of filters removes, which gives the
survivors of every order and step.  The integral of its i-th partial derivative along the diagonal is filter i's Shapley value;
it is taken with exact fractions and scaled by the number of orders, which makes it an integer: the removals of filter i
summed over all orders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _copies
from ._arrow import hash_spans, padded, pieces, runs, sums, utf8
from ._spark import tune, written

#: The filters of the query, in the order of the mask's bits.
FILTERS = "ABCDE"
FEW_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
_SIGNS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))
_SPACES = np.ones(256, np.uint8)
_SPACES[[*range(0x09, 0x0E), 0x20]] = 0


class Removals:
    """The removal polynomial of one part, from the number of documents of each failure mask."""

    def __init__(self, counts: dict[int, int], n: int):
        self.n, self.total = n, sum(counts.values())
        # 1 - prod(1 - x_i) over M = - sum over non-empty S in M of (-1)^|S| x_S: coefficients of the monomials x_S.
        self.coefficient = [0] * (1 << n)
        for mask, count in counts.items():
            s = mask
            while s:
                self.coefficient[s] += count if s.bit_count() % 2 else -count
                s = (s - 1) & mask

    def at_corner(self, chosen: int) -> int:
        """Documents that the filters in ``chosen`` remove together."""
        out, s = 0, chosen
        while s:
            out += self.coefficient[s]
            s = (s - 1) & chosen
        return out

    def shapley(self, i: int) -> Fraction:
        """Integral over t of the partial derivative by x_i at (t, ..., t): a monomial x_S with i gives t^(|S| - 1)."""
        by_degree = [0] * (self.n + 1)
        for s in range(1 << self.n):
            if s >> i & 1:
                by_degree[s.bit_count()] += self.coefficient[s]
        return sum((Fraction(c, degree) for degree, c in enumerate(by_degree) if degree), Fraction(0))


def audit_rows(entries: Sequence[tuple[int, int, int, int]], filters: str = FILTERS) -> Iterator[tuple]:
    """``(mask, documents, good, toxic)`` of one part -> its rows ``(filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley)``, all orders and steps."""
    n = len(filters)
    every, good, toxic = (Removals({e[0]: e[k] for e in entries}, n) for k in (1, 2, 3))
    corner = [[p.at_corner(s) for s in range(1 << n)] for p in (every, good, toxic)]
    unique = {e[0]: e[1] for e in entries}
    value = [every.shapley(i) * factorial(n) for i in range(n)]
    assert all(v.denominator == 1 for v in value)
    for order in permutations(range(n)):
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            now = before | 1 << i
            removed, lost, bad = (c[now] - c[before] for c in corner)
            yield name, step, every.total - corner[0][now], removed, corner[0][1 << i] - removed, unique.get(1 << i, 0), lost, bad, int(value[i])
            before = now


def _masks(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits of the filters that look at one text only: few words, repeated words, capitals, signs."""
    starts, ends, _, first = runs(_SPACES[buf], off)
    h = hash_spans(padded(buf), starts, ends)
    words = np.diff(first)
    doc = np.repeat(np.arange(len(words)), words)
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = sums(new.astype(np.int64), first)
    upper = sums((buf >= 0x41) & (buf <= 0x5A), off)
    points = sums((buf & 0xC0) != 0x80, off)
    signs = sums(_SIGNS[buf], off)
    return (words < FEW_WORDS) + 2 * (100 * distinct < DISTINCT_PERCENT * words) + 4 * (100 * upper > UPPER_PERCENT * points) + 8 * (signs > 0)


def failures(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` -> ``(doc_id, part, mask)`` per row: bit k is set if filter k of ``FILTERS`` fails it.

    A: under 200 words; B: fewer than half of the words are distinct; C: over 3 % of the code points are A to Z; D: one of
    ``#$%&*|``; E: a row of smaller doc_id has the same text.  A null text is empty, a null lang the empty one.  Rows of one
    doc_id are not earlier than each other, and a row without doc_id is neither earlier nor later.
    """
    h1, h2 = _copies.text_hashes(docs["text"])
    part = F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), part, docs["text"].cast("string").alias("text"))

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(4))
            masks = [_masks(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in pieces(off)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(np.concatenate([*masks, np.zeros(0, np.int64)]).astype(np.int32))], ["doc_id", "h1", "h2", "part", "mask"])

    light, _ = written(rows.mapInArrow(run, "doc_id long, h1 long, h2 long, part string, mask int"), "masks")  # the texts are read once
    return _copies.with_later(light).select("doc_id", "part", (F.col("mask") + 16 * F.col("later").cast("int")).alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each mask, and those that ``labels(doc_id, quality, toxic)`` marks 1.

    A doc_id labelled twice counts as marked if one of its labels is 1; null labels and ids mark nothing."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(own) for c, own in (("quality", "good"), ("toxic", "bad"))))
    none = F.lit(0)
    return failed.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", none)).alias("good"), F.sum(F.coalesce("bad", none)).alias("toxic"))


_COUNTS = ("step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included; see ``failures`` and ``audit_rows``.

    A part is one value of ``lang``.  An empty table has no parts and gives no rows; repeated rows count each; columns of
    ``docs`` and ``labels`` that are not named are ignored.  A part reaches its task as 32 counts, however many documents it has.
    """
    tune(docs.sparkSession)
    counted = mask_counts(failures(docs), labels)
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("entries"))

    def run(batches):
        for b in batches:
            for part, entries in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = list(audit_rows([(e["mask"], e["n"], e["good"], e["toxic"]) for e in entries]))
                columns = [pa.array([part] * len(rows)), *(pa.array(list(c)) for c in zip(*rows))]
                columns[2] = columns[2].cast(pa.int32())
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", *_COUNTS])

    return parts.mapInArrow(run, _SCHEMA)
