"""Bloom filters of 64-bit hashes whose size is counted first and bounded: what they let pass goes to an exact step."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of a filter's bits at least and at most: 8 KB and 8 MB.
LEAST, MOST = 16, 26


def bits_for(keys: int, most: int = MOST) -> int:
    """log2 of about ten bits a key, within bounds; beyond, a filter lets more pass and stays right."""
    return int(min(most, max(LEAST, np.ceil(np.log2(max(1, 10 * keys))))))


def build(keys: DataFrame, bits: int) -> np.ndarray:
    """Two-probe filter of a frame of one long column: 2^bits bits, at most 2^(bits - 6) words reach the driver."""
    mask = (1 << bits) - 1
    k = F.col(keys.columns[0])
    probe = keys.select(F.explode(F.array(k.bitwiseAND(mask), F.shiftrightunsigned(k, 32).bitwiseAND(mask))).alias("p"))
    words = probe.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def passes(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) may be keys."""
    mask, low = np.uint64(len(bloom) * 64 - 1), np.uint64(63)
    p, q = h & mask, (h >> np.uint64(32)) & mask
    one = (bloom[p >> np.uint64(6)] >> (p & low)) & (bloom[q >> np.uint64(6)] >> (q & low))
    return (one & np.uint64(1)).astype(bool)


def likely(held: Broadcast):
    """Column function: whether a long column's value may be a key; only that column goes to Python."""

    @F.pandas_udf("boolean")
    def may(keys: pd.Series) -> pd.Series:
        return pd.Series(passes(held.value, keys.to_numpy(np.int64).view(np.uint64)))

    return may


def row_key(docs: DataFrame) -> Column:
    """A document's key: hash of its doc_id and its text."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def parted(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` as the rows that may have one of the ``row_key`` values in the long column of ``keys``, and those that do not.

    So a join needs to move only the former, with their texts."""
    n = keys.count()
    held = docs.sparkSession.sparkContext.broadcast(build(keys, bits_for(n)))
    may = likely(held)(row_key(docs))
    return docs.where(may), docs.where(~may)
