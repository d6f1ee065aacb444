"""Exact copies of a text: which row of each group stands for it, without gathering a group anywhere."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bloom


def text_hashes(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text, null counting as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(whole), F.xxhash64(F.lit("text"), whole)


def with_later(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, h1, h2, ...)`` with ``later``: whether a row of smaller doc_id has the same text.

    The smallest doc_id of each text is one partial aggregate; a row looks itself up there by doc_id *and* text, so the copies
    of one text spread over all tasks.  A null doc_id is neither smaller nor later.
    """
    least = rows.where(F.col("doc_id").isNotNull()).groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    mark = least.withColumn("__first", F.lit(True))
    return rows.join(mark, ["doc_id", "h1", "h2"], "left").withColumn("later", F.col("doc_id").isNotNull() & F.col("__first").isNull()).drop("__first")


def first_filter(marked: DataFrame) -> Broadcast:
    """Two Bloom filters that tell first rows from later copies by the long column ``key`` of ``marked(key, later)``.

    The first holds the later copies, the second those first rows that the first filter takes for copies.  So every first row
    is known; a few copies may pass too.
    """
    copies = marked.where("later").select("key").distinct()
    n = copies.count()
    one = _bloom.build(copies, _bloom.bits_for(n)) if n else None
    two = None
    if n:
        mistaken = marked.where(~F.col("later")).select("key").where(_bloom.likely(marked.sparkSession.sparkContext.broadcast(one))(F.col("key"))).distinct()
        m = mistaken.count()
        two = _bloom.build(mistaken, _bloom.bits_for(m)) if m else None
    return marked.sparkSession.sparkContext.broadcast((one, two))


def maybe_first(held: Broadcast, key: np.ndarray) -> np.ndarray:
    """Which keys may be those of first rows."""
    one, two = held.value
    h = key.view(np.uint64)
    if one is None:
        return np.ones(len(h), bool)
    ok = ~_bloom.passes(one, h)
    return ok if two is None else ok | _bloom.passes(two, h)
