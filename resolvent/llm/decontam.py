"""Benchmark decontamination by winnowing.

An item's windows are its runs of ``size`` consecutive words (an item with fewer words, but not none, is one window).
Each window selects the position of its smallest word k-gram (the leftmost of equal ones), as winnowing does, and each
text keeps one fingerprint for every position that some window of it selects: far fewer than windows.  Equal windows
select the same position, so every shared span of ``size`` words has a fingerprint in both texts.  A Bloom filter of the
benchmark's fingerprints decides what of the documents reaches the join; joined positions are extended both ways, word by
word, over the words beside the k-gram, and where the match is as long as a window, all its words are hit.  Matches that
overlap together cover the whole shared span, however long it is.

The filter has a fixed size whatever the benchmark holds.  Items are attached once per distinct combination of item sets,
not per document, so a passage that a third of the documents hold under many items makes no document x item rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bloom
from ._arrow import LOWER, hash_spans, mix, padded, pieces, runs, utf8
from ._spark import durable, row_base, tidy, tune

_WORD = np.zeros(256, np.uint8)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_BASE = 0xD6E8FEB86659FD93
#: Words of the k-grams among which a window selects its fingerprint.
GRAM = 5
#: log2 of the Bloom filter's bits: one MB.
FILTER_BITS = 23


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the contract (never 0), and at which word each document begins."""
    starts, ends, _, first = runs(_WORD[buf], off)
    return hash_spans(padded(LOWER[buf]), starts, ends), first


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on."""
    n = max(0, len(h) - k + 1)
    g = h[:n].copy()
    for j in range(1, k):
        g *= np.uint64(_BASE)
        g += h[j : j + n]
    return mix(g)


def selected(h: np.ndarray, first: np.ndarray, size: int, gram: int, passes=None) -> tuple[np.ndarray, np.ndarray]:
    """(position, fingerprint) of the k-grams that some window of ``size`` words selects, of those that pass."""
    k = min(gram, size)
    g = _grams(h, k)
    at = np.arange(len(g)) if passes is None else np.flatnonzero(passes(g))
    doc = np.searchsorted(first, at, side="right") - 1
    low, high = first[doc], first[doc + 1] - k  # the document's k-grams
    keep = at <= high
    at, low, high = at[keep], low[keep], high[keep]
    reach = size - k
    around = at[:, None] + np.arange(-reach, reach + 1)
    inside = (around >= low[:, None]) & (around <= high[:, None])
    beside = g[np.clip(around, 0, max(0, len(g) - 1))]
    own = g[at][:, None]
    # How far a window may go to the left and to the right with this k-gram as its leftmost smallest.
    left = np.cumprod((inside & (beside > own))[:, :reach][:, ::-1], axis=1).sum(1)
    right = np.cumprod((inside & (beside >= own))[:, reach + 1 :], axis=1).sum(1)
    at = at[left + right >= reach]
    return at, g[at]


_FOUND = "array<struct<pos:int,len:int,fp:long,words:array<long>>>"


def _as_column(h: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], sizes: list[int], first: np.ndarray, size: int, gram: int) -> pa.Array:
    """The fingerprints found for each size as one list column, with the words around them: ``reach`` before the k-gram, its
    own, and as many behind; 0 where the document ends."""
    pos = np.concatenate([x[0] for x in found])
    fp = np.concatenate([x[1] for x in found])
    length = np.repeat(np.array(sizes, np.int32), [len(x[0]) for x in found])
    doc = np.searchsorted(first, pos, side="right") - 1
    order = np.lexsort((length, pos))
    pos, fp, length, doc = pos[order], fp[order], length[order], doc[order]
    width = 2 * size - min(gram, size)
    around = pos[:, None] + np.arange(width) - (size - min(gram, size))
    inside = (around >= first[doc][:, None]) & (around < first[doc + 1][:, None])
    words = np.where(inside, h[np.clip(around, 0, max(0, len(h) - 1))] if len(h) else np.uint64(0), np.uint64(0))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pos) + 1, dtype=np.int32) * width), pa.array(words.reshape(-1).view(np.int64)))
    cols = [pa.array((pos - first[doc]).astype(np.int32)), pa.array(length), pa.array(fp.view(np.int64)), lists]
    offsets = np.searchsorted(doc, np.arange(len(first)))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(cols, ["pos", "len", "fp", "words"]))


def benchmark_fingerprints(benchmark: DataFrame, size: int, gram: int) -> DataFrame:
    """``benchmark(item_id, text)`` -> ``(item_id, pos, len, fp, words)``."""

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(1))
            for i, j in pieces(off):
                h, first = word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                n = np.diff(first)
                found, sizes = [selected(h, first, size, gram)], [size]
                for m in np.unique(n[(n > 0) & (n < size)]):
                    at, fp = selected(h, first, int(m), gram)
                    own = n[np.searchsorted(first, at, side="right") - 1] == m  # items of exactly so many words
                    found.append((at[own], fp[own]))
                    sizes.append(int(m))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], _as_column(h, found, sizes, first, size, gram)], ["item_id", "w"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"item_id long, w {_FOUND}")
    return rows.select("item_id", F.inline("w"))


def document_fingerprints(docs: DataFrame, bloom: np.ndarray, sizes: list[int], size: int, gram: int) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(row, doc_id, key, n_words, w)``: the fingerprints that pass the filter."""
    held = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches):
        row = row_base()
        for b in batches:
            buf, off = utf8(b.column(2))
            for i, j in pieces(off):
                h, first = word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                found = [selected(h, first, m, gram, lambda g: _bloom.passes(held.value, g)) for m in sizes]
                w = _as_column(h, found, sizes, first, size, gram)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + j - i)), b.column(0)[i:j], b.column(1)[i:j], pa.array(np.diff(first)), w], ["row", "doc_id", "key", "n_words", "w"])
                row += j - i

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _bloom.row_key(docs).alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"row long, doc_id long, key long, n_words long, w {_FOUND}")


def extended(joined: DataFrame, size: int, gram: int) -> DataFrame:
    """``joined(row, pos, len, words, words2, cls)`` -> ``(row, start, stop, cls)``: the matches that are a window long, or
    longer, after extension both ways."""
    k = min(gram, size)
    width = 2 * size - k

    def run(batches):
        for b in batches:
            x, y = (np.asarray(b.column(c).flatten()).reshape(-1, width) for c in (3, 4))
            pos, length = np.asarray(b.column(1)).astype(np.int64), np.asarray(b.column(2)).astype(np.int64)
            same = (x == y) & (x != 0)
            middle = np.minimum(length, k)
            own = np.arange(width) - (size - k)  # place of each word behind the k-gram's first
            full = (same | (own < 0) | (own >= middle[:, None])).all(1)
            left = np.cumprod(same[:, : size - k][:, ::-1], axis=1).sum(1)
            behind = same & (own >= middle[:, None])
            right = np.cumprod(behind | (own < middle[:, None]), axis=1).sum(1) - (size - k) - middle
            room = length - middle
            left, right = np.minimum(left, room), np.minimum(right, room)
            keep = full & (left + middle + right >= length)
            cols = [b.column(0), pa.array((pos - left).astype(np.int32)), pa.array((pos + middle + right).astype(np.int32)), b.column(5)]
            yield pa.RecordBatch.from_arrays(cols, ["row", "start", "stop", "cls"]).filter(pa.array(keep))

    return joined.select("row", "pos", "len", "words", "words2", "cls").mapInArrow(tidy(run), "row long, start int, stop int, cls long")


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and
    ``key``, which tells rows apart that repeat a doc_id.

    Null and empty texts have no words and are never contaminated; null and empty items have no windows; items of
    equal text all count, an item without an id does not.  Other columns are ignored.  An empty benchmark leaves every
    document clean; an empty document table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    prints = durable(benchmark_fingerprints(benchmark, size, gram).where("item_id is not null"))
    sizes = sorted({size, *(r[0] for r in prints.select("len").distinct().collect())})  # at most ``size`` values
    classes = durable(prints.groupBy("len", "fp", "words").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("cls", F.xxhash64("items")))
    base = durable(document_fingerprints(docs, _bloom.build(prints.select("fp").distinct(), filter_bits), sizes, size, gram))
    joined = base.where(F.size("w") > 0).select("row", F.inline("w")).join(classes.select("len", "fp", F.col("words").alias("words2"), "cls"), ["len", "fp"])
    hits = extended(joined, size, gram)
    before = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = hits.select("row", "cls", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0)))).alias("n"))
    found = durable(covered.groupBy("row").agg(F.sum("n").alias("n_hit"), F.array_sort(F.collect_set("cls")).alias("sets")).withColumn("of", F.xxhash64("sets")))
    items = classes.groupBy("cls").agg(F.first("items").alias("items"))
    named = found.groupBy("of").agg(F.first("sets").alias("sets")).select("of", F.explode("sets").alias("cls")).join(items, "cls").groupBy("of").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    # Cut, so that AQE can split the join where one combination is in very many documents.
    named = durable(named.select("of", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256")))
    rows = base.select("row", "doc_id", "n_words", "key").join(found.join(named, "of").drop("sets", "of"), "row", "left")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "key",
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns kept, that share no window with the benchmark; null and empty texts stay, repeated
    rows share their fate, an empty benchmark or table loses nothing.  Only rows that may go are moved."""
    hit = durable(report(docs, benchmark, size).where("contaminated").select("key").distinct())
    some, rest = _bloom.parted(docs, hit)
    name = "key"
    while name in docs.columns:
        name = f"_{name}"
    return rest.unionByName(some.withColumn(name, _bloom.row_key(some)).join(hit.withColumnRenamed("key", name), name, "left_anti").drop(name))
