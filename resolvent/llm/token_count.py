"""Token counts without ids: pieces are counted once per distinct pre-token and joined to frequencies.

1. Every task reduces its texts to distinct pre-tokens with frequencies; a partial aggregation makes them
   distinct over the corpus, and the tokenizer's model counts the pieces of each exactly once.
2. Documents are reduced to pre-token frequencies.  The most frequent pre-tokens (at most ``HOT``, found by
   a histogram of frequencies) are joined where the document is read; the rest, a few hundredths of the
   words, are joined by a shuffle on the pre-token.  Sums per document are the token counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import Table, pieces, spread, sums, utf8
from ._bpe import Pieces, load
from ._spark import durable, row_base, tune

#: Most pre-tokens that are joined by a broadcast, and their most bytes: 76 bytes each with their counts, 10 MB in all.
HOT, HOT_BYTES = 1 << 17, 64
#: Distinct pre-tokens that one task gathers before it passes them on.
FLUSH = 400_000


def _strings(p: Pieces, at: np.ndarray) -> pa.Array:
    """The pre-tokens at the given places as a string column."""
    lens = p.ends[at] - p.starts[at]
    data = p.pad[spread(p.starts[at], lens)]
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def pre_token_counts(docs: DataFrame, path: str, flush: int = FLUSH) -> DataFrame:
    """``docs(text)`` -> ``(piece, freq, n)``: each distinct pre-token, its frequency and its number of ids."""

    def local(batches):
        bpe = load(path)

        def out():
            if strings:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(strings), pa.array(np.concatenate(counts))], ["piece", "freq"])

        table, strings, counts = Table(16), [], []
        total = np.zeros(1 << 12, np.int64)
        for b in batches:
            buf, off = utf8(b.column(0))
            for i, j in pieces(off):
                p = bpe.split(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                h = p.hashes()
                at = table.find(h)
                new = np.flatnonzero(at < 0)
                if new.size:
                    fresh, where = np.unique(h[new], return_index=True)
                    strings.append(_strings(p, new[where]))
                    base = table.n
                    table.add(fresh, np.arange(base, base + len(fresh)))
                    at[new] = table.find(h[new])
                while table.n > len(total):
                    total = np.concatenate([total, np.zeros_like(total)])
                if at.size:
                    c = np.bincount(at)
                    total[: len(c)] += c
                if table.n > flush:
                    counts = [total[: table.n].copy()]
                    yield from out()
                    table, strings, counts = Table(16), [], []
                    total[:] = 0
        counts = [total[: table.n]]
        yield from out()

    def count(batches):
        bpe = load(path)
        for b in batches:
            n = [len(bpe.ids_of(x.encode())) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32())], ["piece", "freq", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(local, "piece string, freq long")
    return found.groupBy("piece").agg(F.sum("freq").alias("freq")).mapInArrow(count, "piece string, freq long, n int")


def _hot(counted: DataFrame, most: int) -> list:
    """At most ``most`` of the most frequent pre-tokens with their numbers of ids."""
    counted = counted.where(F.octet_length("piece") <= HOT_BYTES)
    level = F.floor(F.log2(F.col("freq").cast("double")) * 8).cast("int")
    taken, floor = 0, None
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # at most 8 x 63 rows
        taken += r["count"]
        if taken > most:
            break
        floor = r["level"]
    return [] if floor is None else counted.where(level >= floor).select("piece", "n").collect()


def token_counts(docs: DataFrame, path: str, limit: int = 2048, hot: int = HOT) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_bytes, n_tokens, over_limit)``, one row per input row.

    A null or empty text has no bytes and no tokens.  Special strings of the tokenizer count as one token,
    as its library takes them by default.  Repeated rows are counted each; other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    counted = durable(pre_token_counts(docs, path))
    top = _hot(counted, hot)
    words = [r["piece"].encode() for r in top]
    lens = np.array([len(w) for w in words], np.int64)
    held = spark.sparkContext.broadcast((np.frombuffer(b"".join(words) + bytes(40), np.uint8), np.cumsum(lens) - lens, np.cumsum(lens), np.array([r["n"] for r in top], np.int32)))

    def run(batches):
        bpe, row = load(path), row_base()
        data, starts, ends, n = held.value
        table = Table(18)
        if len(n):
            table.add(Pieces(data, starts, ends, None).hashes(), n)
        for b in batches:
            buf, off = utf8(b.column(1))
            for i, j in pieces(off):
                p = bpe.split(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                h = p.hashes()
                at = table.find(h)
                rare = np.flatnonzero(at < 0)
                doc = np.searchsorted(p.first, rare, side="right") - 1
                order = np.lexsort((h[rare], doc))
                rare, doc = rare[order], doc[order]
                begins = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (h[rare][1:] != h[rare][:-1])]) if rare.size else np.zeros(0, bool))
                freq = np.diff(np.concatenate([begins, [len(rare)]]))
                tail = pa.StructArray.from_arrays([_strings(p, rare[begins]), pa.array(freq.astype(np.int64))], ["piece", "f"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[begins], np.arange(j - i + 1)).astype(np.int32)), tail)
                at[rare] = 0
                cols = [pa.array(np.arange(row, row + j - i)), b.column(0)[i:j], pa.array(np.diff(off[i : j + 1])), pa.array(sums(at, p.first)), lists]
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_bytes", "known", "tail"])
                row += j - i

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = durable(columns.mapInArrow(run, "row long, doc_id long, n_bytes long, known long, tail array<struct<piece:string,f:long>>"))
    rare = base.where(F.size("tail") > 0).select("row", F.inline("tail")).join(counted.select("piece", "n"), "piece")
    rare = rare.groupBy("row").agg(F.sum(F.col("f") * F.col("n")).alias("rare"))
    n = (F.col("known") + F.coalesce("rare", F.lit(0))).cast("long")
    return base.drop("tail").join(rare, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
