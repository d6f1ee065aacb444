"""Token-id files: documents in doc_id order as checksummed, independently coded blocks.

The file format is a Parquet table of segments.  A segment holds whole documents in ascending doc_id order:
its place (``part``, ``segment``, ids of the part ``before`` it), their doc_ids and numbers of ids, and one binary value with the blocks of
``range_coder``.  Segments hold about ``SEGMENT`` ids, or one longer document; Spark commits the files, so a
lost executor's tasks are simply written again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch
from . import range_coder
from ._arrow import pieces, utf8
from ._bpe import load
from ._spark import tune

#: Ids after which a segment ends.
SEGMENT = range_coder.BLOCK * range_coder.GROUP
_SCHEMA = "part int, segment int, before long, n_ids long, doc_ids array<long>, sizes array<long>, blocks binary"


def encode_segments(docs: DataFrame, path: str, end_id: int = 2, segment: int = SEGMENT) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> segments in ascending order of doc_id (nulls first, equal ones by their text's hash)."""
    from pyspark import TaskContext

    tune(docs.sparkSession)

    def run(batches):
        bpe, part, number = load(path), TaskContext.get().partitionId(), 0
        names: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = before = 0

        def row():
            flat = np.concatenate(ids)
            own, n = pa.concat_arrays(names), pa.array(np.concatenate(sizes))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (own, n)]
            cols = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(flat)], pa.int64()), *lists, pa.array([range_coder.encode(flat)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "segment", "before", "n_ids", "doc_ids", "sizes", "blocks"])

        for b in batches:
            buf, off = utf8(b.column(1))
            for i, j in pieces(off):
                flat, first = bpe.encode(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                names.append(b.column(0)[i:j])
                sizes.append(np.diff(first) + 1)
                ids.append(np.insert(flat, first[1:], np.uint16(end_id)))
                held += len(ids[-1])
                if held >= segment:
                    yield row()
                    number, before, held = number + 1, before + held, 0
                    names.clear(), sizes.clear(), ids.clear()
        if names:
            yield row()

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    return columns.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie).mapInArrow(run, _SCHEMA)


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 2, segment: int = SEGMENT) -> str:
    """Write the token files of ``docs`` under ``out``, a folder that all executors share.

    A null or empty text is the end id alone, repeated rows are written each, other columns are ignored, and an empty table
    leaves no segments."""
    encode_segments(docs, path, end_id, segment).write.mode("overwrite").option("compression", "none").parquet(out)
    return out


def read_tokens(spark: SparkSession, out: str, keep_ids: bool = False) -> DataFrame:
    """Read token files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` of every document.

    ``start`` counts the ids of all documents before.  Raises where a block's checksum or a segment's count fails; files
    without segments give no rows.
    """
    tune(spark)
    files = spark.read.schema(_SCHEMA).parquet(out)
    # Ids of all parts before each part: a row of 16 bytes for each file, so small that a join needs no shuffle.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def run(batches):
        for b in batches:
            for start, n, doc_ids, sizes, data in zip(*(b.column(k).to_pylist() for k in range(5))):
                ids = range_coder.decode(data)
                if len(ids) != n or sum(sizes) != n:
                    raise ValueError("a segment does not hold the ids that it says")
                ends = np.cumsum(sizes)
                begins = ends - sizes
                words = ids.astype("<u4")
                crc = [zlib.crc32(words[i:j]) for i, j in zip(begins.tolist(), ends.tolist())]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(start + begins, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begins, n).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"] + (["ids"] if keep_ids else []))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    placed = files.join(F.broadcast(parts), "part")
    return placed.select(F.col("base") + F.col("before"), "n_ids", "doc_ids", "sizes", "blocks").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the token files of ``docs(doc_id, text, ...)`` to the shared folder and read them back.

    A null or empty text is the end id alone.  Rows that repeat a doc_id follow each other; null ids come first; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    out = scratch(spark, "tokens")
    write_tokens(docs, out, path, end_id)
    return read_tokens(spark, out)
