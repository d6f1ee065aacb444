"""Session plumbing: durable cuts of lineage and bounded Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch, shared_folder

#: Most rows and bytes of one Arrow batch.
BATCH_ROWS = 2000
BATCH_BYTES = "16m"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a Python worker holds a few megabytes of text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through files in the shared folder.

    They outlive any executor and are removed by Spark's cleaner with the data frame.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder, compressed, and read it from there; its path, for ``discard``."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that ``written`` made and nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files and checkpoints of data frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, which gives the memory it has freed back to the system when a task ends: workers live on between
    stages, and what one stage leaves in their heaps would count against the next."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return wrapped


def row_base() -> int:
    """First row number of this task: unique over the partitions of one stage."""
    return TaskContext.get().partitionId() << 33
