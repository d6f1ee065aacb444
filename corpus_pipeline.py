"""The corpus pipeline: five stages over ``documents``, each one of the operators, written and read between stages.

Toxic documents go, later repeated runs of lines are deleted, one document of each near-duplicate group stays,
documents that share a passage with the benchmark go, and the rest is packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from resolvent.llm import decontam, line_dedup, near_copies, packing, toxicity
from resolvent.llm.queries import vocabulary
from resolvent.session import importable, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.3 or more go; null and empty texts have no words and stay, repeated rows share a
    score, an empty table or one without labelled documents loses nothing, and extra columns go along."""
    return toxicity.accepted(docs, table(importable(spark), sf_dir, "labels"), threshold=0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of 25 words or more are deleted from the texts, and ``n_chars`` follows; no document goes.  Null
    and empty texts stay, of equal texts the one with the smallest doc_id keeps its lines, repeated rows are one document."""
    importable(spark)
    return line_dedup.clean(docs, min_words=line_dedup.MIN_WORDS, length="n_chars")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id (nulls last), then the smallest text hash.  SimHash
    fingerprints within 3 bits and MinHash bands propose, the exact sets of shingles decide.  Texts without words, null ones
    too, are copies of each other; of repeated rows one stays."""
    importable(spark)
    return near_copies.representatives(docs, size=5, similarity=0.8, radius=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share 10 consecutive words with a benchmark item, or all of a shorter one, go; null and empty texts stay,
    and so does everything where the benchmark is empty."""
    return decontam.clean(docs, table(importable(spark), sf_dir, "benchmark"), size=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents that are left: a null or empty text is the end id alone, repeated rows are packed each,
    an empty table gives no rows."""
    importable(spark)
    return packing.pack(docs, vocabulary(), window=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder, read by the next."""
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs


#: Training and tokens cannot be written in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None
