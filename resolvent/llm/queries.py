"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import importable, table
from . import ball_tree, decontam, filter_audit, line_dedup, matroska, packing, quality, simhash, substring_dedup, token_count, token_files, toxicity, url_filter
from .oracles import ORACLE_SQL


#: Vocabulary file of the token operators, a name that ``public_tokenizers.path`` resolves.
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of a public tokenizer file; the library is looked up only when a token operator runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.drop("key")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=3, held=1, threshold=0.5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=4, held=2, threshold=0.3)


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(importable(spark), sf_dir, "documents"), vocabulary(), limit=2048)


#: The URL rules of the query.
RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(importable(spark), sf_dir, "pages"), RULES)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(importable(spark), sf_dir, "documents"), vocabulary(), end_id=2)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(importable(spark), sf_dir, "documents"), vocabulary(), window=2048, end_id=1)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(importable(spark), sf_dir, "documents"), size=3, radius=3)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(importable(spark), sf_dir, "documents"), min_words=line_dedup.MIN_WORDS)


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(table(importable(spark), sf_dir, "documents"), frame=576)


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.clusters(table(importable(spark), sf_dir, "embeddings"), dims=64, k=16, rounds=3)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(importable(spark), sf_dir, "documents"), window=13)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_audit(table(importable(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_token_count": op4_token_count,
    "op5_url_filter": op5_url_filter,
    "op6_token_files": op6_token_files,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_matroska": op10_matroska,
    "op11_ball_tree": op11_ball_tree,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_filter_audit": op13_filter_audit,
}

__all__ = ["ORACLE_SQL", "QUERIES", "vocabulary"]
