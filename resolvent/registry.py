"""Registry of queries: name -> Spark callable, and name -> the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import audit_queries, curation_queries, decision_queries, graph_queries, resolution, source_queries
from .session import importable

Query = Callable[[SparkSession, str], DataFrame]


def _ready(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(importable(spark), sf_dir)

    return run


_MODULES = (resolution, graph_queries, decision_queries, audit_queries, curation_queries, source_queries)
QUERIES: dict[str, Query] = {name: _ready(f) for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items() if sql}
