"""Registry of the engine's own queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "bm25_search"


def _modules() -> list:
    from coppice.plans import artifact_queries, document_queries, relational_queries, structure_queries, text_queries

    return [text_queries, structure_queries, relational_queries, document_queries, artifact_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in _modules() for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, (_, sql) in m.QUERIES.items() if sql}
