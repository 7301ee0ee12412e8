"""The queries over the reference tables, and the DuckDB SQL that must agree with them.

Doubles are rounded to six places on both sides, here and nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: the query ``name``, with its SQL where SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


from corpusloom.queries import (  # noqa: E402, F401
    gap_queries, text_queries, report_queries, vector_queries, dsl_queries, source_queries, entity_queries, decision_queries, passage_queries, discovery_queries, workflow_queries, file_queries, stream_queries,
)
