"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill.plans import model_queries, relation_queries, search_queries, session_queries, store_queries, text_queries

FLAGSHIP = "daily_activity"
MODULES = (session_queries, relation_queries, search_queries, text_queries, store_queries, model_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
