"""All queries of the price domain, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import decision_queries, feed_queries, history_queries, match_queries, offer_queries, ops_queries, sale_queries

_ALL = [history_queries, offer_queries, sale_queries, decision_queries, feed_queries, ops_queries, match_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for module in _ALL for name, (q, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _ALL for name, (_, sql) in module.QUERIES.items() if sql}
