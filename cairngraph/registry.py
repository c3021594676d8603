"""All queries of the engine with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import build_queries, eval_queries, nav_queries, pattern_queries, search_queries

MODULES = (build_queries, eval_queries, nav_queries, pattern_queries, search_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders of each nation's customers have the most distinct parts, ties kept."""
    return pattern_queries.rank_pool_ties(spark, sf_dir)
