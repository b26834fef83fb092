"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_formats, queries_graphs, queries_patterns, queries_repository, queries_rules, queries_scalars, queries_sets  # noqa: F401  they register their queries
from .queries_patterns import flagship  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
