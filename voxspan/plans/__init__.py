"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import clouds, graphs, reports, transfers

    return clouds.QUERIES | graphs.QUERIES | reports.QUERIES | transfers.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import clouds, graphs, reports, transfers

    return clouds.SQL | graphs.SQL | reports.SQL | transfers.SQL
