"""The registered queries of the library and their DuckDB equivalents, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caselens.plans import analytics, application, catalogs, evidence, grid, inquiries, pages, phases, ranking, reports, retrieval, topic_ranking

MODULES = [retrieval, analytics, pages, ranking, application, reports, catalogs, inquiries, grid, topic_ranking, phases, evidence]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
