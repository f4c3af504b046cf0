"""All queries of the library, llm excepted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import audits, bindings, fitted, panels, reports, sequences, tables  # noqa: F401  registering


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(bindings.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(bindings.SQL)
