"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewright.plans import desk_queries, ledger_queries, pixel_queries, service_queries, stream_queries

_MODULES = (pixel_queries, ledger_queries, stream_queries, desk_queries, service_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.oracle_sql().items()}
