"""All queries of the library by name, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamgrid.plans import analytics, answers, bundles, clinical, content, flow, retrieval, search, understanding

_MODULES = [retrieval, understanding, analytics, content, answers, bundles, search, clinical, flow]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
