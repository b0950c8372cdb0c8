"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import findings, problems, status, summary, views  # noqa: F401 - views register themselves
from .base import REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{name: q.run for name, q in REGISTRY.items()}, **problems.queries()}


def oracle_sql() -> dict[str, str]:
    return {**{name: q.sql for name, q in REGISTRY.items() if q.sql}, **problems.oracle_sql()}
