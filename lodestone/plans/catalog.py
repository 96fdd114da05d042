"""All core queries: the general data-processing problems and the operators on structures, phases and series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import analysis, materials, problems, reference


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return problems.queries() | reference.QUERIES | analysis.QUERIES | materials.QUERIES


def oracle_sql() -> dict[str, str]:
    return problems.oracle_sql() | reference.SQL | analysis.SQL | materials.SQL
