"""All queries of the library's own operators by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import imagery, learning, logs, spatial, stats, survey

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _plans in (survey, spatial, stats, imagery, learning, logs):
    QUERIES |= _plans.query.queries
    ORACLE_SQL |= _plans.query.sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households to cluster means, locations, buffers, a grid's coverage and its labels above the threshold."""
    return spatial.flagship(spark, sf_dir)
