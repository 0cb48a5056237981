"""Registry of the availability queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyobs.plans import availability, evaluation, models, pixels, reports, spatial

MODULES = [availability, spatial, evaluation, pixels, models, reports]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal gap statistics, validated and pivoted."""
    return queries()["gaps_stats_wide"](spark, sf_dir)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
