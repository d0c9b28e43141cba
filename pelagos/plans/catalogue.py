"""All queries over the driver's tables, by name, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pelagos.plans import layers, panels, places, points, registry, rollups, texts, wire  # noqa: F401  (registers its queries)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.exceed_curve(spark, sf_dir)
