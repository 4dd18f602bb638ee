"""Parquet tables of a folder, read lazily with only the columns that a query uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rows(spark: SparkSession, entity, values: list[tuple]) -> DataFrame:
    """Rows given in memory, in the entity's schema."""
    return spark.createDataFrame(values, entity.schema())
