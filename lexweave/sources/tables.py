"""Parquet tables of one data directory, read lazily so that Catalyst prunes columns and pushes filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root`` (one file or a folder of part files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")
