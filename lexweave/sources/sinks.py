"""Writers: JSON columns in CSV, partitioned Parquet, request lines and single-file reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_columns(df: DataFrame) -> DataFrame:
    """Arrays, structs and maps as JSON text."""
    return df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))


def csv(df: DataFrame, path: str, *partition: str) -> None:
    """CSV with a header, nested columns as JSON."""
    writer = json_columns(df).write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.partitionBy(*partition) if partition else writer).csv(path)


def parquet(df: DataFrame, path: str, *partition: str) -> None:
    """Parquet, partitioned by columns of few values."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def lines(df: DataFrame, path: str, column: str = "line") -> None:
    """One text line per row."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def report(df: DataFrame, path: str) -> None:
    """A small report in one file."""
    json_columns(df).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json(df: DataFrame, path: str) -> None:
    """One JSON object per line, nested columns as they are."""
    df.write.mode("overwrite").json(path)
