"""Ranks over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import cut


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``rank`` from 1 in the order of the columns.

    The rows are range-partitioned and kept; each range is ranked by itself and moved on by the sizes of those before.
    Only one count per range reaches the driver's side of the plan.
    """
    ranges = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # one row per partition
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn("rank", within).join(F.broadcast(before), "__range").withColumn("rank", F.col("rank") + F.col("__before")).drop("__range", "__before")


def hold_out(documents: DataFrame, key: str = "file_name", share: float = 0.25) -> DataFrame:
    """``key, split``: the last ``share`` of the distinct keys in their order are the test set."""
    ranked = global_rank(documents.where(F.col(key).isNotNull()).select(key).distinct(), key)
    total = ranked.agg(F.count(F.lit(1)).alias("total"))
    return ranked.crossJoin(F.broadcast(total)).select(key, F.when(F.col("rank") > F.col("total") - F.ceil(F.col("total") * share), "test").otherwise("train").alias("split"))
