"""Matching posts as they arrive: each micro-batch runs the batch plan against the static lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexweave.operators import matching


def match_arriving(spark: SparkSession, posts_folder: str, schema, lexicon: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parquet files that appear in a folder are matched and appended to ``out``; a batch that is run again replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        matching.match_posts(batch, lexicon).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(posts_folder)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
