"""Session settings that the operators rely on, and the folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # small data that grows within a stage keeps all cores
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``; only where neither that nor a directory set on the
    context exists (tests, a laptop) a temporary folder is taken.
    """
    context = spark.sparkContext
    chosen = context._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "lexweave-checkpoints")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the shared checkpoint folder and go on from its files.

    Unlike a checkpointed plan, the files bring their true size: the estimates of a loop of joins would otherwise multiply
    from round to round. The tables are removed by ``clear``, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/lexweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: dict[SparkContext, list[str]] = {}


def clear(spark: SparkSession) -> None:
    """Remove the tables written so far, for a long session whose earlier results are done with."""
    context = spark.sparkContext
    for path in _written.pop(context, []):
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove() -> None:
    for context in list(_written):
        try:
            for path in _written.pop(context):
                p = context._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may be gone by then
            return
