"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", partitions: int = 8, app: str = "barloom", shared: str | None = None) -> SparkSession:
    """A session for tests and benches; on a cluster the session comes from spark-submit.

    ``shared`` is the folder for checkpoints and written tables.
    """
    builder = SparkSession.builder.config("spark.checkpoint.dir", shared) if shared else SparkSession.builder
    return (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        # A whole analysis has more than the default 100 generated classes; beyond that every task recompiles.
        .config("spark.sql.codegen.cache.maxEntries", "4000")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root


@functools.cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="barloom-")


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table written below the checkpoint folder: computed once, cut from their lineage, of known size.

    Where that folder is unset, a local session (one machine) takes a folder of its own.
    """
    spark = df.sparkSession
    local = not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local")
    path = f"{(_local_root() if local else checkpoint_root(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
