"""Intermediate tables in the folder that driver and executors share.

Iterative plans cut their lineage by writing a Parquet table below ``spark.checkpoint.dir`` and reading it
again.  Unlike cached or locally checkpointed blocks such a table survives lost executors, and unlike
``Dataset.checkpoint`` the plan behind it runs once.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULT = "file:///tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or a local one where it is unset and Spark runs in one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL_DEFAULT


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table or set of files of this application."""
    return f"{shared_root(spark)}/flowloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more.

    Spark removes them when the driver collects its garbage, which with a large heap is long after they pile up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cleanup(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it when no DataFrame built on them is needed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
        f"{shared_root(spark)}/flowloom/{spark.sparkContext.applicationId}"
    )
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
