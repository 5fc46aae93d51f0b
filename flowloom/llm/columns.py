"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of one Arrow batch handed to a Python worker: what a task holds of the texts at once.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by rows and bytes, so that long texts do not multiply in a worker's memory.

    Spark reads these settings when a plan runs, not when it is made, so they stay set for the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def wide_batches(spark: SparkSession) -> Iterator[None]:
    """While a table of numbers is written: more rows to a batch, still limited by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(64 * BATCH_ROWS))
    try:
        yield
    finally:
        bound_batches(spark)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` for functions that turn one batch into one batch (or none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a value of bounded size; the function gives it back on executors, unpacked once per task.

    It is packed by value, like the functions that use it, so executors need not have its class installed.
    """
    sent, held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get() -> object:
        if not held:
            held.append(cloudpickle.loads(sent.value))
        return held[0]

    return get


def utf8(column: pa.Array) -> list[bytes]:
    """The strings of a column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A to Z in lower case, all else as it is: ``lower`` would also fold other alphabets.
def lower_ascii(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
