"""Continuous ingestion: raw transfers are validated as they arrive and kept as the table that the operators read.

Both outputs are append-only file sinks with their own checkpoints, so each raw transfer lands in exactly one of
them once, whatever is restarted.  The accepted table is partitioned by time slice, which is what the ledger and
relay operators cut time into, so a run over some weeks reads only their folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.operators.ledger import SLICE_BLOCKS
from flowloom.operators.model import accepted, rejected


def ingest(raw: DataFrame, path: str, checkpoint: str, slice_blocks: int = SLICE_BLOCKS, once: bool = False) -> list[StreamingQuery]:
    """Start writing a stream of raw transfers below ``path`` as ``accepted`` and ``rejected``.

    ``raw`` has the columns of transfers with ``value`` as text.  With ``once``, what is there is written and the
    queries end by themselves.
    """

    def start(rows: DataFrame, name: str, *by: str) -> StreamingQuery:
        writer = rows.writeStream.format("parquet").outputMode("append").option("path", f"{path}/{name}").option("checkpointLocation", f"{checkpoint}/{name}")
        writer = writer.partitionBy(*by) if by else writer
        return (writer.trigger(availableNow=True) if once else writer).start()

    good = accepted(raw).withColumn("slice", F.floor(F.col("block_number") / slice_blocks))
    return [start(good, "accepted", "slice"), start(rejected(raw), "rejected")]
