"""Structured Streaming into a pattern index: each micro-batch is one insert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from glyphlake.operators.index import PatternIndex


def ingest(stream: DataFrame, index: PatternIndex, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Starts a query that adds the stream's rows to the index.

    A batch that was added but not yet acknowledged comes again after a failure; the index's manifest
    holds the last number of each checkpoint, so it is not added twice. Size-tiered merges run inside the
    insert.
    """

    def add(batch: DataFrame, number: int) -> None:
        index.insert(batch, (checkpoint, number))

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
