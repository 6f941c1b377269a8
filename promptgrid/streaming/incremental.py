"""A pipeline over a stream of source rows, one micro-batch after the other, resumed from its checkpoint.

An extension. Every batch runs the same stages as the batch pipelines and is written under its number, so a batch that
is tried again after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def run_stream(source: DataFrame, pipeline: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """``pipeline`` over each micro-batch of ``source``, into ``path``/batch=<n> as Parquet."""

    def write(batch: DataFrame, number: int) -> None:
        pipeline(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
