"""Continuous queries: the stateless query functions applied to each micro-batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def each_batch(stream: DataFrame, query: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream that applies a batch query to every micro-batch; write gets the result and the batch number."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: write(query(df), n)).start()
