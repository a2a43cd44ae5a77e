"""Streaming top-k: a stream of query vectors against a static candidate index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillmesh.operators.retrieval import top_k


def score_stream(queries: DataFrame, candidates: DataFrame, path: str, checkpoint: str, k: int = 10) -> StreamingQuery:
    """Start a query that writes each micro-batch's top-k as a folder of its own.

    Overwriting the batch's folder makes a repeated batch harmless.
    """
    index = candidates.cache()

    def write(batch: DataFrame, number: int) -> None:
        top_k(batch, index, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
