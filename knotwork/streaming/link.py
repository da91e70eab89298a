"""Micro-batch linkage of arriving records against a fixed catalog. An addition: the batch plans need no stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def link_stream(arriving: DataFrame, link: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Links each micro-batch and appends the result; a batch that is run again overwrites its own folder, so results come once."""

    def one(batch: DataFrame, number: int) -> None:
        link(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
