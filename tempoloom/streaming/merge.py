"""New documents as a stream: each micro-batch's mentions are appended to the mention tables, from which nodes and edges follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_mentions(documents: DataFrame, to_mentions: Callable[[DataFrame], tuple[DataFrame, DataFrame]], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """documents: a streaming DataFrame. A batch that is run again overwrites its own part, so that each counts once."""

    def batch(df: DataFrame, number: int) -> None:
        entities, relations = to_mentions(df)
        entities.write.mode("overwrite").parquet(f"{path}/entity_mentions/batch={number}")
        relations.write.mode("overwrite").parquet(f"{path}/relation_mentions/batch={number}")

    writer = documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
