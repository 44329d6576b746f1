"""Change feeds as Structured Streaming: newest-wins upserts, each micro-batch one generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import Buckets
from ..sources.store import Store


def stream_upsert(changes: DataFrame, store: Store, table: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Folds ``changes`` (key, version, payload) into the buckets of ``table``, each micro-batch at its own cost. A batch that
    is replayed changes nothing, and the batch number in the manifest says which was last committed."""
    to = Buckets(store, table, key)
    return changes.writeStream.foreachBatch(lambda batch, number: to.merge(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(changes: DataFrame, key: list[str], time: str = "ts", overlap: str = "5 minutes") -> DataFrame:
    """Changes read again because listings overlap are dropped within the watermark."""
    return changes.withWatermark(time, overlap).dropDuplicatesWithinWatermark(key)
