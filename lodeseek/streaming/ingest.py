"""Documents from a stream of files into a store, in micro-batches that can be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodeseek.sources.store import Store


def ingest(rows: DataFrame, store: Store, index: Callable[[DataFrame], DataFrame], checkpoint: str, keys: tuple[str, ...] = ("source", "source_id")) -> StreamingQuery:
    """Reads what there is of ``rows`` (a streaming DataFrame) and upserts ``index`` of each batch by ``keys``.

    The store notes the batch with the version that it makes, by the stream's checkpoint,
    so one that comes again after a failure changes nothing.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        store.upsert(index(batch), keys, stream=(checkpoint, number))

    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
