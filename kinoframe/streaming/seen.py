"""Repeated fetches beyond the watermark.

A stream's de-duplication state must be bounded, so it covers the watermark's
delay only (``streams.dedupe``). Records that come again later are found in a
store of the records that were seen: a micro-batch is compared with the
buckets of its own ids, and what is new is kept there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kinoframe.session import cut_lineage
from kinoframe.sources.batches import BatchStore

TABLE = "records"


def seen_store(spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int = 64) -> BatchStore:
    """A store of records by id, each id once."""
    return BatchStore(spark, root, {TABLE: schema}, key, {TABLE: [key]}, buckets)


def drop_seen(store: BatchStore, batch: DataFrame, source: str = "batch", batch_id: int | None = None) -> int:
    """Keep the batch's records whose id the store does not hold, one of each
    id; rows without an id are left out. Only the buckets of the batch's ids
    are read and written, and the stored side does not move; a replayed batch
    adds nothing. Returns the version that holds them."""
    key = store.key
    rows = cut_lineage(batch.where(batch[key].isNotNull()).dropDuplicates([key]), "seen-batch")

    def change(tables: dict[str, DataFrame], given: DataFrame) -> dict[str, DataFrame]:
        old = tables[TABLE]
        new = store.spread(given.select(*old.columns)).join(old.select(key), key, "left_anti")
        return {TABLE: old.unionByName(new.select(*old.columns))}

    return store.apply(rows, change, source, batch_id)


def drop_seen_writer(store: BatchStore, source: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps what is new of each batch."""
    def process(batch: DataFrame, batch_id: int) -> None:
        if batch_id > store.taken(source):
            drop_seen(store, batch, source, batch_id)
    return process
