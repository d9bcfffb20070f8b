"""Film batches in a bucketed store, from a stream too.

A micro-batch of partial film records changes the header and its eight child
tables; they become visible together, see ``sources.batches``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoframe.plans.catalogue import KEY, apply_folded, fold_film_batch
from kinoframe.schemas import CHILD_TABLES, KEYS, SCHEMAS
from kinoframe.session import cut_lineage
from kinoframe.sources.batches import BatchStore

FILM_TABLES = ["movies", *CHILD_TABLES]


def film_store(spark: SparkSession, root: str, buckets: int = 64) -> BatchStore:
    """The nine film tables as one store."""
    return BatchStore(spark, root, {n: SCHEMAS[n] for n in FILM_TABLES}, KEY, {n: KEYS[n] for n in FILM_TABLES}, buckets)


def merge_film_batch(store: BatchStore, batch: DataFrame, order: Sequence[str] = (), source: str = "batch",
                     batch_id: int | None = None) -> int:
    """U7 on the touched buckets only: the batch is folded to one record a
    film and dealt into the buckets; the stored rows do not move. Rows without
    a film key are left out."""
    if batch_id is not None and batch_id <= store.taken(source):
        return store.version()
    folded = cut_lineage(fold_film_batch(batch.where(F.col(KEY).isNotNull()), order), "film-batch")
    return store.apply(folded, lambda tables, rows: apply_folded(tables, store.spread(rows), null_keys=False), source, batch_id)


def film_batch_writer(store: BatchStore, source: str, order: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each micro-batch."""
    def process(batch: DataFrame, batch_id: int) -> None:
        merge_film_batch(store, batch, order, source, batch_id)
    return process
