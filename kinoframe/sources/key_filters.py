"""Bloom filters of the keys in each bucket of a store.

A bucket's filter is a set of bitmap pages of 32,768 bits, made by Spark's
bitmap aggregate from hashes of the keys, map-side first. A batch is checked
against the pages of its buckets: a key that a filter does not know is surely
not stored, one that it knows is looked up in the key columns of its bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinoframe.session import cut_lineage
from kinoframe.sources.batches import BUCKET, BatchStore
from kinoframe.streaming.streams import written_so_far

PAGE_BITS = 32768    # of Spark's bitmaps
BITS_PER_KEY = 10    # with HASHES probes about one unknown key in a hundred is looked up
HASHES = 6
PAGES = "slot int, pages int, page int, bits binary, version long"


def _places(keys: Sequence[str], pages: Column) -> Column:
    """The bit positions of a key in a filter of so many pages."""
    probes = [F.pmod(F.xxhash64(F.lit(i), *keys), pages * F.lit(PAGE_BITS)) for i in range(HASHES)]
    return F.array(*probes)


def filter_pages(rows: DataFrame, keys: Sequence[str], slot: Column) -> DataFrame:
    """(slot, pages, page, bits): the filters of the rows' keys by slot, sized
    by the number of keys in each."""
    named = rows.select(slot.alias("slot"), *keys)
    sizes = named.groupBy("slot").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * BITS_PER_KEY / PAGE_BITS)).cast("int").alias("pages"))
    spots = named.join(sizes, "slot").select("slot", "pages", F.explode(_places(keys, F.col("pages"))).alias("at"))
    return (spots.groupBy("slot", "pages", F.floor(F.col("at") / PAGE_BITS).cast("int").alias("page"))
            .agg(F.bitmap_construct_agg((F.col("at") % PAGE_BITS)).alias("bits")))


def write_filters(store: BatchStore, name: str, version: int) -> None:
    """The filters of the buckets that a version wrote, from their key
    columns; written beside the table."""
    rows = store.spark.table(f"`{store.database}`.`{name}`").where(F.col("_version") == version)
    pages = filter_pages(rows, store.declared_keys(name), F.col(BUCKET))
    pages.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(
        f"{store.root}/filters/{name}/made={version}")


def read_filters(store: BatchStore, name: str, buckets: Sequence[int]) -> DataFrame:
    """The filter pages of some buckets at the last commit."""
    found = written_so_far(store.spark, f"{store.root}/filters/{name}", PAGES + ", made int")
    held = {b: v for b, v in store.held(name).items() if b in set(buckets)}
    if found is None or not held:
        return store.spark.createDataFrame([], PAGES).drop("version")
    wanted = F.lit(False)
    for version in sorted(set(held.values())):
        wanted = wanted | ((F.col("made") == version) & F.col("slot").isin([b for b, v in held.items() if v == version]))
    return found.where(wanted).select("slot", "pages", "page", "bits")


def _maybe_stored(rows: DataFrame, keys: Sequence[str], pages: DataFrame) -> DataFrame:
    """The ``_row`` of the rows whose key the filters know."""
    sizes = pages.select("slot", "pages").distinct()
    spots = rows.join(sizes, "slot").select("_row", "slot", F.explode(_places(keys, F.col("pages"))).alias("at"))
    spots = spots.select("_row", "slot", F.floor(F.col("at") / PAGE_BITS).cast("int").alias("page"), (F.col("at") % PAGE_BITS).alias("bit"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), F.col("bit") % 8).cast("int")) > 0, F.lit(False))
    known = spots.join(pages.select("slot", "page", "bits"), ["slot", "page"], "left").withColumn("on", is_set)
    return known.groupBy("_row").agg(F.min("on").alias("all")).where("all").select("_row")


def _stored(store: BatchStore, name: str, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ``_row`` of the rows whose key the table holds: the filters first,
    then the key columns of the buckets with a hit."""
    buckets = sorted(r[0] for r in rows.select("slot").distinct().collect())      # at most the store's buckets
    hits = cut_lineage(rows.join(_maybe_stored(rows, keys, read_filters(store, name, buckets)), "_row", "left_semi"), "key-hits")
    known = sorted(r[0] for r in hits.select("slot").distinct().collect())
    held = store.read(name, known).select(*keys).distinct()
    return hits.join(held, list(keys), "left_semi").select("_row")


def check_batch(store: BatchStore, name: str, batch: DataFrame, order: Sequence[str], parent: str | None = None,
                reason: str = "reason") -> DataFrame:
    """The batch with a reason a row, so that bad rows are refused one by one
    (``quarantine`` for a store): 'null_key', 'orphan' (the parent table lacks
    the store's key), 'duplicate' (the table holds the key), 'repeated' (an
    earlier row of the batch, by ``order``, has it) or 'ok'."""
    keys = store.declared_keys(name)
    rows = cut_lineage(batch.withColumn("_row", F.monotonically_increasing_id()), "key-batch")
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    keyed = rows.where(~missing).withColumn("slot", store.bucket())
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "_row")) > 1
    out = keyed.withColumn("_again", first)
    out = out.join(_stored(store, name, keyed, keys).withColumn("_held", F.lit(True)), "_row", "left")
    why = F.when(F.col("_held"), "duplicate").when(F.col("_again"), "repeated").otherwise("ok")
    if parent is not None:
        found = _stored(store, parent, keyed, [store.key]).withColumn("_parent", F.lit(True))
        out = out.join(found, "_row", "left")
        why = F.when(F.col("_parent").isNull(), "orphan").otherwise(why)
    out = out.withColumn(reason, why).select(*batch.columns, reason)
    return out.unionByName(rows.where(missing).withColumn(reason, F.lit("null_key")).select(*batch.columns, reason))
