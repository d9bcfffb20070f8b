"""Tasks held to a cap per source and hour.

Every source has ``cap`` slots an hour. A task takes the first slot of its own
hour or, where those are taken, the next one free, so tasks keep their order
and none is lost. With slots numbered from the epoch, the i-th task of a
source has slot ``i + max(last, max over j <= i of cap * hour(j) - j)``: a
running maximum, found in two levels so that no task of Spark's holds a whole
source. Between micro-batches a source's state is one number, its last slot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinoframe.session import cut_lineage
from kinoframe.sources.batches import BatchStore

STATE = T.StructType([T.StructField("source", T.StringType()), T.StructField("last_slot", T.LongType())])


def pace(tasks: DataFrame, source: str, ts: str, order: Sequence[str], caps: dict[str, int],
         last: DataFrame | None = None, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(tasks with ``slot`` and ``release_at``, (source, last_slot) of the
    sources that had tasks). ``order`` is a total order of a source's tasks;
    ``last`` holds the sources' last slots. Tasks of a source without a cap,
    or without a time, have no slot and are released at their time."""
    spark = tasks.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cap = F.coalesce(*[F.when(F.col(source) == s, F.lit(c)) for s, c in caps.items()], F.lit(None).cast("int")).cast("long")
    hour = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 3600)
    rows = tasks.withColumns({"_cap": cap, "_hour": hour})
    capped = F.col("_cap").isNotNull() & F.col("_hour").isNotNull()
    ranged = cut_lineage(rows.where(capped).repartitionByRange(n, F.col(source), *[F.col(c) for c in order])
                         .withColumn("_slice", F.spark_partition_id()), "paced")
    upto = Window.partitionBy(source, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_i", F.row_number().over(Window.partitionBy(source, "_slice").orderBy(*order)))
    local = local.withColumn("_most", F.max(F.col("_cap") * F.col("_hour") - F.col("_i")).over(upto))
    # a row for each slice of a source
    slices = local.groupBy(F.col(source).alias("_s"), F.col("_slice").alias("_k")).agg(F.max("_i").alias("_n"), F.max("_most").alias("_m"))
    before = Window.partitionBy("_s").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    slices = slices.withColumn("_prev", F.max(F.col("_m") - F.col("_off")).over(before))
    if last is not None:
        slices = slices.join(last.select(F.col("source").alias("_s"), F.col("last_slot").alias("_last")), "_s", "left")
        slices = slices.withColumn("_prev", F.greatest("_prev", "_last"))
    slices = cut_lineage(slices, "paced-slices")
    placed = local.join(slices, (F.col(source) == F.col("_s")) & (F.col("_slice") == F.col("_k")))
    most = F.greatest(F.col("_most") - F.col("_off"), F.col("_prev"))          # a NULL does not count
    placed = placed.withColumn("slot", F.col("_off") + F.col("_i") + most)
    at = F.greatest(F.col(ts).cast("timestamp"), F.timestamp_seconds(F.floor(F.col("slot") / F.col("_cap")) * 3600))
    out = placed.select(*tasks.columns, "slot", at.alias("release_at"))
    free = rows.where(~capped).select(*tasks.columns, F.lit(None).cast("long").alias("slot"), F.col(ts).cast("timestamp").alias("release_at"))
    ends = slices.groupBy(F.col("_s").alias("source")).agg((F.sum("_n") + F.max(F.greatest(F.col("_m") - F.col("_off"), F.col("_prev")))).alias("last_slot"))
    return out.unionByName(free), ends


def pace_store(spark: SparkSession, root: str, tasks: T.StructType, key: str, buckets: int = 64) -> tuple[BatchStore, BatchStore]:
    """Stores of the released tasks, by id, and of the sources' last slots."""
    released = T.StructType([*tasks.fields, T.StructField("slot", T.LongType()), T.StructField("release_at", T.TimestampType())])
    return (BatchStore(spark, f"{root}/released", {"tasks": released}, key, {"tasks": [key]}, buckets),
            BatchStore(spark, f"{root}/slots", {"slots": STATE}, "source", {"slots": ["source"]}, 1))


def pace_writer(stores: tuple[BatchStore, BatchStore], name: str, source: str, ts: str, order: Sequence[str],
                caps: dict[str, int]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that releases each micro-batch's tasks
    after those before it. The tasks are written first and by id, the last
    slots after; a batch that failed between the two gets the same slots when
    it is done again, as the slots it started from have not moved."""
    tasks, slots = stores

    def process(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= slots.taken(name):
            return
        rows = cut_lineage(batch, "pace-batch")
        placed, ends = pace(rows, source, ts, order, caps, slots.read("slots"))
        placed, ends = cut_lineage(placed, "pace-placed"), cut_lineage(ends, "pace-ends")
        tasks.apply(placed, lambda old, new: {"tasks": old["tasks"].join(tasks.spread(new.select(tasks.key)), tasks.key, "left_anti")
                                              .unionByName(new)}, name, batch_id)
        slots.apply(ends, lambda old, new: {"slots": old["slots"].join(slots.spread(new.select("source")), "source", "left_anti")
                                            .unionByName(new)}, name, batch_id)
    return process
