"""Structured Streaming jobs (T1-T4): landed raw records in, current
records / snapshots / de-duplicated rows / rate counts out.

Sources are file streams (``readStream``); every query runs with a
checkpoint location in the shared folder, so a restarted job resumes where
it stopped. Timestamps arrive as ``timestamp_ntz`` and are cast to
``timestamp`` (watermarks reject NTZ).
"""

from __future__ import annotations

import logging
from typing import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoframe.operators.merge import fold_log
from kinoframe.session import work_path
from kinoframe.sources.tables import TableStore


def file_stream(spark: SparkSession, folder: str, file_glob: str, max_files_per_trigger: int | None = None,
                ts_cols: Sequence[str] = ()) -> DataFrame:
    """Parquet file stream over the files of ``folder`` matching the glob;
    the schema is taken from the files once (no inference per batch)."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.parquet(folder)
    for c in ts_cols:
        df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def run_available(stream: DataFrame, name: str, output_mode: str = "update",
                  batch_fn: Callable[[DataFrame, int], None] | None = None) -> str:
    """Run a streaming query over everything available now and stop
    (``trigger(availableNow=True)``). Without ``batch_fn``: in complete mode
    each micro-batch overwrites one Parquet snapshot; otherwise each batch
    is written to its own ``batch=<id>`` folder (a replayed batch rewrites
    only its own folder, so the sink is idempotent). Returns the output
    folder."""
    spark = stream.sparkSession
    out = work_path(spark, f"stream-{name}")
    ckpt = work_path(spark, f"stream-{name}-ckpt")

    def overwrite(batch: DataFrame, batch_id: int) -> None:
        if output_mode == "complete":
            batch.write.mode("overwrite").parquet(out)
        else:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (stream.writeStream.outputMode(output_mode).foreachBatch(batch_fn or overwrite)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    late = sum(int(o.get("numRowsDroppedByWatermark", 0)) for p in q.recentProgress for o in p["stateOperators"])
    if late:
        logging.getLogger(__name__).warning("%s: %d rows were later than the watermark and dropped", name, late)
    return out


def written_so_far(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The Parquet table at ``path``, or None before its first write."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_output(spark: SparkSession, out: str, schema=None) -> DataFrame:
    """Read a :func:`run_available` folder (batch folders unioned); a stream
    that had no data yet gives an empty frame when ``schema`` is known."""
    df = written_so_far(spark, out) if schema is None else written_so_far(spark, out, schema)
    if df is None:
        return spark.createDataFrame([], schema)
    return df.drop("batch") if "batch" in df.columns else df


def current_record(stream: DataFrame, key: str, order: Sequence[str], columns: Sequence[str],
                   keep_first: Sequence[str] = ()) -> DataFrame:
    """Streaming fold of partial records (U8): per key and column the
    latest non-NULL value by ``order``; ``keep_first`` columns the earliest.
    Order-free, so late rows land in the right place. State: one row per
    key (inherent to a current-record view). The same aggregation as the
    batch fold, run as a streaming aggregation."""
    return fold_log(stream, key, order, columns, keep_first)


def to_pairs(log: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Partial records -> per column struct(_at, v) carrying its own stamp."""
    at = F.struct(*[F.col(c) for c in order])
    return log.select(key, *[F.when(F.col(c).isNotNull(), F.struct(at.alias("_at"), F.col(c).alias("v"))).alias(c)
                             for c in columns])


def fold_pairs(pairs: DataFrame, key: str, columns: Sequence[str], keep_first: Sequence[str] = ()) -> DataFrame:
    """Fold stamped pairs: max (or min for keep_first) of struct(_at, v);
    NULL pairs are skipped, so a NULL never overwrites."""
    return pairs.groupBy(key).agg(*[(F.min(c) if c in keep_first else F.max(c)).alias(c) for c in columns])


def from_pairs(pairs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return pairs.select(key, *[F.col(c)["v"].alias(c) for c in columns])


def snapshot_writer(store: TableStore, table: str, key: str, order: Sequence[str], columns: Sequence[str],
                    keep_first: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: fold the micro-batch into the current
    snapshot and write it as a new version. The fold is a maximum over
    stamped pairs, so a replayed batch (also one from a new checkpoint on an
    old store) changes nothing. The previous version is read, never
    overwritten."""
    def process(batch: DataFrame, batch_id: int) -> None:
        new = to_pairs(batch, key, order, columns)
        if store.exists(table):
            new = store.read(table).unionByName(new)
        store.write(table, fold_pairs(new, key, columns, keep_first))
    return process


def bucket_of(key, buckets: int) -> Column:
    keys = [key] if isinstance(key, str) else list(key)
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def partial_snapshot_writer(path: str, key: str, order: Sequence[str], columns: Sequence[str],
                            keep_first: Sequence[str] = (), buckets: int = 256
                            ) -> Callable[[DataFrame, int], None]:
    """T2 at scale: the snapshot is partitioned by a hash bucket of the key
    and each micro-batch rewrites only the buckets it touches (dynamic
    partition overwrite), so a batch costs O(touched state), not O(state).

    The merge is a max over stamped pairs, hence idempotent: a replayed or
    half-applied batch folded again gives the same snapshot. The merged
    buckets are first written to a fresh folder (lineage cut), so the
    snapshot path is never read and overwritten in one plan.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        new = to_pairs(batch, key, order, columns).withColumn("_bucket", bucket_of(key, buckets))
        _rewrite_touched(path, new, batch_id, lambda prev, rows: fold_pairs(
            prev.unionByName(rows), key, columns, keep_first).withColumn("_bucket", bucket_of(key, buckets)),
            lambda rows: fold_pairs(rows, key, columns, keep_first).withColumn("_bucket", bucket_of(key, buckets)))
    return process


def _rewrite_touched(path: str, new: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame], DataFrame],
                     first: Callable[[DataFrame], DataFrame]) -> None:
    """Merge a micro-batch into the buckets it touches. The batch is computed
    once (persisted); a bucket's rows meet before each write, so a batch
    leaves one file a bucket (AQE splits larger ones)."""
    spark = new.sparkSession
    new = new.persist()
    try:
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:  # e.g. a batch that only moved the watermark
            return
        old = written_so_far(spark, path)
        out = first(new) if old is None else merge(old.where(F.col("_bucket").isin(touched)), new)
        if old is None:
            out.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
            return
        staged = work_path(spark, f"stage-{batch_id}")
        out.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(staged)
        (spark.read.schema(out.schema).parquet(staged).hint("rebalance", "_bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path))
    finally:
        new.unpersist()


def upsert_writer(path: str, key, buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """T1 sink for a streaming aggregation in *update* mode: each micro-batch
    carries the new full rows of the keys that changed; they replace those
    keys in a bucket-partitioned table, rewriting only the touched buckets.
    Replacing by key is idempotent, so a replayed batch is harmless."""
    def process(batch: DataFrame, batch_id: int) -> None:
        keys = [key] if isinstance(key, str) else list(key)
        new = batch.withColumn("_bucket", bucket_of(keys, buckets))
        _rewrite_touched(path, new, batch_id, lambda prev, rows: prev.join(rows.select(*keys), keys, "left_anti")
                         .unionByName(rows), lambda rows: rows)
    return process


def read_partial_snapshot(spark: SparkSession, path: str, key: str, columns: Sequence[str]) -> DataFrame:
    return from_pairs(spark.read.parquet(path), key, columns)


def dedupe(stream: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 day") -> DataFrame:
    """Drop repeated records (the same page fetched twice) within the
    watermark delay; state is bounded by the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def rate_monitor(stream: DataFrame, ts: str, group: Column | str, caps: dict[str, int],
                 window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """T4: fetches per source group and tumbling hour, against the caps.
    State is one row per (hour, group): bounded by time x groups. Rows later
    than ``delay`` are not counted; :func:`run_available` reports how many."""
    g = F.col(group) if isinstance(group, str) else group
    counted = (stream.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), g.alias("source_group"))
               .agg(F.count(F.lit(1)).alias("n")))
    cap = F.coalesce(*[F.when(F.col("source_group") == F.lit(k), F.lit(v)) for k, v in caps.items()],
                     F.lit(None).cast("int"))
    return counted.select(F.col("w.start").alias("window_start"), "source_group", "n", cap.alias("cap"),
                          (F.col("n") > cap).alias("over_cap"))
