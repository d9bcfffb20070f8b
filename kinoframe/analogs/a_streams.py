"""Streaming analogs: the events table as a landed file stream, each result
checked against the same SQL as its batch twin."""

from pyspark.sql import functions as F

from kinoframe.analogs import register
from kinoframe.analogs.a_merge import TYPES
from kinoframe.analogs.common import r6
from kinoframe.session import work_path
from kinoframe.sources.tables import TableStore
from kinoframe.streaming.streams import (current_record, dedupe, file_stream, from_pairs,
                                         partial_snapshot_writer, rate_monitor, read_output,
                                         read_partial_snapshot, run_available, snapshot_writer,
                                         upsert_writer)

FOLD_SQL = """
SELECT user_id,
""" + ",\n".join(f"       round(arg_max(value, (ts, event_id)) FILTER (WHERE event_type = '{ty}'), 6) AS last_{ty}"
                 for ty in TYPES) + """,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts
  FROM events GROUP BY user_id
"""
COLUMNS = [f"last_{ty}" for ty in TYPES] + ["first_ts"]


def _log(stream):
    return stream.select("user_id", "ts", "event_id",
                         *[F.when(F.col("event_type") == ty, F.col("value")).alias(f"last_{ty}") for ty in TYPES],
                         F.col("ts").alias("first_ts"))


def _final(df):
    return df.select("user_id", *[r6(f"last_{ty}").alias(f"last_{ty}") for ty in TYPES],
                     F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_ts"))


@register("stream_current", FOLD_SQL)
def stream_current_query(spark, sf_dir):
    """Streaming fold of partial records; update mode, the changed
    current records upserted into a bucket-partitioned table."""
    s = _log(file_stream(spark, sf_dir, "events.parquet", ts_cols=["ts"]))
    cur = current_record(s, "user_id", ["ts", "event_id"], COLUMNS, keep_first=["first_ts"])
    path = work_path(spark, "current-records")
    run_available(cur, "current", output_mode="update", batch_fn=upsert_writer(path, "user_id", buckets=16))
    return _final(spark.read.parquet(path))


@register("stream_snapshot_buckets", FOLD_SQL)
def stream_snapshot_buckets_query(spark, sf_dir):
    """T2 at scale: micro-batches (one file per trigger, the events file read
    by two landings) folded into a bucket-partitioned snapshot, rewriting only
    the touched buckets."""
    path = work_path(spark, "snapshot-buckets")
    s = _log(file_stream(spark, sf_dir, "events.parquet", ts_cols=["ts"]))
    run_available(s, "snapshot-buckets", output_mode="append",
                  batch_fn=partial_snapshot_writer(path, "user_id", ["ts", "event_id"], COLUMNS,
                                                   keep_first=["first_ts"], buckets=16))
    return _final(read_partial_snapshot(spark, path, "user_id", COLUMNS))


@register("stream_snapshot", FOLD_SQL)
def stream_snapshot_query(spark, sf_dir):
    """Each micro-batch folded into a versioned snapshot table."""
    store = TableStore(spark, work_path(spark, "snapshots"))
    s = _log(file_stream(spark, sf_dir, "events.parquet", ts_cols=["ts"]))
    run_available(s, "snapshot", output_mode="append",
                  batch_fn=snapshot_writer(store, "current", "user_id", ["ts", "event_id"], COLUMNS,
                                           keep_first=["first_ts"]))
    return _final(from_pairs(store.read("current"), "user_id", COLUMNS))


@register("stream_dedup", """
SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events
""")
def stream_dedup_query(spark, sf_dir):
    """The same records landed twice, de-duplicated within the watermark."""
    a = file_stream(spark, sf_dir, "events.parquet", ts_cols=["ts"])
    b = file_stream(spark, sf_dir, "events.parquet", ts_cols=["ts"])
    d = dedupe(a.unionByName(b), ["event_id"], "ts", "1 day")
    d = d.select("event_id", "user_id", "event_type", "value")
    out = run_available(d, "dedup", output_mode="append")
    return read_output(spark, out, d.schema).select("event_id", "user_id", "event_type", r6("value").alias("value"))


CAPS = {"click": 400, "error": 40, "purchase": 800, "signup": 400, "view": 400}


@register("stream_rate", """
SELECT window_start, source_group, n, cap, n > cap AS over_cap
  FROM (SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
               event_type AS source_group, count(*) AS n,
               CASE event_type WHEN 'click' THEN 400 WHEN 'error' THEN 40 WHEN 'purchase' THEN 800
                    ELSE 400 END AS cap
          FROM events GROUP BY 1, 2, 4)
""")
def stream_rate_query(spark, sf_dir):
    """T4: per source group and tumbling hour, the count against the cap;
    update mode, changed (hour, group) rows upserted by key."""
    s = file_stream(spark, sf_dir, "events.parquet", ts_cols=["ts"])
    r = rate_monitor(s, "ts", "event_type", CAPS)
    path = work_path(spark, "rate")
    run_available(r, "rate", output_mode="update",
                  batch_fn=upsert_writer(path, ["window_start", "source_group"], buckets=16))
    out = spark.read.parquet(path)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "source_group", "n", "cap", "over_cap")
