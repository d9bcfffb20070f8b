"""Merge / upsert / quality analogs."""

from pyspark.sql import functions as F

from kinoframe.analogs import register
from kinoframe.analogs.common import r6, t, ts_text
from kinoframe.operators.merge import (apply_batch, fold_log, merge_entries, merge_nested_maps,
                                       merge_null_safe, quarantine, replace_children)
from kinoframe.operators.nest import nest_map2, unnest_map2
from kinoframe.operators.quality import check_unique, find_orphans, percentiles, step_counts

CUSTOMER_UPDATES_SQL = """
WITH upd AS (
  SELECT o_custkey AS c_custkey, CAST(NULL AS VARCHAR) AS c_name, CAST(NULL AS INTEGER) AS c_nationkey,
         arg_max_null(o_totalprice, (o_orderdate, o_orderkey)) AS c_acctbal,
         arg_max_null(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, (o_orderdate, o_orderkey)) AS c_mktsegment
    FROM orders GROUP BY o_custkey
  UNION ALL
  SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal, NULL FROM supplier)
"""


def _customer_updates(spark, sf_dir):
    """Partial customer records derived from the whole orders table (the
    latest order of each customer; segment only known for finished orders),
    plus inserts derived from suppliers."""
    o = t(spark, sf_dir, "orders")
    latest = F.struct("o_orderdate", "o_orderkey")
    upd = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max_by("o_totalprice", latest).alias("c_acctbal"),
        F.max_by(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")), latest).alias("c_mktsegment"))
    ins = t(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))
    return upd.unionByName(ins, allowMissingColumns=True)


@register("merge_null_safe", CUSTOMER_UPDATES_SQL + """
SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey,
       coalesce(n.c_name, o.c_name) AS c_name,
       coalesce(n.c_nationkey, o.c_nationkey) AS c_nationkey,
       coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal,
       coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment
  FROM customer o FULL JOIN upd n ON o.c_custkey = n.c_custkey
""")
def merge_null_safe_query(spark, sf_dir):
    return merge_null_safe(t(spark, sf_dir, "customer"), _customer_updates(spark, sf_dir), "c_custkey")


@register("merge_supplied", CUSTOMER_UPDATES_SQL + """
SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey,
       o.c_name AS c_name, o.c_nationkey AS c_nationkey,
       coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal,
       o.c_mktsegment AS c_mktsegment
  FROM customer o FULL JOIN upd n ON o.c_custkey = n.c_custkey
""")
def merge_supplied_query(spark, sf_dir):
    """Upsert that only touches the supplied column (c_acctbal)."""
    return merge_null_safe(t(spark, sf_dir, "customer"), _customer_updates(spark, sf_dir), "c_custkey",
                           supplied=["c_acctbal"])


@register("keep_first", """
WITH old AS (SELECT o_custkey, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen
               FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY o_custkey),
     new AS (SELECT o_custkey, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen
               FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_custkey)
SELECT coalesce(n.o_custkey, o.o_custkey) AS o_custkey,
       strftime(coalesce(o.first_seen, n.first_seen), '%Y-%m-%d %H:%M:%S') AS first_seen,
       strftime(coalesce(n.last_seen, o.last_seen), '%Y-%m-%d %H:%M:%S') AS last_seen
  FROM old o FULL JOIN new n ON o.o_custkey = n.o_custkey
""")
def keep_first_query(spark, sf_dir):
    """first_seen (date_added) never changes once set; last_seen does."""
    o = t(spark, sf_dir, "orders")
    def snap(cond):
        return o.filter(cond).groupBy("o_custkey").agg(
            F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    merged = merge_null_safe(snap(F.col("o_orderdate") < cut), snap(F.col("o_orderdate") >= cut),
                             "o_custkey", keep_first=["first_seen"])
    return merged.select("o_custkey", ts_text("first_seen").alias("first_seen"),
                         ts_text("last_seen").alias("last_seen"))


RATINGS_SQL = """
WITH old AS (SELECT user_id, event_type, CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS part,
                    avg(value) AS score FROM events
              WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2, 3),
     new AS (SELECT user_id, event_type, CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS part,
                    CASE WHEN event_type = 'error' THEN NULL ELSE avg(value) END AS score FROM events
              WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2, 3)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type,
       coalesce(n.part, o.part) AS part,
       round(CASE WHEN n.user_id IS NOT NULL THEN n.score ELSE o.score END, 6) AS score
  FROM old o FULL JOIN new n ON o.user_id = n.user_id AND o.event_type = n.event_type AND o.part = n.part
"""

RATING_KEYS = ["user_id", "event_type", "part"]


def _rating_batches(spark, sf_dir):
    """Ratings-shaped rows (film = user_id, user = event_type, type = part
    of day, score = average value): the old batch from the first half of the
    month, the new batch from the second half ('error' scores are NULL)."""
    ev = t(spark, sf_dir, "events").withColumn(
        "part", F.when(F.hour("ts") < 12, "am").otherwise("pm"))
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    old = ev.filter(F.col("ts") < cut).groupBy(*RATING_KEYS).agg(F.avg("value").alias("score"))
    new = ev.filter(F.col("ts") >= cut).groupBy(*RATING_KEYS).agg(
        F.when(F.col("event_type") != "error", F.avg("value")).alias("score"))
    return old, new


@register("merge_ratings", RATINGS_SQL)
def merge_ratings_query(spark, sf_dir):
    """U3 on rows: an entry in the new batch replaces the old one, even when
    its score is NULL (the 'error' type)."""
    old, new = _rating_batches(spark, sf_dir)
    out = merge_entries(old, new, RATING_KEYS)
    return out.select(*RATING_KEYS, r6("score").alias("score"))


@register("merge_ratings_map", RATINGS_SQL)
def merge_ratings_map_query(spark, sf_dir):
    """U3 on the nested form: per key a map user -> type -> score, deep-merged
    with ``map_zip_with`` and unnested back to rows."""
    old, new = _rating_batches(spark, sf_dir)
    m_old = nest_map2(old, "user_id", "event_type", "part", "score", alias="m_old")
    m_new = nest_map2(new, "user_id", "event_type", "part", "score", alias="m_new")
    both = m_old.join(m_new, "user_id", "full_outer")
    merged = both.select("user_id", merge_nested_maps(F.col("m_old"), F.col("m_new")).alias("m"))
    out = unnest_map2(merged, "user_id", "m", "event_type", "part", value_name="score")
    return out.select(*RATING_KEYS, r6("score").alias("score"))


LINE_COLS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
             "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")

NEW_LINES_SQL = """
new_lines AS (
  SELECT o_orderkey AS l_orderkey, o_custkey AS l_partkey, CAST(0 AS BIGINT) AS l_suppkey,
         CAST(g AS INTEGER) AS l_linenumber, CAST(g AS DOUBLE) AS l_quantity, o_totalprice AS l_extendedprice,
         0.0 AS l_discount, 0.0 AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, o_orderdate AS l_shipdate
    FROM orders, generate_series(1, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 2 END) AS s(g)
   WHERE o_orderstatus = 'P')
"""


def _new_lines(spark, sf_dir):
    """Replacement lines for every pending order; '5-LOW' orders get an
    empty batch (zero rows), which must delete nothing."""
    o = t(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P")
    n = F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(2)
    exploded = o.select("*", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("g"))
    return exploded.select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_partkey"),
        F.lit(0).cast("long").alias("l_suppkey"), F.col("g").cast("int").alias("l_linenumber"),
        F.col("g").cast("double").alias("l_quantity"), F.col("o_totalprice").alias("l_extendedprice"),
        F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"), F.lit("N").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"), F.col("o_orderdate").alias("l_shipdate"))


@register("replace_children", "WITH " + NEW_LINES_SQL + f"""
SELECT {LINE_COLS} FROM lineitem
 WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new_lines)
UNION ALL
SELECT {LINE_COLS} FROM new_lines
""")
def replace_children_query(spark, sf_dir):
    return replace_children(t(spark, sf_dir, "lineitem"), _new_lines(spark, sf_dir), "l_orderkey")


@register("apply_batch", "WITH " + NEW_LINES_SQL + """,
batch AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'Q' END AS o_orderstatus
            FROM orders WHERE o_orderstatus = 'P'),
hdr AS (SELECT o.o_orderkey, coalesce(b.o_orderstatus, o.o_orderstatus) AS o_orderstatus, o.o_orderpriority
          FROM orders o LEFT JOIN batch b USING (o_orderkey)),
kids AS (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new_lines)
         UNION ALL SELECT l_orderkey, l_quantity FROM new_lines)
SELECT h.o_orderkey, h.o_orderstatus, h.o_orderpriority, k.n_lines, round(k.qty, 6) AS qty
  FROM hdr h LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty FROM kids GROUP BY 1) k
    ON h.o_orderkey = k.l_orderkey
""")
def apply_batch_query(spark, sf_dir):
    """One batch of nested partial order records (new status, list of
    lines) applied to the header and to its child table."""
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    lines = _new_lines(spark, sf_dir)
    nested = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(*lines.columns)).alias("lines"))
    batch = (t(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P")
             .select("o_orderkey",
                     F.when(F.col("o_orderpriority") != "1-URGENT", F.lit("Q")).alias("o_orderstatus"))
             .join(nested.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left"))
    kids = t(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    def unnest_lines(b):
        return b.select(F.explode("lines").alias("x")).select("x.*").withColumnRenamed("l_orderkey", "o_orderkey")
    hdr, children = apply_batch(orders, {"lines": kids}, batch, "o_orderkey", ["o_orderstatus"],
                                {"lines": unnest_lines})
    agg = children["lines"].groupBy("o_orderkey").agg(F.count("*").alias("n_lines"),
                                                      F.sum("l_quantity").alias("qty"))
    return hdr.join(agg, "o_orderkey", "left").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "n_lines", r6("qty").alias("qty"))


TYPES = ["click", "error", "purchase", "signup", "view"]


@register("fold_log", """
SELECT user_id,
""" + ",\n".join(f"       round(arg_max(value, (ts, event_id)) FILTER (WHERE event_type = '{ty}'), 6) AS last_{ty}"
                 for ty in TYPES) + """,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts
  FROM events GROUP BY user_id
""")
def fold_log_query(spark, sf_dir):
    """U8: each event is a partial record of its user (one column per event
    type set, the rest NULL); the fold keeps the latest non-NULL value per
    column and the first timestamp."""
    ev = t(spark, sf_dir, "events")
    log = ev.select("user_id", "ts", "event_id",
                    *[F.when(F.col("event_type") == ty, F.col("value")).alias(f"last_{ty}") for ty in TYPES],
                    F.col("ts").alias("first_ts"))
    cur = fold_log(log, "user_id", ["ts", "event_id"], [f"last_{ty}" for ty in TYPES] + ["first_ts"],
                   keep_first=["first_ts"])
    return cur.select("user_id", *[r6(f"last_{ty}").alias(f"last_{ty}") for ty in TYPES],
                      F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_ts"))


@register("check_unique", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1
""")
def check_unique_query(spark, sf_dir):
    return check_unique(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("find_orphans", """
SELECT d.doc_id, d.source FROM documents d
 WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def find_orphans_query(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", "source")
    return find_orphans(docs, t(spark, sf_dir, "labels"), "doc_id")


@register("quarantine", """
SELECT l.doc_id, l.quality, l.toxic,
       CASE WHEN l.doc_id IS NULL THEN 'null_key'
            WHEN NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) THEN 'orphan'
            ELSE 'ok' END AS reason
  FROM labels l
""")
def quarantine_query(spark, sf_dir):
    return quarantine(t(spark, sf_dir, "labels"), "doc_id", t(spark, sf_dir, "documents"), "doc_id")


@register("percentiles", """
SELECT event_type,
       round(quantile_cont(value, 0.1), 6) AS p10,
       round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.9), 6) AS p90
  FROM events GROUP BY event_type
""")
def percentiles_query(spark, sf_dir):
    p = percentiles(t(spark, sf_dir, "events"), "value", by=["event_type"])
    return p.select("event_type", r6("p10").alias("p10"), r6("p50").alias("p50"), r6("p90").alias("p90"))


@register("row_counts", """
SELECT 0 AS step_no, 'loaded' AS step, count(*) AS n FROM events
UNION ALL SELECT 1, 'typed', count(*) FROM events WHERE event_type IN ('click', 'view', 'purchase')
UNION ALL SELECT 2, 'valued', count(*) FROM events
 WHERE event_type IN ('click', 'view', 'purchase') AND value > 10
""")
def row_counts_query(spark, sf_dir):
    ev = t(spark, sf_dir, "events")
    out = step_counts(ev, [("loaded", F.lit(True)),
                           ("typed", F.col("event_type").isin("click", "view", "purchase")),
                           ("valued", F.col("value") > 10)])
    return out.select(F.col("step_no").cast("int").alias("step_no"), "step", "n")


@register("weibull_percentiles", """
WITH d AS (SELECT pow(-ln(1.0 - ((c_custkey * 7919) % 1000 + 0.5) / 1000.0), 1.0 / 1.1) AS draw FROM customer)
SELECT round(pow(10, quantile_cont(draw, 0.1)) - 1, 6) AS p10,
       round(pow(10, quantile_cont(draw, 0.5)) - 1, 6) AS p50,
       round(pow(10, quantile_cont(draw, 0.9)) - 1, 6) AS p90
  FROM d
""")
def weibull_percentiles_query(spark, sf_dir):
    """A19 on drawn values: one Weibull(1.1) draw per customer (repeatable
    closed-form uniform), percentiles 10/50/90 reported as 10^p - 1."""
    u = ((F.col("c_custkey") * 7919) % 1000 + 0.5) / 1000.0
    draws = t(spark, sf_dir, "customer").select(F.pow(-F.log(1.0 - u), 1.0 / 1.1).alias("draw"))
    p = percentiles(draws, "draw")
    return p.select(*[r6(F.pow(F.lit(10.0), F.col(c)) - 1).alias(c) for c in ("p10", "p50", "p90")])
