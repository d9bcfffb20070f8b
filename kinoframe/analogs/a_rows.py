"""Rows for operators that other queries reach only from the inside."""

from pyspark.sql import functions as F

from kinoframe.analogs import register
from kinoframe.analogs.a_features import BASE_SQL, _features
from kinoframe.analogs.common import r6, t
from kinoframe.functions.text import to_bool
from kinoframe.operators.nest import nest_map, nest_values, unnest_map
from kinoframe.plans.features import feature_list
from kinoframe.plans.models import ModelResult, importances_table
from kinoframe.plans.score import attach_predictions
from kinoframe.sources.tables import from_storage, to_storage


@register("to_storage", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ',' || strftime(ts + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') AS stamps,
       epoch(date_trunc('second', ts))::BIGINT AS instant
  FROM events
""")
def to_storage_query(spark, sf_dir):
    """Timestamps and lists of timestamps as text, and back."""
    e = t(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("stamp"))
    e = e.withColumn("stamps", F.array("stamp", F.col("stamp") + F.expr("INTERVAL 1 DAY")))
    text = to_storage(e)
    back = from_storage(text.select("event_id", "stamp"), e.select("event_id", "stamp").schema)
    return (text.select("event_id", "stamp", F.array_join("stamps", ",").alias("stamps"))
            .join(back.select("event_id", F.unix_seconds("stamp").alias("instant")), "event_id"))


@register("nest_unranked", """
SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id
""")
def nest_unranked_query(spark, sf_dir):
    """A list without a rank, in the order of its values."""
    nested = nest_values(t(spark, sf_dir, "events"), "user_id", "event_type", alias="kinds")
    return nested.select("user_id", F.array_join("kinds", ",").alias("kinds"))


@register("unnest_map_flat", """
SELECT l_orderkey, l_linenumber, round(sum(l_quantity), 6) AS quantity, round(max(l_discount), 6) AS discount
  FROM lineitem GROUP BY l_orderkey, l_linenumber
""")
def unnest_map_flat_query(spark, sf_dir):
    """A7 + B5: one map a key, exploded again."""
    lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("quantity"),
                                                                                 F.max("l_discount").alias("discount"))
    nested = nest_map(lines, "l_orderkey", "l_linenumber", ["quantity", "discount"], alias="lines")
    rows = unnest_map(nested, "l_orderkey", "lines", "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", r6("quantity").alias("quantity"), r6("discount").alias("discount"))


FEATURES = ["crit_rating", "crit_votes", "imdb_rating", "imdb_votes", "metacritic_score", "runtime", "years_since_release", "psi"]


@register("feature_list", BASE_SQL + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS feature, count({c}) AS n FROM feat" for i, c in enumerate(FEATURES)))
def feature_list_query(spark, sf_dir):
    """M7: the numeric columns that the models learn from, with the number of
    films that have each."""
    f = _features(spark, sf_dir)
    names = feature_list(f)
    counts = f.agg(*[F.count(c).alias(c) for c in names])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(c).alias("n"))
                                            for i, c in enumerate(names)])))


@register("to_bool", """
SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_size % 3 > 0 END AS from_number,
       CASE WHEN p_partkey % 5 > 0 THEN p_size % 2 > 0 END AS from_text
  FROM part
""")
def to_bool_query(spark, sf_dir):
    """0/1 numbers and texts as booleans, NULL stays."""
    known = F.col("p_partkey") % 5 > 0
    p = t(spark, sf_dir, "part").select("p_partkey", F.when(known, F.col("p_size") % 3).alias("number"),
                                        F.when(known, F.when(F.col("p_size") % 2 > 0, "true").otherwise("false")).alias("word"))
    return p.select("p_partkey", to_bool("number").alias("from_number"), to_bool("word").alias("from_text"))


@register("attach_predictions", """
SELECT coalesce(f.o_custkey, s.o_custkey, r.o_custkey) AS o_custkey, f.n, s.seen, r.total
  FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f
  FULL JOIN (SELECT o_custkey, count(*) AS seen FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) s ON f.o_custkey = s.o_custkey
  FULL JOIN (SELECT o_custkey, round(max(o_totalprice), 6) AS total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) r
    ON r.o_custkey = coalesce(f.o_custkey, s.o_custkey)
""")
def attach_predictions_query(spark, sf_dir):
    """Two predictions joined to the features, outer on the key."""
    o = t(spark, sf_dir, "orders")
    per = lambda rows, agg: rows.groupBy("o_custkey").agg(agg)
    features = per(o.where("o_orderstatus = 'F'"), F.count(F.lit(1)).alias("n"))
    seen = per(o.where("o_orderstatus = 'P'"), F.count(F.lit(1)).alias("seen"))
    total = per(o.where("o_orderpriority = '1-URGENT'"), F.round(F.max("o_totalprice"), 6).alias("total"))
    return attach_predictions(features, [seen, total], "o_custkey")


@register("importances", """
WITH s AS (SELECT 'seen' AS model, event_type AS feature, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM events), 6) AS importance
             FROM events GROUP BY event_type),
r AS (SELECT 'rating' AS model, event_type AS feature, round(avg(value), 6) AS importance FROM events GROUP BY event_type)
SELECT model, feature, importance, CAST(row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS INTEGER) AS rank
  FROM (SELECT * FROM s UNION ALL SELECT * FROM r)
""")
def importances_query(spark, sf_dir):
    """O3 + O4: two models' feature tables ranked, the largest first."""
    e = t(spark, sf_dir, "events")
    total = e.agg(F.count(F.lit(1)).cast("double").alias("n")).select("n").scalar()
    per = e.groupBy(F.col("event_type").alias("feature"))
    shares = per.agg(F.round(F.count(F.lit(1)) / total, 6).alias("importance"))
    means = per.agg(F.round(F.avg("value"), 6).alias("importance"))
    return importances_table({"seen": ModelResult(shares, shares, {}, {}), "rating": ModelResult(means, means, {}, {})})
