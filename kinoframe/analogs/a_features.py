"""Feature / score / recommendation analogs: customers as films, orders as
their releases and genres (order priorities), events as rating rows
(film = user_id, user = event_type, type = rating before noon, psi after).
"""

from pyspark.sql import functions as F

from kinoframe.analogs import register
from kinoframe.analogs.common import r6, t
from kinoframe.plans.features import encode, feature_table, impute_mean, split_train_test
from kinoframe.plans.score import recommend, score, writeback

AS_OF = "2002-01-01 00:00:00"
USER = "purchase"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _movies(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    agg = o.groupBy(F.col("o_custkey").alias("crit_id")).agg(
        F.min("o_orderdate").alias("first_date"),
        F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("original_release_date"),
        F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("avg_total"))
    c = t(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "crit_id")
    x = c.join(agg, "crit_id", "left")
    return x.select(
        "crit_id", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey").cast("long")).alias("imdbid"),
        F.col("c_name").alias("title"), F.coalesce(F.year("first_date"), F.lit(1995)).alias("year"),
        F.lit(None).cast("int").alias("imdb_year"), F.col("c_acctbal").alias("crit_rating"),
        F.col("n_orders").alias("crit_votes"), (F.col("avg_total") / 70001).alias("imdb_rating"),
        F.lit(None).cast("long").alias("imdb_votes"), F.col("c_mktsegment").alias("kind"),
        F.when(F.col("crit_id") % 7 != 0, F.col("c_nationkey") * 4).alias("metacritic_score"),
        F.when(F.col("n_orders") % 4 != 0, F.col("n_orders") * 10).alias("runtime"),
        F.lit(None).cast("timestamp").alias("dutch_release_date"),
        F.col("original_release_date").cast("timestamp").alias("original_release_date"))


def _ratings(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("crit_id"), F.col("event_type").alias("user"),
                     F.when(F.hour("ts") < 12, "rating").otherwise("psi").alias("type")).agg(
        F.avg("value").alias("score"))


def _genres(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("crit_id")).agg(
        F.array_sort(F.collect_set("o_orderpriority")).alias("genres"))


def _features(spark, sf_dir):
    return feature_table(_movies(spark, sf_dir), _ratings(spark, sf_dir), _genres(spark, sf_dir), USER, AS_OF)


BASE_SQL = f"""
WITH agg AS (
  SELECT o_custkey AS crit_id, min(o_orderdate) AS first_date,
         min(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS original_release_date,
         count(*) AS n_orders, avg(o_totalprice) AS avg_total,
         list_sort(list_distinct(list(o_orderpriority))) AS genres
    FROM orders GROUP BY o_custkey),
movies AS (
  SELECT c.c_custkey AS crit_id, CASE WHEN c.c_nationkey % 5 <> 0 THEN CAST(c.c_nationkey AS BIGINT) END AS imdbid,
         c.c_name AS title, CAST(coalesce(year(a.first_date), 1995) AS INTEGER) AS year, c.c_acctbal AS crit_rating,
         a.n_orders AS crit_votes, a.avg_total / 70001 AS imdb_rating, CAST(NULL AS BIGINT) AS imdb_votes,
         c.c_mktsegment AS kind, CASE WHEN c.c_custkey % 7 <> 0 THEN c.c_nationkey * 4 END AS metacritic_score,
         CASE WHEN a.n_orders % 4 <> 0 THEN a.n_orders * 10 END AS runtime,
         floor((epoch_us(TIMESTAMP '{AS_OF}')
                - epoch_us(coalesce(a.original_release_date,
                                    make_timestamp(coalesce(year(a.first_date), 1995), 1, 1, 0, 0, 0))))
               / 86400000000) / 365.25 AS years_since_release,
         a.genres
    FROM customer c LEFT JOIN agg a ON c.c_custkey = a.crit_id),
r AS (
  SELECT user_id AS crit_id,
         avg(value) FILTER (WHERE hour(ts) < 12) AS rating,
         avg(value) FILTER (WHERE hour(ts) >= 12) AS psi
    FROM events WHERE event_type = '{USER}' GROUP BY user_id),
feat AS (
  SELECT m.*, r.rating, r.psi, coalesce(CAST(r.rating > 0 AS INTEGER), 0) AS rated
    FROM movies m LEFT JOIN r USING (crit_id) WHERE m.imdbid > 0)
"""


@register("feature_table", BASE_SQL + """
SELECT crit_id, imdbid, title, year, round(crit_rating, 6) AS crit_rating, crit_votes,
       round(imdb_rating, 6) AS imdb_rating, imdb_votes, kind, metacritic_score, runtime,
       round(years_since_release, 6) AS years_since_release, round(rating, 6) AS rating,
       round(psi, 6) AS psi, array_to_string(genres, ',') AS genres, rated
  FROM feat
""")
def feature_table_query(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.select("crit_id", "imdbid", "title", "year", r6("crit_rating").alias("crit_rating"), "crit_votes",
                    r6("imdb_rating").alias("imdb_rating"), "imdb_votes", "kind", "metacritic_score", "runtime",
                    r6("years_since_release").alias("years_since_release"), r6("rating").alias("rating"),
                    r6("psi").alias("psi"), F.array_join("genres", ",").alias("genres"), "rated")


def _bucket():
    return (F.col("crit_id") * 2654435761) % 100


def _slug(v):
    return v.replace(" ", "_").lower()


@register("multi_hot", BASE_SQL + """
SELECT crit_id, (crit_id * 2654435761) % 100 < 33 AS is_test,
""" + ",\n".join([f"       CAST(coalesce(kind = '{s}', false) AS DOUBLE) AS \"kind_{_slug(s)}\"" for s in SEGMENTS]
                 + [f"       CAST(coalesce(list_contains(genres, '{p}'), false) AS DOUBLE) AS \"genre_{_slug(p)}\""
                    for p in PRIORITIES]) + """
  FROM feat
""")
def multi_hot_query(spark, sf_dir):
    """M5 + M6: split by key bucket; vocabularies fitted on the train rows."""
    f = split_train_test(_features(spark, sf_dir), "crit_id", bucket=_bucket())
    enc = encode(f)
    cols = [c for c in enc.columns if c.startswith("kind_") or c.startswith("genre_")]
    return enc.select("crit_id", "is_test", *cols)


@register("impute_mean", BASE_SQL + """
SELECT crit_id, round(coalesce(metacritic_score, avg(metacritic_score) OVER ()), 6) AS metacritic_score,
       round(coalesce(runtime, avg(runtime) OVER ()), 6) AS runtime,
       round(coalesce(psi, avg(psi) OVER ()), 6) AS psi
  FROM feat
""")
def impute_mean_query(spark, sf_dir):
    """M8 + A18: mean imputation; the all-NULL imdb_votes column is dropped."""
    f = _features(spark, sf_dir)
    out, kept = impute_mean(f, ["metacritic_score", "runtime", "psi", "imdb_votes"])
    assert "imdb_votes" not in kept
    return out.select("crit_id", *[r6(c).alias(c) for c in kept])


SCORE_SQL = BASE_SQL + """,
sc AS (
  SELECT *, least(greatest((crit_rating + 1000) / 11000, 0.0), 1.0) AS seen_probability,
         CAST(40 + crit_id % 60 AS DOUBLE) AS pred_rating, ((crit_id * 7919) % 1000 + 0.5) / 1000 AS draw FROM feat),
sc2 AS (
  SELECT *, pow(seen_probability * pow(exp(-pow(pow(greatest(years_since_release, 0.0), 0.8) / 3.0, 0.6)), 3),
                0.25) AS pred_seeit FROM sc),
scored AS (
  SELECT *, CAST(pred_seeit >= draw AS INTEGER) AS "show",
         pow(pred_seeit * pow(pred_rating / 100.0, 3), 0.25) * 100 AS score FROM sc2)
"""


def _scored(spark, sf_dir, features=None):
    f = features if features is not None else _features(spark, sf_dir)
    f = f.withColumn("seen_probability", F.least(F.greatest((F.col("crit_rating") + 1000) / 11000, F.lit(0.0)),
                                                 F.lit(1.0)))
    f = f.withColumn("pred_rating", (F.lit(40) + F.col("crit_id") % 60).cast("double"))
    return score(f, draw=((F.col("crit_id") * 7919) % 1000 + 0.5) / 1000)


@register("score", SCORE_SQL + """
SELECT crit_id, round(pred_seeit, 6) AS pred_seeit, round(draw, 6) AS draw, "show", round(score, 6) AS score
  FROM scored
""")
def score_query(spark, sf_dir):
    """M13-M16 with derived seen probability, predicted rating and age."""
    s = _scored(spark, sf_dir)
    return s.select("crit_id", r6("pred_seeit").alias("pred_seeit"), r6("draw").alias("draw"), "show",
                    r6("score").alias("score"))


@register("writeback", SCORE_SQL + f""",
old AS (SELECT user_id AS crit_id, event_type AS "user", CASE WHEN hour(ts) < 12 THEN 'rating' ELSE 'psi' END AS type,
               avg(value) AS score FROM events GROUP BY 1, 2, 3),
new AS (SELECT crit_id, '{USER}' AS "user", t.type,
               CASE t.type WHEN 'seen_probability' THEN seen_probability WHEN 'pred_rating' THEN pred_rating
                           WHEN 'pred_seeit' THEN pred_seeit ELSE score END AS score
          FROM scored, (VALUES ('seen_probability'), ('pred_rating'), ('pred_seeit'), ('pred_score')) t(type))
SELECT crit_id, "user", type, round(score, 6) AS score FROM old
 WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.crit_id = old.crit_id AND new."user" = old."user" AND new.type = old.type)
UNION ALL
SELECT crit_id, "user", type, round(score, 6) FROM new
""")
def writeback_query(spark, sf_dir):
    """Scores written back as rating rows of the user (U3 merge)."""
    w = writeback(_ratings(spark, sf_dir), _scored(spark, sf_dir), USER)
    return w.select("crit_id", "user", "type", r6("score").alias("score"))


@register("recommend", SCORE_SQL + """
SELECT crit_id, title, round(score, 6) AS score, round(pred_rating, 6) AS pred_rating
  FROM scored
 WHERE rated = 0 AND "show" = 1 AND pred_rating >= 50 AND kind IN ('BUILDING', 'MACHINERY')
   AND NOT coalesce(list_contains(genres, '5-LOW'), false)
 ORDER BY score DESC, crit_id LIMIT 500
""")
def recommend_query(spark, sf_dir):
    """P15 filter + top 500 by score (the list length is the feature)."""
    f = split_train_test(_features(spark, sf_dir), "crit_id", bucket=_bucket())
    s = _scored(spark, sf_dir, encode(f))
    r = recommend(s, k=500, kinds=("BUILDING", "MACHINERY"), short_col="genre_5-low")
    return r.select("crit_id", "title", r6("score").alias("score"), r6("pred_rating").alias("pred_rating"))
