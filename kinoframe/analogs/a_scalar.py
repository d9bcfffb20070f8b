"""Scalar-expression and small-source analogs (N10, N13-N17, M1, M2, S3,
S4, A15)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinoframe.analogs import register
from kinoframe.analogs.common import r6, t, ts_text
from kinoframe.functions.dates import fractional_year, humanized_age, release_date, years_since
from kinoframe.functions.text import pad_id
from kinoframe.functions.values import ifnull
from kinoframe.sources.catalogue import offers_info, ratings_link
from kinoframe.sources.tables import add_columns, align_schema

AS_OF = "2002-01-01 00:00:00"


# The labels of an age in seconds, stated apart from the code that makes them.
AGE_SQL = """
       CASE WHEN rel IS NULL THEN 'Not updated before'
            WHEN age < 10 THEN 'just now'
            WHEN age < 45 THEN CAST(CAST(floor(age) AS BIGINT) AS VARCHAR) || ' seconds ago'
            WHEN age < 90 THEN 'a minute ago'
            WHEN age < 45 * 60 THEN CAST(greatest(floor(age / 60), 2)::BIGINT AS VARCHAR) || ' minutes ago'
            WHEN age < 90 * 60 THEN 'an hour ago'
            WHEN age < 22 * 3600 THEN CAST(greatest(floor(age / 3600), 2)::BIGINT AS VARCHAR) || ' hours ago'
            WHEN age < 36 * 3600 THEN 'a day ago'
            WHEN age < 154 * 3600 THEN CAST(greatest(floor(age / 86400), 2)::BIGINT AS VARCHAR) || ' days ago'
            WHEN age < 252 * 3600 THEN 'a week ago'
            WHEN age < 28 * 86400 THEN CAST(greatest(floor(age / 604800), 2)::BIGINT AS VARCHAR) || ' weeks ago'
            WHEN age < 45 * 86400 THEN 'a month ago'
            WHEN age < 345 * 86400 THEN CAST(greatest(floor(age / 2592000), 2)::BIGINT AS VARCHAR) || ' months ago'
            WHEN age < 547 * 86400 THEN 'a year ago'
            ELSE CAST(greatest(floor(age / 31536000), 2)::BIGINT AS VARCHAR) || ' years ago' END"""


@register("scalar_dates", f"""
WITH x AS (
  SELECT o_orderkey, year(o_orderdate) AS year,
         CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) + 1 END AS imdb_year,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS rel,
         CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS local_rel,
         CASE WHEN o_orderkey % 7 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 11 = 0 THEN NULL
              ELSE o_totalprice END AS metric,
         epoch(TIMESTAMP '{AS_OF}') - epoch(rel) AS age
    FROM orders)
SELECT o_orderkey, printf('%07d', o_orderkey) AS padded,
       round(coalesce(year(rel) + (epoch_us(rel) - epoch_us(make_timestamp(year(rel), 1, 1, 0, 0, 0)))
                      / (epoch_us(make_timestamp(year(rel) + 1, 1, 1, 0, 0, 0))
                         - epoch_us(make_timestamp(year(rel), 1, 1, 0, 0, 0))),
                      imdb_year + 0.5, year + 0.5), 6) AS float_year,
       strftime(coalesce(local_rel, rel, make_timestamp(coalesce(imdb_year, year, 1900), 1, 1, 0, 0, 0)),
                '%Y-%m-%d %H:%M:%S') AS release_date,
       round(floor((epoch_us(TIMESTAMP '{AS_OF}')
                    - epoch_us(coalesce(local_rel, rel, make_timestamp(coalesce(imdb_year, year, 1900), 1, 1, 0, 0, 0))))
                   / 86400000000) / 365.25, 6) AS years_since_release,
       {AGE_SQL} AS age_label,
       round(coalesce(CASE WHEN isnan(metric) THEN NULL ELSE metric END, -1.0), 6) AS metric
  FROM x
""")
def scalar_dates_query(spark, sf_dir):
    """N10 + N15 + N16 + N17 + M1 + M2 on order dates with derived gaps."""
    o = t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    x = o.select("o_orderkey", F.year("o_orderdate").alias("year"),
                 F.when(k % 2 == 0, F.year("o_orderdate") + 1).alias("imdb_year"),
                 F.when(k % 3 != 0, F.col("o_orderdate")).cast("timestamp").alias("rel"),
                 F.when(k % 5 == 0, F.date_add("o_orderdate", 30)).cast("timestamp").alias("local_rel"),
                 F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 11 == 0, F.lit(None))
                  .otherwise(F.col("o_totalprice")).alias("metric"))
    rd = release_date("local_rel", "rel", "imdb_year", "year")
    return x.select(
        "o_orderkey", pad_id("o_orderkey").alias("padded"),
        r6(fractional_year("rel", "imdb_year", "year")).alias("float_year"),
        ts_text(rd).alias("release_date"),
        r6(years_since(rd, AS_OF)).alias("years_since_release"),
        humanized_age(F.col("rel"), AS_OF).alias("age_label"),
        r6(ifnull(F.col("metric"), F.lit(-1.0), floating=True)).alias("metric"))


DECLARED_NATION = T.StructType([
    T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()),
    T.StructField("n_comment", T.StringType()), T.StructField("n_population", T.LongType())])


@register("align_schema", """
SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS n_comment, CAST(NULL AS BIGINT) AS n_population, n_regionkey
  FROM nation
""")
def align_schema_query(spark, sf_dir):
    """S3: declared-but-missing columns added as typed NULLs in place; the
    undeclared column kept last."""
    return align_schema(t(spark, sf_dir, "nation"), DECLARED_NATION)


@register("add_columns", """
SELECT r_regionkey, CAST(NULL AS VARCHAR) AS r_comment, CAST(NULL AS INTEGER) AS r_rank, r_name FROM region
""")
def add_columns_query(spark, sf_dir):
    """Columns added after a given column; an existing one is a no-op."""
    return add_columns(t(spark, sf_dir, "region"), {"r_comment": "string", "r_rank": "int", "r_name": "string"},
                       after="r_regionkey")


QUALITY = {"R": "High Definition", "A": "Ultra High Definition"}


@register("offers_hd", """
SELECT o.o_orderkey,
       CASE WHEN l.n IS NOT NULL THEN 'https://passthepopcorn.me/torrents.php?id=' || CAST(o.o_orderkey AS VARCHAR) END
         AS ptp_url,
       coalesce(l.hd, false) AS ptp_hd_available
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag IN ('R', 'A')) AS hd
               FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
""")
def offers_hd_query(spark, sf_dir):
    """N13 + A15: per order an offers answer (one film whose offers are its
    lines) landed as JSON text, parsed: link and any-HD flag; an order
    without lines answers with no film."""
    li = t(spark, sf_dir, "lineitem")
    qual = F.coalesce(*[F.when(F.col("l_returnflag") == k, F.lit(v)) for k, v in QUALITY.items()],
                      F.lit("Standard Definition"))
    per = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_list(F.struct(qual.alias("Quality"))).alias("Torrents"))
    o = t(spark, sf_dir, "orders").select("o_orderkey").join(per, "o_orderkey", "left")
    movie = F.struct(F.col("o_orderkey").cast("string").alias("GroupId"), F.col("Torrents"))
    movies = F.when(F.col("Torrents").isNull(), F.array().cast("array<struct<GroupId:string,Torrents:"
                                                               "array<struct<Quality:string>>>>")) \
              .otherwise(F.array(movie))
    docs = o.select("o_orderkey", F.to_json(F.struct(movies.alias("Movies"))).alias("answer"))
    return offers_info(docs, "answer").select("o_orderkey", "ptp_url", "ptp_hd_available")


@register("ratings_link", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'invalid' ELSE 'ok' END AS status,
       CASE WHEN event_type IN ('error', 'view') THEN NULL
            ELSE 'http://rt.example/m/' || CAST(event_id AS VARCHAR) END AS tomato_url
  FROM events
""")
def ratings_link_query(spark, sf_dir):
    """Answers landed as JSON text ('error' events answer Response
    False, 'view' events an empty link)."""
    e = t(spark, sf_dir, "events")
    doc = (F.when(F.col("event_type") == "error", F.lit('{"Response": "False"}'))
           .when(F.col("event_type") == "view", F.lit('{"Response": "True", "tomatoURL": ""}'))
           .otherwise(F.concat(F.lit('{"Response": "True", "tomatoURL": "http://rt.example/m/'),
                               F.col("event_id").cast("string"), F.lit('"}'))))
    return ratings_link(e.select("event_id", doc.alias("answer")), "answer").select("event_id", "status", "tomato_url")
