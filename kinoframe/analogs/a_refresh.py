"""Refresh-scheduling analogs: customers as films (R1-R9, A10, A17, P11,
P13, P14, W2, W3, O2).

crit_id = c_custkey; release date = first order date; year = its year;
popularity = account balance (unknown for the AUTOMOBILE segment); external
id = nation key (absent when divisible by 5); stamps = latest order date per
status (F: criticker, O: omdb, P: imdb_main). Draws are closed forms of the
ids so that the SQL oracle can repeat them.
"""

from pyspark.sql import functions as F

from kinoframe.analogs import register
from kinoframe.analogs.common import r6, t, ts_text
from kinoframe.functions.dates import fractional_year
from kinoframe.plans.refresh import (RefreshConfig, SOURCES, due, next_updates, period_scores,
                                     population_stats, sequence)
from kinoframe.session import cut_lineage

AS_OF = "2002-01-01 00:00:00"
SHAPE = 1.5


def _films(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    agg = o.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_date"),
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("criticker_updated"),
        F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate"))).alias("omdb_updated"),
        F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate"))).alias("imdb_main_updated"))
    c = t(spark, sf_dir, "customer")
    x = c.join(agg, c.c_custkey == agg.o_custkey, "left")
    year = F.coalesce(F.year("first_date"), F.lit(1995))
    # The film header is read several times (statistics, medians, scores):
    # derive it once and cut the lineage, as a stored header table would be.
    return cut_lineage(x.select(
        F.col("c_custkey").alias("crit_id"), year.alias("year"),
        fractional_year(F.col("first_date"), F.lit(None), year).alias("float_year"),
        F.when(F.col("c_mktsegment") != "AUTOMOBILE", F.col("c_acctbal")).alias("crit_popularity"),
        F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey").cast("long")).alias("imdbid"),
        F.col("first_date").cast("timestamp").alias("date_added"),
        F.col("criticker_updated").cast("timestamp").alias("criticker_updated"),
        F.col("omdb_updated").cast("timestamp").alias("omdb_updated"),
        F.col("imdb_main_updated").cast("timestamp").alias("imdb_main_updated")), "films")


def _jitter_u():
    return ((F.col("crit_id") * 7919 + F.col("source_no") * 104729) % 1000 + 0.5) / 1000.0


def _gap_u():
    return ((F.col("crit_id") * 4001 + F.col("source_no") * 7) % 997 + 0.5) / 997.0


def _due(spark, sf_dir, cfg):
    films = _films(spark, sf_dir)
    scored = period_scores(films, population_stats(films))
    return due(next_updates(scored, cfg, jitter_draw=_jitter_u()), AS_OF)


SRC_VALUES = ", ".join(f"({i}, '{s}', '{next(g for g in ('criticker', 'omdb', 'imdb', 'ptp') if s.startswith(g))}', "
                       f"{float(m)})" for i, (s, m) in enumerate(SOURCES, start=1))

FILMS_SQL = f"""
WITH agg AS (
  SELECT o_custkey, min(o_orderdate) AS first_date,
         max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS criticker_updated,
         max(o_orderdate) FILTER (WHERE o_orderstatus = 'O') AS omdb_updated,
         max(o_orderdate) FILTER (WHERE o_orderstatus = 'P') AS imdb_main_updated
    FROM orders GROUP BY o_custkey),
films AS (
  SELECT c.c_custkey AS crit_id, coalesce(year(a.first_date), 1995) AS year,
         coalesce(year(a.first_date)
                  + (epoch_us(a.first_date) - epoch_us(make_timestamp(year(a.first_date), 1, 1, 0, 0, 0)))
                  / (epoch_us(make_timestamp(year(a.first_date) + 1, 1, 1, 0, 0, 0))
                     - epoch_us(make_timestamp(year(a.first_date), 1, 1, 0, 0, 0))),
                  coalesce(year(a.first_date), 1995) + 0.5) AS float_year,
         CASE WHEN c.c_mktsegment <> 'AUTOMOBILE' THEN c.c_acctbal END AS crit_popularity,
         CASE WHEN c.c_nationkey % 5 <> 0 THEN CAST(c.c_nationkey AS BIGINT) END AS imdbid,
         a.first_date AS date_added, a.criticker_updated, a.omdb_updated, a.imdb_main_updated
    FROM customer c LEFT JOIN agg a ON c.c_custkey = a.o_custkey),
s0 AS (
  SELECT min(float_year) AS year_min, median(float_year) AS year_median, max(float_year) AS year_max,
         min(crit_popularity) AS pop_min, median(crit_popularity) AS pop_median,
         max(crit_popularity) AS pop_max, min(date_added) AS earliest_date_added FROM films),
s1 AS (
  SELECT *, ln(ln(36.0) / ln(6.0)) / ln((year_max - year_min) / (year_max - year_median)) AS year_b,
            ln(ln(36.0) / ln(6.0)) / ln((pop_max - pop_min) / (pop_max - pop_median)) AS pop_b FROM s0),
stats AS (
  SELECT *, ln(8.0) / pow(year_max - year_median, year_b) AS year_a,
            ln(8.0) / pow(pop_max - pop_median, pop_b) AS pop_a FROM s1),
scored AS (
  SELECT f.*, exp(s.year_a * pow(greatest(s.year_max - f.year, 0.0), s.year_b)) AS year_score,
         exp(s.pop_a * pow(greatest(s.pop_max - coalesce(f.crit_popularity, s.pop_median), 0.0), s.pop_b)) AS pop_score,
         s.earliest_date_added
    FROM films f CROSS JOIN stats s),
scored2 AS (SELECT *, exp((2.0 * ln(year_score) + ln(pop_score)) / 3.0) AS base_weeks FROM scored),
src(source_no, source, source_group, multiplier) AS (VALUES {SRC_VALUES}),
tasks AS (
  SELECT f.crit_id, src.source, src.source_no, src.source_group,
         CASE src.source WHEN 'criticker' THEN f.criticker_updated WHEN 'omdb' THEN f.omdb_updated
              WHEN 'imdb_main' THEN f.imdb_main_updated END AS stamp,
         f.base_weeks, src.multiplier, f.earliest_date_added,
         ((f.crit_id * 7919 + src.source_no * 104729) % 1000 + 0.5) / 1000.0 AS u
    FROM scored2 f CROSS JOIN src
   WHERE src.source = 'criticker' OR f.imdbid IS NOT NULL),
tasks2 AS (
  SELECT *, least(CASE WHEN stamp IS NULL THEN base_weeks * multiplier / 50000.0 ELSE base_weeks * multiplier END
                  * pow(-ln(1.0 - u), 1.0 / {SHAPE}) / pow(ln(2.0), 1.0 / {SHAPE}), 500.0) AS weeks
    FROM tasks),
tasks3 AS (
  SELECT *, make_timestamp(epoch_us(coalesce(stamp, earliest_date_added))
                           + CAST(round(weeks * 604800000000.0) AS BIGINT)) AS next_update
    FROM tasks2),
due AS (SELECT * FROM tasks3 WHERE next_update <= TIMESTAMP '{AS_OF}'),
caps(source_group, cap) AS (VALUES ('criticker', 400), ('omdb', 40), ('imdb', 800), ('ptp', 400)),
uph AS (SELECT d.source_group, least(count(*), min(c.cap)) AS per_hour
          FROM due d JOIN caps c USING (source_group) GROUP BY d.source_group),
seq AS (
  SELECT d.*, -ln(1.0 - ((d.crit_id * 4001 + d.source_no * 7) % 997 + 0.5) / 997.0) * 3600.0 / u.per_hour AS gap_s
    FROM due d JOIN uph u USING (source_group)),
seq2 AS (
  SELECT *, sum(gap_s) OVER (PARTITION BY source_group ORDER BY next_update, crit_id, source
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS offset_s
    FROM seq)
"""


@register("population_stats", FILMS_SQL + """
SELECT round(year_min, 6) AS year_min, round(year_median, 6) AS year_median, round(year_max, 6) AS year_max,
       round(pop_min, 6) AS pop_min, round(pop_median, 6) AS pop_median, round(pop_max, 6) AS pop_max,
       round(year_a, 6) AS year_a, round(year_b, 6) AS year_b, round(pop_a, 6) AS pop_a, round(pop_b, 6) AS pop_b,
       strftime(earliest_date_added, '%Y-%m-%d %H:%M:%S') AS earliest_date_added
  FROM stats
""")
def population_stats_query(spark, sf_dir):
    s = population_stats(_films(spark, sf_dir))
    nums = ["year_min", "year_median", "year_max", "pop_min", "pop_median", "pop_max",
            "year_a", "year_b", "pop_a", "pop_b"]
    return s.select(*[r6(c).alias(c) for c in nums], ts_text("earliest_date_added").alias("earliest_date_added"))


@register("period_scores", FILMS_SQL + """
SELECT crit_id, round(year_score, 6) AS year_score, round(pop_score, 6) AS pop_score,
       round(base_weeks, 6) AS base_weeks
  FROM scored2
""")
def period_scores_query(spark, sf_dir):
    films = _films(spark, sf_dir)
    s = period_scores(films, population_stats(films))
    return s.select("crit_id", r6("year_score").alias("year_score"), r6("pop_score").alias("pop_score"),
                    r6("base_weeks").alias("base_weeks"))


@register("refresh_due", FILMS_SQL + """
SELECT crit_id, source, round(weeks, 6) AS weeks, strftime(next_update, '%Y-%m-%d %H:%M:%S') AS next_update
  FROM due
""")
def refresh_due_query(spark, sf_dir):
    d = _due(spark, sf_dir, RefreshConfig(weibull_shape=SHAPE))
    return d.select("crit_id", "source", r6("weeks").alias("weeks"), ts_text("next_update").alias("next_update"))


@register("refresh_plan", FILMS_SQL + """
SELECT crit_id, source, source_group, round(offset_s, 3) AS offset_s
  FROM seq2 ORDER BY offset_s, crit_id, source LIMIT 30
""")
def refresh_plan_query(spark, sf_dir):
    """The first 30 tasks (the production batch size) of the merged plan."""
    cfg = RefreshConfig(weibull_shape=SHAPE)
    s = sequence(_due(spark, sf_dir, cfg), cfg, AS_OF, n=30, gap_draw=_gap_u())
    return s.select("crit_id", "source", "source_group", F.round("offset_s", 3).alias("offset_s"))


@register("refresh_sequence", FILMS_SQL + """
SELECT crit_id, source, source_group, round(offset_s, 3) AS offset_s FROM seq2
""")
def refresh_sequence_query(spark, sf_dir):
    """R8 + W2 on the whole due set (two-level prefix sum, no n)."""
    cfg = RefreshConfig(weibull_shape=SHAPE)
    s = sequence(_due(spark, sf_dir, cfg), cfg, AS_OF, n=None, gap_draw=_gap_u())
    return s.select("crit_id", "source", "source_group", F.round("offset_s", 3).alias("offset_s"))
