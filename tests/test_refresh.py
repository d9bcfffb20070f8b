"""Refresh schedule: scalar checks and the 48-task golden case (jitter = 1)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kinoframe.functions.scoring import combined_period, curve_a, curve_b, period_score
from kinoframe.plans.refresh import (RefreshConfig, due, next_updates, period_scores, population_stats,
                                     sequence)

# The reference's stamps carry +01:00; in UTC they are the day before at 23:00.
STAMP = dt.datetime(2017, 12, 31, 23, 0)
AS_OF = "2018-12-31 23:00:00"


def scalar(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_curve_scalars(spark):
    b = scalar(spark, curve_b(F.lit(13.0), F.lit(90.0), 10, 100))
    assert b == pytest.approx(0.35824, abs=1e-5)
    a = scalar(spark, curve_a(F.lit(13.0), F.lit(b), 10))
    assert a == pytest.approx(0.91866, abs=1e-5)
    assert scalar(spark, period_score(F.lit(11.0), F.lit(a), F.lit(b))) == pytest.approx(8.748, abs=1e-3)
    assert scalar(spark, combined_period(F.lit(10.0), F.lit(15.0), 1, 1)) == pytest.approx(12.2474, abs=1e-4)
    assert scalar(spark, combined_period(F.lit(10.0), F.lit(200.0), 1, 0)) == pytest.approx(10.0)
    assert scalar(spark, combined_period(F.lit(10.0), F.lit(200.0), 1, 0.01)) == pytest.approx(10.3010, abs=1e-4)


def films(spark):
    rows = [
        (1234, 10.0, 2017, 133093, None, None),
        (2345, 0.0, 1930, 133094, None, None),
        (4567, 10.0, 2017, 133095, STAMP, STAMP),
        (5678, 5.0, 2000, 133096, STAMP, STAMP),
        (6789, 0.0, 1930, 133097, STAMP, STAMP),
        (49141, 5.0, 2000, None, None, None),
    ]
    df = spark.createDataFrame(rows, "crit_id int, crit_popularity double, year int, imdbid long, "
                                     "criticker_updated timestamp, omdb_updated timestamp")
    return df.withColumn("float_year", F.col("year") + 0.5).withColumn("date_added", F.lit(STAMP).cast("timestamp"))


def test_stats(spark):
    s = population_stats(films(spark)).first()
    assert (s["year_min"], s["year_median"], s["year_max"]) == (1930.5, 2000.5, 2017.5)
    assert (s["pop_min"], s["pop_median"], s["pop_max"]) == (0.0, 5.0, 10.0)
    assert s["year_a"] == pytest.approx(0.624554, abs=1e-6) and s["year_b"] == pytest.approx(0.424542, abs=1e-6)
    assert s["pop_a"] == pytest.approx(0.415888, abs=1e-6) and s["pop_b"] == pytest.approx(1.0)


def test_golden_due_set(spark):
    f = films(spark)
    scored = period_scores(f, population_stats(f))
    base = {r["crit_id"]: r["base_weeks"] for r in scored.collect()}
    assert base[1234] == pytest.approx(1.3637, abs=1e-4) and base[2345] == pytest.approx(64.4337, abs=1e-4)
    cfg = RefreshConfig()
    # u = 0.5 makes the Weibull jitter exactly its median, 1.
    d = due(next_updates(scored, cfg, jitter_draw=F.lit(0.5)), AS_OF)
    counts = {r["source_group"]: r["n"] for r in d.groupBy("source_group").agg(F.count("*").alias("n")).collect()}
    assert counts == {"criticker": 5, "omdb": 3, "imdb": 35, "ptp": 5}
    assert d.count() == 48
    crit = {r["crit_id"] for r in d.filter("source = 'criticker'").collect()}
    assert crit == {1234, 2345, 4567, 5678, 49141}
    omdb = {r["crit_id"] for r in d.filter("source = 'omdb'").collect()}
    assert omdb == {1234, 2345, 4567}
    w = {r["crit_id"]: r["update_period"] for r in next_updates(scored, cfg, jitter_draw=F.lit(0.5))
         .filter("source = 'omdb'").collect()}
    assert w[6789] == 500.0


def test_sequence_paths_agree(spark):
    f = films(spark)
    cfg = RefreshConfig()
    d = due(next_updates(period_scores(f, population_stats(f)), cfg, jitter_draw=F.lit(0.5)), AS_OF)
    full = {(r["crit_id"], r["source"]): r["offset_s"] for r in sequence(d, cfg, AS_OF).collect()}
    top = sequence(d, cfg, AS_OF, n=7).collect()
    assert len(top) == 7
    for r in top:
        assert r["offset_s"] == pytest.approx(full[(r["crit_id"], r["source"])])
    # the first 7 overall are the 7 smallest offsets of the full plan
    assert sorted(r["offset_s"] for r in top) == pytest.approx(sorted(full.values())[:7])
    # gaps have mean 3600 / min(count, cap): criticker has 5 tasks
    crit = sorted(v for (k, s), v in full.items() if s == "criticker")
    assert len(crit) == 5 and all(b > a for a, b in zip(crit, crit[1:]))


def test_prefix_sum_matches_window(spark):
    from pyspark.sql import Window
    from kinoframe.operators.prefix import running_sum
    df = spark.range(0, 5000).select((F.col("id") % 3).cast("string").alias("g"), F.col("id").alias("o"),
                                     (F.col("id") % 7 + 0.25).alias("v"))
    got = running_sum(df, "g", ["o"], "v", "cum", partitions=7)
    ref = df.withColumn("cum_ref", F.sum("v").over(Window.partitionBy("g").orderBy("o")))
    bad = got.join(ref, ["g", "o"]).filter(F.abs(F.col("cum") - F.col("cum_ref")) > 1e-6).count()
    assert bad == 0 and got.count() == 5000


def test_schedule_on_film_header(spark):
    from kinoframe.plans.refresh import film_refresh_input, schedule
    from kinoframe.schemas import MOVIES
    from kinoframe.sources.tables import align_schema
    f = films(spark).drop("float_year")
    movies = align_schema(f, MOVIES).select(*MOVIES.fieldNames())
    plan = schedule(film_refresh_input(movies), RefreshConfig(), AS_OF, n=30).collect()
    assert 0 < len(plan) <= 30
    assert [r["arrival"] for r in plan] == sorted(r["arrival"] for r in plan)


def test_prefix_sum_spreads_a_hot_group(spark):
    from pyspark.sql import Window
    from kinoframe.operators.prefix import running_sum
    # one group holds 90% of the rows
    df = spark.range(0, 20000).select(F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g"),
                                      F.col("id").alias("o"), F.lit(1.0).alias("v"))
    got = running_sum(df, "g", ["o"], "v", "cum", partitions=8)
    ref = df.withColumn("cum_ref", F.sum("v").over(Window.partitionBy("g").orderBy("o")))
    assert got.join(ref, ["g", "o"]).filter(F.col("cum") != F.col("cum_ref")).count() == 0
    # the hot group is cut into several range slices, i.e. several tasks
    slices = (df.repartitionByRange(8, "g", "o").withColumn("s", F.spark_partition_id())
              .filter("g = 'hot'").select("s").distinct().count())
    assert slices >= 4
