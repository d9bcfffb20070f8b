"""Survival curve, scores, write-back, recommendations, one-hot."""

import pytest
from pyspark.sql import functions as F

from kinoframe.functions.scoring import survival, weibull_jitter
from kinoframe.plans.features import encode, impute_mean, split_train_test
from kinoframe.plans.score import recommend, score, writeback


def test_survival(spark):
    r = spark.createDataFrame([(0.0,), (5.0,), (-2.0,)], "x double").select(survival("x").alias("s")).collect()
    assert [x["s"] for x in r] == pytest.approx([1.0, 0.326267, 1.0], abs=1e-6)
    j = spark.range(1).select(weibull_jitter(F.lit(0.5), 3.0).alias("j")).first()["j"]
    assert j == pytest.approx(1.0)


def test_score_and_writeback(spark):
    films = spark.createDataFrame([(1, 0.9, 80.0, 0.0), (2, 0.0, 90.0, 1.0)],
                                  "crit_id int, seen_probability double, pred_rating double, years_since_release double")
    s = {r["crit_id"]: r for r in score(films, draw=F.lit(0.5)).collect()}
    assert s[1]["pred_seeit"] == pytest.approx(0.9 ** 0.25)
    assert s[1]["show"] == 1 and s[2]["show"] == 0
    assert s[1]["score"] == pytest.approx((0.9 ** 0.25 * 0.8 ** 3) ** 0.25 * 100)
    ratings = spark.createDataFrame([(1, "ann", "rating", 70.0), (1, "ann", "pred_score", 1.0)],
                                    "crit_id int, user string, type string, score double")
    w = writeback(ratings, score(films, draw=F.lit(0.5)), "ann")
    got = {(r["crit_id"], r["type"]) for r in w.collect()}
    assert (1, "rating") in got and len(got) == 9


def test_one_hot_train_vocabulary_and_impute(spark):
    df = spark.createDataFrame([(1, "movie", ["Drama", "Sci-Fi"], 1.0), (2, "tv series", ["Short"], None),
                                (3, "movie", ["Unseen"], 3.0)], "crit_id int, kind string, genres array<string>, m double")
    f = split_train_test(df, "crit_id", bucket=F.when(F.col("crit_id") == 3, 0).otherwise(50))
    e = {r["crit_id"]: r.asDict() for r in encode(f).collect()}
    assert "genre_unseen" not in e[1] and e[3]["genre_drama"] == 0.0 and e[1]["genre_sci-fi"] == 1.0
    assert e[2]["kind_tv_series"] == 1.0
    out, kept = impute_mean(df.withColumn("z", F.lit(None).cast("double")), ["m", "z"])
    assert kept == ["m"] and {r["crit_id"]: r["m"] for r in out.collect()}[2] == 2.0


def test_recommend(spark):
    df = spark.createDataFrame([(i, 0, 1, 60.0, "movie", 0.0, float(i)) for i in range(10)]
                               + [(99, 1, 1, 60.0, "movie", 0.0, 100.0), (98, 0, 1, 60.0, "movie", 1.0, 100.0)],
                               "crit_id int, rated int, show int, pred_rating double, kind string, genre_short double, score double")
    assert [r["crit_id"] for r in recommend(df, k=3).collect()] == [9, 8, 7]
