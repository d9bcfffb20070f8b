"""Final scores, write-back and recommendations."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinoframe.functions.scoring import final_score, seeit, unit_draw
from kinoframe.operators.merge import merge_entries

SCORE_TYPES = ["seen_probability", "pred_rating", "pred_seeit", "pred_score"]


def score(films: DataFrame, seed: int = 0, key: str = "crit_id", draw: Column | None = None) -> DataFrame:
    """M13-M16 on (key, seen_probability, pred_rating, years_since_release):
    pred_seeit, a repeatable draw, show = pred_seeit >= draw, and score."""
    u = draw if draw is not None else unit_draw(seed, F.col(key))
    x = films.withColumn("pred_seeit", seeit(F.col("seen_probability"), F.col("years_since_release")))
    x = x.withColumn("draw", u).withColumn("show", (F.col("pred_seeit") >= F.col("draw")).cast("int"))
    return x.withColumn("score", final_score(F.col("pred_seeit"), F.col("pred_rating")))


def attach_predictions(features: DataFrame, preds: Sequence[DataFrame], key: str = "crit_id") -> DataFrame:
    """Predictions joined back to the features, outer on the key."""
    out = features
    for p in preds:
        out = out.join(p, key, "full_outer")
    return out


def writeback(ratings: DataFrame, scored: DataFrame, user: str, key: str = "crit_id") -> DataFrame:
    """The 4 scores unpivoted to rating rows of ``user`` and merged into
    the ratings rows (new entries replace, rating / psi rows are kept)."""
    new = scored.select(key, F.lit(user).alias("user"),
                        F.stack(F.lit(len(SCORE_TYPES)),
                                *[x for t in SCORE_TYPES for x in (F.lit(t), F.col(
                                    "score" if t == "pred_score" else t).cast("double"))]
                                ).alias("type", "score"))
    return merge_entries(ratings.select(key, "user", "type", F.col("score").cast("double")), new,
                         [key, "user", "type"])


def recommend(scored: DataFrame, k: int = 500, key: str = "crit_id", kind_col: str = "kind",
              kinds: Sequence[str] = ("movie",), short_col: str | None = "genre_short",
              min_rating: float = 50.0) -> DataFrame:
    """M18 = P15 + O5: unrated, shown, predicted rating >= 50, of the given
    kinds, not a short; the top ``k`` by score (key breaks ties)."""
    cond = ((F.coalesce(F.col("rated"), F.lit(0)) == 0) & (F.col("show") == 1)
            & (F.col("pred_rating") >= min_rating) & F.col(kind_col).isin(*kinds))
    if short_col is not None and short_col in scored.columns:
        cond = cond & (F.coalesce(F.col(short_col), F.lit(0.0)) == 0)
    return scored.filter(cond).orderBy(F.col("score").desc(), F.col(key)).limit(k)
