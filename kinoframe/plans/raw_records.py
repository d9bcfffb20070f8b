"""Landed raw records to a film batch, and the catalogue enrichment.

``main_records`` turns the text fields of fetched film records into the
columns and lists that ``apply_film_batch`` takes; ``enrich_films`` brings
catalogue items to the films they belong to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinoframe.functions.text import parse_aka, parse_release, parse_votes, people_list, strip_author, to_int_or_null
from kinoframe.operators.lookup import bridge
from kinoframe.operators.merge import merge_null_safe
from kinoframe.operators.priority import median_of, release_dates_of, shortest_of, titles_of
from kinoframe.schemas import ROLES
from kinoframe.sources.catalogue import catalogue_items, clean_catalogue_items

KEY = "crit_id"


def main_records(raw: DataFrame, stamp_col: str = "fetched_at", stamp_as: str = "imdb_main_updated") -> DataFrame:
    """One film record per raw record (key, releases, akas, plots, runtimes,
    genres, keywords, cast / director / writer lists, votes, score, a stamp).

    Every pick (dates, titles, shortest plot, median runtime) is made from the
    lists that stand in the row, so nothing moves and a film that was fetched
    twice gives two records, each with its own values; genres and keywords
    become sorted sets. Fields that are missing stay NULL, so the merge keeps
    what is stored.
    """
    parsed = raw.withColumns({"_releases": F.transform("releases", parse_release), "_akas": F.transform("akas", parse_aka),
                              "_plots": F.transform("plots", strip_author), "_runtimes": F.transform("runtimes", to_int_or_null)})
    original_date, local_date = release_dates_of("_releases")
    original, english = titles_of("_akas")
    return parsed.select(
        KEY, parse_votes("votes").cast("int").alias("imdb_votes"), F.col("score").try_cast("double").alias("imdb_rating"),
        F.array_sort(F.array_distinct("genres")).alias("genres"), F.array_sort(F.array_distinct("keywords")).alias("keywords"),
        *[people_list(r).alias(r) for r in ROLES.values() if r in raw.columns], F.col(stamp_col).alias(stamp_as),
        original_date.alias("original_release_date"), local_date.alias("dutch_release_date"),
        original.alias("original_title"), english.alias("imdb_title"), shortest_of(F.col("_plots")).alias("plot_storyline"),
        median_of(F.col("_runtimes")).alias("runtime"))


def enrich_films(movies: DataFrame, pages: DataFrame, stamp) -> DataFrame:
    """Catalogue pages to the films they name: items cleaned, external ids
    bridged, the three catalogue columns and the stamp merged (a page that is
    fetched twice counts once, the item of the highest id wins)."""
    items = clean_catalogue_items(catalogue_items(pages))
    found = bridge(items, movies.select("imdbid", KEY), "imdbid", KEY)
    batch = found.select(KEY, "netflix_id", "netflix_title", "netflix_rating", F.lit(stamp).cast("timestamp").alias("netflix_updated"))
    # netflix_id orders a film's items; the fold would leave the order column out
    batch = batch.withColumn("_by", F.col("netflix_id"))
    return merge_null_safe(movies, batch, KEY, order=["_by"])


def stamp_genres(genres: DataFrame, fetched: DataFrame, stamp, id_col: str = "genreid",
                 stamp_col: str = "movies_updated") -> DataFrame:
    """The genre catalogue with the stamp on the genres that were fetched."""
    done = fetched.select(id_col, F.lit(stamp).cast("timestamp").alias("_now")).distinct()
    return (genres.join(done, id_col, "left").withColumn(stamp_col, F.coalesce("_now", stamp_col)).drop("_now"))
