"""Declared schemas and keys of the film catalogue (the tables of SURVEY
section 1.3). Types are widened to Spark's: unsigned ints that can exceed a
signed int are LongType, floats DoubleType, text-stored timestamps
TimestampType, the 0/1 HD flag BooleanType.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(),
          "ts": T.TimestampType(), "bool": T.BooleanType()}


def _schema(spec: str) -> T.StructType:
    fields = []
    for item in spec.split(","):
        name, ty = item.split()
        fields.append(T.StructField(name, _TYPES[ty], True))
    return T.StructType(fields)


# Column names, order and types of each table.
MOVIES = _schema(
    "crit_id int, imdbid long, year int, imdb_year int, title string, imdb_title string, english_title string, "
    "original_title string, crit_rating double, crit_votes int, imdb_rating double, imdb_votes long, "
    "metacritic_score int, kind string, runtime int, plot_summary string, plot_storyline string, "
    "original_release_date ts, dutch_release_date ts, crit_popularity double, crit_url string, tomato_url string, "
    "poster_url string, trailer_url string, ptp_url string, ptp_hd_available bool, netflix_id long, "
    "netflix_title string, netflix_rating double, date_added ts, criticker_updated ts, imdb_main_updated ts, "
    "imdb_release_updated ts, imdb_metacritic_updated ts, imdb_keywords_updated ts, imdb_taglines_updated ts, "
    "imdb_vote_details_updated ts, imdb_plot_updated ts, omdb_updated ts, ptp_updated ts, unogs_updated ts, "
    "netflix_updated ts")
PERSONS = _schema("crit_id int, person_id long, rank int, name string, canonical_name string, role string")
GENRES = _schema("crit_id int, genre string")
COUNTRIES = _schema("crit_id int, country string, rank int")
LANGUAGES = _schema("crit_id int, language string, rank int")
KEYWORDS = _schema("crit_id int, keyword string")
TAGLINES = _schema("crit_id int, tagline string, rank int")
VOTE_DETAILS = _schema("crit_id int, demographic string, votes int, rating double")
RATINGS = _schema("crit_id int, user string, type string, score double")
NETFLIX_GENRES = _schema("genreid long, genre_name string, movies_updated ts")
UNOGS_SUSPENSION = _schema("id int, last_suspension ts")

SCHEMAS = {"movies": MOVIES, "persons": PERSONS, "genres": GENRES, "countries": COUNTRIES,
           "languages": LANGUAGES, "keywords": KEYWORDS, "taglines": TAGLINES, "vote_details": VOTE_DETAILS,
           "ratings": RATINGS, "netflix_genres": NETFLIX_GENRES, "unogs_suspension": UNOGS_SUSPENSION}

# Primary keys (uniqueness contract, checked by quality.check_unique).
KEYS = {"movies": ["crit_id"], "persons": ["crit_id", "person_id", "role"], "genres": ["crit_id", "genre"],
        "countries": ["crit_id", "country"], "languages": ["crit_id", "language"],
        "keywords": ["crit_id", "keyword"], "taglines": ["crit_id", "rank"],
        "vote_details": ["crit_id", "demographic"], "ratings": ["crit_id", "user", "type"],
        "netflix_genres": ["genreid", "genre_name"], "unogs_suspension": ["id"]}

CHILD_TABLES = ["persons", "genres", "countries", "languages", "keywords", "taglines", "vote_details", "ratings"]
ROLES = {"cast": "cast", "director": "director", "writer": "writer"}
HEADER_COLUMNS = [f.name for f in MOVIES.fields]
