"""JSON sources (S7, N9, N13, N14, A15, A16, P10): catalogue pages, genre
pages, offer lists and ratings-link answers, all with string values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinoframe.functions.text import external_id, is_sentinel

ITEM_FIELDS = ["netflixid", "title", "image", "synopsis", "rating", "type", "released", "runtime",
               "largeimage", "unogsdate", "imdbid", "download"]
CATALOGUE_SCHEMA = T.StructType([
    T.StructField("COUNT", T.StringType()),
    T.StructField("ITEMS", T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ITEM_FIELDS]))),
])
GENRE_PAGE_SCHEMA = T.StructType([
    T.StructField("ITEMS", T.ArrayType(T.MapType(T.StringType(), T.ArrayType(T.LongType())))),
])
OFFERS_SCHEMA = T.StructType([T.StructField("Movies", T.ArrayType(T.StructType([
    T.StructField("GroupId", T.StringType()),
    T.StructField("Torrents", T.ArrayType(T.StructType([T.StructField("Quality", T.StringType())]))),
])))])
HD_QUALITIES = ("High Definition", "Ultra High Definition")
OFFER_URL = "https://passthepopcorn.me/torrents.php?id=%s"


def read_catalogue_json(spark: SparkSession, path: str, one_document_per_file: bool = False) -> DataFrame:
    """Catalogue pages, one JSON document per line (files are split);
    ``one_document_per_file`` for files whose only document spans lines."""
    return spark.read.schema(CATALOGUE_SCHEMA).option("multiLine", one_document_per_file).json(path)


def catalogue_items(pages: DataFrame) -> DataFrame:
    """S7 -> rows: one per listed item, with the page's total count."""
    return pages.select(F.col("COUNT").try_cast("long").alias("count"),
                        F.explode("ITEMS").alias("it")).select("count", "it.*")


def clean_catalogue_items(items: DataFrame) -> DataFrame:
    """N9 + P10: id -> long, rating -> double (NULL when not a number),
    'tt0123' -> 123; rows with a sentinel or NULL external id are dropped."""
    return items.filter(~is_sentinel(F.col("imdbid"))).select(
        F.col("netflixid").try_cast("bigint").alias("netflix_id"),
        F.col("title").alias("netflix_title"),
        F.col("rating").try_cast("double").alias("netflix_rating"),
        external_id(F.col("imdbid")).alias("imdbid"))


def genre_page_index(pages: DataFrame) -> DataFrame:
    """Genre page ``ITEMS: [{name: [ids]}]`` -> one row per id with its
    distinct sorted names (inverted index by double explode + collect_set)."""
    pairs = (pages.select(F.explode("ITEMS").alias("m"))
                  .select(F.explode("m").alias("genre_name", "ids"))
                  .select("genre_name", F.explode("ids").alias("genreid")))
    return pairs.groupBy("genreid").agg(F.array_sort(F.collect_set("genre_name")).alias("genre_names"))


def offers_info(df: DataFrame, json_col: str, url: str = OFFER_URL) -> DataFrame:
    """N13 + A15: offers answer -> link of the first film and whether any
    offer is HD or UHD; no film -> link NULL, flag false."""
    # Parse once into a column; the fields are then read from it (the
    # optimizer does not inline an expensive expression used several times).
    parsed = df.select("*", F.try_element_at(F.from_json(F.col(json_col), OFFERS_SCHEMA)["Movies"],
                                             F.lit(1)).alias("_first"))
    first = F.col("_first")
    hd = F.exists(F.coalesce(first["Torrents"], F.array()), lambda x: x["Quality"].isin(*HD_QUALITIES))
    return parsed.select(*[F.col(c) for c in df.columns],
                         F.when(first.isNotNull(), F.format_string(url, first["GroupId"])).alias("ptp_url"),
                         F.coalesce(hd, F.lit(False)).alias("ptp_hd_available"))


def ratings_link(df: DataFrame, json_col: str, field: str = "tomatoURL") -> DataFrame:
    """Answer JSON -> link; ``Response = 'False'`` rows are rejected
    (status 'invalid'), an empty link means 'no update' (NULL)."""
    resp = F.get_json_object(F.col(json_col), "$.Response")
    link = F.nullif(F.get_json_object(F.col(json_col), f"$.{field}"), F.lit(""))
    return df.select("*", F.when(resp == "False", F.lit("invalid")).otherwise(F.lit("ok")).alias("status"),
                     F.when(resp.isNull() | (resp != "False"), link).alias("tomato_url"))
