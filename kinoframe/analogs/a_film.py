"""Film jobs on the given tables: pages in both quote styles, film lists and
a batch of partial film records; the oracles state the result from the source
columns, not by the library's patterns."""

from pyspark.sql import functions as F

from kinoframe.analogs import register
from kinoframe.analogs.a_ingest import _catalogue_pages
from kinoframe.analogs.common import r6, t, ts_text
from kinoframe.plans.catalogue import apply_film_batch
from kinoframe.plans.raw_records import enrich_films, main_records, stamp_genres
from kinoframe.schemas import SCHEMAS
from kinoframe.session import spread_rows
from kinoframe.sources.elements import extract_film_elements
from kinoframe.sources.pages import extract_film_list, extract_film_page


def _quoted(template):
    """A page's pieces with its quote character in place of each ~."""
    return F.replace(F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in template]),
                     F.lit("~"), F.when(F.col("p_partkey") % 2 == 0, F.lit("'")).otherwise(F.lit('"')))


@register("film_page", """
SELECT p_partkey AS crit_id,
       CASE WHEN p_partkey % 7 > 0 THEN 'http://img/' || p_partkey || '.jpg?a=1&b=2' END AS poster_url,
       CASE WHEN p_partkey % 3 > 0 THEN p_size END AS my_rating,
       CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size + 2 END AS my_psi,
       CASE WHEN p_partkey % 5 > 0 THEN 'https://www.youtube.com/watch?v=t_' || p_partkey END AS trailer_url,
       CASE WHEN p_partkey % 6 > 0 THEN p_partkey END AS imdbid,
       round(p_size / 8.0, 6) AS crit_rating,
       CASE WHEN p_partkey % 2 = 0 THEN p_size * 10 ELSE 0 END AS crit_votes
  FROM part
""")
def film_page_query(spark, sf_dir):
    """S8 + N11: film pages of both quote styles, attributes in any order,
    entities, and blocks that lack their element."""
    p = t(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("int"))
    k, size = F.col("p_partkey"), F.col("p_size")
    html = _quoted([
        "<html><meta itemprop=~url~ content=~http://x~>",
        F.when(k % 7 > 0, F.concat(F.lit("<meta content=~http://img/"), k.cast("string"),
                                   F.lit(".jpg?a=1&amp;b=2~ itemprop=~image~>"))).otherwise(F.lit("")),
        F.when(k % 3 > 0, F.concat(F.lit("<div id=~a~ class=~fi_score_div big~> "), size.cast("string"), F.lit("<")))
         .otherwise(F.lit("<div class=~fi_score_div~>none<")),
        F.when(k % 4 == 0, F.concat(F.lit("/div><div class=~fi_psi_div~ id=~g~>"), (size + 1).cast("string"), F.lit("<")))
         .otherwise(F.lit("/div><div class=~fi_psi_div~>n/a<")),
        "/div>Your PSI: <span class=~s~>", size + 2, "</span><div id=~fi_trailer~>",
        F.when(k % 5 > 0, F.concat(F.lit("<iframe width=~1~ src=~https://www.youtube.com/embed/t_"), k.cast("string"),
                                   F.lit("~></iframe>"))).otherwise(F.lit("")),
        "</div><iframe src=~https://www.youtube.com/embed/advert~></iframe><p class=~e~ id=~fi_info_ext~>",
        F.when(k % 6 > 0, F.concat(F.lit("<a href=~http://db/title/tt"), F.lpad(k.cast("string"), 7, "0"), F.lit("/~>db</a>")))
         .otherwise(F.lit("")),
        "</p><a href=~http://db/title/tt9999999/~>other</a><span itemprop=~ratingValue~>", (size / 8.0),
        "</span>", F.when(k % 2 == 0, F.concat(F.lit("<b itemprop=~reviewCount~> "), (size * 10).cast("string"), F.lit("</b>")))
        .otherwise(F.lit(""))])
    got = extract_film_page(p.select(k.alias("crit_id"), html.alias("html")))
    return got.withColumn("crit_rating", F.round("crit_rating", 6))


@register("film_list", """
SELECT p_partkey AS page, 9 AS nr_pages, p_partkey AS crit_id, 'http://f/' || p_partkey || '?a=1&b=2' AS crit_url,
       p_name || ' & more' AS title, 1950 + p_size AS year, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS psi,
       CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 END AS rating
  FROM part
""")
def film_list_query(spark, sf_dir):
    """Film-list items of both quote styles, with and without scores."""
    p = t(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("int"))
    k, size = F.col("p_partkey"), F.col("p_size")
    html = _quoted([
        "<p>Page 1 of 9</p><li class=~~ id=~fl_titlelist_title_", k, "~><div class=~fl_name~><a title=~", F.col("p_name"),
        " &amp; more~ class=~l~ href=~http://f/", k, "?a=1&amp;b=2~>", F.col("p_name"), " (TV) (", size + 1950,
        ")</a></div><div class=~s~ titleid=~", k, "~>",
        F.when(k % 3 > 0, F.concat(F.lit("<div class=~pti yellow~ title=~Probable Score~>"), size.cast("string"), F.lit("</div>")))
         .otherwise(F.lit("")),
        F.when(k % 4 == 0, F.concat(F.lit("<div title=~Your Ranking~ class=~r~> "), (size + 1).cast("string"), F.lit("</div>")))
         .otherwise(F.lit("")), "</div></li><li id=~other~>x</li>"])
    got = extract_film_list(p.select(k.alias("page"), html.alias("html")))
    return got.select("page", "nr_pages", F.col("crit_id").cast("long").alias("crit_id"), "crit_url", "title", "year", "psi", "rating")


@register("film_batch", """
SELECT p_partkey AS crit_id, CASE WHEN p_partkey % 4 = 0 THEN 'second' ELSE p_name END AS title,
       CAST(CASE WHEN p_partkey % 4 = 0 THEN 1990 ELSE p_size END AS INTEGER) AS year,
       'director ' || p_partkey AS director,
       CASE WHEN p_partkey % 12 = 0 THEN 'late ' || p_partkey ELSE 'cast ' || p_partkey END AS cast_names,
       CASE WHEN p_partkey % 20 = 0 THEN 'g1,g2' ELSE 'old' END AS genres,
       round(CASE WHEN p_partkey % 4 = 0 THEN 7.0 ELSE p_size END, 6) AS rating,
       round(CASE WHEN p_partkey % 4 = 0 THEN 3.0 END, 6) AS psi
  FROM part
""")
def film_batch_query(spark, sf_dir):
    """U1 + U4 + U7: a batch with partial role lists, films that come twice
    and list columns, applied to stored films made of parts."""
    p = t(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("int")
    tables = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}

    def fill(name, rows):
        schema = SCHEMAS[name]
        tables[name] = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                                     for f in schema.fields])

    fill("movies", p.select(k.alias("crit_id"), F.col("p_name").alias("title"), F.col("p_size").alias("year")))
    fill("persons", p.select(k.alias("crit_id"), F.explode(F.array(F.lit("director"), F.lit("cast"))).alias("role"))
         .select("crit_id", "role", F.lit(1).alias("rank"), F.lit(1).alias("person_id"),
                 F.concat_ws(" ", "role", "crit_id").alias("name")).withColumn("canonical_name", F.col("name")))
    fill("genres", p.select(k.alias("crit_id"), F.lit("old").alias("genre")))
    fill("ratings", p.select(k.alias("crit_id"), F.lit("me").alias("user"), F.lit("rating").alias("type"),
                             F.col("p_size").alias("score")))
    some = p.where("p_partkey % 4 = 0").select(k.alias("crit_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("at"))
    second = F.col("at") == 2
    name = F.concat(F.lit("late "), F.col("crit_id"))
    person = F.struct(name.alias("canonical_name"), name.alias("name"), F.lit(2).cast("long").alias("person_id"))
    batch = some.select(
        "crit_id", "at", F.when(second, "second").otherwise("first").alias("title"), F.when(~second, 1990).alias("year"),
        F.when(~second & (F.col("crit_id") % 3 == 0), F.array(person)).alias("cast"),
        F.when(second & (F.col("crit_id") % 5 == 0), F.array(F.lit("g2"), F.lit("g1"))).alias("genres"),
        F.create_map(F.lit("me"), F.create_map(F.when(second, "psi").otherwise("rating"),
                                               F.when(second, 3.0).otherwise(7.0))).alias("my_ratings"))
    new = apply_film_batch(tables, batch, order=["at"])
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("name")))
    people = new["persons"].groupBy("crit_id").agg(of("director").alias("director"), of("cast").alias("cast_names"))
    genres = new["genres"].groupBy("crit_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("genre"))).alias("genres"))
    score = lambda ty: F.round(F.avg(F.when(F.col("type") == ty, F.col("score"))), 6)
    ratings = new["ratings"].groupBy("crit_id").agg(score("rating").alias("rating"), score("psi").alias("psi"))
    out = (new["movies"].select("crit_id", "title", F.col("year").cast("int").alias("year")).join(people, "crit_id", "left")
           .join(genres, "crit_id", "left").join(ratings, "crit_id", "left"))
    return out.withColumn("crit_id", F.col("crit_id").cast("long"))


@register("main_record", """
SELECT CAST(p_partkey AS BIGINT) AS crit_id,
       CASE WHEN p_partkey % 3 = 0 THEN '2001-01-01' ELSE '1999-03-05' END AS original_release_date,
       CASE WHEN p_partkey % 4 = 0 THEN '2002-03-01' END AS dutch_release_date,
       p_name || ' orig' AS original_title, p_name || ' ww' AS imdb_title,
       CASE WHEN p_partkey % 5 > 0 THEN 1000 + p_size END AS imdb_votes,
       round(CASE WHEN p_partkey % 2 = 0 THEN p_size / 4.0 END, 6) AS imdb_rating,
       p_brand || ',' || 'x' AS genres, 'short ' || p_partkey AS plot_storyline,
       CAST(p_size + 10 AS INTEGER) AS runtime, 'Doe, Jo ' || p_size || '|van Dam, Al' AS cast_names,
       '2020-01-01 00:00:00' AS imdb_main_updated
  FROM part
UNION ALL
SELECT CAST(p_partkey AS BIGINT), '2007-07-07', NULL, NULL, NULL, p_size, 1.5, 'z', 'new ' || p_partkey,
       CAST(p_size + 200 AS INTEGER), '', '2021-01-01 00:00:00'
  FROM part WHERE p_partkey % 7 = 0
""")
def main_record_query(spark, sf_dir):
    """Raw text records made of parts, turned into film records; every
    seventh film was fetched a second time, with other values."""
    p = spread_rows(t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"))
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    person = lambda name, i: F.struct(name.alias("name"), F.lit(i).alias("personID"))
    raw = p.select(
        k.alias("crit_id"), F.array_compact(F.array(
            F.when(k % 3 == 0, "USA::1 January 2001").otherwise("USA::5 March 1999"), F.lit("UK::2 May 1990 (re-release)"),
            F.when(k % 4 == 0, "Netherlands::March 2002 (limited)"))).alias("releases"),
        F.array(text(F.lit("(original title)::"), F.col("p_name"), " orig"), text("World-wide::", F.col("p_name"), " ww"),
                text("USA::", F.col("p_name"), " usa")).alias("akas"),
        F.when(k % 5 > 0, text("(1,", F.lpad(size.cast("string"), 3, "0"), ")")).alias("votes"),
        F.when(k % 2 == 0, (size / 4.0).cast("string")).otherwise("n/a").alias("score"),
        F.array(F.lit("x"), F.col("p_brand"), F.lit("x")).alias("genres"), F.array(F.lit("k")).alias("keywords"),
        F.array(text("a much longer plot ", k, "::me"), text("short ", k, "::you")).alias("plots"),
        F.array(size.cast("string"), F.lit("none"), (size + 20).cast("string")).alias("runtimes"),
        F.array(person(text("Jo ", size, " Doe"), "1"), person(F.lit("Al van Dam"), "2"), person(F.lit("No Id"), "x"),
                person(text("Jo ", size, " Doe"), "1")).alias("cast"),
        F.lit("2020-01-01").cast("timestamp").alias("fetched_at"))
    again = {"crit_id": k, "releases": F.array(F.lit("Chile::7 July 2007")), "votes": size.cast("string"), "score": F.lit("1.5"),
             "genres": F.array(F.lit("z")), "plots": F.array(text("new ", k, "::me")),
             "runtimes": F.array((size + 200).cast("string")), "cast": F.array(), "fetched_at": F.lit("2021-01-01")}
    raw = raw.unionByName(p.where(k % 7 == 0).select(
        *[again.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in raw.schema.fields]))
    got = main_records(raw)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return got.select(F.col("crit_id").cast("long").alias("crit_id"), day("original_release_date"), day("dutch_release_date"),
                      "original_title", "imdb_title", "imdb_votes", r6("imdb_rating").alias("imdb_rating"),
                      F.array_join("genres", ",").alias("genres"), "plot_storyline", "runtime",
                      F.array_join(F.transform("cast", lambda x: x["canonical_name"]), "|").alias("cast_names"),
                      ts_text("imdb_main_updated").alias("imdb_main_updated"))


@register("catalogue_enrich", """
SELECT p_partkey AS crit_id, p_name AS title, CASE WHEN p_partkey % 10 > 3 THEN p_partkey END AS netflix_id,
       CASE WHEN p_partkey % 10 > 3 THEN p_name WHEN p_partkey % 2 = 0 THEN 'old' END AS netflix_title,
       round(CASE WHEN p_partkey % 10 > 3 AND p_size % 5 > 0 THEN p_retailprice WHEN p_partkey % 2 = 0 THEN 1.5 END, 6) AS netflix_rating,
       CASE WHEN p_partkey % 10 > 3 THEN '2021-02-03 00:00:00' END AS netflix_updated,
       CASE WHEN p_size % 5 = 0 THEN '2021-02-03 00:00:00' END AS genre_stamp
  FROM part
""")
def catalogue_enrich_query(spark, sf_dir):
    """Catalogue items (pages fetched twice), bridge, merge and genre stamps."""
    p = t(spark, sf_dir, "part")
    old = F.col("p_partkey") % 2 == 0
    movies = p.select(F.col("p_partkey").alias("crit_id"), F.col("p_partkey").alias("imdbid"), F.col("p_name").alias("title"),
                      F.lit(None).cast("long").alias("netflix_id"), F.when(old, "old").alias("netflix_title"),
                      F.when(old, 1.5).alias("netflix_rating"), F.lit(None).cast("timestamp").alias("netflix_updated"),
                      F.col("p_size").alias("genreid"))
    pages = _catalogue_pages(spark, sf_dir)
    films = enrich_films(movies, pages.unionByName(pages), "2021-02-03")
    genres = movies.select("genreid").distinct().withColumn("movies_updated", F.lit(None).cast("timestamp"))
    stamped = stamp_genres(genres, genres.where("genreid % 5 = 0"), "2021-02-03")
    return (films.join(stamped, "genreid", "left")
            .select("crit_id", "title", "netflix_id", "netflix_title", r6("netflix_rating").alias("netflix_rating"),
                    ts_text("netflix_updated").alias("netflix_updated"), ts_text("movies_updated").alias("genre_stamp")))


@register("film_page_nested", """
SELECT p_partkey AS crit_id, 'http://img/' || p_partkey || '.jpg?a>b' AS poster_url,
       CASE WHEN p_partkey % 3 > 0 THEN p_size END AS my_rating, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size + 2 END AS my_psi,
       CASE WHEN p_partkey % 5 > 0 THEN 'https://www.youtube.com/watch?v=t_' || p_partkey END AS trailer_url,
       CASE WHEN p_partkey % 6 > 0 THEN p_partkey END AS imdbid, round(p_size / 8.0, 6) AS crit_rating,
       CAST(p_size * 10 AS INTEGER) AS crit_votes
  FROM part
""")
def film_page_nested_query(spark, sf_dir):
    """S8 + N11: film pages whose blocks hold other blocks, with comments,
    scripts and signs in attributes that look like tags."""
    p = spread_rows(t(spark, sf_dir, "part").select("p_partkey", "p_size")).withColumn("p_size", F.col("p_size").cast("int"))
    k, size = F.col("p_partkey"), F.col("p_size")
    html = _quoted([
        "<!-- <div class=~fi_score_div~>99</div> --><script>var a = ~<div class='fi_psi_div'>98</div>~; // PSI</script>",
        "<meta title=~a > b~ itemprop=~image~ content=~http://img/", k, ".jpg?a>b~>",
        "<div class=~fi_score_div~><div class=~note~><div>96</div>97</div> ", F.when(k % 3 > 0, size.cast("string")).otherwise(F.lit("none")), " <br></div>",
        "<div class=~big fi_psi_div~><div>95</div>", F.when(k % 4 == 0, (size + 1).cast("string")).otherwise(F.lit("n/a")), "</div>",
        "Your PSI: <!-- <span>94</span> --><div><b>is</b>", F.repeat(F.lit("<i>.</i>"), 40), "<span title=~x > y~>", size + 2, "</span></div>",
        "<div id=~fi_trailer~><div><div></div></div>", F.when(k % 5 > 0, F.concat(F.lit("<div><iframe src=~https://www.youtube.com/embed/t_"), k.cast("string"),
                                                                              F.lit("~></iframe></div>"))).otherwise(F.lit("")),
        "</div><iframe src=~https://www.youtube.com/embed/advert~></iframe><p id=~fi_info_ext~><!-- <a href=~http://db/title/tt9999998/~> -->",
        F.when(k % 6 > 0, F.concat(F.lit("<a title=~</p>~ href=~http://db/title/tt"), F.lpad(k.cast("string"), 7, "0"), F.lit("/~>db</a>"))).otherwise(F.lit("")),
        "</p><a href=~http://db/title/tt9999999/~>other</a><span itemprop=~ratingValue~><i>of 10</i>", size / 8.0, "</span>",
        "<b itemprop=~reviewCount~>", size * 10, "<span> votes</span></b>"])
    got = extract_film_elements(p.select(k.alias("crit_id"), html.alias("html")))
    return got.withColumn("crit_rating", F.round("crit_rating", 6))
