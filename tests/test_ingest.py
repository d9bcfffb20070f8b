"""Sources and lookups: catalogue JSON, genre pages, offers, pages, tiers,
stale order, bridge, tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kinoframe.operators.lookup import (NotFound, bridge, bridge_sets, exclude_blocked, get_one,
                                        popularity_tiers, recent_first, stale_first, tier_select)
from kinoframe.session import work_path
from kinoframe.sources.catalogue import (GENRE_PAGE_SCHEMA, catalogue_items, clean_catalogue_items,
                                         genre_page_index, offers_info, ratings_link, read_catalogue_json)
from kinoframe.sources.pages import extract_film_list, extract_film_page
from kinoframe.sources.tables import TableStore, add_columns, align_schema, create_table, to_storage


def test_catalogue_items(spark, tmp_path):
    page = {"COUNT": "3", "ITEMS": [
        {"netflixid": "501", "title": "Red Kite", "rating": "2.5", "imdbid": "tt0000321"},
        {"netflixid": "502", "title": "Blue Kite", "rating": "", "imdbid": "tt0000321"},
        {"netflixid": "503", "title": "No Kite", "rating": "1", "imdbid": "notfound"}]}
    path = tmp_path / "page.json"
    path.write_text(json.dumps(page))
    items = clean_catalogue_items(catalogue_items(read_catalogue_json(spark, str(path)))).collect()
    assert [(r["netflix_id"], r["netflix_rating"], r["imdbid"]) for r in items] == [
        (501, 2.5, 321), (502, None, 321)]


def test_genre_page_inversion(spark):
    doc = json.dumps({"ITEMS": [{"All Action": [4, 2, 1]}, {"All Anime": [2, 3]}]})
    pages = spark.createDataFrame([(doc,)], "j string").select(F.from_json("j", GENRE_PAGE_SCHEMA).alias("p")) \
                 .select("p.*")
    got = {r["genreid"]: r["genre_names"] for r in genre_page_index(pages).collect()}
    assert got == {1: ["All Action"], 2: ["All Action", "All Anime"], 3: ["All Anime"], 4: ["All Action"]}


def test_offers_and_ratings_link(spark):
    docs = [json.dumps({"Movies": [{"GroupId": "12", "Torrents": [{"Quality": "Standard Definition"},
                                                                 {"Quality": "High Definition"}]}]}),
            json.dumps({"Movies": []}),
            json.dumps({"Movies": [{"GroupId": "13", "Torrents": [{"Quality": "Standard Definition"}]}]})]
    got = [(r["ptp_url"], r["ptp_hd_available"]) for r in
           offers_info(spark.createDataFrame([(d,) for d in docs], "j string"), "j").collect()]
    assert got == [("https://passthepopcorn.me/torrents.php?id=12", True), (None, False),
                   ("https://passthepopcorn.me/torrents.php?id=13", False)]
    answers = [json.dumps({"Response": "True", "tomatoURL": "http://rt/x"}), json.dumps({"Response": "False"}),
               json.dumps({"Response": "True", "tomatoURL": ""})]
    got = [(r["status"], r["tomato_url"]) for r in
           ratings_link(spark.createDataFrame([(a,) for a in answers], "j string"), "j").collect()]
    assert got == [("ok", "http://rt/x"), ("invalid", None), ("ok", None)]


LIST_PAGE = """<div id="fl_nav_pagenums_page">Page 1 of 3</div><ul class="fl_titlelist">
<li class="fl_titlelist_title" id="fl_titlelist_title_26496">
 <div class="fl_name"><a title="Film A" href="https://example.test/film/A/">Film A (Part 2) (2008)</a></div>
 <div class="fl_titlelist_rating" titleid="26496"><div class="pti">55</div></div></li>
<li class="fl_titlelist_title_ranked" id="fl_titlelist_title_66059">
 <div class="fl_name"><a title="Film B" href="https://example.test/film/B/">Film B (2011) (TV)</a></div>
 <div class="fl_titlelist_score" titleid="66059"><div class="fl_score green" title="Your Ranking">61</div></div></li>
<li class="fl_titlelist_title" id="fl_titlelist_title_999">
 <div class="fl_name"><a title="Film C" href="https://example.test/film/C/">Film C (1999)</a></div>
 <div class="fl_titlelist_rating" titleid="999"></div></li></ul>"""


def test_film_list_page(spark):
    df = spark.createDataFrame([(1, 8, LIST_PAGE)], "page int, pop int, html string")
    blocked = spark.createDataFrame([(999,)], "crit_id int")
    rows = extract_film_list(df, page="page", popularity="pop", blocked=blocked).orderBy("crit_id").collect()
    assert [(r["crit_id"], r["title"], r["year"], r["psi"], r["rating"]) for r in rows] == [
        (26496, "Film A", 2008, 55, None), (66059, "Film B", 2011, None, 61)]
    assert rows[0]["nr_pages"] == 3 and rows[0]["crit_popularity"] == 8.0


FILM_PAGE = """<meta itemprop="image" content="https://img.test/p.jpg">
<div class="fi_score_div">75</div><p class="fi_extrainfo">PSI <span>60</span></p>
<div id="fi_trailer"><iframe src="https://www.youtube.com/embed/abc123"></iframe></div>
<p class="fi_extrainfo" id="fi_info_ext"><a href="http://www.imdb.com/title/tt0133093/">IMDb</a></p>
<span itemprop="ratingValue">7.9</span>"""


def test_film_page(spark):
    r = extract_film_page(spark.createDataFrame([(1, FILM_PAGE)], "id int, html string")).first()
    assert (r["poster_url"], r["my_rating"], r["my_psi"], r["imdbid"], r["crit_rating"], r["crit_votes"]) == (
        "https://img.test/p.jpg", 75, 60, 133093, 7.9, 0)
    assert r["trailer_url"] == "https://www.youtube.com/watch?v=abc123"


def test_tiers(spark):
    got = {r["band"]: r["min_year"] for r in popularity_tiers(spark, 8, 2018).collect()}
    assert got == {8: 2018, 9: 2016, 10: 2013}
    films = spark.createDataFrame([(1, 9, 2015), (2, 9, 2016), (3, 10, 2013), (4, 7, 2020)], "id int, band int, year int")
    assert sorted(r["id"] for r in tier_select(films, "band", "year", popularity_tiers(spark, 8, 2018)).collect()) == [2, 3]


def test_stale_order(spark):
    g = spark.createDataFrame([(1, dt.datetime(2018, 3, 28)), (2, dt.datetime(2018, 3, 20)), (3, None),
                               (4, dt.datetime(2018, 3, 17))], "genreid int, movies_updated timestamp")
    assert [r["genreid"] for r in stale_first(g, "genreid", "movies_updated", "2018-04-01").collect()] == [3, 4, 2]


def test_recent_first_and_lookup(spark):
    df = spark.createDataFrame([(i, dt.datetime(2018, 1, 1 + i), None) for i in range(15)] + [(99, None, None)],
                               "crit_id int, a timestamp, b timestamp")
    assert [r["crit_id"] for r in recent_first(df, "crit_id", ["a", "b"]).collect()] == list(range(14, 4, -1))
    assert get_one(df, "crit_id", 3).count() == 1
    with pytest.raises(NotFound):
        get_one(df, "crit_id", 1000)


def test_bridge(spark):
    m = spark.createDataFrame([(1, 101), (2, 102), (3, 102), (4, None)], "crit_id int, imdbid long")
    sets = {r["imdbid"]: r["crit_ids"] for r in bridge_sets(m, "imdbid", "crit_id").collect()}
    assert sets == {101: [1], 102: [2, 3]}
    items = spark.createDataFrame([(101, "a"), (102, "b"), (103, "c")], "imdbid long, t string")
    assert sorted((r["t"], r["crit_id"]) for r in bridge(items, m, "imdbid", "crit_id").collect()) == [
        ("a", 1), ("b", 2), ("b", 3)]
    assert exclude_blocked(items, "imdbid", spark.createDataFrame([(103,)], "imdbid long")).count() == 2


def test_tables(spark):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("crit_id", T.IntegerType()), T.StructField("title", T.StringType()),
                           T.StructField("year", T.IntegerType())])
    store = TableStore(spark, work_path(spark, "test-tables"))
    with pytest.raises(ValueError):
        create_table(spark, store, "movies", schema, keys=[])
    assert create_table(spark, store, "movies", schema, keys=["crit_id"]).count() == 0
    store.write("movies", spark.createDataFrame([(1, "Amélie", 2001)], schema))
    old = spark.createDataFrame([(1, "x")], "crit_id int, extra string")
    assert align_schema(old, schema).columns == ["crit_id", "title", "year", "extra"]
    assert add_columns(old, {"a": "int"}, first=True).columns == ["a", "crit_id", "extra"]
    assert add_columns(old, {"a": "int"}, after="crit_id").columns == ["crit_id", "a", "extra"]
    assert add_columns(old, {"crit_id": "int"}).columns == ["crit_id", "extra"]
    with pytest.raises(ValueError):
        add_columns(old, {"a": "int"}, after="crit_id", first=True)
    assert store.read("movies").first()["title"] == "Amélie"
    from kinoframe.sources.tables import migrate
    wider = T.StructType(schema.fields + [T.StructField("runtime", T.IntegerType())])
    assert migrate(store, {"movies": wider}) == ["movies"] and migrate(store, {"movies": wider}) == []
    assert store.read("movies").columns == ["crit_id", "title", "year", "runtime"]
    ts = spark.createDataFrame([(dt.datetime(2018, 1, 1, 12),)], "t timestamp")
    assert to_storage(ts).first()["t"] == "2018-01-01T12:00:00Z"
    from kinoframe.sources.tables import from_storage
    legacy = spark.createDataFrame([("1", "2018-01-01T00:00:00+01:00", 1)], "crit_id string, date_added string, hd int")
    back = from_storage(legacy, T.StructType([T.StructField("crit_id", T.IntegerType()),
                                              T.StructField("date_added", T.TimestampType()),
                                              T.StructField("hd", T.BooleanType())])).first()
    assert (back["crit_id"], back["date_added"], back["hd"]) == (1, dt.datetime(2017, 12, 31, 23, 0), True)
