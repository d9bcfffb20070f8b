"""The film instance: wide export, nested records, batch apply, checks."""

import datetime as dt

from pyspark.sql import functions as F

from kinoframe.plans.catalogue import apply_film_batch, assemble_films, check_tables, explode_films, film_wide_export
from kinoframe.schemas import SCHEMAS
from kinoframe.sources.tables import align_schema

D = dt.datetime(2018, 1, 1)


def tables(spark):
    def mk(name, rows, cols):
        df = spark.createDataFrame(rows, cols)
        return align_schema(df, SCHEMAS[name]).select(*SCHEMAS[name].fieldNames())
    return {
        "movies": mk("movies", [(1234, 10.0, "u1", "The Matrix", 1999, 133093, D),
                                (49141, 1.0, "u2", "Other", 2010, None, D)],
                     "crit_id int, crit_popularity double, crit_url string, title string, year int, imdbid long, "
                     "date_added timestamp"),
        "languages": mk("languages", [(1234, "English", 1), (1234, "French", 2), (49141, "English", 1)],
                        "crit_id int, language string, rank int"),
        "persons": mk("persons", [
            (1234, "director", "Lana Wachowski", 2, "Wachowski, Lana", 905152),
            (1234, "cast", "Keanu Reeves", 1, "Reeves, Keanu", 206),
            (1234, "cast", "Extra Six", 6, "Six, Extra", 6),
            (1234, "director", "Lilly Wachowski", 1, "Wachowski, Lilly", 905154),
            (1234, "cast", "Laurence Fishburne", 2, "Fishburne, Laurence", 401),
            (49141, "cast", "Some One", 1, "One, Some", 1)],
            "crit_id int, role string, name string, rank int, canonical_name string, person_id long"),
        "genres": mk("genres", [(1234, "Sci-Fi"), (1234, "Action")], "crit_id int, genre string"),
        "countries": mk("countries", [(1234, "USA", 1)], "crit_id int, country string, rank int"),
        "keywords": mk("keywords", [], "crit_id int, keyword string"),
        "taglines": mk("taglines", [(1234, "Free your mind", 1)], "crit_id int, tagline string, rank int"),
        "vote_details": mk("vote_details", [(1234, "aged 18-29", 1000, 8.5)],
                           "crit_id int, demographic string, votes int, rating double"),
        "ratings": mk("ratings", [(1234, "ann", "rating", 90.0), (1234, "ann", "psi", 80.0)],
                      "crit_id int, user string, type string, score double"),
    }


def test_wide_export(spark):
    rows = {r["crit_id"]: r for r in film_wide_export(tables(spark), "ann").collect()}
    m = rows[1234]
    assert m["actors"] == "Keanu Reeves / Laurence Fishburne"  # rank 6 excluded
    assert m["directors"] == "Lilly Wachowski / Lana Wachowski"
    assert m["genres"] == "Action / Sci-Fi" and m["languages"] == "English / French"
    assert m["rating_ann"] == 90.0 and m["pred_score_ann"] is None
    assert rows[49141]["genres"] is None and rows[49141]["writers"] is None
    assert len(film_wide_export(tables(spark), "ann").columns) == 52


def test_roundtrip(spark):
    t = tables(spark)
    # ranks are list positions after a round trip: keep contiguous ranks
    t["persons"] = t["persons"].filter("rank <= 2")
    films = assemble_films(t)
    back = explode_films(films)
    for name in ["persons", "languages", "genres", "countries", "taglines", "vote_details", "ratings"]:
        a = sorted(map(tuple, t[name].select(*sorted(t[name].columns)).collect()), key=str)
        b = sorted(map(tuple, back[name].select(*sorted(t[name].columns)).collect()), key=str)
        assert a == b, name


def test_apply_batch(spark):
    t = tables(spark)
    batch = spark.createDataFrame(
        [(1234, None, 2000, ["Dutch"], {"ann": {"psi": 60.0, "pred_score": 1.0}}, dt.datetime(2019, 1, 1)),
         (None, "no key", 1990, ["Xx"], None, None)],
        "crit_id int, title string, year int, languages array<string>, "
        "my_ratings map<string,map<string,double>>, date_added timestamp")
    new = apply_film_batch(t, batch)
    m = new["movies"].filter("crit_id = 1234").first()
    assert (m["title"], m["year"], m["date_added"]) == ("The Matrix", 2000, D)
    langs = sorted((r["crit_id"], r["language"]) for r in new["languages"].collect())
    assert langs == [(1234, "Dutch"), (49141, "English")]
    scores = {r["type"]: r["score"] for r in new["ratings"].collect()}
    assert scores == {"rating": 90.0, "psi": 60.0, "pred_score": 1.0}
    assert new["persons"].count() == t["persons"].count()  # not supplied: untouched


def test_checks(spark):
    t = tables(spark)
    t["genres"] = t["genres"].unionByName(spark.createDataFrame([(1234, "Action"), (7, "X")], "crit_id int, genre string"))
    res = {(r["table"], r["check"]): r["n"] for r in check_tables(t).collect()}
    assert res[("genres", "duplicate_key")] == 1 and res[("genres", "orphan")] == 1
    assert res[("movies", "duplicate_key")] == 0


def test_role_filter_reaches_the_scan(spark):
    from kinoframe.session import work_path
    t = tables(spark)
    path = work_path(spark, "persons-scan")
    t["persons"].write.parquet(path)
    t["persons"] = spark.read.parquet(path)
    plan = film_wide_export(t, "ann")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan or "PushedFilters: [IsNotNull(crit_id), Or(" in plan, plan
