"""Normalisation expressions on invented records."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinoframe.functions.dates import fractional_year
from kinoframe.functions.text import (canonical_name, parse_aka, parse_release, parse_votes, people_list, person_record,
                                      strip_author)
from kinoframe.operators.priority import (median_int, median_of, pick_release_dates, pick_titles, release_dates_of, shortest_of,
                                          shortest_text, titles_of)
from kinoframe.plans.raw_records import main_records


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col(schema.split()[0])).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,country,date,tags", [
    ("New Atlantis::17 May 2011", "New Atlantis", dt.datetime(2011, 5, 17), None),
    ("Utopia::November 1984 (re-release)", "Utopia", dt.datetime(1984, 11, 1), ["re-release"]),
    ("Erewhon::30 January 1956 (Old Town)\n (late show)", "Erewhon", dt.datetime(1956, 1, 30), ["Old Town", "late show"]),
    ("Ruritania::8 December 1937 (Strelsau, Castle)\n (gala)", "Ruritania", dt.datetime(1937, 12, 8), ["Strelsau, Castle", "gala"]),
    ("Laputa::1926", "Laputa", dt.datetime(1926, 1, 1), None),
    ("Laputa::1926 (one)\n (two)\n (three)", "Laputa", dt.datetime(1926, 1, 1), ["two", "three"]),
])
def test_parse_release(spark, raw, country, date, tags):
    r = one(spark, parse_release, raw)
    assert r["country"] == country
    assert r["date"] == date
    assert r["tags"] == tags


def release(country, day, *tags):
    return f"{country}::{day:%-d %B %Y}" + "\n".join(f" ({t})" for t in tags)


D = [dt.datetime(1950, 6, 1) + dt.timedelta(days=k) for k in range(9)]
HOME = "Netherlands"   # fixed value: the country whose own date is kept
# (releases, earliest date, earliest date at home): a plain release goes before a limited one, that before any other;
# a re-release never counts
RELEASE_SETS = [
    ([release("Utopia", D[0], "gala"), release("Utopia", D[2], "limited"), release("Erewhon", D[5])], D[5], None),
    ([release("Utopia", D[3], "gala"), release("Laputa", D[4], "limited"), release(HOME, D[1], "gala")], D[4], D[1]),
    ([release(HOME, D[7]), release(HOME, D[6], "gala"), release("Utopia", D[8])], D[7], D[7]),
    ([release(HOME, D[0], "gala"), release(HOME, D[4], "limited"), release("Laputa", D[2])], D[2], D[4]),
    ([release(HOME, D[1], "re-release"), release("Utopia", D[6]), release("Utopia", D[8])], D[6], None),
    ([release("Laputa", D[3], "gala"), release("Erewhon", D[2], "Old Town")], D[2], None),
]


def test_release_priority(spark):
    rows = [(i, s) for i, (lst, _, _) in enumerate(RELEASE_SETS) for s in lst]
    df = spark.createDataFrame(rows, "film int, raw string").select("film", parse_release("raw").alias("r"))
    got = {r["film"]: r for r in pick_release_dates(df.select("film", "r.*"), "film").collect()}
    for i, (_, orig, local) in enumerate(RELEASE_SETS):
        assert got[i]["original_release_date"] == orig
        assert got[i]["local_release_date"] == local


def test_release_none_gives_no_row(spark):
    df = spark.createDataFrame([(1, None)], "film int, raw string").select("film", parse_release("raw").alias("r"))
    assert df.first()["r"] is None


@pytest.mark.parametrize("raw,expect", [
    ("Utopia::Red Kite", ("Utopia", None, "Red Kite")),
    ("Laputa (Laputan title)::Kite Ed", ("Laputa", "Laputan title", "Kite Ed")),
    ("New Atlantis (tv title)::Kite", ("New Atlantis", "tv title", "Kite")),
    ("Erewhon (tv title) (English title)::The Kite", ("Erewhon", "English title", "The Kite")),
    ("(original title)::Rode Vlieger", ("", "original title", "Rode Vlieger")),
])
def test_parse_aka(spark, raw, expect):
    r = one(spark, parse_aka, raw)
    assert (r["country"], r["tag"], r["title"]) == expect


# (titles, English title, original title): the four classes in turn, least title first; none without an original
TITLE_SETS = [
    (["Utopia::Kite", "Laputa (English title)::The Kite", "World-wide::A Kite"], None, None),
    (["(original title)::Vlieger", "USA::Kite 4", "Laputa (English title)::Kite 3", "World-wide::Kite 2",
      "World-wide (English title)::Kite 1"], "Kite 1", "Vlieger"),
    (["(original title)::Vlieger", "USA::A", "Laputa (English title)::B", "World-wide::D", "World-wide::C"], "C", "Vlieger"),
    (["(original title)::Zeppelin", "(original title)::Vlieger", "USA::A", "Laputa (tv title) (English title)::B"], "B", "Vlieger"),
    (["(original title)::Vlieger", "USA::Kite", "Laputa (Laputan title)::Etik"], "Kite", "Vlieger"),
    (["(original title)::Vlieger", "Utopia::Kite"], None, "Vlieger"),
]


def test_title_priority(spark):
    rows = [(i, s) for i, (lst, _, _) in enumerate(TITLE_SETS) for s in lst]
    df = spark.createDataFrame(rows, "film int, raw string").select("film", parse_aka("raw").alias("a"))
    got = {r["film"]: r for r in pick_titles(df.select("film", "a.*"), "film").collect()}
    for i, (_, eng, orig) in enumerate(TITLE_SETS):
        assert (got[i]["english_title"], got[i]["original_title"]) == (eng, orig)


def test_picks_from_lists_equal_picks_over_rows(spark):
    releases = spark.createDataFrame([(lst,) for lst, _, _ in RELEASE_SETS] + [([],), (None,)], "r array<string>")
    dates = releases.select(F.transform("r", parse_release).alias("p")).select(*release_dates_of("p")).collect()
    assert [tuple(r) for r in dates] == [(o, h) for _, o, h in RELEASE_SETS] + [(None, None)] * 2
    akas = spark.createDataFrame([(lst,) for lst, _, _ in TITLE_SETS] + [([],), (None,)], "a array<string>")
    titles = akas.select(F.transform("a", parse_aka).alias("p")).select(*titles_of("p")).collect()
    assert [tuple(r) for r in titles] == [(o, e) for _, e, o in TITLE_SETS] + [(None, None)] * 2
    lists = spark.createDataFrame([(["bb", "aa", "ccc", None], [2, 3]), ([None], [3, None, 4]), ([], []), (None, None), (["x"], [9, 1, 7])],
                                  "t array<string>, n array<int>")
    got = lists.select(shortest_of(F.col("t")), median_of(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("bb", 2), (None, 4), (None, None), (None, None), ("x", 7)]


def test_main_records_of_a_film_that_was_fetched_twice(spark):
    raw = spark.createDataFrame(
        [(1, ["Utopia::1 June 1990"], ["(original title)::A"], ["p::x"], ["100"], "7", "1.0", ["g"], ["k"], dt.datetime(2020, 1, 1)),
         (1, ["Utopia::1 June 2001"], ["(original title)::B"], ["q::x"], ["200"], "8", None, ["h"], None, dt.datetime(2021, 1, 1)),
         (2, None, None, None, None, None, None, None, None, None)],
        "crit_id int, releases array<string>, akas array<string>, plots array<string>, runtimes array<string>, votes string, "
        "score string, genres array<string>, keywords array<string>, fetched_at timestamp")
    records = main_records(raw)
    assert "Exchange" not in records._jdf.queryExecution().executedPlan().toString()
    got = [(r["crit_id"], r["original_release_date"], r["original_title"], r["plot_storyline"], r["runtime"], r["imdb_votes"])
           for r in records.collect()]
    assert got == [(1, dt.datetime(1990, 6, 1), "A", "p", 100, 7), (1, dt.datetime(2001, 6, 1), "B", "q", 200, 8),
                   (2, None, None, None, None, None)]


@pytest.mark.parametrize("raw,expect", [(None, None), ("71", 71), ("(9,810,442)", 9810442), ("9,810)", None), ("many", None)])
def test_parse_votes(spark, raw, expect):
    assert one(spark, parse_votes, raw) == expect


def test_person_and_dedupe(spark):
    r = one(spark, person_record, ("Ada Lovelace", "1234"), "p struct<name:string,personID:string>")
    assert r.asDict() == {"canonical_name": "Lovelace, Ada", "name": "Ada Lovelace", "person_id": 1234}
    people = [("Lovelace, Ada", "1"), ("A B", "x"), ("Ada Lovelace", "1"), ("C D", "2")]
    lst = one(spark, people_list, people, "p array<struct<name:string,personID:string>>")
    assert [p["name"] for p in lst] == ["Ada Lovelace", "C D"]  # unparseable dropped, first kept


def test_strip_author(spark):
    assert one(spark, strip_author, "A kite is lost::J. Doe") == "A kite is lost"
    assert one(spark, strip_author, "A kite is lost") == "A kite is lost"
    assert one(spark, strip_author, "Two\nlines::someone") == "Two\nlines"


def test_fractional_year(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 7, 1), 2017, 2016), (None, 2017, 2016), (None, None, 2016)],
                               "r timestamp, iy int, y int")
    got = [r[0] for r in df.select(fractional_year("r", "iy", "y")).collect()]
    assert got == pytest.approx([2018.5, 2017.5, 2016.5], abs=0.01)


def test_shortest_and_median(spark):
    df = spark.createDataFrame([(1, "bb", 0), (1, "aa", 1), (1, "ccc", 2), (2, None, 0)], "k int, t string, p int")
    assert {r["k"]: r["t"] for r in shortest_text(df, "k", "t", "p").collect()} == {1: "bb"}
    m = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 4), (3, 1)], "k int, v int")
    assert {r["k"]: r["v"] for r in median_int(m, "k", "v").collect()} == {1: 2, 2: 4, 3: 1}


def test_humanized_age(spark):
    from kinoframe.functions.dates import humanized_age
    as_of = dt.datetime(2018, 4, 1)
    cases = [(None, "Not updated before"), (as_of - dt.timedelta(seconds=5), "just now"),
             (as_of - dt.timedelta(seconds=30), "30 seconds ago"), (as_of - dt.timedelta(minutes=1), "a minute ago"),
             (as_of - dt.timedelta(hours=3), "3 hours ago"), (as_of - dt.timedelta(days=1), "a day ago"),
             (as_of - dt.timedelta(days=4), "4 days ago"), (as_of - dt.timedelta(days=400), "a year ago"),
             (as_of - dt.timedelta(days=1000), "2 years ago")]
    df = spark.createDataFrame([(c,) for c, _ in cases], "t timestamp")
    got = [r[0] for r in df.select(humanized_age(F.col("t"), as_of)).collect()]
    assert got == [e for _, e in cases]


def test_a_text_is_parsed_once_however_often_its_parts_are_used(spark):
    got = spark.createDataFrame([("USA::5 March 1999 (limited) (a) (b)", "Jo van Dam")], "r string, n string")
    parsed = got.select(parse_release("r").alias("r"), canonical_name("n").alias("n"))
    plan = parsed._jdf.queryExecution().analyzed().toString()
    # country, date and rest of a release, its tags; first and last name
    assert plan.count("regexp_extract(") + plan.count("regexp_extract_all(") <= 8 and plan.count("regexp_replace(") == 1
    row = parsed.first()
    assert row["n"] == "van Dam, Jo" and row["r"]["tags"] == ["a", "b"] and row["r"]["date"].year == 1999
