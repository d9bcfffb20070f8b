"""Cases that the registered queries do not reach: payload columns, ties,
partial batches, page forms."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinoframe.functions.text import canonical_name, parse_votes, strip_author
from kinoframe.operators.lookup import dedupe_first_words, popularity_tiers
from kinoframe.operators.merge import quarantine
from kinoframe.operators.prefix import running_sum
from kinoframe.operators.quality import exact_percentiles
from kinoframe.plans.catalogue import apply_film_batch, explode_films, film_wide_export
from kinoframe.schemas import CHILD_TABLES, HEADER_COLUMNS
from kinoframe.sources.catalogue import catalogue_items, read_catalogue_json
from kinoframe.sources.pages import extract_film_list, extract_film_page


def test_running_sum_keeps_payload(spark):
    x = spark.range(300_000).select("id", (F.col("id") % 3).alias("g"), (F.xxhash64("id") % 1000).cast("double").alias("v"),
                                    F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    got = running_sum(x, "g", ["v", "id"], "v", "s", partitions=16)
    assert got.columns == ["id", "g", "v", "payload", "s"]
    w = Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    both = got.join(x.select("id", F.sum("v").over(w).alias("e")), "id")
    assert both.count() == 300_000 and both.where("s <> e").count() == 0


def test_running_sum_null_group(spark):
    x = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), ("a", 1, 5.0)], "g string, o int, v double")
    assert sorted(r["s"] for r in running_sum(x, "g", ["o"], "v", "s", 2).collect()) == [2.0, 5.0, 5.0]


def test_percentiles_of_ties_weigh_one_row(spark):
    x = spark.range(40_000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") < 30_000, 7.0)
                                   .otherwise(F.col("id").cast("double")).alias("v"))
    got = {r["g"]: r for r in exact_percentiles(x, "v", [0.1, 0.5, 0.9], ["g"]).collect()}
    e = {r["g"]: r["p"] for r in x.groupBy("g").agg(F.percentile("v", F.array(F.lit(.1), F.lit(.5), F.lit(.9))).alias("p")).collect()}
    for g in (0, 1):
        assert [got[g]["p10"], got[g]["p50"], got[g]["p90"]] == list(e[g])


def test_tiers_subtract_growing_spans(spark):
    years = [r["min_year"] for r in popularity_tiers(spark, 3, 2019).orderBy("band").collect()]
    assert years[0] == 2019 and [a - b for a, b in zip(years, years[1:])] == [2, 3, 5, 8, 13, 21, 34]


def film_tables(spark):
    person = "struct<canonical_name:string,name:string,person_id:bigint>"
    films = spark.createDataFrame(
        [(1, [("A, D", "D A", 1)], [("B, C", "C B", 2)], ["x"], {"u": {"rating": 5.0}})],
        f"crit_id int, director array<{person}>, cast array<{person}>, genres array<string>, my_ratings map<string,map<string,double>>")
    from kinoframe.plans.catalogue import _with_all_lists
    t = explode_films(_with_all_lists(films))
    types = {"crit_id": "int", "date_added": "timestamp", "year": "int"}
    t["movies"] = spark.range(1).select(*[(F.lit(1) if c == "crit_id" else F.lit(None)).cast(types.get(c, "string")).alias(c)
                                          for c in HEADER_COLUMNS])
    assert set(CHILD_TABLES) <= set(t)
    return t


def test_film_batch_replaces_roles_apart_and_folds_repeats(spark):
    person = "struct<canonical_name:string,name:string,person_id:bigint>"
    batch = spark.createDataFrame(
        [(1, "first", 1990, [("N, E", "E N", 9)], {"u": {"rating": 7.0}}, 1),
         (1, "last", None, None, {"u": {"psi": 3.0}, "w": {"rating": 1.0}}, 2),
         (2, "two", 2000, None, None, 1), (2, "two again", 2001, None, None, 2)],
        f"crit_id int, title string, year int, cast array<{person}>, my_ratings map<string,map<string,double>>, at int")
    new = apply_film_batch(film_tables(spark), batch, order=["at"])
    films = {r["crit_id"]: r for r in new["movies"].collect()}
    assert new["movies"].count() == 2 and (films[1]["title"], films[1]["year"]) == ("last", 1990)
    assert films[2]["title"] == "two again"
    people = {(r["role"], r["name"]) for r in new["persons"].collect()}
    assert people == {("director", "D A"), ("cast", "E N")}
    assert {(r["user"], r["type"]): r["score"] for r in new["ratings"].collect()} == \
        {("u", "rating"): 7.0, ("u", "psi"): 3.0, ("w", "rating"): 1.0}
    assert [r["genre"] for r in new["genres"].collect()] == ["x"]


def test_export_user_is_a_value_not_sql(spark):
    t = film_tables(spark)
    t["ratings"] = spark.createDataFrame([(1, "a\\b' OR", "rating", 7.0)], t["ratings"].select("crit_id", "user", "type", "score").schema)
    assert film_wide_export(t, "a\\b' OR").collect()[0]["rating_a\\b' OR"] == 7.0


def test_quarantine_tags_rows_without_key(spark):
    rows = spark.createDataFrame([(1,), (None,), (3,)], "k int")
    got = quarantine(rows, "k", spark.createDataFrame([(1,)], "k int"))
    assert sorted((str(r["k"]), r["reason"]) for r in got.collect()) == [("1", "ok"), ("3", "orphan"), ("None", "null_key")]


FILM = """<head><meta content={q}http://img/a&amp;b.jpg{q} itemprop={q}image{q}></head>
<div id={q}x{q} class={q}big fi_score_div{q}> 81 <</div><div class={q}fi_psi_div{q}>n/a</div>PSI<br><span a={q}b{q}>64</span>
<div id={q}fi_trailer{q}>{trailer}</div><div><iframe src={q}//www.youtube.com/embed/advert{q}></iframe></div>
<p class={q}fi_extrainfo{q} id={q}fi_info_ext{q}>{info}</p><p><a href={q}http://db/title/tt9999999/{q}>other</a></p>
<span itemprop={q}ratingValue{q}>7.25</span>"""


def test_film_pages_in_both_quote_styles(spark):
    rows = []
    for k, q in enumerate("\"'"):
        rows.append((2 * k, FILM.format(q=q, trailer=f"<iframe width=1 src={q}https://www.youtube.com/embed/aB-9_x{q}></iframe>",
                                        info=f"see <a target={q}t{q} href={q}http://db/title/tt0040797/{q}>it</a>")))
        rows.append((2 * k + 1, FILM.format(q=q, trailer="", info="nothing")))
    got = {r["id"]: r for r in extract_film_page(spark.createDataFrame(rows, "id int, html string")).collect()}
    for k in (0, 2):
        r = got[k]
        assert (r["poster_url"], r["my_rating"], r["my_psi"], r["imdbid"], r["crit_rating"], r["crit_votes"]) == \
            ("http://img/a&b.jpg", 81, 64, 40797, 7.25, 0)
        assert r["trailer_url"].endswith("aB-9_x")
        # a block without its element takes none from what follows
        assert got[k + 1]["trailer_url"] is None and got[k + 1]["imdbid"] is None


def test_film_list_items(spark):
    item = ("<li id={q}fl_titlelist_title_7{q} class={q}{q}><a href={q}http://f/7{q} title={q}Cat &amp; Mouse{q}>Cat &amp; Mouse (TV) (1999)</a>"
            "<div titleid={q}7{q} class={q}s{q}><div class={q}pti yellow{q} title={q}Probable Score{q}>55</div></div></li>")
    html = "Page 2 of 5 " + item.format(q="'") + item.format(q='"').replace("_7", "_8").replace("7\"", "8\"")
    got = {r["crit_id"]: r for r in extract_film_list(spark.createDataFrame([(html,)], "html string")).collect()}
    assert set(got) == {7, 8}
    for r in got.values():
        assert (r["title"], r["year"], r["psi"], r["rating"], r["nr_pages"]) == ("Cat & Mouse", 1999, 55, None, 5)


def test_catalogue_lines_are_all_read(spark, tmp_path):
    f = tmp_path / "pages.json"
    f.write_text("".join('{"COUNT": "3", "ITEMS": [{"netflixid": "%d"}]}\n' % k for k in range(3)))
    assert catalogue_items(read_catalogue_json(spark, str(f))).count() == 3


def test_names_votes_and_plots(spark):
    row = spark.createDataFrame([("Anna van der Berg", "12 (3,456)", "plot\nmore::me")], "n string, v string, p string")
    r = row.select(canonical_name("n").alias("n"), parse_votes("v").alias("v"), strip_author("p").alias("p")).first()
    assert (r["n"], r["v"], r["p"]) == ("van der Berg, Anna", 3456, "plot\nmore")


@pytest.mark.parametrize("hot_rows", [0, 2, 1000])
def test_words_cross_the_exchange_inside_their_texts(spark, hot_rows):
    texts = [(1, "a b a"), (1, "b c  c"), (2, ""), (None, "x y"), (None, "y"), (None, "y x"), (3, None), (4, "a.b (c a.b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = dedupe_first_words(docs, "doc_id", "text", " ", hot_rows=hot_rows)
    want: dict = {}
    for doc, text in texts:
        for pos, word in enumerate(text.split(" ") if text is not None else [], 1):
            want[doc, word] = min(pos, want.get((doc, word), pos))
    assert sorted((r.doc_id or 0, r.word, r.first_pos) for r in got.collect()) == sorted((d or 0, w, p) for (d, w), p in want.items())


def test_only_hot_keys_words_are_exchanged_one_by_one(spark):
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    plan = dedupe_first_words(docs, "doc_id", "text", " ")._jdf.queryExecution().executedPlan().toString()
    first = plan.split("posexplode")[0]
    assert first.count("HashAggregate(keys=[doc_id") == 2 and "Exchange" not in first
