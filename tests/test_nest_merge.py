"""Nest / unnest / merge on the film fixture rows, plus properties."""

import datetime as dt

from pyspark.sql import functions as F

from kinoframe.operators.merge import (fold_log, merge_entries, merge_null_safe, quarantine,
                                       replace_children)
from kinoframe.operators.nest import (attach, nest_by_role, nest_list, nest_map2, nest_values, unnest_list,
                                      unnest_map2, unnest_roles)
from kinoframe.operators.quality import check_unique, find_orphans

PERSONS = [  # stored out of rank order
    (1234, "director", "Lana Wachowski", 2, "Wachowski, Lana", 905152),
    (1234, "cast", "Keanu Reeves", 1, "Reeves, Keanu", 206),
    (1234, "director", "Lilly Wachowski", 1, "Wachowski, Lilly", 905154),
    (1234, "cast", "Laurence Fishburne", 2, "Fishburne, Laurence", 401),
    (49141, "cast", "Someone", 1, "Someone", 1),
    (49141, "director", "Other", 1, "Other", 2),
]
P_SCHEMA = "crit_id int, role string, name string, rank int, canonical_name string, person_id long"


def test_nest_in_rank_order_and_roundtrip(spark):
    p = spark.createDataFrame(PERSONS, P_SCHEMA)
    nested = nest_by_role(p, "crit_id", "role", {"cast": "cast", "director": "director", "writer": "writer"},
                          ["canonical_name", "name", "person_id"], order=["rank"])
    rec = {r["crit_id"]: r for r in nested.collect()}
    assert [x["name"] for x in rec[1234]["director"]] == ["Lilly Wachowski", "Lana Wachowski"]
    assert [x["name"] for x in rec[1234]["cast"]] == ["Keanu Reeves", "Laurence Fishburne"]
    assert rec[1234]["writer"] is None  # missing child list stays NULL
    back = unnest_roles(nested, "crit_id", {"cast": "cast", "director": "director", "writer": "writer"})
    assert sorted(map(tuple, back.select("crit_id", "role", "name", "rank", "canonical_name", "person_id")
                      .collect())) == sorted(PERSONS)


def test_languages_sorted_rank_and_empty_lists(spark):
    df = spark.createDataFrame([(1234, ["French", "English"]), (49141, []), (5, None)], "crit_id int, langs array<string>")
    out = unnest_list(df, "crit_id", "langs", sort=True, value="language").collect()
    assert [(r["crit_id"], r["language"], r["rank"]) for r in out] == [(1234, "English", 1), (1234, "French", 2)]


def test_ratings_map_roundtrip(spark):
    rows = [(1, "ann", "rating", 80.0), (1, "ann", "psi", 70.0), (1, "bob", "rating", 50.0), (2, "ann", "psi", None)]
    df = spark.createDataFrame(rows, "crit_id int, user string, type string, score double")
    m = nest_map2(df, "crit_id", "user", "type", "score", alias="my_ratings")
    rec = {r["crit_id"]: r["my_ratings"] for r in m.collect()}
    assert rec[1] == {"ann": {"rating": 80.0, "psi": 70.0}, "bob": {"rating": 50.0}}
    back = unnest_map2(m, "crit_id", "my_ratings", "user", "type", "score")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    hdr = spark.createDataFrame([(1,), (3,)], "crit_id int")
    att = {r["crit_id"]: r["my_ratings"] for r in attach(hdr, "crit_id", [m], empty_map_cols=["my_ratings"]).collect()}
    assert att[3] == {}


def test_partial_update_keeps_columns(spark):
    old = spark.createDataFrame([(1234, "The Matrix", 1999, 10.0, dt.datetime(2018, 1, 1))],
                                "crit_id int, title string, year int, pop double, date_added timestamp")
    new = spark.createDataFrame([(1234, None, 2000, None, dt.datetime(2019, 1, 1)), (7, "New", 2001, 1.0, None)],
                                "crit_id int, title string, year int, pop double, date_added timestamp")
    m = {r["crit_id"]: r for r in merge_null_safe(old, new, "crit_id", keep_first=["date_added"]).collect()}
    assert (m[1234]["title"], m[1234]["year"], m[1234]["pop"]) == ("The Matrix", 2000, 10.0)
    assert m[1234]["date_added"] == dt.datetime(2018, 1, 1)
    assert m[7]["title"] == "New"
    # keys that repeat in a batch are folded, the latest value of each column wins
    twice = new.unionByName(spark.createDataFrame([(7, "Newer", None, None, None), (None, "no key", 1, None, None)],
                                                  new.schema))
    f = merge_null_safe(old, twice, "crit_id", keep_first=["date_added"], order=[]).collect()
    assert [(r["title"], r["year"]) for r in f if r["crit_id"] == 7] == [("Newer", 2001)]
    assert [r["title"] for r in f if r["crit_id"] is None] == ["no key"]
    # idempotent: applying the same batch twice changes nothing
    once = merge_null_safe(old, new, "crit_id", keep_first=["date_added"])
    twice = merge_null_safe(once, new, "crit_id", keep_first=["date_added"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_replace_children_only_touched_keys(spark):
    langs = spark.createDataFrame([(1234, "English", 1), (1234, "French", 2), (49141, "English", 1)],
                                  "crit_id int, language string, rank int")
    new = spark.createDataFrame([(1234, "Dutch", 1)], "crit_id int, language string, rank int")
    out = sorted(map(tuple, replace_children(langs, new, "crit_id").collect()))
    assert out == [(1234, "Dutch", 1), (49141, "English", 1)]
    empty = spark.createDataFrame([], "crit_id int, language string, rank int")
    assert replace_children(langs, empty, "crit_id").count() == 3  # an empty batch deletes nothing
    touched = spark.createDataFrame([(49141,)], "crit_id int")
    assert replace_children(langs, empty, "crit_id", touched=touched, clear_empty=True).count() == 2


def test_fold_equals_sequential_merges(spark):
    log = [(1, 1, "a", None), (1, 2, None, 5), (1, 3, "c", None), (2, 1, None, None), (1, 0, "z", 9)]
    df = spark.createDataFrame(log, "k int, ts int, s string, n int")
    folded = {r["k"]: (r["s"], r["n"]) for r in fold_log(df, "k", ["ts"], ["s", "n"]).collect()}
    cur = None
    for ts in sorted({r[1] for r in log}):
        batch = df.filter(F.col("ts") == ts).select("k", "s", "n")
        cur = batch if cur is None else merge_null_safe(cur, batch, "k")
    seq = {r["k"]: (r["s"], r["n"]) for r in cur.collect()}
    assert folded == seq == {1: ("c", 5), 2: (None, None)}


def test_merge_entries_null_replaces(spark):
    old = spark.createDataFrame([(1, "ann", "rating", 80.0), (1, "ann", "psi", 70.0)],
                                "crit_id int, user string, type string, score double")
    new = spark.createDataFrame([(1, "ann", "psi", None), (1, "ann", "pred_score", 3.0)],
                                "crit_id int, user string, type string, score double")
    got = {(r["type"]): r["score"] for r in merge_entries(old, new, ["crit_id", "user", "type"]).collect()}
    assert got == {"rating": 80.0, "psi": None, "pred_score": 3.0}


def test_quality_jobs(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 3)], "a int, b int")
    assert [tuple(r) for r in check_unique(df, ["a", "b"]).collect()] == [(1, 1, 2)]
    parent = spark.createDataFrame([(1,)], "a int")
    assert find_orphans(df, parent, "a").count() == 1  # NULL key has no parent
    tags = sorted(r["reason"] for r in quarantine(df, "a", parent, "a").collect())
    assert tags == ["null_key", "ok", "ok", "ok"]


def test_partition_count_independent(spark):
    df = spark.range(0, 2000).select((F.col("id") % 37).alias("k"), F.col("id").alias("r"),
                                     F.col("id").cast("string").alias("v"))
    a = nest_values(df.repartition(1), "k", "v", order=["r"]).collect()
    b = nest_values(df.repartition(13), "k", "v", order=["r"]).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_export_independent_of_partitioning(spark):
    from kinoframe.operators.export import ChildPart, CondAvg, ListAgg, wide_export
    child = spark.range(0, 3000).select((F.col("id") % 97).alias("k"), (F.col("id") % 5).alias("rank"),
                                        F.col("id").cast("string").alias("v"), (F.col("id") % 3).alias("x"))
    header = spark.range(0, 100).select(F.col("id").alias("k"))
    def run(n):
        part = ChildPart(child.repartition(n), [ListAgg("vs", "v", ["rank"], "rank <= 2"), CondAvg("ax", "x", "rank = 1")])
        return sorted(map(tuple, wide_export(header.repartition(n), "k", [part]).collect()), key=str)
    assert run(1) == run(11)


def test_exact_percentiles_match_numpy(spark):
    import numpy as np
    from kinoframe.operators.quality import percentiles
    rng = np.random.default_rng(3)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 4, 3000), rng.integers(0, 50, 3000) / 4)]
    rows += [(9, 1.0)]  # a single-row group
    df = spark.createDataFrame(rows, "g int, v double")
    for method in ("sorted", "map"):
        got = {r["g"]: (r["p10"], r["p50"], r["p90"]) for r in percentiles(df, "v", method=method, by=["g"]).collect()}
        for g in set(x[0] for x in rows):
            vals = [v for gg, v in rows if gg == g]
            assert got[g] == tuple(float(np.percentile(vals, q)) for q in (10, 50, 90)), (method, g)
