"""The bucketed batch store: pruned merges, one commit point, replays."""

import random

import pytest
from pyspark.sql import functions as F

from kinoframe.analogs.a_batches import PEOPLE
from kinoframe.operators.merge import merge_null_safe
from kinoframe.plans.catalogue import KEY, apply_film_batch
from kinoframe.plans.film_batches import FILM_TABLES, film_store, merge_film_batch
from kinoframe.schemas import SCHEMAS
from kinoframe.sources.batches import BatchStore
from kinoframe.sources.key_filters import _maybe_stored, check_batch, filter_pages, read_filters, write_filters
from kinoframe.sources.sketches import sketch_writer, statistics
from kinoframe.streaming.seen import drop_seen, seen_store

BATCH = (f"crit_id int, at int, title string, year int, cast {PEOPLE}, genres array<string>, "
         "vote_details map<string,struct<rating:double,votes:int>>, my_ratings map<string,map<string,double>>")


def records(spark, rows):
    return spark.createDataFrame(rows, BATCH)


def drawn(seed, n, films):
    r = random.Random(seed)
    some = lambda value: value if r.random() < 0.6 else None
    return [(some(r.randrange(films)) if r.random() < 0.1 else r.randrange(films), k, some(f"t{seed}.{k}"), some(r.randrange(2000)),
             some([(f"A{k}", f"B{k}", r.randrange(9))]), some(r.sample("abcdef", r.randrange(4))),
             some({"all": (r.random(), k)}), some({r.choice("mn"): {r.choice("xy"): some(float(k))}})) for k in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return film_store(spark, str(tmp_path / "films"), buckets=4)


def test_batches_equal_whole_table_merges(spark, store):
    whole = {n: spark.createDataFrame([], SCHEMAS[n]) for n in FILM_TABLES}
    for batch_id in range(3):
        batch = records(spark, drawn(batch_id, 25, 12))
        whole = {n: spark.createDataFrame(df.select(*SCHEMAS[n].fieldNames()).collect(), SCHEMAS[n])
                 for n, df in apply_film_batch(whole, batch, ["at"]).items()}
        merge_film_batch(store, batch, ["at"], "s", batch_id)
    now = store.read_all()
    for name in FILM_TABLES:
        assert rows_of(now[name]) == rows_of(whole[name].select(*now[name].columns)), name


def test_half_written_batch_is_invisible_and_done_again(spark, store, monkeypatch):
    first = records(spark, [(k, 0, f"t{k}", 1, [("A", "A", k)], ["x"], None, None) for k in range(8)])
    merge_film_batch(store, first, ["at"], "s", 0)
    before = {n: rows_of(df) for n, df in store.read_all().items()}
    second = records(spark, [(3, 0, "new", None, None, ["y", "z"], None, None)])
    with monkeypatch.context() as m:
        m.setattr(BatchStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            merge_film_batch(store, second, ["at"], "s", 1)
    assert {n: rows_of(df) for n, df in store.read_all().items()} == before
    assert merge_film_batch(store, second, ["at"], "s", 1) == 2
    assert merge_film_batch(store, second, ["at"], "s", 1) == 2 and store.version() == 2   # a replay changes nothing
    assert rows_of(store.read("genres").where("crit_id = 3")) == [(3, "y"), (3, "z")]
    assert store.read("movies").where("crit_id = 3").first()["title"] == "new"
    assert {n: rows_of(df) for n, df in store.read_all(version=1).items()} == before        # the commit before
    assert store.vacuum(keep=1) > 0
    assert rows_of(store.read("genres").where("crit_id = 3")) == [(3, "y"), (3, "z")]
    again = film_store(spark, store.root, buckets=4)
    assert again.version() == 2 and again.taken("s") == 1


def test_a_batch_reads_and_writes_its_buckets_only(spark, store):
    merge_film_batch(store, records(spark, [(k, 0, f"t{k}", 1, None, ["x"], None, None) for k in range(40)]), ["at"])
    one = records(spark, [(7, 0, "new", None, None, ["y"], None, None)])
    touched = store.touched(one)
    assert len(touched) == 1
    old = store.read("movies", touched)
    plan = merge_null_safe(old, store.spread(one.select(KEY, "title")), KEY, columns=["title"], null_keys=False)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Bucketed: true" in text                          # the batch's own
    assert all(f"_bucket={touched[0]}/" in f for f in old.inputFiles())
    merge_film_batch(store, one, ["at"])
    held = {r["partition"] for r in spark.sql(f"SHOW PARTITIONS {store._name('genres')}").collect()}
    assert {p for p in held if p.startswith("_version=2")} == {f"_version=2/_bucket={touched[0]}"}
    assert store.read("movies").count() == 40
    got = {r[0] for r in store.read("genres").where(F.col(KEY) == 7).select("genre").collect()}
    assert got == {"y"}


def test_declared_keys_hold_in_the_catalog(spark, tmp_path):
    store = film_store(spark, str(tmp_path / "k"), buckets=2)
    assert store.declared_keys("ratings") == ["crit_id", "user", "type"]
    with pytest.raises(ValueError):
        BatchStore(spark, str(tmp_path / "bad"), {"movies": SCHEMAS["movies"]}, KEY, {"movies": ["nothing"]})
    assert store.read("movies").count() == 0 and store.version() == 0 and store.taken("s") == -1


def test_filters_know_every_stored_key_and_few_others(spark):
    rows = spark.range(20000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("slot"))
    pages = filter_pages(rows.where("k % 2 = 0"), ["k"], F.col("slot"))
    assert pages.select("pages").distinct().collect()[0][0] == 2          # 3,334 keys of 10 bits
    known = _maybe_stored(rows.withColumn("_row", F.col("k")), ["k"], pages)
    got = {r["_row"] for r in known.collect()}
    assert all(k in got for k in range(0, 20000, 2))
    assert len([k for k in got if k % 2]) < 300                           # of 10,000


def test_batch_keys_are_checked_by_filter_and_bucket(spark, tmp_path):
    store = film_store(spark, str(tmp_path / "keyed"), buckets=8)
    store.on_write.append(write_filters)
    merge_film_batch(store, records(spark, [(k, 0, f"t{k}", 1, None, ["x"], None, None) for k in range(50)]), ["at"])
    merge_film_batch(store, records(spark, [(7, 0, None, None, None, ["x", "y"], None, None)]), ["at"])
    rows = [(7, "x"), (7, "y"), (7, "z"), (7, "z"), (8, "x"), (8, "y"), (99, "x"), (None, "x"), (9, None)]
    batch = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "crit_id int, genre string, at int")
    got = {r["at"]: r["reason"] for r in check_batch(store, "genres", batch, ["at"], parent="movies").collect()}
    assert [got[i] for i in range(9)] == ["duplicate", "duplicate", "ok", "repeated", "duplicate", "ok", "orphan", "null_key", "null_key"]
    one = store.touched(batch.where("crit_id = 7"))
    assert read_filters(store, "genres", one).select("slot").distinct().count() == 1
    assert all(f"_bucket={one[0]}/" in f for f in store.read("genres", one).inputFiles())
    assert check_batch(store, "genres", batch.limit(0), ["at"], parent="movies").collect() == []


def test_records_seen_long_ago_are_dropped(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(30)] * 2 + [(None, "none")], "id int, v string")
    store = seen_store(spark, str(tmp_path / "seen"), rows.schema, "id", buckets=4)
    drop_seen(store, rows.where("id < 20 or id is null"), "s", 0)
    drop_seen(store, rows, "s", 1)
    assert drop_seen(store, rows.withColumn("v", F.lit("again")), "s", 1) == 2       # a replay
    drop_seen(store, rows.where("id = 3").withColumn("v", F.lit("again")), "s", 2)
    assert rows_of(store.read("records")) == sorted(((k, f"v{k}") for k in range(30)), key=str)
    touched = store.touched(rows.where("id = 3"))
    assert {b for b, v in store.held("records").items() if v == 3} == set(touched)


def test_sketches_follow_the_touched_buckets(spark, tmp_path):
    store = film_store(spark, str(tmp_path / "sketched"), buckets=4)
    store.on_write.append(sketch_writer({"movies": ["year", "crit_popularity"]}))
    merge_film_batch(store, records(spark, [(k, 0, None, 1900 + k, None, None, None, None) for k in range(101)]), ["at"])
    got = statistics(store, "movies", [0.5]).collect()
    assert [(r["feature"], r["n"], r["low"], r["high"]) for r in got] == [("year", 101, 1900.0, 2000.0)]   # no popularity yet
    assert abs(got[0]["p50"] - 1950) <= 1
    merge_film_batch(store, records(spark, [(100, 0, None, 1800, None, None, None, None)]), ["at"])
    assert store.spark.read.parquet(f"{store.root}/sketches/movies/made=2").count() == 1                     # one bucket
    again = statistics(store, "movies", [0.5]).first()
    assert (again["n"], again["low"], again["high"]) == (101, 1800.0, 1999.0)
    assert statistics(store, "movies", [0.5], version=1).first()["high"] == 2000.0
