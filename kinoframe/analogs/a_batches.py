"""Film batches that arrive as a stream and change a bucketed store."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinoframe.analogs import register
from kinoframe.analogs.common import t, ts_text
from kinoframe.plans.film_batches import film_batch_writer, film_store
from kinoframe.schemas import SCHEMAS
from kinoframe.session import work_path
from kinoframe.sources.batches import BatchStore
from kinoframe.sources.key_filters import check_batch, write_filters
from kinoframe.sources.sketches import sketch_writer, statistics
from kinoframe.streaming.pace import pace_store, pace_writer
from kinoframe.streaming.seen import drop_seen_writer, seen_store
from kinoframe.streaming.streams import dedupe, file_stream, run_available

NEW_FILMS = 1_000_000_000   # added to a part's key for the films of the last landing
PEOPLE = "array<struct<canonical_name:string,name:string,person_id:bigint>>"
RECORD = {"crit_id": "int", "at": "int", "title": "string", "year": "int", "date_added": "timestamp", "cast": PEOPLE,
          "director": PEOPLE, "genres": "array<string>", "keywords": "array<string>",
          "my_ratings": "map<string,map<string,double>>"}


def landings(part):
    """Four landings of partial film records made of parts: all films; every
    fourth film twice; every sixth with an empty list and a NULL score; new
    films and a record without a key."""
    k = F.col("p_partkey")
    person = lambda name: F.array(F.struct(name.alias("canonical_name"), name.alias("name"), F.lit(1).cast("long").alias("person_id")))
    named = lambda what: F.concat(F.lit(what + " "), k)
    score = lambda user, kind, value: F.create_map(F.lit(user), F.create_map(F.lit(kind), value.cast("double")))

    def records(rows, **given):
        return rows.select(*[given.get(c, F.lit(None)).cast(ty).alias(c) for c, ty in RECORD.items()])

    day = lambda d: F.lit(d).cast("timestamp")
    fourth, sixth, tenth = (part.where(k % n == 0) for n in (4, 6, 10))
    yield records(part, crit_id=k, at=F.lit(0), title=F.col("p_name"), year=F.col("p_size"), date_added=day("2020-01-01"),
                  cast=person(named("cast")), director=person(named("director")), genres=F.array(F.lit("x"), F.col("p_brand")),
                  my_ratings=score("me", "rating", F.col("p_size")))
    yield records(fourth, crit_id=k, at=F.lit(1), title=F.lit("first"), year=F.lit(1990), date_added=day("2019-01-01"),
                  cast=F.when(k % 3 == 0, person(named("late"))), my_ratings=score("me", "rating", F.lit(7))).unionByName(
        records(fourth, crit_id=k, at=F.lit(2), title=F.lit("second"), genres=F.when(k % 5 == 0, F.array(F.lit("g2"), F.lit("g1"))),
                my_ratings=score("me", "psi", F.lit(3))))
    yield records(sixth, crit_id=k, at=F.lit(3), year=F.lit(2001), genres=F.array().cast("array<string>"),
                  keywords=F.array(F.lit("k2"), F.lit("k1")), my_ratings=F.map_concat(
                      score("me", "rating", F.lit(None)), score("you", "rating", F.lit(1))))
    yield records(tenth, crit_id=k + NEW_FILMS, at=F.lit(4), title=named("new"), year=F.col("p_size"),
                  date_added=day("2021-01-01"), genres=F.array(F.lit("n"))).unionByName(records(tenth, at=F.lit(5), title=F.lit("lost")))


@register("stream_film_batch", f"""
SELECT CAST(p_partkey AS BIGINT) AS crit_id, CASE WHEN p_partkey % 4 = 0 THEN 'second' ELSE p_name END AS title,
       CAST(CASE WHEN p_partkey % 6 = 0 THEN 2001 WHEN p_partkey % 4 = 0 THEN 1990 ELSE p_size END AS INTEGER) AS year,
       '2020-01-01 00:00:00' AS date_added,
       CASE WHEN p_partkey % 12 = 0 THEN 'late ' ELSE 'cast ' END || p_partkey AS cast_names, 'director ' || p_partkey AS director,
       CASE WHEN p_partkey % 20 = 0 THEN 'g1,g2' ELSE p_brand || ',x' END AS genres,
       CASE WHEN p_partkey % 6 = 0 THEN 'k1,k2' END AS keywords,
       CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 7.0 ELSE CAST(p_size AS DOUBLE) END AS rating,
       CASE WHEN p_partkey % 4 = 0 THEN CAST(3.0 AS DOUBLE) END AS psi,
       CASE WHEN p_partkey % 6 = 0 THEN CAST(1.0 AS DOUBLE) END AS your_rating
  FROM part
UNION ALL
SELECT p_partkey + {NEW_FILMS}, 'new ' || p_partkey, p_size, '2021-01-01 00:00:00', NULL, NULL, 'n', NULL, NULL, NULL, NULL
  FROM part WHERE p_partkey % 10 = 0
""")
def stream_film_batch_query(spark, sf_dir):
    """T2 + U7: landed partial records with people, genres, keywords and
    ratings, a micro-batch each, one of them delivered twice; read back at
    the last commit."""
    folder = work_path(spark, "landed")
    for rows in landings(t(spark, sf_dir, "part")):
        rows.repartition("crit_id").write.mode("append").parquet(folder)
    store = film_store(spark, work_path(spark, "film-batches"), buckets=4)
    merge = film_batch_writer(store, "landed", ["at"])

    def twice(batch, batch_id):
        merge(batch, batch_id)
        if batch_id == 1:
            merge(batch, batch_id)

    run_available(file_stream(spark, folder, "*.parquet", max_files_per_trigger=1), "film-batches", "append", twice)
    now = store.read_all()
    of = lambda name, by, value, **cases: now[name].groupBy("crit_id").agg(*[
        F.max(F.when(by(case), F.col(value))).alias(alias) for alias, case in cases.items()])
    listed = lambda name, value, alias: now[name].groupBy("crit_id").agg(
        F.array_join(F.array_sort(F.collect_list(value)), ",").alias(alias))
    out = now["movies"].select("crit_id", "title", "year", ts_text("date_added").alias("date_added"))
    for part in (of("persons", lambda r: F.col("role") == r, "name", cast_names="cast", director="director"),
                 listed("genres", "genre", "genres"), listed("keywords", "keyword", "keywords"),
                 of("ratings", lambda ut: (F.col("user") == ut[0]) & (F.col("type") == ut[1]), "score",
                    rating=("me", "rating"), psi=("me", "psi"), your_rating=("you", "rating"))):
        out = out.join(part, "crit_id", "left")
    return out.withColumn("crit_id", F.col("crit_id").cast("long"))


@register("create_table", """
WITH b AS (SELECT p_partkey, g.genre, n.nth FROM part, (VALUES ('old'), ('new')) g(genre), (VALUES (1), (2)) n(nth)
            WHERE n.nth = 1 OR p_partkey % 6 = 1)
SELECT p_partkey, genre, CAST(nth AS INTEGER) AS nth, 'crit_id,genre' AS declared_keys,
       CASE WHEN p_partkey % 50 = 0 THEN 'null_key' WHEN p_partkey % 3 = 0 THEN 'orphan'
            WHEN genre = 'old' AND p_partkey % 4 = 0 THEN 'duplicate' WHEN nth = 2 THEN 'repeated' ELSE 'ok' END AS reason
  FROM b
""")
def create_table_query(spark, sf_dir):
    """S2 + S9 + S10 + U9: tables with declared keys, and a batch of child
    rows checked against the filters of its buckets."""
    p = t(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("int")
    names = ["movies", "genres"]
    store = BatchStore(spark, work_path(spark, "keyed"), {n: SCHEMAS[n] for n in names}, "crit_id",
                       {"movies": ["crit_id"], "genres": ["crit_id", "genre"]}, buckets=4)
    store.on_write.append(write_filters)
    films = p.select(k.alias("crit_id"), "p_name")

    def load(tables, rows):
        typed = [F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS["movies"].fields if f.name not in ("crit_id", "title")]
        return {"movies": rows.where("crit_id % 3 > 0").select("crit_id", F.col("p_name").alias("title"), *typed),
                "genres": rows.where("crit_id % 4 = 0").select("crit_id", F.lit("old").alias("genre"))}

    store.apply(films, load)
    batch = p.select("p_partkey", F.when(k % 50 > 0, k).alias("crit_id"), F.explode(F.array(F.lit("old"), F.lit("new"))).alias("genre"))
    batch = batch.withColumn("nth", F.explode(F.when(F.col("p_partkey") % 6 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    checked = check_batch(store, "genres", batch, ["nth"], parent="movies")
    return checked.select("p_partkey", "genre", "nth", F.lit(",".join(store.declared_keys("genres"))).alias("declared_keys"), "reason")


@register("stream_dedup_long", """
SELECT event_id, user_id, event_type, round(value, 6) AS value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events
""")
def stream_dedup_long_query(spark, sf_dir):
    """The same records delivered again, at once and 30 days later: the
    watermark's state drops the first kind, the stored ids the second."""
    events = t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("fetched", F.col("ts"))
    later = events.withColumn("fetched", F.col("ts") + F.expr("INTERVAL 30 DAYS"))
    folder = work_path(spark, "fetched")
    for rows in (events.unionByName(events), later):
        rows.coalesce(4).write.mode("append").parquet(folder)
    ids = events.select("event_id", "user_id", "event_type", "value", "ts")
    store = seen_store(spark, work_path(spark, "seen"), ids.schema, "event_id", buckets=4)
    recent = dedupe(file_stream(spark, folder, "*.parquet"), ["event_id"], "fetched", "1 day")
    run_available(recent.select(*ids.columns), "dedup-long", "append", drop_seen_writer(store, "fetches"))
    got = store.read("records")
    return got.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"), ts_text("ts").alias("ts"))


@register("population_sketch", """
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price, o_custkey FROM orders),
long AS (SELECT 'price' AS feature, price AS v FROM x UNION ALL SELECT 'customer', CAST(o_custkey AS DOUBLE) FROM x)
SELECT feature, count(*) AS n, round(min(v), 6) AS low, round(max(v), 6) AS high, TRUE AS p10_within, TRUE AS p50_within, TRUE AS p90_within
  FROM long GROUP BY feature
""")
def population_sketch_query(spark, sf_dir):
    """A10 + A19: statistics of a store after a batch changed every fourth
    row, from the sketches of its buckets; each quantile's exact rank lies
    within 1 % of the wanted one."""
    orders = t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_totalprice").cast("double").alias("price"),
                                               F.col("o_custkey").cast("double").alias("customer"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("customer", T.DoubleType())])
    store = BatchStore(spark, work_path(spark, "sketched"), {"films": schema}, "id", {"films": ["id"]}, buckets=8)
    store.on_write.append(sketch_writer({"films": ["price", "customer"]}))
    store.apply(orders, lambda old, new: {"films": new})
    change = orders.where("id % 4 = 0").withColumn("price", F.col("price") * 2)
    store.apply(change, lambda old, new: {"films": old["films"].join(store.spread(new.select("id")), "id", "left_anti")
                                          .unionByName(new)}, "later")
    probs = (0.1, 0.5, 0.9)
    stats = statistics(store, "films", probs)
    one = stats.select(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("p10", "p50", "p90")))).alias("m")).scalar()
    now = store.read("films")
    names = ["price", "customer"]
    # the share of rows below and up to each quantile brackets the wanted rank
    ranks = now.agg(*[F.avg((F.col(c) < one[c][f"p{int(p * 100)}"]).cast("double")).alias(f"{c}_{i}_lt") for c in names for i, p in enumerate(probs)],
                    *[F.avg((F.col(c) <= one[c][f"p{int(p * 100)}"]).cast("double")).alias(f"{c}_{i}_le") for c in names for i, p in enumerate(probs)])
    rows = ranks.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), *[
        ((F.col(f"{c}_{i}_lt") <= p + 0.01) & (F.col(f"{c}_{i}_le") >= p - 0.01)).alias(f"p{int(p * 100)}_within")
        for i, p in enumerate(probs)]) for c in names])))
    return stats.join(rows, "feature").select("feature", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"),
                                              "p10_within", "p50_within", "p90_within")


PACE_CAPS = {"click": 4, "error": 2, "purchase": 8, "signup": 4}    # an hour; views have none


@register("stream_pace", """
WITH c AS (SELECT * FROM (VALUES ('click', 4), ('error', 2), ('purchase', 8), ('signup', 4)) v(event_type, cap)),
i AS (SELECT event_id, event_type, ts, cap, epoch_us(ts) // 3600000000 AS hour,
             row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events JOIN c USING (event_type)),
s AS (SELECT *, i + max(cap * hour - i) OVER (PARTITION BY event_type ORDER BY i) AS slot FROM i)
SELECT event_id, event_type, CAST(slot AS BIGINT) AS slot,
       strftime(greatest(ts, TIMESTAMP '1970-01-01' + INTERVAL 1 HOUR * CAST(slot // cap AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS release_at FROM s
UNION ALL
SELECT event_id, event_type, NULL, strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events WHERE event_type = 'view'
""")
def stream_pace_query(spark, sf_dir):
    """R8 + T4: events as tasks, landed in four parts of time; a source over
    its cap is held back to the next hour with a free slot."""
    e = t(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    quarter = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.struct("a", "b")).scalar()
    part = F.least(F.floor((F.unix_micros("ts") - F.unix_micros(quarter["a"])) * 4
                           / (F.unix_micros(quarter["b"]) - F.unix_micros(quarter["a"]) + 1)), F.lit(3))
    folder = work_path(spark, "tasks")
    for n in range(4):
        e.where(part == n).coalesce(1).write.mode("append").parquet(folder)
    stores = pace_store(spark, work_path(spark, "paced"), e.schema, "event_id", buckets=4)
    run_available(file_stream(spark, folder, "*.parquet", max_files_per_trigger=1), "pace", "append",
                  pace_writer(stores, "tasks", "event_type", "ts", ["ts", "event_id"], PACE_CAPS))
    return stores[0].read("tasks").select("event_id", "event_type", "slot", ts_text("release_at").alias("release_at"))
