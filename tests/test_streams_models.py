"""Snapshot sink idempotence and late data; the full prediction run;
property checks with hypothesis."""

import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kinoframe.operators.merge import fold_log, merge_null_safe
from kinoframe.operators.nest import nest_values, unnest_list
from kinoframe.plans.models import ForestConfig, get_predictions
from kinoframe.session import work_path
from kinoframe.sources.tables import TableStore
from kinoframe.streaming.streams import from_pairs, snapshot_writer

T0 = dt.datetime(2024, 1, 1)
COLS = ["a", "b"]


def _log(spark, rows):
    return spark.createDataFrame(rows, "k int, ts timestamp, id int, a double, b string")


def test_snapshot_replay_and_late_rows(spark):
    store = TableStore(spark, work_path(spark, "snap-test"))
    write = snapshot_writer(store, "cur", "k", ["ts", "id"], COLS)
    b0 = _log(spark, [(1, T0 + dt.timedelta(hours=2), 1, 1.0, None), (2, T0, 2, None, "x")])
    late = _log(spark, [(1, T0, 3, 9.0, "early")])  # older than what is stored: must not win for a
    write(b0, 0)
    write(b0, 0)  # replay of the same batch id: idempotent
    write(late, 1)
    got = {r["k"]: (r["a"], r["b"]) for r in from_pairs(store.read("cur"), "k", COLS).collect()}
    assert got == {1: (1.0, "early"), 2: (None, "x")}
    both = b0.unionByName(late)
    batch = {r["k"]: (r["a"], r["b"]) for r in fold_log(both, "k", ["ts", "id"], COLS).collect()}
    assert got == batch


def test_get_predictions(spark):
    rows = []
    for i in range(120):
        rows.append((i, 1000 + i, f"t{i}", 1990 + i % 20, float(i % 10), i * 3, float(i % 7), i * 11,
                     "movie" if i % 3 else "tv series", 40 + i % 50, 80 + i % 40, float(i % 15),
                     float(50 + i % 50) if i % 2 else None, float(i % 9), ["Drama"] if i % 4 else ["Short", "Comedy"]))
    feats = spark.createDataFrame(rows, "crit_id int, imdbid long, title string, year int, crit_rating double, "
                                        "crit_votes int, imdb_rating double, imdb_votes long, kind string, "
                                        "metacritic_score int, runtime int, years_since_release double, "
                                        "rating double, psi double, genres array<string>")
    feats = feats.withColumn("rated", F.coalesce((F.col("rating") > 0).cast("int"), F.lit(0)))
    ratings = spark.createDataFrame([(1, "ann", "rating", 70.0)], "crit_id int, user string, type string, score double")
    small = ForestConfig(num_trees=5, max_depth=3, folds=2, parallelism=2)
    scored, rows_back, res = get_predictions(feats, ratings, "ann", seen_cfg=small, rating_cfg=small)
    out = scored.select("crit_id", "seen_probability", "pred_rating", "pred_seeit", "show", "score").collect()
    assert len(out) == 120
    assert all(0.0 <= r["seen_probability"] <= 1.0 and r["pred_rating"] is not None for r in out)
    assert "test_auc" in res["seen"].metrics and "test_r2" in res["rating"].metrics
    assert res["seen"].importances.count() > 0
    # the user's one rating row is kept, 4 score rows per film are added
    assert rows_back.filter("user = 'ann'").count() == 1 + 120 * 4


log_rows = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50), st.one_of(st.none(), st.integers(0, 9))),
                    min_size=1, max_size=25)


@settings(max_examples=8, deadline=None)
@given(log_rows)
def test_fold_equals_sequential_merge_property(spark, rows):
    # unique (ts) per key so the sequential order is well defined
    seen, data = set(), []
    for k, ts, v in rows:
        if (k, ts) not in seen:
            seen.add((k, ts))
            data.append((k, ts, v))
    df = spark.createDataFrame(data, "k int, ts int, v int")
    folded = {r["k"]: r["v"] for r in fold_log(df, "k", ["ts"], ["v"]).collect()}
    expect = {}
    for k, ts, v in sorted(data, key=lambda x: x[1]):
        if v is not None or k not in expect:
            expect[k] = v if v is not None else expect.get(k)
    assert folded == expect
    once = merge_null_safe(df.select("k", "v").limit(0), df.select("k", "v").dropDuplicates(["k"]), "k")
    assert once.count() == len({r[0] for r in data})


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.text(alphabet="abc", min_size=1, max_size=3)), min_size=1, max_size=20))
def test_unnest_of_nest_property(spark, rows):
    data = [(k, i, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k int, pos int, v string")
    nested = nest_values(df, "k", "v", order=["pos"], alias="vs")
    back = unnest_list(nested, "k", "vs", rank="rank", value="v").collect()
    expect = []
    for k in sorted({d[0] for d in data}):
        vals = [v for kk, _, v in sorted(data, key=lambda x: x[1]) if kk == k]
        expect += [(k, v, i + 1) for i, v in enumerate(vals)]
    assert sorted((r["k"], r["v"], r["rank"]) for r in back) == sorted(expect)


def test_partial_snapshot_buckets(spark):
    from kinoframe.streaming.streams import partial_snapshot_writer, read_partial_snapshot
    path = work_path(spark, "partial-snap-test")
    write = partial_snapshot_writer(path, "k", ["ts", "id"], COLS, buckets=4)
    rows = [(k, T0 + dt.timedelta(minutes=m), m * 10 + k, float(m) if (m + k) % 3 else None, f"s{m}" if m % 2 else None)
            for m in range(6) for k in range(7)]
    batches = [_log(spark, rows[i::3]) for i in range(3)]
    write(batches[0], 0)
    write(batches[2], 1)   # later rows first
    write(batches[2], 1)   # replay
    write(batches[1], 2)   # late rows
    got = sorted(map(tuple, read_partial_snapshot(spark, path, "k", COLS).collect()))
    expect = sorted(map(tuple, fold_log(_log(spark, rows), "k", ["ts", "id"], COLS).collect()))
    assert got == expect


def test_streaming_update_mode_multi_batch(spark):
    from kinoframe.streaming.streams import current_record, file_stream, run_available, upsert_writer
    folder = work_path(spark, "stream-src")
    rows = [(k, T0 + dt.timedelta(minutes=m), m * 10 + k, float(m) if (m + k) % 3 else None, f"s{m}" if m % 2 else None)
            for m in range(6) for k in range(5)]
    # three landed files, the last one with the oldest rows (late data)
    for i, part in enumerate([rows[10:20], rows[20:], rows[:10]]):
        _log(spark, part).coalesce(1).write.parquet(f"{folder}/part{i}")
        spark.read.parquet(f"{folder}/part{i}").coalesce(1).write.mode("overwrite").parquet(f"{folder}/flat{i}")
    stream = file_stream(spark, f"{folder}/flat*", "*.parquet", max_files_per_trigger=1)
    cur = current_record(stream, "k", ["ts", "id"], COLS)
    path = work_path(spark, "stream-upsert")
    run_available(cur, "multi", output_mode="update", batch_fn=upsert_writer(path, "k", buckets=3))
    got = sorted(map(tuple, spark.read.parquet(path).select("k", *COLS).collect()))
    expect = sorted(map(tuple, fold_log(_log(spark, rows), "k", ["ts", "id"], COLS).collect()))
    assert got == expect


def test_exploration_grid_size(spark):
    from kinoframe.plans.models import SEEN_PRODUCTION, _forest, param_grid
    forest = _forest("classifier", SEEN_PRODUCTION, "rated")
    assert len(param_grid(forest, SEEN_PRODUCTION, full_grid=True)) == 18
    assert len(param_grid(forest, SEEN_PRODUCTION)) == 1
