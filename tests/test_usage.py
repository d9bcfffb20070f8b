"""The README usage path on a bucketed store of the fixture film tables."""

from kinoframe.operators.nest import nest_values
from kinoframe.plans.catalogue import apply_film_batch, film_wide_export
from kinoframe.plans.features import feature_table
from kinoframe.plans.refresh import RefreshConfig, film_refresh_input, schedule
from kinoframe.schemas import SCHEMAS
from kinoframe.session import work_path
from kinoframe.sources.tables import BucketedStore
from tests.test_catalogue import tables


def test_readme_usage(spark):
    store = BucketedStore(spark, work_path(spark, "usage"), key="crit_id", buckets=8)
    for name, df in tables(spark).items():
        store.write(name, df)
    t = {name: store.read(name, schema) for name, schema in SCHEMAS.items()}  # missing ones created empty
    assert t["netflix_genres"].count() == 0
    assert film_wide_export(t, user="ann").count() == 2
    plan = schedule(film_refresh_input(t["movies"]), RefreshConfig(weibull_shape=3),
                    as_of="2024-01-01 00:00:00", n=30).collect()
    assert 0 < len(plan) <= 30
    batch = spark.createDataFrame([(1234, 2001, ["Dutch"])], "crit_id int, year int, languages array<string>")
    assert apply_film_batch(t, batch)["languages"].count() == 2
    genres = nest_values(t["genres"], "crit_id", "genre", alias="genres")
    rows = feature_table(t["movies"], t["ratings"], genres, user="ann", as_of="2024-01-01").collect()
    assert [r["rated"] for r in rows] == [1]
