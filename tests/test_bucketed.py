"""Co-located film tables: the export needs no shuffle on bucketed tables."""

from kinoframe.plans.catalogue import film_wide_export
from kinoframe.session import work_path
from kinoframe.sources.tables import BucketedStore
from tests.test_catalogue import tables


def test_export_without_exchange(spark):
    t = tables(spark)
    store = BucketedStore(spark, work_path(spark, "bucketed"), key="crit_id", buckets=4)
    for name, df in t.items():
        store.write(name, df)
    bt = {name: store.read(name) for name in t}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = film_wide_export(bt, "ann")
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows = {r["crit_id"]: r for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange" not in plan, plan
    assert rows[1234]["actors"] == "Keanu Reeves / Laurence Fishburne"
