"""Tasks held to a cap per source and hour."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kinoframe.sources.batches import BatchStore
from kinoframe.streaming.pace import pace, pace_store, pace_writer

START = dt.datetime(2024, 1, 1)
CAPS = {"a": 3, "b": 1}


def drawn(spark, seed, n, first=0):
    r = random.Random(seed)
    rows = [(first + k, r.choice("aab-"), START + dt.timedelta(minutes=r.randrange(60 * 9), days=first)) for k in range(n)]
    return spark.createDataFrame(rows + [(first + n, "a", None)], "id int, source string, ts timestamp")


def one_by_one(rows, last):
    """Slots as a queue hands them out, task after task."""
    out = {}
    for r in sorted((r for r in rows if r["ts"] and r["source"] in CAPS), key=lambda r: (r["ts"], r["id"])):
        hour = int(r["ts"].replace(tzinfo=dt.timezone.utc).timestamp()) // 3600
        slot = max(CAPS[r["source"]] * hour, last.get(r["source"], -1) + 1)
        out[r["id"]] = last[r["source"]] = slot
    return out


@pytest.mark.parametrize("partitions", [1, 5])
def test_slots_are_those_of_a_queue(spark, partitions):
    tasks = drawn(spark, 2, 300)
    placed, ends = pace(tasks, "source", "ts", ["ts", "id"], CAPS, partitions=partitions)
    rows, last = placed.collect(), {}
    want = one_by_one(rows, last)
    assert {r["id"]: r["slot"] for r in rows if r["slot"] is not None} == want and len(rows) == 301
    assert {r["source"]: r["last_slot"] for r in ends.collect()} == last
    assert all(r["release_at"] == r["ts"] for r in rows if r["slot"] is None)
    busy = collections.Counter((r["source"], r["release_at"].replace(minute=0, second=0)) for r in rows if r["slot"] is not None)
    assert all(n <= CAPS[s] for (s, _), n in busy.items())
    assert all(r["release_at"] >= r["ts"] for r in rows if r["ts"])


def test_micro_batches_go_on_where_the_last_ended(spark, tmp_path, monkeypatch):
    batches = [drawn(spark, 5, 80), drawn(spark, 6, 60, 1000).withColumn("ts", F.lit(START)), drawn(spark, 7, 40, 2000)]
    stores = pace_store(spark, str(tmp_path), batches[0].schema, "id", buckets=2)
    process = pace_writer(stores, "s", "source", "ts", ["ts", "id"], CAPS)
    want, last = {}, {}
    for number, batch in enumerate(batches):
        if number == 1:   # lost between the tasks and the slots
            apply = BatchStore.apply
            with monkeypatch.context() as m:
                m.setattr(BatchStore, "apply", lambda self, *a: apply(self, *a) if self is stores[0] else (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    process(batch, number)
        process(batch, number)
        process(batch, number)
        want |= one_by_one(batch.collect(), last)
    rows = stores[0].read("tasks").collect()
    assert {r["id"]: r["slot"] for r in rows if r["slot"] is not None} == want
    assert len(rows) == sum(b.count() for b in batches)
