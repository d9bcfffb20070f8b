"""Keyed tables that change batch by batch.

Every table is a catalog table, bucketed by the key and partitioned by the
version that wrote a bucket and the bucket's number. A batch reads and writes
only the buckets of its keys; several tables become visible together when the
batch's commit, a small table of which version holds each bucket, is written
last. Readers resolve one commit, so they see whole batches only; what a
failed batch left behind is named by no commit.

One writer at a time. The catalog is the session's; a store that is opened
again finds its partitions in its folder.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinoframe.streaming.streams import written_so_far

VERSION, BUCKET = "_version", "_bucket"
COMMIT = "name string, slot int, at long, version long"
WRITERS = 4          # tables written at a time
SOURCE = "source "   # commit rows of the batches taken from a source


class BatchStore:
    """Tables of one key under ``root``: ``schemas`` declares them,
    ``keys`` their unique keys (kept as table properties)."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType], key: str,
                 keys: dict[str, Sequence[str]] | None = None, buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.schemas, self.keys = schemas, {n: list(k) for n, k in (keys or {}).items()}
        self.database = "batches_" + hashlib.md5(self.root.encode()).hexdigest()[:16]
        self.on_write: list[Callable[[BatchStore, str, int], None]] = []   # called for each table before the commit
        # a table bucketed by the key serves joins on more columns than the key
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        place = self.root.replace("'", "\\'")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}` LOCATION '{place}'")
        for name, schema in schemas.items():
            self._create(name, schema)

    def _name(self, name: str) -> str:
        return f"`{self.database}`.`{name}`"

    def _create(self, name: str, schema: T.StructType) -> None:
        """The table with its declared columns and keys. An empty key or
        one that is no column is refused."""
        keys = self.keys.get(name, [self.key])
        if not keys or not {self.key, *keys} <= set(schema.fieldNames()):
            raise ValueError(f"{name}: keys {keys} must be columns, {self.key} among them")
        if self.spark.catalog.tableExists(f"{self.database}.{name}"):
            return
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        self.spark.sql(
            f"CREATE TABLE {self._name(name)} ({columns}, {VERSION} bigint, {BUCKET} int) USING parquet "
            f"OPTIONS ('partitionOverwriteMode' 'dynamic') PARTITIONED BY ({VERSION}, {BUCKET}) "
            f"CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS TBLPROPERTIES ('kinoframe.keys' '{','.join(keys)}')")
        self.spark.sql(f"MSCK REPAIR TABLE {self._name(name)}")

    def declared_keys(self, name: str) -> list[str]:
        """The keys that the table was created with, from the catalog."""
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self._name(name)}").collect()
        return {r["key"]: r["value"] for r in rows}["kinoframe.keys"].split(",")

    def bucket(self, key: str | None = None) -> Column:
        """The bucket number of a key, as the catalog's bucketing computes it."""
        return F.pmod(F.hash(F.col(key or self.key)), F.lit(self.buckets))

    def touched(self, batch: DataFrame) -> list[int]:
        """The buckets of a batch's keys: at most ``buckets`` numbers."""
        return sorted(r[0] for r in batch.where(F.col(self.key).isNotNull()).select(self.bucket()).distinct().collect())

    # --- commits ---

    def commits(self) -> DataFrame:
        """Every commit's rows: for each table and bucket the version that
        holds it, for each source the last batch taken."""
        found = written_so_far(self.spark, f"{self.root}/commits", COMMIT)
        return found if found is not None else self.spark.createDataFrame([], COMMIT)

    def version(self) -> int:
        """The last committed version, 0 before the first."""
        return self.commits().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _state(self, version: int | None) -> dict[str, dict[int, int]]:
        """name -> slot -> version, of one commit: tables x buckets rows."""
        version = self.version() if version is None else version
        state: dict[str, dict[int, int]] = defaultdict(dict)
        for r in self.commits().where(F.col("version") == version).collect():
            state[r["name"]][r["slot"]] = r["at"]
        return state

    def taken(self, source: str) -> int:
        """The last batch taken from a source, -1 before the first."""
        return self._state(None).get(SOURCE + source, {}).get(0, -1)

    def held(self, name: str, version: int | None = None) -> dict[int, int]:
        """bucket -> version that holds it, at a commit (default: the last)."""
        return dict(self._state(version).get(name, {}))

    # --- reading ---

    def _scan(self, name: str, held: dict[int, int]) -> DataFrame:
        at: dict[int, list[int]] = defaultdict(list)
        for bucket, version in held.items():
            at[version].append(bucket)
        wanted = F.lit(False)
        for version, numbers in sorted(at.items()):
            wanted = wanted | ((F.col(VERSION) == version) & F.col(BUCKET).isin(sorted(numbers)))
        return self.spark.table(self._name(name)).where(wanted).select(*self.schemas[name].fieldNames())

    def read(self, name: str, buckets: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        """The table at a commit (default: the last); only some buckets of it
        are scanned where ``buckets`` names them."""
        held = self.held(name, version)
        return self._scan(name, held if buckets is None else {b: held[b] for b in buckets if b in held})

    def read_all(self, buckets: Sequence[int] | None = None, version: int | None = None) -> dict[str, DataFrame]:
        """All tables at one commit."""
        version = self.version() if version is None else version
        state = self._state(version)
        picked = lambda held: held if buckets is None else {b: held[b] for b in buckets if b in held}
        return {n: self._scan(n, picked(state.get(n, {}))) for n in self.schemas}

    # --- writing ---

    def spread(self, df: DataFrame) -> DataFrame:
        """``df`` dealt by key into the buckets, as the stored tables are: a
        join with them moves ``df`` only."""
        return df.repartition(self.buckets, self.key)

    def apply(self, batch: DataFrame, change: Callable[[dict[str, DataFrame], DataFrame], dict[str, DataFrame]],
              source: str = "batch", batch_id: int | None = None) -> int:
        """Change the buckets of the batch's keys. ``change`` takes the tables'
        touched buckets and the batch and returns the new rows of the tables
        that it changes. Returns the version that holds the result.

        A batch of a source that was taken before changes nothing, so a
        stream may repeat it; one that failed half-way is done again.
        """
        last = self.version()
        state, version = self._state(last), last + 1
        if batch_id is not None and batch_id <= state.get(SOURCE + source, {}).get(0, -1):
            return last
        touched = self.touched(batch)
        before = {n: self._scan(n, {b: v for b, v in state.get(n, {}).items() if b in set(touched)}) for n in self.schemas}
        after = change(before, batch) if touched else {}
        with ThreadPoolExecutor(WRITERS) as pool:   # the tables are independent until the commit
            list(pool.map(lambda given: self._write(*given, version), after.items()))
        for name in after:
            state[name].update(dict.fromkeys(touched, version))
            for written in self.on_write:
                written(self, name, version)
        if batch_id is not None:
            state[SOURCE + source] = {0: batch_id}
        self._commit(state, version)
        return version

    def _write(self, name: str, rows: DataFrame, version: int) -> None:
        names = self.schemas[name].fieldNames()
        given = rows.select(*names, self.bucket().alias(BUCKET))
        columns = ", ".join(f"`{c}`" for c in [*names, BUCKET])
        self.spark.sql(f"INSERT OVERWRITE TABLE {self._name(name)} PARTITION ({VERSION} = {version}, {BUCKET}) "
                       f"SELECT {columns} FROM {{given}}", given=given)

    def _commit(self, state: dict[str, dict[int, int]], version: int) -> None:
        """The commit point: one file, which appears when it is complete."""
        rows = [(name, slot, at, version) for name, held in state.items() for slot, at in held.items()]
        (self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("overwrite")
         .parquet(f"{self.root}/commits/commit={version}"))

    def vacuum(self, keep: int = 2) -> int:
        """Drop the partitions that none of the last ``keep`` commits names
        (replaced buckets and what failed batches left); returns how many."""
        last = self.version()
        held = {(r["name"], r["at"], r["slot"]) for r in self.commits().where(F.col("version") > last - keep).collect()}
        dropped = 0
        for name in self.schemas:
            for r in self.spark.sql(f"SHOW PARTITIONS {self._name(name)}").collect():
                version, bucket = (int(x.split("=")[1]) for x in r["partition"].split("/"))
                if version <= last and (name, version, bucket) not in held:
                    self.spark.sql(f"ALTER TABLE {self._name(name)} DROP PARTITION ({VERSION} = {version}, {BUCKET} = {bucket})")
                    dropped += 1
        return dropped
