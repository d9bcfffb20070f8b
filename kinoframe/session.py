"""Session helpers: builder for tests/bench, shared work folder, checked broadcast."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side we are willing to broadcast without measuring it first (rows).
DEFAULT_BROADCAST_ROWS = 1_000_000


# Settings for a large cluster (about 100 TB of input, ~1000 executors):
# partitions sized so one shuffle block stays well inside executor memory,
# AQE to coalesce small partitions and split skewed ones at runtime.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
}


def apply_conf(spark: SparkSession, conf: dict[str, str] = CLUSTER_CONF) -> None:
    """Apply runtime SQL settings (e.g. :data:`CLUSTER_CONF`) to a session."""
    for k, v in conf.items():
        spark.conf.set(k, v)


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "kinoframe", event_log_dir: str | None = None) -> SparkSession:
    """Session used by tests and the bench (the cluster passes its own).
    ``event_log_dir`` writes Spark's event log there (stage and task times,
    read offline; the web UI stays off)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if event_log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured (a shared file system); only when it
    is unset (tests on one machine) is a folder of our own chosen.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: a machine-local "
                               "folder does not survive the loss of an executor's host")
        configured = os.path.join("/tmp", "kinoframe-checkpoints")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder, for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/kinoframe/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage by writing ``df`` as a Parquet table in the shared
    checkpoint folder and reading it back (never ``localCheckpoint``).

    One computation plus a columnar write (``Dataset.checkpoint`` would
    compute an unpersisted plan twice); the re-read table survives executor
    loss and gives AQE real size statistics.
    """
    path = work_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def spread_rows(df: DataFrame, a_core: int = 4) -> DataFrame:
    """The rows dealt evenly over ``a_core`` partitions a core, where they
    stand in fewer than two: a small file is read by a few tasks, however much
    work each of its rows makes. Call it on the narrow rows, before that work.
    A table of more files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(a_core * cores)


DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only after measuring it; otherwise leave the choice to AQE.

    One pass counts the rows and the bytes of their JSON form (an upper-ish
    bound of the serialised size). Beyond either bound the join falls back
    to a shuffle (sort-merge or shuffled hash, chosen at runtime).
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if row["n"] <= max_rows and row["b"] <= max_bytes else df


def fixed_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a side whose size is fixed by construction (a literal table
    of parameters, at most a few dozen rows), so no count is needed."""
    return F.broadcast(df)


def read_tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names]


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a
    checkout on a shared path; an installed package needs nothing)."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, home])
