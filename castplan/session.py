"""Spark session helpers."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_STORED: list = []


def get_spark(master: str | None = None, app_name: str = "castplan",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one with sane defaults.

    On a cluster the session already exists and its settings win; the defaults here only
    matter for local runs and tests.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # broadcast only on sizes measured at run time (AQE), never on plan-time estimates
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return ``spark.checkpoint.dir``; set a scratch one only when the session has none.

    Clusters name a shared folder there; a machine-local folder is only acceptable for
    local runs and tests, which is the only case where this function creates one.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):  # local-cluster has executors of its own
            raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a shared "
                               "folder (castplan writes run intermediates there).")
        current = tempfile.mkdtemp(prefix="castplan-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def store(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate of the run once as Parquet under ``spark.checkpoint.dir`` and read it
    back: its readers prune columns and push filters, and a lost executor costs a re-read."""
    return _stored(df, name)[0]


def _stored(df: DataFrame, name: str) -> tuple:
    spark = df.sparkSession
    entry = (spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/castplan-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}")
    _STORED.append(entry)
    df.write.parquet(entry[1])
    release_shuffles(spark)
    return spark.read.schema(df.schema).parquet(entry[1]), entry


@contextmanager
def steps(spark: SparkSession):
    """``store`` for the steps of one result: what it stores is deleted when the block ends."""
    mine: list = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        rows, entry = _stored(df, name)
        mine.append(entry)
        return rows
    try:
        yield keep
    finally:
        for entry in mine:
            drop_folder(spark, entry[1])
            _STORED.remove(entry)


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage: the shuffle files of ended queries stay on the executors' disks until it does, and
    a driver with memory to spare may not for the whole run.  The second time takes what still held the last query at the first."""
    for pause in (0.3, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this run has written."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored(spark: SparkSession) -> None:
    """Delete the run's intermediates (call when its reports have been read)."""
    for entry in [x for x in _STORED if x[0] is spark]:
        drop_folder(spark, entry[1])
        _STORED.remove(entry)


@atexit.register
def _drop_at_exit() -> None:
    for spark in {id(s): s for s, _ in _STORED}.values():
        try:
            drop_stored(spark)
        except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to clear
            pass
