"""Sessions and the shared folder that written tables and checkpoints live in."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording the Python call site of every column expression triples the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int | str = 8, app: str = "caravel") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(cpus))
    spark = builder.config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(shuffle_bytes: int, cores: int) -> dict[str, str]:
    """Settings to start a large run with, from the bytes its widest shuffle moves.

    About 256 MB per reduce task keeps sorts and hash maps in memory; AQE merges what turns out
    smaller and splits what turns out larger, so the initial count errs on the high side.
    """
    partitions = max(cores, -(-shuffle_bytes // (256 << 20)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": "256m",
    }


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session while a block runs; afterwards it is what it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or the warehouse where that is not set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return re.sub("^file:/(?!/)", "file:///", named.rstrip("/"))


def _file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object, so that any shared store works."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    file_system, where = _file_system(spark, path)
    return file_system.exists(where)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none where there is no such folder."""
    file_system, where = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in file_system.listStatus(where)) if file_system.exists(where) else []


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; nothing happens where there is none."""
    file_system, where = _file_system(spark, path)
    file_system.delete(where, True)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/caravel/{label}-{uuid.uuid4().hex[:12]}"
    file_system, where = _file_system(spark, path)
    file_system.mkdirs(where)
    file_system.deleteOnExit(where)
    return path
