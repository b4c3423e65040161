"""Session settings the engine is tuned for.  Every value is a default: set ones win."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FORMAT = 5  # of stored tables: a new one where their columns or meaning change
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bidlens")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Where named tables are stored: the cluster's ``spark.checkpoint.dir``; a temporary folder only where none is set (tests)."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        context.setCheckpointDir(os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "checkpoint"))
    return context.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Digest of the names, sizes and times of all files of some tables: changes when any of them is written anew."""
    found = []
    for path in paths:
        files, where = _file_system(spark, path)
        for status in files.listStatus(where):
            found.append(f"{status.getPath()}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


def stored_at(spark: SparkSession, name: str, key: str) -> tuple[str, bool]:
    """(path of a named table in the shared folder, whether it is already written).  ``key`` names what it was made of.

    Such tables outlive executors and sessions; who no longer needs one deletes its folder.
    """
    path = f"{shared_folder(spark)}/bidlens-{FORMAT}/{name}-{key}"
    files, where = _file_system(spark, f"{path}/_SUCCESS")
    return path, files.exists(where)


def stored(spark: SparkSession, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A named table: read where it is written, else made and written first."""
    path, written = stored_at(spark, name, key)
    if not written:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
