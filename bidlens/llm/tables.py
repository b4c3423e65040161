"""Reading the given tables and keeping intermediate ones in the shared folder of the cluster."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# what the operators call a word: anything between ASCII blanks, as a Java and as a DuckDB pattern
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of its own only in a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


class Scratch:
    """Intermediate tables of one call: written once to the shared folder, reread, dropped when no longer needed.

    A written table cuts the lineage, outlives lost executors and is read with column pruning.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released() -> None:
    """Gives a Python worker's free memory back at the end of a task: workers outlive stages, and an idle one's counts too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def held_out() -> Column:
    """Rows whose labels no classifier may learn from: crc32 of the id's digits leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))

