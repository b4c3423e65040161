"""Reading canonical tables: fixed schemas, absent columns added with their default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_missing_columns(frame: DataFrame, schema: T.StructType, default: str = "") -> DataFrame:
    """Columns of ``schema`` in order; ones the frame lacks get '' (text), 0 (numbers) or null."""
    def column(field):
        if field.name in frame.columns:
            return F.col(field.name).cast(field.dataType).alias(field.name)
        if isinstance(field.dataType, T.StringType):
            value = F.lit(default)
        elif isinstance(field.dataType, T.NumericType):
            value = F.lit(0)
        else:
            value = F.lit(None)
        return value.cast(field.dataType).alias(field.name)

    return frame.select(*[column(f) for f in schema.fields])


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return with_missing_columns(spark.read.parquet(path), schema)


def read_text_files(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """One row per file: path and decoded text."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", encoding).alias("text"))


def write_table(frame: DataFrame, path: str, mode: str = "append", partition_by: tuple = ()) -> None:
    writer = frame.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_lines(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    frame.write.mode(mode).json(path)
