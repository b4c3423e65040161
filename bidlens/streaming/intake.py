"""Notice intake as a stream: service bodies land as files, every notice is appended once.

What was taken in is known by keyed state, (number, order), in the state store; the saved table is never read.  Notices
without a number can't be saved; they are counted as failures, over the life of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from bidlens.sources import envelopes, notices

KEYS = ["bid_ntce_no", "bid_ntce_ord"]


def read_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.format("text").option("wholetext", True).load(folder).withColumnRenamed("value", "body")


def received(bodies: DataFrame) -> DataFrame:
    """Notices of service bodies, whatever their number, with their place in the body."""
    return notices.normalize(envelopes.explode_items(envelopes.parse(bodies))).drop("item", "body")


def taken_in(found: DataFrame) -> DataFrame:
    """The first notice of every (number, order) that was not there before, and rows that count blank numbers.

    Of a key's notices in one batch the one with the smallest place, then the smallest content, is the first.  ``failed`` is
    0 for a notice; a row with a blank number carries all failures so far.
    """
    columns = [c for c in found.columns if c not in KEYS]
    schema = StructType([StructField(f.name, f.dataType, True) for f in found.schema.fields]).add("failed", "long")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, count = None, 0
        for rows in frames:
            count += len(rows)
            if key[0] and not state.exists:
                top = rows.sort_values(["item_pos"], kind="stable").iloc[:1]
                order = (int(top["item_pos"].iloc[0]), repr(top.iloc[0].tolist()))
                if best is None or order < best[0]:
                    best = (order, top)
        if not key[0]:
            total = (state.get[0] if state.exists else 0) + count
            state.update((total,))
            yield pd.DataFrame({c: [v] for c, v in zip(KEYS, key)} | {c: [None] for c in columns} | {"failed": [total]})[schema.fieldNames()]
        elif best is not None:
            state.update((1,))
            yield best[1].assign(failed=0)[schema.fieldNames()]

    keyed = found.withColumns({k: F.coalesce(k, F.lit("")) for k in KEYS}).groupBy(*KEYS)
    return keyed.applyInPandasWithState(step, schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def save(batch: DataFrame, batch_id: int, path: str) -> None:
    """A batch is one folder of either table: written anew when the same batch comes again after a failure."""
    batch = batch.persist()
    batch.filter(F.col("failed") == 0).drop("failed").write.mode("overwrite").parquet(f"{path}/notices/batch={batch_id}")
    batch.filter(F.col("failed") > 0).select(F.col("failed").alias("failures")).write.mode("overwrite").parquet(f"{path}/failures/batch={batch_id}")
    batch.unpersist()


def start(spark: SparkSession, folder: str, path: str, checkpoint: str, **trigger):
    """Starts the stream into ``path``/notices and ``path``/failures."""
    stream = taken_in(received(read_bodies(spark, folder))).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return stream.foreachBatch(lambda batch, batch_id: save(batch, batch_id, path)).trigger(**(trigger or {"availableNow": True})).start()


def saved(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/notices").drop("batch")


def failures(spark: SparkSession, path: str) -> int:
    """Notices without a number so far."""
    return spark.read.schema("failures long").parquet(f"{path}/failures").agg(F.coalesce(F.max("failures"), F.lit(0))).first()[0]
