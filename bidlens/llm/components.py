"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.llm.tables import Scratch


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """Points neighbours at the least of a node and its neighbours: those above the node, or (small) those below and itself.

    The minimum is an aggregate with map-side combining and goes back by a join, so that no neighbourhood is gathered.
    """
    if small:
        around = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    else:
        around = links.select(F.col("b").alias("u"), F.col("a").alias("v")).union(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if small:
        out = joined.select("m", "v").union(least.select("m", F.col("u").alias("v")))
    else:
        out = joined.filter(F.col("v") > F.col("u")).select("m", "v")
    return out.filter(F.col("m") != F.col("v")).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b) that is not the least of its component."""
    rows = links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    state = lambda frame: frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    rows = scratch.keep(rows, f"{name}-0")
    seen, n = state(rows), 0
    while seen[0]:
        n += 1
        rows = scratch.keep(_stars(_stars(rows, small=False), small=True), f"{name}-{n}")
        scratch.drop(f"{name}-{n - 1}")
        found = state(rows)
        if found == seen:
            break
        seen = found
    return rows.select(F.col("b").alias("id"), F.col("a").alias("component"))
