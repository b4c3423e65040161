"""Exact "text a holds text b" joins without comparing every pair.

A containing text must hold every part of the contained one, so both sides meet in an equi join on one such
part (an anchor) and only those pairs are verified.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions import text as tx

ANCHOR_TOKENS = 3
SHORT_PIECE = 5
CELLS = 1 << 16  # of the frequency sketch
BITS = 20  # the table of anchors has 2^20 bits

# workers get what a task needs of this module from the driver
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _piece(size: int, text: str, end) -> Column:
    """All pieces of ``size`` characters."""
    return F.transform(F.sequence(F.lit(1), end), lambda i: F.substring(F.col(text), i, F.lit(size)))


def _cells(digests: np.ndarray) -> np.ndarray:
    """The bit of each run of ANCHOR_TOKENS neighbouring digests of tokens."""
    out = np.zeros(max(len(digests) - ANCHOR_TOKENS + 1, 0), np.uint64)
    for i in range(ANCHOR_TOKENS):
        out = (out + digests[i : i + len(out)].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(64 - BITS)).astype(np.int64)


def _hits(batches, table: np.ndarray, names: list[str]):
    """Rows with the places of those of their runs whose bit is set; rows without any are left out."""
    for batch in batches:
        listed = batch["digests"]
        sizes = listed.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = np.flatnonzero(table[_cells(listed.flatten().to_numpy(zero_copy_only=False))])
        row = np.searchsorted(ends, at, "right")
        whole = at + ANCHOR_TOKENS <= ends[row]  # a run ends in the row in which it begins
        at, row = at[whole], row[whole]
        rows, starts = np.unique(row, return_index=True)
        places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(at - (ends - sizes)[row] + 1, pa.int32()))
        yield pa.RecordBatch.from_arrays([*[batch[c].take(pa.array(rows)) for c in names], places], [*names, "places"])


def anchor_bits(anchors: DataFrame) -> np.ndarray:
    """Table of BITS: which of them are set by the anchors.  Of fixed size; many anchors only make it let more through."""
    digests = anchors.select(F.transform(F.split("anchor", " "), lambda t: F.xxhash64(t)).alias("d"))
    one = digests.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(np.concatenate([_cells(np.array(d, np.int64)) for d in b["d"].to_pylist()] or [np.zeros(0, np.int64)]))], ["cell"]) for b in batches), "cell long")
    table = np.zeros(1 << BITS, bool)
    table[[r.cell for r in one.distinct().collect()]] = True
    return table


def anchored(hays: DataFrame, anchors: DataFrame) -> DataFrame:
    """Hays with an ``anchor``: a row for each of their runs of three tokens that may be one of the anchors."""
    table, names = anchor_bits(anchors), hays.columns
    rows = hays.withColumn("digests", F.transform(tx.raw_tokens(F.col("hay")), lambda t: F.xxhash64(t)))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in hays.schema.fields]
    kept = rows.mapInArrow(lambda batches: _hits(batches, table, names), ", ".join([*kinds, "places array<int>"]))
    runs = tx.let(tx.raw_tokens(F.col("hay")), lambda t: F.transform("places", lambda p: F.array_join(F.slice(t, p, ANCHOR_TOKENS), " ")))
    return kept.select(*names, F.explode(F.array_distinct(runs)).alias("anchor"))


def text_pairs(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """Pairs where ``hay`` contains ``needle``; other columns of both sides are kept.

    Anchor of a needle of five tokens or more: three neighbouring tokens inside it (not its edges, which may be part of a
    longer word in the hay), the longest such run: long tokens are rarer.  A table of bits, of fixed size, says which runs of
    a hay may be an anchor; only these, and hays that have some, go on.  Anchor of a shorter one: its first five
    characters, or all if it has fewer; the sizes that occur (five at most) are looked up first, so that no hay is cut
    into characters for nothing.  Empty needles are in every text and no pair is listed for them.
    """
    tokens = needles.withColumn("_t", tx.raw_tokens(F.col("needle")))
    inner = F.sequence(F.lit(2), F.size("_t") - ANCHOR_TOKENS)
    runs = F.transform(inner, lambda i: F.array_join(F.slice("_t", i, ANCHOR_TOKENS), " "))
    best = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"]
    left = tokens.filter(F.size("_t") >= ANCHOR_TOKENS + 2).select("needle_id", best.alias("anchor"))
    found = anchored(hays, left).join(left, "anchor").drop("anchor").join(needles, "needle_id")
    few = tokens.filter((F.size("_t") < ANCHOR_TOKENS + 2) & (F.length("needle") > 0)).withColumn("size", F.least(F.length("needle"), F.lit(SHORT_PIECE)))
    # only ids travel with the characters' anchors; the wide text is joined back for the few candidate pairs
    for size in sorted(r[0] for r in few.select("size").distinct().collect()):
        short = few.filter(F.col("size") == size).select("needle_id", F.substring("needle", 1, size).alias("anchor"))
        long = hays.filter(F.length("hay") >= size)
        pieces = long.select("hay_id", F.explode(F.array_distinct(_piece(size, "hay", F.length("hay") - size + 1))).alias("anchor"))
        candidates = pieces.join(short, "anchor").select("hay_id", "needle_id")
        found = found.unionByName(candidates.join(hays, "hay_id").join(needles, "needle_id"))
    return found.filter(F.col("hay").contains(F.col("needle")))


def pieces_of(text: str, size: int) -> Column:
    """The distinct pieces of ``size`` characters of a column that has at least so many."""
    return F.array_distinct(_piece(size, text, F.length(text) - size + 1))


def frequencies(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(cell, often): how many rows fall into each of ``CELLS`` cells of the keys' digests.

    A sketch of fixed size: a cell's count is that of its pieces together, never less than that of any of them.  Tasks
    count their rows first, so what moves is at most their cells.
    """
    return pieces.select(cell_of(keys)).groupBy("cell").agg(F.count("*").alias("often"))


def cell_of(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(CELLS)).alias("cell")


def rarest_anchors(short: DataFrame, pieces: DataFrame, on: list[str], size: int) -> DataFrame:
    """(on, short_key, anchor): of every distinct short key the piece that the longer side has least, by its sketch."""
    keys = [*on, "anchor"]
    own = short.select(*on, "short_key").distinct().withColumn("anchor", F.explode(pieces_of("short_key", size)))
    met = own.withColumn("cell", cell_of(keys)).join(frequencies(pieces, keys), "cell", "left")
    rank = F.struct(F.coalesce("often", F.lit(0)).alias("often"), F.col("anchor"))
    return met.groupBy(*on, "short_key").agg(F.min(rank)["anchor"].alias("anchor"))


def key_pairs(short: DataFrame, long: DataFrame, on: list[str], min_length: int = 5) -> DataFrame:
    """Pairs, equal on ``on``, where ``long_key`` holds ``short_key`` (at least ``min_length`` characters).

    Anchor: the piece of ``min_length`` characters of the short key that is rarest among those of the long keys, so that
    beginnings that many keys share don't bring them all together.
    """
    left = short.filter(F.length("short_key") >= min_length)
    right = long.filter(F.length("long_key") >= min_length).withColumn("anchor", F.explode(pieces_of("long_key", min_length)))
    left = left.join(rarest_anchors(left, right.select(*on, "anchor"), on, min_length), [*on, "short_key"])
    return left.join(right, [*on, "anchor"]).filter(F.col("long_key").contains(F.col("short_key"))).drop("anchor")
