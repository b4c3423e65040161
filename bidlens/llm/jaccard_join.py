"""N-gram Jaccard join by prefix filters under two global token orders.

Tokens are the distinct 3-word shingles of a text, as 64-bit digests.  Both orders put rare tokens first: tokens are ranked
by the level (logarithm) of their document frequency, within a level by one of two independent digests.  Of two texts at
or above the threshold, each prefix under each order holds a token of the other's: the first shared token.  Its places
in the two prefixes also bound the overlap that can still follow.  Candidates meet on a prefix token of the first order
with places that allow the threshold, must share a prefix token of the second, and only then are verified exactly.

Copies are joined once: texts with equal sets form a class and its smallest id stands for it.  Links are found in two
steps.  First every token's texts are compared with one hub, the text in which the token comes earliest (the one with the
fewest rare tokens): linear in the size of a group, and it connects what is similar.  Then every candidate pair that
still lies in different components is compared, so no link that would connect anything is missed.

Frequencies count all texts: executors sort their shingles into ranges of digests, which are summed range by range.
Levels are broadcast as a table of at most 16 MB, one cell for all digests that begin alike, with the highest level of its
tokens.  Any ranking gives the same links; levels only save candidates.

Null and empty texts have no shingles and link with nothing.  Rows with the same id share a component.  Rows without an id
have none.  Columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.components import components
from bidlens.llm.shingles import WordDigests, mixed, shingle_set, words_of
from bidlens.llm.tables import Scratch, released

FREQUENT = 4  # texts with a token from which it has a level
SLAB = 2_000_000  # shingles sorted at once
SECOND = np.uint64(0xD6E8FEB86659FD93)


def prefix_size(n: int, percent: int) -> int:
    """Tokens that must hold a shared one if two sets are at or above the threshold."""
    return n - -(-percent * n // 100) + 1


def range_bits(rows: int) -> int:
    """Ranges of digests: about as many as 256 texts fit into one, between 64 and 16 million."""
    return min(24, max(6, rows.bit_length() - 9))


def table_bits(rows: int) -> int:
    """Cells of the level table: 64 a text, at most 16 million."""
    return min(24, max(12, rows.bit_length() + 6))


def frequencies(texts: DataFrame, size: int, bits: int, wide: int) -> DataFrame:
    """(first, cells): pieces of the level table; a piece begins at cell ``first``.

    A cell's byte is 0, or 1 and more for tokens with a document frequency of ``FREQUENT`` and more.  A task sends a range's digests as sorted bytes (24 bits each) with counts, so that a shuffle of all shingles costs
    three to four bytes each.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n = WordDigests(), [], 0

        def sorted_ranges() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held) >> np.uint64(64 - bits - 24), return_counts=True)
            which, first = np.unique(tokens >> np.uint64(24), return_index=True)
            ends = np.append(first[1:], len(tokens))
            low = np.ascontiguousarray((tokens & np.uint64(0xFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
            few = np.minimum(counts, 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays(
                [pa.array(which.astype(np.int64)), pa.array([low[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                 pa.array([few[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], names=["range", "tokens", "counts"]
            )

        for batch in batches:
            for text in batch.column(0):
                held.append(shingle_set(seen.of(words_of(text.as_py(), lower=True)), size))
                n += len(held[-1])
                if n >= SLAB:
                    yield sorted_ranges()
                    held, n = [], 0
        if n:
            yield sorted_ranges()
        held.clear()
        seen.clear()
        released()

    def summed(table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint8).reshape(-1, 3).astype(np.int64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8)
        tokens, at = np.unique(raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16, return_inverse=True)
        df = np.bincount(at, counts).astype(np.int64)
        often = df >= FREQUENT
        level = (np.log2(df[often]) - np.log2(FREQUENT) + 1).astype(np.uint8)
        where = (tokens[often] | int(table.column("range")[0].as_py()) << 24) >> (bits + 24 - wide)
        first = int(where[0]) if len(where) else 0
        cells = np.zeros(int(where[-1]) - first + 1 if len(where) else 0, np.uint8)
        np.maximum.at(cells, where - first, level)
        return pa.table({"first": pa.array([first], pa.int64()), "cells": pa.array([cells.tobytes()], pa.binary())})

    parts = texts.select("text").mapInArrow(ranges, "range long, tokens binary, counts binary")
    return parts.groupBy("range").applyInArrow(summed, "first long, cells binary")


def level_table(pieces: DataFrame, wide: int) -> np.ndarray:
    """The whole table; what comes to the driver is its size."""
    table = np.zeros(1 << wide, np.uint8)
    for first, cells in pieces.toLocalIterator():
        part = np.frombuffer(cells, np.uint8)
        np.maximum(table[first:first + len(part)], part, out=table[first:first + len(part)])
    return table


def prefixes(tokens: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens under either order, in order."""
    size = prefix_size(len(tokens), percent)
    high = levels[tokens >> np.uint64(64 - int(len(levels)).bit_length() + 1)].astype(np.uint64) << np.uint64(58)
    out = []
    for digest in (tokens, mixed(tokens ^ SECOND)):
        key = high | (digest >> np.uint64(6))
        first = np.argpartition(key, size - 1)[:size] if size < len(key) else np.arange(len(key))
        out.append(tokens[first[np.argsort(key[first], kind="stable")]])
    return out[0], out[1]


def profiles(texts: DataFrame, levels, size: int, percent: int, wanted=None) -> DataFrame:
    """Of every row: id, set size, digest of the set and first prefix.

    With ``wanted``, a bitmap of id digests, of the rows in it instead: the second prefix and the set.
    """
    whole = wanted is not None
    schema = "doc_id long, n int, sig_a long, sig_b long, prefix array<long>" if not whole else "doc_id long, n int, second array<long>, tokens array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, table = WordDigests(), levels.value
        bitmap = wanted.value if whole else None
        longs = pa.list_(pa.int64())
        for batch in batches:
            if whole:
                slots = batch.column(2).to_numpy()
                batch = batch.filter(pa.array(bitmap[slots >> 3] >> (slots & 7).astype(np.uint8) & 1 == 1))
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, sig_a, sig_b, first, second, sets = [], [], [], [], [], []
                for text in part.column(1):
                    tokens = shingle_set(seen.of(words_of(text.as_py(), lower=True)), size)
                    n.append(len(tokens))
                    one, two = prefixes(tokens, table, percent) if len(tokens) else (tokens, tokens)
                    if whole:
                        second.append(two.view(np.int64))
                        sets.append(tokens.view(np.int64))
                    else:
                        digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
                        sig_a.append((digest >> 64) - (1 << 63))
                        sig_b.append((digest & (1 << 64) - 1) - (1 << 63))
                        first.append(one.view(np.int64))
                columns = [second, sets] if whole else [sig_a, sig_b, first]
                kinds = [longs, longs] if whole else [pa.int64(), pa.int64(), longs]
                names = ["second", "tokens"] if whole else ["sig_a", "sig_b", "prefix"]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), *arrays], names=["doc_id", "n", *names])
        seen.clear()
        released()

    slot = [slot_of(F.col("doc_id"), len(wanted.value)).alias("slot")] if whole else []
    return texts.select("doc_id", "text", *slot).mapInArrow(run, schema)


def slot_of(doc_id: Column, size: int) -> Column:
    """Bit of an id in a bitmap of ``size`` bytes."""
    return F.pmod(F.xxhash64(doc_id), F.lit(8 * size))


def bitmap_of(ids: DataFrame, wide: int) -> np.ndarray:
    """Bitmap of 2 ** wide bits (2 MB at most) with the slots of all ids; what comes to the driver is its size.

    It only keeps most texts without a candidate from being cut; an exact semi join follows.
    """
    size = max(1 << wide, 1 << 16) // 8

    def packed(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, np.uint8)
        bits[table.column("low").to_numpy()] = 1
        return pa.table({"piece": table.column("piece").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    slots = ids.select(slot_of(F.col("doc_id"), size).alias("slot")).distinct()
    pieces = slots.select(F.floor(F.col("slot") / 65536).alias("piece"), (F.col("slot") % 65536).cast("int").alias("low"))
    out = np.zeros(size, np.uint8)
    for piece, bits in pieces.groupBy("piece").applyInArrow(packed, "piece long, bits binary").toLocalIterator():
        out[piece * 8192:(piece + 1) * 8192] = np.frombuffer(bits, np.uint8)
    return out


def reachable(percent: int, n_a: Column, pos_a: Column, n_b: Column, pos_b: Column) -> Column:
    """Whether two sets whose first shared token has these places can be at or above the threshold."""
    return F.least(n_a - pos_a, n_b - pos_b) * (100 + percent) >= (n_a + n_b) * percent


def sets_of(pairs: DataFrame, known: DataFrame | None, texts: DataFrame, levels, size: int, percent: int, wide: int) -> DataFrame:
    """Second prefixes and whole sets of the texts in ``pairs`` (a, b) that are not known yet.  No text is shuffled."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    if known is not None:
        ids = ids.join(known.select("doc_id"), "doc_id", "left_anti")
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap_of(ids, wide))
    return profiles(texts, levels, size, percent, wanted).join(ids, "doc_id", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a token of the second order's prefixes and whose sets are at or above the threshold."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "second", "tokens")])
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.arrays_overlap("second_a", "second_b"))
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return joined.filter(both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent).select("a", "b").distinct()


def prepared(documents: DataFrame, size: int, percent: int, scratch: Scratch) -> tuple:
    """What the join starts from: texts, levels, bits of a bitmap, all rows, rows with shingles, classes, and places of shared tokens."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = rows.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    count = rows.select("doc_id").count()
    bits, wide = range_bits(count), table_bits(count)
    levels = spark.sparkContext.broadcast(level_table(scratch.keep(frequencies(texts, size, bits, wide), "levels"), wide))

    profiled = scratch.keep(profiles(rows, levels, size, percent), "profiles")
    every = scratch.keep(profiled.drop("prefix"), "documents")
    known = profiled.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = scratch.keep(
        known.groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "classes"
    )
    scratch.drop("profiles")
    known = every.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    places = classes.select(F.col("rep").alias("id"), "n", F.posexplode("prefix").alias("pos", "token"))
    shared = places.groupBy("token").agg(F.count("*").alias("texts")).filter("texts > 1").select("token")
    met = scratch.keep(places.join(shared, "token"), "met")
    return texts, levels, wide, every, known, classes, met


def links(documents: DataFrame, size: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """Every pair of different sets at or above the threshold, as (a, b) with a < b, and (doc_id, rep): the class of each text.

    A pair names the two classes' smallest ids; texts of one class are linked with each other.  Every candidate is verified,
    also within a component, so the work grows with the pairs of different texts that share a prefix token.  An id with
    several texts is a member of the class of each.
    """
    scratch = Scratch(documents.sparkSession, "links")
    texts, levels, wide, _, known, classes, met = prepared(documents, size, percent, scratch)
    side = lambda x: met.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "pos")])
    met_twice = side("a").join(side("b"), "token").filter(
        (F.col("id_a") < F.col("id_b")) & reachable(percent, F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"))
    )
    pairs = scratch.keep(met_twice.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "candidates")
    sets = scratch.keep(sets_of(pairs, None, texts, levels, size, percent, wide), "sets")
    members = known.select("doc_id", "sig_a", "sig_b").distinct().join(classes.select("sig_a", "sig_b", "rep"), ["sig_a", "sig_b"]).select("doc_id", "rep")
    return scratch.keep(verified(pairs, sets, percent), "links"), scratch.keep(members, "members")


def link_counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, n_links) of every id with shingles: linked texts of other classes and the others of its own; an id with several texts has the links of each."""
    sizes = members.groupBy("rep").agg(F.count("*").alias("size"))
    ways = pairs.union(pairs.select("b", "a")).toDF("rep", "other")
    linked = ways.join(sizes.toDF("other", "n"), "other").groupBy("rep").agg(F.sum("n").alias("n"))
    each = sizes.join(linked, "rep", "left").select("rep", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    return members.join(each, "rep").groupBy("doc_id").agg(F.sum("n_links").alias("n_links"))


def near_components(documents: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    scratch = Scratch(documents.sparkSession, "jaccard")
    texts, levels, wide, every, known, classes, met = prepared(documents, size, percent, scratch)

    hubs = met.groupBy("token").agg(F.min(F.struct("pos", "n", "id")).alias("hub"))
    near = met.join(hubs, "token").filter((F.col("id") != F.col("hub.id")) & reachable(percent, F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos")))
    stars = near.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()
    stars = scratch.keep(stars, "stars")
    sets = scratch.keep(sets_of(stars, None, texts, levels, size, percent, wide), "sets")
    grouped = components(scratch.keep(verified(stars, sets, percent), "star-links"), scratch, "grouped")

    apart = met.join(grouped, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = scratch.keep(apart, "apart")
    mixed_tokens = apart.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token")
    apart = apart.join(mixed_tokens, "token", "left_semi")
    side = lambda x: apart.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "pos", "component")])
    crossing = side("a").join(side("b"), "token").filter(
        (F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b"))
        & reachable(percent, F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"))
    )
    rest = crossing.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    rest = scratch.keep(rest, "rest")
    sets = sets.union(scratch.keep(sets_of(rest, sets, texts, levels, size, percent, wide), "more-sets"))
    more = scratch.keep(verified(rest, sets, percent), "more-links")
    merged = grouped.select(F.col("component").alias("a"), F.col("id").alias("b")).union(more)
    # rows of one id with different texts: their classes belong together
    same = known.select("doc_id", "sig_a", "sig_b").distinct().join(classes.select("sig_a", "sig_b", "rep"), ["sig_a", "sig_b"])
    same = scratch.keep(same.select("doc_id", "rep").distinct(), "members")
    merged = merged.union(same.filter(F.col("doc_id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    final = components(merged, scratch, "final")
    out = every.select("doc_id", F.col("n").cast("long").alias("n_shingles"))
    return out.join(final, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
