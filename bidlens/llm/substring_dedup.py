"""Repeated word windows found by recompression.

Rounds name runs of one word and then pairs of neighbours by digests of their content, so that equal substrings get equal
symbols everywhere but near their ends.  Which pairs merge is decided by one bit of each symbol's digest.  A window of
words therefore has a core, symbols that its own words determine whatever stands around it; the core's longest symbol of
the highest round (least digest among equals) reveals the window.  Symbols that occur in one document only end there.
Windows with a symbol that documents share are verified by the digest of all their words (64 bits).

Every word covered by a window whose words also start in a document with a smaller id is removed.  Windows are judged on
the input.

Documents are dealt into blocks by a digest of their id, written once as a table bucketed by block; each round reads it
without a shuffle.  A block sends its distinct symbols, then its distinct suspected windows with their smallest document,
as sorted byte strings by range of digests.  A range looks over all blocks and answers with one bit an entry: shared, or
known to a smaller document.  However often a passage occurs, a block sends it once.

Null and empty texts have no words.  Repeated rows (same id) are judged alike and never against each other.  Rows without
an id are kept whole and support nothing.  Columns other than id and text are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.llm.shingles import STEP, WordDigests, grams, mixed, words_of
from bidlens.llm.tables import Scratch, released

ROUNDS = 3
BLOCK_CHARS = 2_000_000  # characters of text in a block
RANGE_ENTRIES = 2_000_000  # entries of all blocks that a range looks over, about


def window_keys(digests: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, key) of every window of ``size`` words within one document."""
    n = len(digests)
    start = np.flatnonzero(doc[:n - size + 1] == doc[size - 1:]) if n >= size else np.zeros(0, np.int64)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    symbol, length, of, a, b = digests, np.ones(n, np.uint64), doc, start, start + size
    levels = []
    for turn in range(ROUNDS):
        if turn == 0:  # runs: the first and the last may go on outside the window
            first = np.append(True, (symbol[1:] != symbol[:-1]) | (of[1:] != of[:-1]))
            at, run = np.flatnonzero(first), np.cumsum(first) - 1
            times = np.diff(np.append(at, n)).astype(np.uint64)
            symbol = np.where(times > 1, mixed(symbol[at] * STEP + times), symbol[at])
            length, of, a, b = times, of[at], run[a] + 1, run[b - 1]
        right = (mixed(symbol ^ np.uint64(turn + 1)) & np.uint64(1)).astype(bool)
        merges = np.flatnonzero(~right[:-1] & right[1:] & (of[:-1] == of[1:]))
        first = np.ones(len(symbol), bool)
        first[merges + 1] = False
        at, place = np.flatnonzero(first), np.append(np.cumsum(first) - 1, first.sum())
        alive = a < b
        head, tail = np.minimum(a, len(symbol) - 1), np.maximum(b - 1, 0)
        # a right half may belong to what stands before the window, a left half to what comes after
        a, b = np.where(right[head], place[head + 1], place[head]), np.where(right[tail], place[tail] + 1, place[tail])
        a = np.where(alive, a, b)
        named, lengths = symbol[at], length[at]
        named[place[merges]] = mixed(symbol[merges] * STEP + symbol[merges + 1])
        lengths[place[merges]] += length[merges + 1]
        symbol, length, of = named, lengths, of[at]
        levels.append((a, b, (np.minimum(length, np.uint64(127)) << np.uint64(56)) | (symbol >> np.uint64(8))))
    key = grams(digests, size)[start]
    open_ = np.ones(len(start), bool)
    for a, b, rank in reversed(levels):
        which = np.flatnonzero(open_ & (a < b))
        lo, hi = a[which], b[which]
        best = rank[lo]
        for k in range(1, int((hi - lo).max(initial=1))):
            here = lo + k < hi
            best[here] = np.maximum(best[here], rank[lo[here] + k])
        key[which] = mixed(best)
        open_[which] = False
    return start, key


class Block:
    """The documents of one block: words, windows, symbols."""

    def __init__(self, table: pa.Table, size: int):
        self.size, seen = size, WordDigests()
        self.ids, self.words = table.column("doc_id").to_pylist(), [words_of(t) for t in table.column("text").to_pylist()]
        counts = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(counts) - counts
        self.digests = np.concatenate([seen.of(w) for w in self.words]) if len(counts) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        judged = np.array([i is not None for i in self.ids], bool)
        self.start, self.key = window_keys(self.digests, self.doc, size)
        keep = judged[self.doc[self.start]] if len(self.start) else np.zeros(0, bool)
        self.start, self.key = self.start[keep], self.key[keep]
        self.id = np.array([i or 0 for i in self.ids], np.int64)

    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, ascending, and whether two documents of this block have it (2) or one (1)."""
        ids = self.id[self.doc[self.start]]
        changes = np.append(True, (self.key[1:] != self.key[:-1]) | (ids[1:] != ids[:-1]))[:len(ids)]
        key, ids = self.key[changes], ids[changes]
        keys, at = np.unique(key, return_inverse=True)
        low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, at, ids)
        np.maximum.at(high, at, ids)
        return keys, np.where(low < high, 2, 1).astype(np.uint8)

    def suspects(self, shared: np.ndarray) -> None:
        """Keeps windows whose key is shared; ``shared`` has a bit for each distinct key."""
        keys, _ = self.symbols()
        self.start = self.start[shared[np.searchsorted(keys, self.key)]] if len(keys) else self.start
        self.window = grams(self.digests, self.size)[self.start]
        self.owner = self.id[self.doc[self.start]]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct suspected windows, ascending, and the smallest document of this block with each."""
        found, at = np.unique(self.window, return_inverse=True)
        low = np.full(len(found), np.iinfo(np.int64).max)
        np.minimum.at(low, at, self.owner)
        return found, low

    def removed(self, known: np.ndarray) -> np.ndarray:
        """Marks words covered by a window of a smaller document; ``known`` has a bit for each distinct window."""
        found, low = self.windows()
        steps = np.zeros(len(self.digests) + 1, np.int64)
        if len(found):
            at = np.searchsorted(found, self.window)
            gone = self.start[known[at] | (self.owner > low[at])]
            np.add.at(steps, gone, 1)
            np.add.at(steps, gone + self.size, -1)
        return np.cumsum(steps[:-1]) > 0


def by_range(block: int, values: np.ndarray, extra: np.ndarray, bits: int) -> pa.Table:
    """Ascending values by their first bits; bytes of a column stand plane by plane, so that equal ones compress."""
    which, first = np.unique(values >> np.uint64(64 - bits), return_index=True)
    ends = np.append(first[1:], len(values))
    plane = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return pa.table({
        "block": pa.array(np.full(len(which), block), pa.int64()), "range": pa.array(which.astype(np.int64)),
        "entries": pa.array([plane(values[a:b]) for a, b in zip(first, ends)], pa.binary()),
        "extra": pa.array([plane(extra[a:b]) for a, b in zip(first, ends)], pa.binary()),
    })


def planes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def answered(table: pa.Table, kind: str) -> pa.Table:
    """One range over all blocks: a bit for every entry of every block.

    ``symbols``: two documents have it.  ``windows``: a document smaller than the block's smallest has it.
    """
    entries = [planes(v, np.uint64) for v in table.column("entries").to_pylist()]
    extra = [planes(v, np.uint8 if kind == "symbols" else np.int64) for v in table.column("extra").to_pylist()]
    values, at = np.unique(np.concatenate(entries), return_inverse=True)
    if kind == "symbols":
        yes = np.bincount(at, np.concatenate(extra)) > 1
        bits = yes[at]
    else:
        owners = np.concatenate(extra)
        low = np.full(len(values), np.iinfo(np.int64).max)
        np.minimum.at(low, at, owners)
        bits = low[at] < owners
    ends = np.cumsum([len(e) for e in entries])
    return pa.table({
        "block": table.column("block"), "kind": [kind] * len(entries), "range": table.column("range"),
        "n": pa.array([len(e) for e in entries], pa.int32()), "bits": pa.array([np.packbits(p).tobytes() for p in np.split(bits, ends[:-1])], pa.binary()),
    })


ANSWER = "block long, kind string, range long, n int, bits binary"
ENTRIES = "block long, range long, entries binary, extra binary"


def bits_of(answers: pa.Table, kind: str) -> np.ndarray:
    rows = sorted((r, n, b) for k, r, n, b in zip(*[answers.column(c).to_pylist() for c in ("kind", "range", "n", "bits")]) if k == kind)
    return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for _, n, b in rows]).astype(bool) if rows else np.zeros(0, bool)


def pieces(words: list[bytes], gone: np.ndarray) -> bytes:
    return b" ".join([w for w, g in zip(words, gone) if not g]) if gone.any() else b" ".join(words)


def without_repeats(documents: DataFrame, size: int = 13, carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row: ``kept`` is what stays, words joined by one space.

    Columns named in ``carry`` stay with their row.  With ``whole``, texts that lose nothing stay as they are.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "substrings")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    chars, count = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    n_blocks = max(1, min(chars // BLOCK_CHARS + 1, count))
    buckets = int(min(max(1, n_blocks // 4), 10_000))
    bits = max(4, int(chars // 6 // 5 // RANGE_ENTRIES).bit_length())
    name = f"blocks_{uuid.uuid4().hex}"
    block = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(n_blocks)).alias("block")
    dealt = rows.select(block, "doc_id", "text", *carry).repartition(buckets, "block")
    dealt.write.bucketBy(buckets, "block").option("path", f"{scratch.folder}/blocks").saveAsTable(name)
    blocks = spark.table(name)

    def symbols(key: tuple, table: pa.Table) -> pa.Table:
        out = by_range(key[0].as_py(), *Block(table, size).symbols(), bits)
        released()
        return out

    def suspects(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        found = Block(table, size)
        found.suspects(bits_of(answers, "symbols"))
        out = by_range(key[0].as_py(), *found.windows(), bits)
        del found
        released()
        return out

    def result(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        found = Block(table, size)
        found.suspects(bits_of(answers, "symbols"))
        gone = found.removed(bits_of(answers, "windows"))
        each = [gone[a:a + len(w)] for a, w in zip(found.first, found.words)]
        out = pa.table({
            "doc_id": table.column("doc_id"), "n_words": pa.array([len(w) for w in found.words], pa.int64()),
            "n_removed": pa.array([int(g.sum()) for g in each], pa.int64()),
            "kept": pa.array([t if whole and not g.any() else pieces(w, g).decode() for t, w, g in zip(table.column("text").to_pylist(), found.words, each)], pa.string()),
            **{c: table.column(c) for c in carry},
        })
        del found, gone, each
        released()
        return out

    def of_range(kind: str):
        return lambda table: answered(table, kind)

    shared = blocks.groupBy("block").applyInArrow(symbols, ENTRIES).groupBy("range").applyInArrow(of_range("symbols"), ANSWER)
    shared = scratch.keep(shared, "shared")
    windows = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(suspects, ENTRIES)
    known = scratch.keep(windows.groupBy("range").applyInArrow(of_range("windows"), ANSWER), "known")
    answers = shared.union(known)
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()), *[rows.schema[c] for c in carry],
    ])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(result, schema)


def repeat_table(documents: DataFrame, size: int = 13) -> DataFrame:
    return without_repeats(documents, size).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
