"""Benchmark decontamination by SimHash of item-sized windows.

For every size that a benchmark item has (in words), windows of that size slide over the whole text; a text with fewer
words is one window.  A window's fingerprint
is the SimHash (64 bits) of its 5-word shingles, weighted by how often they occur in it.  Fingerprints of items stand in a
multi-index: eight blocks of eight bits.  Two fingerprints within ``RADIUS`` differ by at most RADIUS // 8 bits in some
block, so that looking up, for each block, all values that near finds every item within the radius.  Candidates are then
verified by the exact weighted Jaccard similarity of shingles, sum of minima over sum of maxima, at ``THRESHOLD`` or more.

A window can only reach the threshold if that share of an item's shingle weight lies in it.  Counting shingles that occur
in any item tells where this holds, and only there windows are fingerprinted: it loses nothing.

Words are lower-cased (A-Z).  Items with fewer than five words are one shingle.  Items of more than ``ITEM_CHARS``
characters together are taken in several passes over the documents, one after the other, so what executors and the driver
hold is bounded.

Null and empty texts hold no item, null and empty items are in no text; items with the same text are each reported.
Repeated rows are judged each.  Columns other than ids and texts are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.shingles import WordDigests, grams, words_of
from bidlens.llm.tables import Scratch, released

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 23
BLOCKS = 8
ITEM_CHARS = 20_000_000
POPCOUNT = np.array([bin(v).count("1") for v in range(256)], np.uint8)


def simhash(shingles: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingle digests: for each bit, whether more occurrences have it set than not."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(*shingles.shape, 8), axis=2)
    return np.packbits(bits.sum(1, dtype=np.int32) * 2 > shingles.shape[1], axis=1)


def weights(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][at_a], b[1][at_b]).sum())
    return least / (int(a[1].sum()) + int(b[1].sum()) - least)


class SizeIndex:
    """Items of one size in words."""

    def __init__(self, size: int, items: list[tuple[int, np.ndarray]]):
        self.size, self.items = size, [(i, weights(s)) for i, s in items]
        self.fingerprints = simhash(np.stack([s for _, s in items]))
        # near[block][value]: items whose block differs from the value by at most RADIUS // BLOCKS bits
        values = np.arange(256, dtype=np.uint8)
        self.near = [POPCOUNT[values[:, None] ^ self.fingerprints[None, :, b]] <= RADIUS // BLOCKS for b in range(BLOCKS)]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        met = self.near[0][prints[:, 0]]
        for b in range(1, BLOCKS):
            met = met | self.near[b][prints[:, b]]
        window, item = np.nonzero(met)
        near = POPCOUNT[prints[window] ^ self.fingerprints[item]].sum(1, dtype=np.int32) <= RADIUS
        return window[near], item[near]


class Index:
    def __init__(self, items: list[tuple[int, str]]):
        seen, by_size = WordDigests(), {}
        for item_id, text in items:
            words = words_of(text, lower=True)
            if words:
                digests = seen.of(words)
                by_size.setdefault(len(words), []).append((item_id, grams(digests, min(SHINGLE, len(words)))))
        self.sizes = [SizeIndex(size, rows) for size, rows in sorted(by_size.items())]
        self.known = {k: np.unique(np.concatenate([s for size, rows in by_size.items() if min(size, SHINGLE) == k for _, s in rows] or [np.zeros(0, np.uint64)])) for k in range(1, SHINGLE + 1)}
        self.slots = {k: self._slots(v) for k, v in self.known.items() if len(v)}

    @staticmethod
    def _slots(known: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << 20, bool)
        table[known >> np.uint64(44)] = True
        return table

    def hits(self, text: str, seen: WordDigests) -> list[dict]:
        """Best window of every item that the text holds."""
        words = words_of(text, lower=True)
        if not words or not self.sizes:
            return []
        digests, best = seen.of(words), {}
        for k, table in self.slots.items():
            shingles = grams(digests, k)
            in_items = table[shingles >> np.uint64(44)]
            if not in_items.any():
                continue
            found = shingles[in_items]
            at = np.searchsorted(self.known[k], found)
            in_items[in_items] = self.known[k][np.minimum(at, len(self.known[k]) - 1)] == found
            total = np.append(0, np.cumsum(in_items))
            for index in self.sizes:
                of_size = index.size - k + 1
                if min(index.size, SHINGLE) != k or total[-1] < THRESHOLD * of_size:
                    continue
                n = min(of_size, len(shingles))  # a text shorter than the item is one window
                at = np.flatnonzero(total[n:] - total[:-n] >= THRESHOLD * of_size)
                for part in range(0, len(at), 4096):
                    starts = at[part:part + 4096]
                    rows = np.lib.stride_tricks.sliding_window_view(shingles, n)[starts]
                    for window, item in zip(*index.candidates(simhash(rows))):
                        item_id, of_item = index.items[item]
                        alike = similarity(weights(rows[window]), of_item)
                        if alike >= THRESHOLD and (item_id not in best or alike > best[item_id]["similarity"]):
                            best[item_id] = {"item_id": item_id, "start": int(starts[window]), "n_words": min(index.size, len(words)), "similarity": alike}
        return [best[i] for i in sorted(best)]


HITS = "array<struct<item_id: long, start: long, n_words: int, similarity: double>>"


def indexes(benchmark: DataFrame, item_chars: int = ITEM_CHARS) -> Iterator[tuple[Index, bool]]:
    """Items in groups of about ``item_chars`` characters, one after the other, and whether it is the last; one group unless
    the benchmark is larger."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    groups = int(total // item_chars) + 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(groups))
    for g in range(groups):
        yield Index([tuple(r) for r in items.filter(part == g).orderBy("item_id", "text").collect()]), g == groups - 1


def held_items(index: Index, text: str | Column = "text") -> Column:
    """Items that each text holds, with the best window's first word and similarity."""

    @F.pandas_udf(HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = WordDigests()
        for texts in batches:
            yield pd.Series([index.hits(t or "", seen) for t in texts], dtype="object")
        seen.clear()
        released()

    return hits(F.col(text) if isinstance(text, str) else text)


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): every item that a document holds, with its best window."""
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    scratch, out, n = Scratch(documents.sparkSession, "decontamination"), None, 0
    for index, last in indexes(benchmark):
        part = texts.select("doc_id", F.explode(held_items(index)).alias("hit")).select("doc_id", "hit.*")
        part = part if last else scratch.keep(part, f"hits-{n}")  # the driver forgets an index before it makes the next
        out, n = part if out is None else out.unionByName(part), n + 1
        del index, part
    return out


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows whose text holds no item; all columns as they are."""
    scratch, n = Scratch(documents.sparkSession, "decontamination"), 0
    for index, last in indexes(benchmark):
        documents = documents.filter(F.size(held_items(index, F.col("text").cast("string"))) == 0)
        if not last:
            documents = scratch.keep(documents, f"left-{n}")
            if n:
                scratch.drop(f"left-{n - 1}")
        n += 1
        del index
    return documents
