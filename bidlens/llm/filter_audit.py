"""How five filters interact: what each removes at each step of each of the 120 orders they can run in.

Every text becomes a mask of the filters it fails, and every part (source) counts its rows by mask, so 32 counts a part
stand for all its rows.  Permutations in lexicographic order are numbered by their Lehmer rank; those that share a prefix
of s filters are one interval of (5 - s)! ranks.  A mask is removed at step s by exactly the orders whose first s - 1
filters it passes and whose s-th it fails, a union of such intervals.  So a part's totals are difference arrays: its counts
are added at each interval's start and taken off at its end, and a prefix sum over the 120 ranks gives every order at once.

Null texts count as empty, null sources as the empty string.  Rows without an id have no labels, repeat nothing and are
repeated by nothing; rows that repeat an id with the same text do not fail E for each other.  Where an id has several
labels, any 1 counts.  An empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens.llm.tables import BLANKS

FILTERS = "ABCDE"
N = len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]  # position = Lehmer rank
COUNTS = ("rows", "good", "toxic")
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
PARTS = 256  # parts whose totals are computed at once
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in (*MEASURES, "shapley"))


def lehmer_rank(order: str) -> int:
    """Number of permutations of the same letters that sort before this one."""
    return sum(sum(later < letter for later in order[i + 1:]) * factorial(len(order) - 1 - i) for i, letter in enumerate(order))


def intervals(length: int) -> Iterator[tuple[str, int, int]]:
    """(prefix, first rank, rank after the last) of every ordered choice of ``length`` filters."""
    for prefix in permutations(FILTERS, length):
        first = lehmer_rank("".join(prefix) + "".join(sorted(set(FILTERS) - set(prefix))))
        yield "".join(prefix), first, first + factorial(N - length)


def interval_ends() -> dict[str, np.ndarray]:
    """What each mask adds where: measure -> rows (mask, step, first rank, rank after the last)."""
    ends: dict[str, list[tuple[int, int, int, int]]] = {"kept": [], "removed": [], "redundant": [], "unique_fails": []}
    for step in range(1, N + 1):
        for prefix, first, after in intervals(step):
            seen = [1 << FILTERS.index(letter) for letter in prefix]
            last, earlier = seen[-1], sum(seen[:-1])
            for mask in range(1 << N):
                at = (mask, step - 1, first, after)
                if not mask & (earlier | last):
                    ends["kept"].append(at)
                elif mask & last:
                    ends["redundant" if mask & earlier else "removed"].append(at)
                if mask == last:
                    ends["unique_fails"].append(at)
    return {name: np.array(rows) for name, rows in ends.items()}


def totals(counts: np.ndarray) -> np.ndarray:
    """(parts, 120 ranks, 5 steps, 7 measures) from the counts (parts, 32 masks, 3) of rows, good and toxic ones."""
    ends = interval_ends()
    plan = [(name, ends.get(name, ends["removed"]), {"good_lost": 1, "toxic_lost": 2}.get(name, 0)) for name in MEASURES]
    out = np.zeros((len(counts), len(ORDERS) + 1, N, len(MEASURES) + 1), np.int64)
    for k, (_, rows, column) in enumerate(plan):
        mask, step, first, after = rows.T
        added = counts[:, mask, column]
        np.add.at(out, (slice(None), first, step, k), added)
        np.subtract.at(out, (slice(None), after, step, k), added)
    out = np.cumsum(out, axis=1)[:, :-1]
    filters = np.array([[FILTERS.index(letter) for letter in order] for order in ORDERS])
    for f in range(N):
        out[:, filters == f, -1] = out[:, filters == f, 1].sum(axis=1)[:, None]
    return out


def failures(text: Column, words: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text fails."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < 200, F.size(F.array_distinct(words)) * 100 < n * 50, capitals.cast("long") * 100 > F.length(text) * 2, text.rlike(r"[#$%&*|]"))
    return sum((F.when(fail, 1 << bit).otherwise(0) for bit, fail in enumerate(fails)), F.lit(0))


def mask_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, rows, good, toxic), one row for each mask that occurs in a part.

    Texts stay in the scan: what moves is a digest, the bits, the id and the part.  Equal texts have equal bits, so that a
    group of copies is counted per part and label before it meets; its smallest id alone passes E.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failures(F.col("text"), F.col("words")).alias("bits"))
    rows = rows.groupBy("doc_id", "part", "digest", "bits").agg(F.count("*").alias("n"))
    is_one = lambda name: F.max(F.coalesce((F.col(name) == 1).cast("int"), F.lit(0))).alias(name)
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    marked = rows.filter(F.col("doc_id").isNotNull()).join(marks.withColumnsRenamed({"quality": "good"}), "doc_id", "left").fillna(0, ["good", "toxic"])
    counted = marked.groupBy("digest", "bits", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least")  # an id is one row here for each part and text
    )
    first = F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("digest"))
    split = counted.withColumn("passing", F.when(first, F.col("least.n")).otherwise(0))
    lone = rows.filter(F.col("doc_id").isNull()).select("part", F.col("bits").alias("mask"), "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    by_mask = lone
    for e, n in ((0, F.col("passing")), (1 << N - 1, F.col("n") - F.col("passing"))):
        by_mask = by_mask.unionByName(split.select("part", (F.col("bits") + e).alias("mask"), n.alias("n"), "good", "toxic"))
    total = lambda n, name: F.sum(n).cast("long").alias(name)
    return by_mask.groupBy("part", "mask").agg(
        total(F.col("n"), "rows"), total(F.col("n") * F.col("good"), "good"), total(F.col("n") * F.col("toxic"), "toxic")
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step, zeros included."""
    parts = mask_counts(documents, labels).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("masks"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = pa.array([o for o in ORDERS for _ in range(N)])
        step = pa.array(list(range(1, N + 1)) * len(ORDERS), pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                part = batch.slice(at, PARTS)
                lists = part.column(1)
                counts = np.zeros((part.num_rows, 1 << N, len(COUNTS)), np.int64)
                owner, flat = lists.value_parent_indices().to_numpy(), lists.flatten()
                for k, name in enumerate(COUNTS):
                    counts[owner, flat.field("mask").to_numpy(), k] = flat.field(name).to_numpy()
                found = totals(counts).reshape(part.num_rows, len(step), -1)
                for name, values in zip(part.column(0), found):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()] * len(step)), order, step, *map(pa.array, values.T.copy())], names=["part", "filter_order", "step", *MEASURES, "shapley"]
                    )

    return parts.mapInArrow(run, SCHEMA)


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), fails AS (
  SELECT t.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic, {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 2 * length(t.text), 'D': regexp_matches(t.text, '[#$%&*|]'),
    'E': coalesce(t.doc_id > f.first, false)} AS f
  FROM texts t JOIN firsts f ON f.text = t.text LEFT JOIN marks m ON m.doc_id = t.doc_id
), masks AS (
  SELECT part, concat(CASE WHEN f.A THEN 'A' END, CASE WHEN f.B THEN 'B' END, CASE WHEN f.C THEN 'C' END, CASE WHEN f.D THEN 'D' END,
    CASE WHEN f.E THEN 'E' END) AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS this, filter_order[1:step - 1] AS earlier FROM orders, unnest(range(1, 6)) AS s(step)
), every AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, this, n, good, toxic, contains(failed, this) AS fails, failed = this AS alone,
    failed <> '' AND regexp_matches(failed, '[' || earlier || '_]') AS gone
  FROM masks, steps
), sums AS (
  SELECT part, filter_order, step, this, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM every GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, this) AS BIGINT) AS shapley FROM sums
"""
