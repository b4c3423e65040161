"""Labelled rows that classifiers learn from: a bounded sample, never a held-out row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.llm.tables import held_out


def sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int) -> tuple[list[str], np.ndarray, float]:
    """Texts and 0/1 labels of at most ``per_class`` rows of each class, chosen by a seeded hash of the id; and the
    share of class 1 among all rows that may be learned from.

    Ids are chosen from the narrow label table; then only their texts are read.  Rows without id, label or text are left
    out, of repeated rows one is taken.
    """
    given = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    share = given.agg(F.avg("y")).first()[0] or 0.0
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = [given.filter(F.col("y") == y).withColumn("o", order).orderBy("o", "doc_id").limit(per_class) for y in (0, 1)]
    ids = chosen[0].union(chosen[1]).select("doc_id", "y", "o")
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    found = texts.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).orderBy("o", "doc_id").select("text", "y").collect()
    return [r.text for r in found], np.array([r.y for r in found], dtype=np.float32), share


def best_threshold(scores: np.ndarray, labels: np.ndarray, share: float = 0.5) -> float:
    """The cut with most right decisions where a ``share`` of rows is of class 1, midway between two scores."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    below_0, below_1 = np.cumsum(1 - y), np.cumsum(y)
    right = (1 - share) * below_0 / max(below_0[-1], 1) + share * (1 - below_1 / max(below_1[-1], 1))
    k = int(np.argmax(right))
    return float(s[k] + s[min(k + 1, len(s) - 1)]) / 2
