"""Document quality from a linear-chain conditional random field over lines.

Every line that holds a word is labelled good or bad.  A line's features are shares (symbols, capitals, repeated words and
so on) put into bins, its own and those of the lines before and after it; neighbouring labels are tied by a transition
table.  Training has no labels of lines: all lines of a text carry the text's label, on a bounded sample of labelled rows
(``PER_CLASS`` of each class at most).  A text's raw quality is the mean of its lines' marginals of being good, from
forward-backward and weighted by length; a logistic fit on rows kept from training turns it into a score.

Null and empty texts have no lines; their raw quality is 0.  If a class has no labelled row, every score is 0.5.
Repeated rows get the same score; columns other than id and text are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.labelled import best_threshold, sample
from bidlens.llm.tables import held_out

PER_CLASS = 3000
CUT = 0.7  # the score at which a text counts as good
SYMBOLS = str.maketrans("", "", "#*$%&<>^~=@+\\/{}[]_")
BINS = 8
FEATURES = 12


def measure(line: str, words: list[str], earlier: set[str]) -> tuple[float, ...]:
    """Shares and means of one line; no position, language or source."""
    n, chars = len(words), sum(map(len, words))
    upper = sum(map(str.isupper, words))
    distinct = Counter(words)
    return (
        math.log1p(n), chars / n, (len(line) - len(line.translate(SYMBOLS))) / n, line.count("|") / n, line.count("!") / n, upper / n,
        1 - len(distinct) / n, max(distinct.values()) / n, sum(map(str.__eq__, words, words[1:])) / n, sum(map(str.isdigit, words)) / n,
        (line.count(".") + line.count(",")) / n, float(line in earlier),
    )


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(measures, lengths) of the lines with a word."""
    rows, sizes, earlier = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        if words:
            rows.append(measure(line, words, earlier))
            sizes.append(len(line))
            earlier.add(line)
    return np.array(rows, dtype=np.float64).reshape(-1, FEATURES), np.array(sizes, dtype=np.float64)


@dataclass
class Model:
    edges: list[np.ndarray]  # bin edges of each measure
    weights: np.ndarray  # of each feature for the label good against bad
    transitions: np.ndarray  # (before, after), labels bad 0 and good 1
    slope: float
    offset: float


def features(edges: list[np.ndarray], measures: np.ndarray) -> np.ndarray:
    """Feature numbers of every line: own bins, the bins of the line before and of the line after, a last one always on."""
    n, block = len(measures), FEATURES * BINS
    own = np.stack([np.searchsorted(edges[k], measures[:, k], side="right") + k * BINS for k in range(FEATURES)], 1)
    missing = 3 * block
    before = np.concatenate([np.full((1, FEATURES), missing), own[:-1] + block])
    after = np.concatenate([own[1:] + 2 * block, np.full((1, FEATURES), missing + 1)])
    return np.concatenate([own, before, after, np.full((n, 1), missing + 2)], 1)


N_FEATURES = 3 * FEATURES * BINS + 3


def marginals(scores: list[float], t: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """P(good) of every line and the expected transitions, by forward-backward on ratios good : bad."""
    n = len(scores)
    e = [[math.exp(v) for v in row] for row in t]
    forward = [(0.0, 0.0)] * n
    for i, s in enumerate(scores):
        g = math.exp(min(max(s, -30.0), 30.0))
        if i:
            b0, b1 = forward[i - 1]
            bad, good = b0 * e[0][0] + b1 * e[1][0], (b0 * e[0][1] + b1 * e[1][1]) * g
        else:
            bad, good = 1.0, g
        total = bad + good
        forward[i] = bad / total, good / total
    out, pairs = [0.0] * n, [[0.0, 0.0], [0.0, 0.0]]
    back = (1.0, 1.0)
    for i in range(n - 1, -1, -1):
        f0, f1 = forward[i]
        z = f0 * back[0] + f1 * back[1]
        out[i] = f1 * back[1] / z
        if i:
            g = math.exp(min(max(scores[i], -30.0), 30.0))
            p0, p1 = forward[i - 1]
            cells = [[p0 * e[0][0] * back[0], p0 * e[0][1] * g * back[1]], [p1 * e[1][0] * back[0], p1 * e[1][1] * g * back[1]]]
            z = cells[0][0] + cells[0][1] + cells[1][0] + cells[1][1]
            for a in (0, 1):
                for b in (0, 1):
                    pairs[a][b] += cells[a][b] / z
            n0, n1 = e[0][0] * back[0] + e[0][1] * g * back[1], e[1][0] * back[0] + e[1][1] * g * back[1]
            back = n0 / (n0 + n1), n1 / (n0 + n1)
    return out, pairs


def raw_quality(model: Model, text: str) -> float:
    measures, sizes = lines_of(text)
    if not len(sizes):
        return 0.0
    good, _ = marginals(model.weights[features(model.edges, measures)].sum(1).tolist(), model.transitions.tolist())
    return float(np.dot(good, sizes) / sizes.sum())


def squash(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def train(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 3, epochs: int = 6, rate: float = 0.05) -> Model:
    """Stochastic gradient of the conditional log likelihood; a text counts once however many lines it has."""
    every = np.concatenate([m for m, _ in texts if len(m)])
    edges = [np.unique(np.quantile(every[:, k], np.arange(1, BINS) / BINS)) for k in range(FEATURES)]
    given = [features(edges, m) if len(m) else None for m, _ in texts]
    weights, t = np.zeros(N_FEATURES), np.zeros((2, 2))
    rng = np.random.default_rng(seed)
    share = [len(y) / (2 * max((y == label).sum(), 1)) for label in (0, 1)]
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(len(y)):
            if given[i] is None:
                continue
            label, n = int(y[i]), len(given[i])
            good, pairs = marginals(weights[given[i]].sum(1).tolist(), t.tolist())
            pull = step * share[label] / math.sqrt(n)
            np.add.at(weights, given[i].ravel(), np.repeat(pull * (label - np.array(good)), given[i].shape[1]))
            seen = np.zeros((2, 2))
            seen[label, label] = n - 1
            t += pull * 0.1 * (seen - np.array(pairs))
            weights *= 1 - 1e-4 * step
            np.clip(t, -3, 3, out=t)
    return Model(edges, weights, t, 1.0, 0.0)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 3) -> Model | None:
    """Learns from at most ``per_class`` labelled rows of each class; a quarter of them only calibrates."""
    texts, y, share = sample(documents, labels, "quality", per_class, seed)
    if len(set(y.tolist())) < 2:
        return None
    measured = [lines_of(t) for t in texts]
    kept = np.arange(len(y)) % 4 == 3
    if len(set(y[kept].tolist())) < 2 or len(set(y[~kept].tolist())) < 2:
        kept = np.ones(len(y), bool)
    model = train([m for m, k in zip(measured, kept) if not k or kept.all()], y[~kept] if not kept.all() else y, seed)
    raw = np.array([squash(raw_quality(model, t)) for t, k in zip(texts, kept) if k])
    cut = best_threshold(raw, y[kept], share)
    model.slope = 1 / max(float(np.std(raw)), 0.1)
    model.offset = math.log(CUT / (1 - CUT)) - model.slope * cut
    return model


def scorer(model: Model | None) -> Column:
    """Score of the column ``text``."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = (model.slope * squash(raw_quality(model, t or "")) + model.offset for t in texts)
            yield pd.Series([1 / (1 + math.exp(-v)) for v in values], dtype="float64")

    return score(F.col("text")) if model else F.lit(0.5)


def quality_table(documents: DataFrame, labels: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = rows.select("doc_id", held_out().alias("held_out"), scorer(fit(documents, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
