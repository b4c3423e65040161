"""Toxicity by a convolutional text classifier in numpy.

A word is the sum of two hashed embeddings, of itself and of its first letters.  Filters one, two and three words wide
slide over the text, the largest response of each filter (max pooling) feeds a logistic output.  Embeddings start from
the smoothed log odds of their bucket, the rest is learned by Adam on a bounded sample of labelled rows (``PER_CLASS`` of
each class at most).  A threshold is calibrated for each language on rows kept from training; the language is guessed
from the text's own function words, and scores are shifted so that every language's threshold lies at the same score.

Scores read whole texts, in pieces only as far as memory goes.  Null and empty texts have no words: their pooled
responses are zero and they get the score of a text without any sign.  If a class has no labelled row, every score is 0.
Repeated rows get the same score; columns other than id and text are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.labelled import best_threshold, sample
from bidlens.llm.tables import held_out, released

PER_CLASS = 3000
CUT = 0.3  # the score at which a text counts as toxic
WORD = re.compile(r"[^\W\d_]+")
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
PREFIX = 5
# fixed values: frequent function words, by which the language of a text is guessed
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as on be by at this are from or",
    "de": "der die und das ist nicht ein eine mit von den des auf im sich für dem zu als auch",
    "fr": "le la les et des est un une que qui dans pour pas sur avec du par en au ce",
    "es": "el los las y del que un una por con para no se su al lo es en como más",
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def buckets(word: str) -> tuple[int, int]:
    """Embedding rows of a word and of its first letters."""
    return zlib.crc32(word.encode()) % BUCKETS, BUCKETS + zlib.crc32(b"^" + word[:PREFIX].encode()) % BUCKETS


class Words(dict):
    """Word -> both buckets in one number; forgets all when it holds too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        a, b = buckets(word)
        self[word] = value = a << 32 | b
        return value

    def ids(self, words: list[str]) -> np.ndarray:
        packed = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.stack([packed >> 32, packed & 0xFFFFFFFF], 1)


@dataclass
class Model:
    embedding: np.ndarray  # both tables, and a last row of zeros for padding
    filters: list[np.ndarray]  # for each width: (width * DIM, FILTERS)
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: float
    shifts: dict[str, float]  # language -> what moves its threshold to CUT


def language(words: list[str], of_word: dict[str, str]) -> str:
    counts: dict[str, int] = {}
    for word in words:
        if word in of_word:
            for lang in of_word[word]:
                counts[lang] = counts.get(lang, 0) + 1
    return max(sorted(counts), key=counts.__getitem__) if counts else ""


def function_words() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang, listed in FUNCTION_WORDS.items():
        for word in listed.split():
            out.setdefault(word, []).append(lang)
    return out


def padded(ids: np.ndarray) -> np.ndarray:
    """Two rows of padding close a text, so that no window reaches another one."""
    return np.concatenate([ids, np.full((max(WIDTHS) - 1, 2), 2 * BUCKETS)])


def respond(model: Model, x: np.ndarray) -> list[np.ndarray]:
    """Responses of all filters at every position; ``x``: embedded words with padding."""
    n = len(x) - max(WIDTHS) + 1
    out = []
    for width, weights, bias in zip(WIDTHS, model.filters, model.biases):
        total = np.broadcast_to(bias, (n, FILTERS)).copy()
        for k in range(width):
            total += x[k:k + n] @ weights[k * DIM:(k + 1) * DIM]
        out.append(total)
    return out


def pool(model: Model, ids: np.ndarray, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter over the whole text, not below zero, and where it is."""
    rows, best, at = padded(ids), np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.int64)
    for start in range(0, len(ids), step):
        part = rows[start:start + step + max(WIDTHS) - 1]
        x = model.embedding[part[:, 0]] + model.embedding[part[:, 1]]
        found = np.concatenate(respond(model, x), 1)
        where = found.argmax(0)
        top = found[where, np.arange(found.shape[1])]
        better = top > best
        best[better], at[better] = top[better], start + where[better]
    return best, at


def logit(model: Model, ids: np.ndarray) -> float:
    return float(pool(model, ids)[0] @ model.dense + model.offset)


def start_model(texts: list[np.ndarray], y: np.ndarray, seed: int) -> Model:
    """Random weights, but embeddings hold the log odds of texts with their bucket, shrunk where it is rare."""
    rng = np.random.default_rng(seed)
    counts = np.zeros((2, 2 * BUCKETS + 1))
    for ids, label in zip(texts, y):
        counts[int(label), np.unique(ids)] += 1
    totals = np.array([(y == 0).sum(), (y == 1).sum()])
    odds = np.log((counts[1] + 0.5) / (totals[1] + 1)) - np.log((counts[0] + 0.5) / (totals[0] + 1))
    embedding = rng.normal(0, 0.05, (2 * BUCKETS + 1, DIM)).astype(np.float32)
    signs = np.clip(odds * counts[1] / (counts[1] + 5), -2, 5)
    embedding[:, 0] = signs
    for k in range(1, DIM):  # every other column sees a part of the buckets, so that different signs add up
        mine = np.arange(len(signs)) % (DIM - 1) == k - 1
        embedding[mine, k] = signs[mine]
    embedding[-1] = 0
    filters = [rng.normal(0, 0.05, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for width, weights in zip(WIDTHS, filters):
        for k in range(width):
            weights[k * DIM + np.arange(FILTERS) % DIM, np.arange(FILTERS)] += 0.5 / width
    return Model(embedding, filters, [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS], np.full(len(WIDTHS) * FILTERS, 0.2, np.float32), -2.0, {})


def train(texts: list[np.ndarray], y: np.ndarray, seed: int = 5, epochs: int = 8, batch: int = 32, rate: float = 0.01) -> Model:
    """Adam on the log loss, classes weighted alike; max pooling sends a gradient to the winning window alone."""
    model = start_model(texts, y, seed)
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, len(y) / (2 * max((y == 1).sum(), 1)), len(y) / (2 * max((y == 0).sum(), 1)))
    params = [*model.filters, *model.biases, model.dense]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for first in range(0, len(order), batch):
            step += 1
            grads, of_offset, moved = [np.zeros_like(p) for p in params], 0.0, []
            part = order[first:first + batch]
            for i in part:
                best, at = pool(model, texts[i])
                error = (1 / (1 + np.exp(-(best @ model.dense + model.offset))) - y[i]) * weight[i] / len(part)
                grads[-1] += error * best
                of_offset += error
                rows = padded(texts[i])
                for column in np.flatnonzero(best > 0):
                    which, f = divmod(int(column), FILTERS)
                    width = WIDTHS[which]
                    window = rows[at[column]:at[column] + width]
                    x = (model.embedding[window[:, 0]] + model.embedding[window[:, 1]]).ravel()
                    down = error * model.dense[column]
                    grads[which][:, f] += down * x
                    grads[len(WIDTHS) + which][f] += down
                    moved.append((window, down * model.filters[which][:, f].reshape(width, DIM)))
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            model.offset -= rate * 5 * of_offset
            for window, g in moved:
                for column in (0, 1):
                    np.add.at(model.embedding, window[:, column], -rate * g)
            model.embedding[-1] = 0
    return model


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 5) -> Model | None:
    """Learns from at most ``per_class`` labelled rows of each class; a quarter of them only calibrates."""
    texts, y, share = sample(documents, labels, "toxic", per_class, seed)
    if len(set(y.tolist())) < 2:
        return None
    seen, listed, ids, guessed = Words(), function_words(), [], []
    for text in texts:  # word lists are not kept: they would be many times the texts
        words = words_of(text)
        ids.append(seen.ids(words).astype(np.int32))
        guessed.append(language(words, listed))
    del texts
    kept = np.arange(len(y)) % 4 == 3
    if len(set(y[kept].tolist())) < 2 or len(set(y[~kept].tolist())) < 2:
        kept = np.ones(len(y), bool)
        model = train(ids, y, seed)
    else:
        model = train([v for v, k in zip(ids, kept) if not k], y[~kept], seed)
    share = 1.5 * share / (1 + share / 2)  # to miss a toxic text counts as one and a half false alarms
    scores = np.array([logit(model, v) for v, k in zip(ids, kept) if k])
    langs = np.array([lang for lang, k in zip(guessed, kept) if k])
    target, common = np.log(CUT / (1 - CUT)), best_threshold(scores, y[kept], share)
    model.shifts[""] = target - common
    for lang in FUNCTION_WORDS:
        own = langs == lang
        n = int(y[kept][own].sum())
        found = best_threshold(scores[own], y[kept][own], share) if 0 < n < own.sum() else common
        model.shifts[lang] = target - (n * found + 20 * common) / (n + 20)  # few positives: near the common threshold
    return model


def scorer(model: Model | None) -> Column:
    """Score of the column ``text``."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen, listed = Words(), function_words()
        for texts in batches:
            out = []
            for text in texts:
                words = words_of(text or "")
                shift = model.shifts[language(words, listed)]
                out.append(1 / (1 + np.exp(-(logit(model, seen.ids(words)) + shift))))
            yield pd.Series(out, dtype="float64")
        seen.clear()
        released()

    return score(F.col("text")) if model else F.lit(0.0)


def score_texts(documents: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``documents`` and ``toxicity``, 0 to 1."""
    return documents.withColumn("toxicity", scorer(model))


def toxicity_table(documents: DataFrame, labels: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = rows.select("doc_id", held_out().alias("held_out"), scorer(fit(documents, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
