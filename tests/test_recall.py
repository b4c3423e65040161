"""Recall of one text in another: counted within the row of a pair."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bidlens.functions import text as tx
from bidlens.operators import quality as qa
from bidlens.plans import quality_queries as queries
from bidlens.plans.bindings import Tables

SF = "/root/testdata/sf0.001"
PAIR = "pair_id long, a string, b string"


def ratios(a: Counter, b: Counter):
    met = sum((a & b).values())
    return (met / a.total() if a else 1.0, met / b.total() if b else 1.0)


def grams(text, n):
    compact = "".join(text.split())
    return Counter([compact] if 0 < len(compact) < n else [compact[i : i + n] for i in range(len(compact) - n + 1)])


def texts(letters, seed):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(40)]
    return [*made, "", " ", "가", "abcd", "abcd", "ab cd", "abcde", "aaaaaaaa", "😀😀😀😀😀😀 가나다라마바"]


@pytest.mark.parametrize(("letters", "n"), [("ab ", 5), ("ab가나😀 c", 3), ("".join(map(chr, range(0x21, 0x2000))), 5), ("ab😀 ", 31)])
def test_gram_recall_equals_counting(spark, letters, n):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(texts(letters, 1), reversed(texts(letters, 2))))] + [(-1, "abcd", "abcd"), (-2, "aabbaabb", "aabb aabb aabb")]
    rows = [(i, tx_a.replace("\x85", ""), tx_b.replace("\x85", "")) for i, tx_a, tx_b in rows]
    got = {r.pair_id: (r.recall_a, r.recall_b) for r in qa.ngram_recall(spark.createDataFrame(rows, PAIR), n).collect()}
    assert got == {i: ratios(grams(a, n), grams(b, n)) for i, a, b in rows}


def test_token_recall_equals_counting(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abB1") for _ in range(rnd.randrange(2, 5)))
    rows = [(i, *[" ".join(word() for _ in range(rnd.randrange(30))) for _ in "ab"]) for i in range(60)] + [(-1, None, "aa"), (-2, "aa aa", None), (-3, "ab aba", "aba ab ab")]
    counts = {i: [Counter((x or "").lower().split()) for x in (a, b)] for i, a, b in rows}
    pairs = spark.createDataFrame(rows, PAIR)
    got = {r.pair_id: (r.recall_a, r.recall_b) for r in qa.multiset_recall(pairs, tx.tokenize).collect()}
    assert got == {i: ratios(a, b) for i, (a, b) in counts.items()}
    got = {r.pair_id: (r.recall_a, r.recall_b) for r in qa.unique_recall(pairs, tx.tokenize).collect()}
    assert got == {i: ratios(Counter(set(a)), Counter(set(b))) for i, (a, b) in counts.items()}


@pytest.mark.parametrize("make", [
    lambda t: qa.ngram_recall(queries._pairs(t)), lambda t: qa.multiset_recall(queries._pairs(t), tx.tokenize), lambda t: qa.unique_recall(queries._pairs(t), tx.tokenize),
    queries._metrics,
])
def test_no_piece_leaves_its_row(spark, make):
    """One join of the texts; neither rows for pieces nor a table of their counts."""
    plan = make(Tables(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan and "Generate" not in plan
