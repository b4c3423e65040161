"""The k best rules of a text against ranking every pair, and how many pairs that takes."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.operators import overlap
from bidlens.operators import search as se

RULE = "rule_id long, rule_type string, confidence double, rule_text string, updated_at long, doc_id long, chunk_id long"


def rules_of(spark, n, seed, common=6):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"c{j}" for j in range(common) if rnd.random() < 0.8] + [f"w{int(rnd.paretovariate(0.5)) % 500}" for _ in range(rnd.randrange(12))]
        rows.append((i, rnd.choice(["license", "region", "basis_rule"]), rnd.choice([None, 0.3, 0.9, 5.0, -1.0]), " ".join(words), i % 17, i, i * 10))
    return spark.createDataFrame(rows, RULE)


def texts_of(spark, n, seed, common=6):
    rnd = random.Random(seed)
    rows = [
        (f"t{i}", rnd.choice(["license", "region"]), " ".join([f"c{j}" for j in range(common)] + [f"w{int(rnd.paretovariate(0.5)) % 500}" for _ in range(rnd.randrange(16))]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows + [("none", "license", "zz yy"), ("empty", "license", ""), ("null", "license", None)], "requirement_key string, requirement_type string, requirement_text string")


@pytest.mark.parametrize("k", [1, 3])
def test_best_rules_equal_ranking_all_pairs(spark, k):
    rules, texts = rules_of(spark, 400, 3), texts_of(spark, 60, 4)
    order = W.partitionBy("requirement_key").orderBy(F.desc("score"), F.desc("updated_at"), F.desc("rule_id"))
    every = se.match_scores(texts, rules, carry=("updated_at",)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    got = se.approved_topk(texts, rules, k)
    columns = ["requirement_key", "rank", "rule_id", "shared", "score"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, every.select(*columns).collect()))


def test_scored_pairs_grow_with_texts_not_with_pairs(spark):
    # every text shares the frequent words with every rule, and a rare pair of words with a few
    rules = spark.createDataFrame([(i, "license", 0.5, f"common often always r{i // 4} s{i // 4}", i, i, i) for i in range(1200)], RULE)
    texts = spark.createDataFrame([(f"t{i}", "license", f"common often always r{i} s{i}") for i in range(100)], "requirement_key string, requirement_type string, requirement_text string")
    ready = rules.withColumn("tokens", F.array_distinct(F.split("rule_text", " "))).drop("rule_text")
    bounded = overlap.with_floor(overlap.texts_by_rarity(texts, ready), ready, 3)
    assert overlap.contenders(bounded, ready).count() <= 100 * 4
    assert se.match_scores(texts, rules).count() == 100 * 1200
    best = se.approved_topk(texts, rules, 3).filter("requirement_key = 't7'").orderBy("rank").collect()
    assert [r.rule_id for r in best] == [31, 30, 29]


def test_no_rules_and_no_texts(spark):
    assert se.approved_topk(texts_of(spark, 2, 1), rules_of(spark, 0, 1)).count() == 0
    assert se.approved_topk(texts_of(spark, 0, 1).limit(0), rules_of(spark, 5, 1)).count() == 0


def counted_by_hand(texts, rules):
    """Pairs as the SQL counts them: rows of one rule, and of one text, add up."""
    def words(text):
        return sorted({w.lower() for w in re.findall("[0-9A-Za-z가-힣]{2,}", text or "")})

    shared = Counter()
    for t in texts.collect():
        for r in rules.collect():
            both = len(set(words(t.requirement_text)) & set(words(r.rule_text)))
            shared[t.requirement_key, t.requirement_type, len(words(t.requirement_text)), r.rule_id, r.rule_type, r.confidence] += both
    out = []
    for (key, kind, size, rule, rule_kind, sure), n in shared.items():
        bonus = 0.15 if kind is not None and rule_kind == kind else 0.05 if rule_kind == "basis_rule" else 0.0
        if n:
            out.append((key, rule, n, math.floor(min(1.0, n / size + bonus + min(max(sure or 0.0, 0.0), 1.0) * 0.1) * 10000 + 0.5) / 10000))
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "cells", "groups"), [(1000, 2_000_000, None), (7, 50, 5)])
def test_every_pair_equals_counting_by_hand(spark, monkeypatch, block, cells, groups):
    monkeypatch.setattr(overlap, "BLOCK_TEXTS", block)
    monkeypatch.setattr(overlap, "CELLS", cells)
    odd = [(500, "license", 0.3, "c1 c2 가나 w1", 0, 0, 0), (500, "license", 0.3, "C1 다라 w2 w2", 0, 0, 0), (500, "license", 0.4, "c1", 0, 0, 0),
           (501, None, None, "c1 c2", 0, 0, 0), (502, "basis_rule", 0.5, None, 0, 0, 0), (503, "basis_rule", 0.5, "", 0, 0, 0)]
    rules = rules_of(spark, 60, 5).union(spark.createDataFrame(odd, RULE))
    more = [("twice", "license", "c1 c2 가나"), ("twice", "license", "c1 c3 다라"), ("twice", "region", "c1 c3 w1"), ("untyped", None, "c1 c2"), (None, "license", "c1")]
    texts = texts_of(spark, 20, 6).union(spark.createDataFrame(more, "requirement_key string, requirement_type string, requirement_text string"))
    got = se.match_scores(texts, rules, groups=groups).collect()
    assert sorted(map(tuple, got), key=str) == counted_by_hand(texts, rules)


def test_pairs_are_neither_shuffled_nor_grouped(spark):
    """Where a block of texts has met a group of rules, nothing follows but the score."""
    frame = se.match_scores(texts_of(spark, 5, 1), rules_of(spark, 9, 1))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    assert plan.index("FlatMapCoGroupsInArrow") < plan.index("Aggregate")


def test_all_pairs_of_no_rules_or_no_texts(spark):
    assert se.match_scores(texts_of(spark, 2, 1), rules_of(spark, 0, 1)).count() == 0
    assert se.match_scores(texts_of(spark, 0, 1).limit(0), rules_of(spark, 5, 1)).count() == 0


def test_tokens_of_rules_are_those_of_texts(spark):
    """The rules' texts are split in Arrow: a rule shares as many tokens with its own text as that has."""
    odd = ["Ab가b 1x ﾊﾝ", "İstanbul ẞtraße KELVIN \u212Aelvin ﬁsh", "가힣 힤가 ᄀ가", "a b c", "a_b-cd.EF ef", "😀ab😀cd", "ab\u00a0cd\u200bef", "é1 1é2 22é"]
    texts = spark.createDataFrame([(f"t{i}", "license", x) for i, x in enumerate(odd)], "requirement_key string, requirement_type string, requirement_text string")
    rules = spark.createDataFrame([(i, "license", 0.5, x) for i, x in enumerate(odd)], "rule_id long, rule_type string, confidence double, rule_text string")
    assert sorted(map(tuple, se.match_scores(texts, rules).collect())) == counted_by_hand(texts, rules)


def test_texts_that_differ_in_unknown_tokens_are_scored_once(spark, monkeypatch):
    asked, before = [], overlap.with_floor
    monkeypatch.setattr(overlap, "with_floor", lambda texts, rules, k: asked.append(texts) or before(texts, rules, k))
    rules = rules_of(spark, 300, 11)
    rows = [(f"t{i}", ["license", "region", None][i % 3], f"c1 c2 w{i % 2} unknown{i}" + " more" * (i % 5 == 0)) for i in range(60)]
    texts = spark.createDataFrame(rows, "requirement_key string, requirement_type string, requirement_text string")
    got = se.approved_topk(texts, rules, 3)
    order = W.partitionBy("requirement_key").orderBy(F.desc("score"), F.desc("updated_at"), F.desc("rule_id"))
    every = se.match_scores(texts, rules, carry=("updated_at",)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 3)
    columns = ["requirement_key", "rank", "rule_id", "shared", "score"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, every.select(*columns).collect()))
    assert got.count() == 180 and asked[0].count() == 12  # type, known tokens, size
