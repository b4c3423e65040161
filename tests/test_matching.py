"""Demands against profile values: the same answers as comparing each pair, and one row a demand that moves."""

import random
import re

from bidlens.operators import matching as ma
from bidlens.plans.bindings import TRADE

DEMAND = "company_id long, requirement_type string, required_value string"
VALUE = "company_id long, requirement_type string, pos long, value string"


def _compact(text):
    return re.sub(r"[^\w]|_", "", text).lower()


def _meets(kind, wanted, value):
    a, b = _compact(wanted), _compact(value)
    if not a or not b:
        return False
    if kind == "region":
        def keys(text, compact):
            named = [label for label, names in TRADE.regions.items() if any(_compact(n) in compact for n in names)]
            return {*named, *map(_compact, re.findall(TRADE.region_word, text)), compact}

        return bool(keys(wanted, a) & keys(value, b))
    aliases = {"license": TRADE.licenses, "company_type": TRADE.companies, "required_document": TRADE.documents}[kind]
    label = lambda c: next((k for k, names in aliases.items() if any(_compact(n) in c for n in [k, *names])), "")
    return (label(a) != "" and label(a) == label(b)) or a == b or (min(len(a), len(b)) >= 5 and (a in b or b in a))


def test_first_match_is_that_of_all_pairs(spark):
    rng = random.Random(7)
    words = ["ring", "widget", "Brand#1", "Brand#23", "ECONOMY", "PROMO", "NATION_1", "NATION_22", "NATION_7", "bolt", "cold", "-", "plate kit"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    kinds = ["region", "license", "company_type", "required_document"]
    values = sorted({(rng.randint(1, 4), rng.choice(kinds), rng.randint(0, 9), text()) for _ in range(150)})
    demands = sorted({(rng.randint(1, 5), rng.choice(kinds), text()) for _ in range(150)})
    got = ma.first_matches(spark.createDataFrame(demands, DEMAND), spark.createDataFrame(values, VALUE), TRADE).collect()
    want = {}
    for company, kind, wanted in demands:
        met = [(pos, value) for c, k, pos, value in values if (c, k) == (company, kind) and _meets(kind, wanted, value)]
        if met:
            want[company, kind, wanted] = min(met)
    assert {(r.company_id, r.requirement_type, r.required_value): (r.match_pos, r.matched_value) for r in got} == want


def test_no_demand_is_multiplied_before_it_moves(spark):
    demands = spark.createDataFrame([(1, "license", "x" * 500)], DEMAND)
    profile = spark.createDataFrame([(1, "license", 0, "a" + "x" * 600)], VALUE)
    found = ma.first_matches(demands, profile, TRADE)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and found.count() == 1
