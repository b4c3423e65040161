"""What judgments are made of: the same rows as the longer way, from less that is mined, moved and made twice."""

from pyspark.sql import functions as F

from bidlens.operators import judgment as ju
from bidlens.operators import matching as ma
from bidlens.operators import requirements as rq
from bidlens.operators import rules as ru
from bidlens.operators import search as se
from bidlens.plans.bindings import TRADE, Tables

SMALL = "/root/testdata/sf0.001"


def same(a, b):
    rows = lambda f: sorted(map(str, f.select(*sorted(f.columns)).collect()))
    assert rows(a) == rows(b) != []


def test_evidence_is_found_after_the_comparison(spark):
    t = Tables(spark, SMALL)
    odd = [(1, "region", " NATION_1 "), (1, "license", "Brand#1\t"), (2, "company_type", "ECONOMY"), (3, "required_document", " ring, widget"), (4, "money", "12"), (5, "license", "")]
    t.__dict__["trade_lines"] = t.trade_lines.filter("notice_id < 200").union(spark.createDataFrame(odd, "a long, b string, c string")).distinct()
    inputs = rq.requirement_inputs(t.trade_requirements, TRADE).drop("needs_review", "comparison_strategy")
    want = ma.compare(inputs, t.trade_pairs, t.trade_profile, TRADE)
    same(t.judged_requirements, want.select(*t.judged_requirements.columns))
    plan = t.judged_requirements._jdf.queryExecution().optimizedPlan().toString()
    assert "of that part" in plan.split("Join")[0] and "of that part" not in plan.split("Join", 1)[1]  # made above all joins: nothing of it moves
    same(t.requirement_texts, ju.texts_of(ju.with_text_key(t.judged_requirements)))


def test_only_rules_that_may_be_approved_are_mined(spark, monkeypatch):
    t, mined, before = Tables(spark, SMALL), [], ru.candidates
    every = se.healthy_rules(t.rules, t.searchable_chunks, t.index_items).select("rule_id", "rule_type", "doc_id", "chunk_id", "condition_text")
    monkeypatch.setattr(ru, "candidates", lambda passages, d: mined.append(passages) or before(passages, d))
    got = t.healthy_rules
    same(got.select("rule_id", "rule_type", "doc_id", "chunk_id"), every.drop("condition_text"))
    good = {r.doc_id for r in t.labels.filter("quality = 1").collect()}
    assert {r.doc_id for r in mined[0].select("doc_id").distinct().collect()} <= good
    assert mined[0].count() < t.searchable_chunks.count() / 2
    assert got.filter(F.size("tokens") == 0).count() == 0


def test_guide_reads_its_items_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(n):
        read.add(1)
        return n

    columns = "notice_id long, company_id long, match_status string, required_evidence_types array<string>, recommended_action string, label string, required_value string, citation_status string, item_pos long"
    rows = [
        (1, 1, "missing", ["a b", "", "A-B", "c"], "do citation", "l", "v", "missing", 5), (1, 1, "missing", ["c"], "do citation", "l", "w", "weak_candidate", 3),
        (1, 1, "matched", ["z"], "no", "l", "v", "missing", 9), (1, 2, "uncertain", None, " ", "l", "v", "candidate_found", 1), (2, 2, None, ["q"], "x", None, "v", None, 1),
    ]
    items = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), columns).withColumn("item_pos", seen.asNondeterministic()("item_pos"))
    got = sorted(tuple(r)[:3] + (r.item_pos, r.sub_pos, r.value) for r in ju.preparation_guide(items).collect())
    assert read.value == len(rows)
    assert got == [
        (1, 1, "action", 3, 0, "do 근거"), (1, 1, "document", 3, 0, "c"), (1, 1, "document", 5, 0, "a b"),
        (1, 1, "note", 3, 0, "l / w: 기준문서 근거 후보 점수가 낮아 원문 검토가 필요합니다."), (1, 1, "note", 5, 0, "l / v: 기준문서 근거 후보가 없습니다."),
    ]


def test_priority_groups_move_once(spark):
    columns = "notice_id long, company_id long, match_status string, requirement_type string, label string, required_value string, source_text string, requirement_id string, recommended_action string, gap_reason string, required_evidence_types array<string>, item_pos long"
    rows = [(1, 1, s, "license", "l", "v", "t", f"r{n}", f"do {n} citation", f"why {n}", [f"d{n}"], n) for s, n in (("missing", 7), ("uncertain", 4), ("matched", 1), ("needs_review", 9))]
    rows += [(1, 1, "missing", "money", "m", "12", "t", "r2", "pay", None, [], 2), (2, 1, "matched", "money", "m", "12", "t", "r3", "pay", None, [], 2)]
    groups = ju.priority_groups(spark.createDataFrame(rows, columns))
    got = sorted((r.position, r.item_count, r.first_pos, r.first_requirement, r.next_step, r.reason, r.documents, r.related_ids) for r in groups.collect())
    assert got == [(1, 1, 2, "r2", "pay", None, [], ["r2"]), (2, 3, 4, "r4", "do 4 근거", "why 4", ["d4"], ["r4", "r7", "r9"])]
    plan = groups._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
