"""Texts are cut and mined once by queries that need what they hold several times."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from bidlens.functions import text as tx
from bidlens.operators import chunks as ch
from bidlens.operators import rules as ru
from bidlens.plans.bindings import Tables

SF = "/root/testdata/sf0.001"
GENERATED = """doc_id long, chunk_id long, chunk_index int, pos int, type_pos int, rule_type string, condition_text string, target_scope string,
  citation_candidate_id string, confidence double, extraction_key string, status string"""
STORED = """rule_id long, doc_id long, chunk_id long, rule_type string, target_scope string, confidence double, status string, condition_text string,
  extraction_key string, citation_candidate_id string, review_note string"""


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def made(spark, place, key, text="Text", doc=1):
    return (doc, 10 + place, place, 0, 0, "license", text, "s", f"basis:{doc}:chunk:{10 + place}", 0.7, key, "needs_review")


def test_reconcile_meets_by_document_once(spark):
    generated = spark.createDataFrame(
        [made(spark, 0, "a", "Old text!"), made(spark, 1, "b", "old  TEXT"), made(spark, 2, "c", "other"), made(spark, 0, "a", doc=2), made(spark, 0, "z", doc=3)], GENERATED
    )
    stored = spark.createDataFrame(
        [
            (1, 1, 10, "license", "s", 0.5, "needs_review", "oldtext", "", "", ""), (2, 1, 10, "license", "s", 0.5, "approved", "oldtext", "", "x", "n"),
            (3, 1, 10, "license", "s", 0.5, "rejected", "other", "c", "basis:1:chunk:10", ""), (4, 1, 10, "license", "s", 0.5, "archived", "gone", None, "x", None),
            (5, 1, 10, "license", "s", 0.5, "needs_review", "gone", "q", "x", ""), (6, 3, 10, "license", "s", 0.5, "approved", "gone", "z", "x", ""),
            (7, None, 10, "license", "s", 0.5, "approved", "gone", "a", "x", ""),
        ], STORED,
    )
    out = ru.reconcile(generated, stored, spark.createDataFrame([(1,), (2,)], "doc_id long"))
    got = {(r.rule_id, r.doc_id): (r.action, r.chunk_id, r.extraction_key, r.status) for r in out.collect()}
    assert got == {
        (1, 1): ("update", 11, "b", "needs_review"), (2, 1): ("revalidate_vanished", 10, "", "needs_review"), (3, 1): ("revalidate_citation", 12, "c", "needs_review"),
        (4, 1): ("keep", 10, None, "archived"), (5, 1): ("delete", 10, "q", "needs_review"), (6, 3): ("keep", 10, "z", "approved"), (7, None): ("keep", 10, "a", "approved"),
        (None, 2): ("insert", 10, "a", "needs_review"),
    }
    assert plan(out).count("Join ") == 1  # that of the ready documents


def test_nothing_is_cut_twice(spark):
    queries = entry.queries()
    for name in ("rule_reconcile", "rule_reconcile_counts", "requirement_replace", "index_drop_document"):
        assert "Generate" not in plan(queries[name](spark, SF)), name
    # windows, lines and types of the stored rules' passages; the passages they are checked against are only keys
    assert plan(queries["rule_approval_check"](spark, SF)).count("Generate ") == 3


def test_a_line_is_made_compact_and_lower_once(spark):
    """Every step of the miner on a line's text is one expression of the plan, not one a use."""
    frame = Tables(spark, SF).mined_rules
    text = plan(frame)
    assert text.count("regexp_replace(coalesce(line") + text.count("regexp_replace(line") == 1
    assert text.count("lower(line") == 1
    assert text.count("substring(text#") == 1  # a passage is cut once, not for a filter and again


def test_the_length_of_a_text_is_not_counted_for_each_window(spark):
    docs = spark.createDataFrame([(1, "a" * 5000)], "doc_id long, text string").repartition(1)
    out = ch.long_windows(docs)
    assert plan(out).count("length(text#") == 1
    assert [(r.char_start, r.char_end) for r in out.collect()] == [(0, 1600), (1420, 3020), (2840, 4440), (4260, 5000)]
    ragged = spark.createDataFrame([(1, "\u3000\n " + "ab " * 600 + "\x85"), (2, None), (3, " \x1f"), (4, "x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.chunk_index, r.char_start, r.char_end, r.chunk_text) for r in ch.long_windows(ragged).collect())
    whole = "\u3000\n " + "ab " * 600 + "\x85"
    assert [g[:2] for g in got] == [(1, 0), (1, 1), (4, 0)]
    assert all(g[4] == whole[g[2] : g[3]] == g[4].strip() for g in got[:2])


def test_shortcuts_for_plain_texts_change_nothing(spark):
    """Lines and normalised texts against the patterns without any test before them."""
    odd = "\n\r\t \x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u200a\u200b’\u2028\u2029\u202f\u205f\u3000\xe9가\U0001f600\0"
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(odd + "ab" * rnd.choice([1, 20])) for _ in range(rnd.randrange(40)))) for i in range(400)]
    rows += [(-1, None), (-2, ""), (-3, "a\rb\r\nc\n\n\nd"), (-4, "a\u200b b"), (-5, "a ’ \n\u3000b")]
    x, lines = F.col("x"), F.transform(F.split(F.coalesce("x", F.lit("")), tx.LINE_BREAK), tx.clean_text)
    base = F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\0"), F.lit("")), r"\r\n?", "\n")
    base = F.regexp_replace(F.regexp_replace(base, tx.RARE_BREAK, "\n"), r"[ \t]+", " ")
    basis = tx.clean_text(F.regexp_replace(F.regexp_replace(base, f"{tx.BLANK}*\n{tx.BLANK}*", "\n"), "\n{3,}", "\n\n"))
    evidence = tx.clean_text(F.regexp_replace(base, f"{tx.BLANK}*\n{tx.WS}*", "\n"))
    frame = spark.createDataFrame(rows, "i long, x string").repartition(2)
    got = frame.select("x", lines.alias("a"), tx.lines(x).alias("b"), basis.alias("c"), tx.basis_normalize(x).alias("d"), evidence.alias("e"), tx.evidence_normalize(x).alias("f"))
    for r in got.collect():
        assert (r.a, r.c, r.e) == (r.b, r.d, r.f), repr(r.x)
