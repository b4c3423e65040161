"""Citations are found once per text and version; stored tables are made once per version of their files."""

import pytest

from bidlens import session
from bidlens.operators import judgment as ju

TEXT = "requirement_key string, requirement_type string, requirement_text string"
CITED = "requirement_key string, position int, citation_candidate_id string, doc_id long, chunk_id long, score double, source_type string, rule_id long"


def test_only_new_texts_are_cited(spark, tmp_path):
    asked = []

    def cite(texts):
        keys = sorted(r.requirement_key for r in texts.collect())
        asked.append(keys)
        return spark.createDataFrame([(k, n, f"basis:1:chunk:{n}", 1, n, 0.5, "basis_search", None) for k in keys if k != "none" for n in (1, 2)], CITED)

    texts = lambda *keys: spark.createDataFrame([(k, "license", f"text {k}") for k in keys], TEXT)
    memo = ju.Memo(spark, str(tmp_path / "memo"), "v1")
    assert memo.citations().count() == 0
    assert memo.cite_new(texts("a", "b", "none"), cite)
    assert not memo.cite_new(texts("a", "b", "none"), cite)  # a second run asks for nothing
    assert memo.cite_new(texts("b", "c"), cite)
    assert asked == [["a", "b", "none"], ["c"]]
    assert sorted((r.requirement_key, r.position) for r in memo.citations().collect()) == [(k, n) for k in "abc" for n in (1, 2)]
    other = ju.Memo(spark, str(tmp_path / "memo"), "v2")  # other rules or passages: nothing is known
    assert other.cite_new(texts("a"), cite) and asked[-1] == ["a"]
    assert memo.citations().count() == 6


def test_stored_tables_follow_their_files(spark, tmp_path):
    source, made = str(tmp_path / "source.parquet"), []
    spark.range(3).write.parquet(source)

    def make():
        made.append(1)
        return spark.read.parquet(source).selectExpr("id + 1 AS n")

    read = lambda: sorted(r.n for r in session.stored(spark, f"table-{tmp_path.name}", session.fingerprint(spark, source), make).collect())
    assert read() == read() == [1, 2, 3] and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    assert read() == [1, 2, 3, 4, 5] and len(made) == 2
    with pytest.raises(Exception):
        session.fingerprint(spark, str(tmp_path / "missing.parquet"))


def test_judged_items_are_read_once(spark, tmp_path):
    columns = "requirement_key string, required_value string, label string, required_evidence_types array<string>, status string"
    rows = [("a", "v", "l", ["e"], "prepared"), ("b", "w", "l", [], "possibly_missing"), ("c", "x", "l", [], "needs_review")]
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "compared"))
    memo = ju.Memo(spark, str(tmp_path / "memo"), "v1")
    texts = spark.createDataFrame([(k, "license", k) for k in "abz"], TEXT)
    memo.cite_new(texts, lambda t: spark.createDataFrame([(k, 1, f"basis:1:chunk:{k}", 1, 1, s, "basis_search", None) for k, s in (("a", 0.5), ("b", 0.1), ("z", 0.9))], CITED))
    items, _cited = ju.judgment_items(spark.read.parquet(str(tmp_path / "compared")), memo)
    got = {r.requirement_key: (r.citation_count, r.ready_count, r.citation_status) for r in items.collect()}
    assert got == {"a": (1, 1, "candidate_found"), "b": (1, 0, "weak_candidate"), "c": (0, 0, "missing")}
    scans = [line for line in items._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation [" in line and "required_value" in line]
    assert len(scans) == 1
