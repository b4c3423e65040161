"""Evaluation of search results: what is expected is looked for once, whatever its rows."""

from pyspark.sql import functions as F

from bidlens.operators import search as se


def test_what_is_expected_is_looked_for_once(spark):
    looked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(c):
        looked.add(1)
        return c

    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    results = spark.createDataFrame([(1, 1, 5, 50, 0.9), (1, 2, 6, 60, 0.5), (2, 1, 7, 70, 0.4)], "query_id long, rank int, doc_id long, chunk_id long, score double")
    rows = [(1, "basis:6:chunk:60"), (1, "basis:6:chunk:60"), (1, "basis:9:chunk:90"), (3, "basis:5:chunk:50"), (9, "basis:1:chunk:1")]
    # a task's rows, as a table that is read: Spark evaluates a local one beforehand
    expected = spark.sparkContext.parallelize(rows, 1).toDF("query_id long, citation_candidate_id string")
    expected = expected.withColumn("citation_candidate_id", seen.asNondeterministic()("citation_candidate_id"))
    got = {r.query_id: r for r in se.evaluate_queries(queries, results, expected).collect()}
    assert looked.value == len(rows)
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1].citation_candidate_ids == ["basis:5:chunk:50", "basis:6:chunk:60"] and got[1].matched_expected_ids == ["basis:6:chunk:60"]
    figures = {q: (r.result_count, r.result_hit, r.top_score, r.expected_count, r.matched_count, r.missed_count, r.expected_hit, r.expected_coverage) for q, r in got.items()}
    assert figures == {
        1: (2, True, 0.9, 2, 1, 1, True, 0.5), 2: (1, True, 0.4, 0, 0, 0, None, None), 3: (0, False, 0.0, 1, 0, 1, False, 0.0), 4: (0, False, 0.0, 0, 0, 0, None, None),
    }
    assert got[3].citation_candidate_ids is None and got[3].matched_expected_ids is None and got[2].matched_expected_ids == []
