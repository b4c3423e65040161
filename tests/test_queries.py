"""Registered queries against their SQL at the smallest scale, and properties that must hold."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from bidlens.plans.bindings import TABLE_NAMES

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "tokenize", "json_list_parse", "chunk_paragraph_window", "chunk_table_rows", "index_validate", "index_manifest", "search_topk",
    "rule_candidates", "requirement_candidates", "readiness_score", "registration_duplicates", "requirement_compare", "envelope_parse",
    "attachments_explode", "page_assemble", "merged_search_page", "recent_failures", "run_record", "token_multiset_recall", "char_ngram_recall",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9))
        return "<null>" if v is None else str(v)

    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, db, name):
    frame = entry.queries()[name](spark, SF)
    got = canon(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = db.execute(entry.oracle_sql()[name])
    assert got == canon([c[0] for c in cursor.description], cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_reconcile_uses_every_action_once(spark):
    rows = entry.queries()["rule_reconcile"](spark, "/root/testdata/sf0.01").select("rule_id", "action").collect()
    ids = [r.rule_id for r in rows if r.rule_id is not None]
    assert len(ids) == len(set(ids))
    assert {"insert", "update", "delete", "keep"} <= {r.action for r in rows}


def test_partitions_do_not_change_results(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(tuple, entry.queries()["approved_evidence"](spark, SF).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
