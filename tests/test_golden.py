"""Facts that must hold on tiny frames."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.functions import text as tx
from bidlens.functions.dictionaries import DEMO, KOREAN
from bidlens.operators import chunks as ch
from bidlens.operators import collection as co
from bidlens.operators import index as ix
from bidlens.operators import judgment as ju
from bidlens.operators import matching as ma
from bidlens.operators import quality as qa
from bidlens.operators import requirements as rq
from bidlens.operators import rules as ru
from bidlens.operators import search as se
from bidlens.operators.containment import text_pairs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(column.alias("v")).first()["v"]


def test_text_functions(spark):
    c = F.col("s")
    assert one(spark, tx.clean_text(c), s="　 a b \n") == "a b"
    assert one(spark, tx.compact_key(c), s="조경-식재·ABC ①") == "조경식재abc①"
    assert one(spark, tx.tokenize(c), s="A1 b, 한글 x 직접생산") == ["a1", "한글", "직접생산"]
    assert one(spark, tx.basis_normalize(c), s=" a\t b \r\n\n\n\n c\0 ") == "a b\n\nc"
    assert one(spark, tx.won_format(c), s="1,234,567.0 원") == "1,234,567원"
    assert one(spark, tx.won_format(c), s="약 3억") == "약 3억"
    assert one(spark, tx.registration_number(c), s="142 81 28387") == "142-81-28387"
    assert one(spark, tx.date_normalize(c), s="2010 년 05 월 5 일") == "2010-05-05"
    assert one(spark, tx.region_derive(c), s="경기도 성남시 수정구") == "경기도 성남시"
    assert one(spark, tx.pii_mask(c), s="Bearer abc.d 900101-1234567 142-81-28387") == "Bearer [REDACTED] [REDACTED_RRN] 142-**-*****"
    assert one(spark, tx.secret_mask(c), s="abcdefghijklmnop") == "abcd********mnop"
    assert one(spark, tx.url_redact(c), s="https://h/p?token=a&x=1#f") == "https://h/p?token=%5BREDACTED%5D&x=1#f"
    assert one(spark, tx.json_list(c), s='["a", " b ", "a"]') == ["a", "b"]
    assert one(spark, tx.json_list(c), s="a, b,,a") == ["a", "b"]


def test_procurement_boundaries(spark):
    text = "개요입니다 1. 목적 가. 범위(2024)2024. 5. 1까지 제출한다그리고"
    lines = one(spark, tx.procurement_boundary_restore(F.col("s")), s=text).split("\n")
    assert "1. 목적" in lines and lines[-1] == "그리고"
    assert any(x.startswith("2024. 5. 1") for x in lines)


def test_long_paragraph_windows(spark):
    text = "가" * 1680
    rows = ch.paragraph_windows(spark.createDataFrame([(1, text)], ["doc_id", "text"])).orderBy("chunk_index").collect()
    assert [(r.char_start, r.char_end) for r in rows] == [(0, 1600), (1420, 1680)]


def test_windows_are_source_pieces(spark):
    text = "\n\n".join(f"문단 {i} " + "내용 " * (20 + i % 50) for i in range(60))
    text = "\n\n".join(p.strip() for p in text.split("\n\n"))
    rows = ch.paragraph_windows(spark.createDataFrame([(1, text)], ["doc_id", "text"])).orderBy("chunk_index").collect()
    assert len(rows) > 3
    for r in rows:
        assert r.chunk_text == text[r.char_start:r.char_end]
    for a, b in zip(rows, rows[1:]):
        assert a.char_end - 180 <= b.char_start < a.char_end


def test_table_rows_keep_their_columns(spark):
    rows = [(1, ["", "품명"]), (2, ["1", "의자"]), (3, ["", ""])]
    table = spark.createDataFrame([("d", "p1-t1", 1, rows)], "doc_id string, table_id string, page_number int, rows array<struct<row_index:int,cells:array<string>>>")
    got = ch.table_row_chunks(table).collect()
    assert [r.chunk_text for r in got] == ["[table_id: p1-t1]\n[page: 1]\ncol_1: 1\n품명: 의자"]


def test_repetition_does_not_score(spark):
    from bidlens.operators import index as ix

    chunks = spark.createDataFrame([(1, 10, 0, "의자 의자 의자"), (2, 20, 0, "의자 책상")], ["doc_id", "chunk_id", "chunk_index", "chunk_text"])
    queries = spark.createDataFrame([("q1", "의자 책상")], ["query_id", "query"])
    for salts in (1, 4):
        got = se.topk(queries, ix.postings(chunks), 5, salts=salts).orderBy("rank").collect()
        assert [(r.doc_id, r.score) for r in got] == [(2, 1.0), (1, 0.5)]


def test_evaluation_coverage(spark):
    queries = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "c")], ["query_id", "query"])
    results = spark.createDataFrame([(q, 1, 1, 1, 0.5) for q in ("q1", "q2", "q3")], ["query_id", "rank", "doc_id", "chunk_id", "score"])
    expected = spark.createDataFrame([("q1", "basis:1:chunk:1"), ("q2", "basis:9:chunk:9")], ["query_id", "citation_candidate_id"])
    m = se.evaluation_metrics(se.evaluate_queries(queries, results, expected)).first()
    assert m.citation_coverage == 0.5 and m.result_coverage == 1.0


def test_shadowed_label(spark):
    scan = ru.labels(F.col("s"), KOREAN.companies, KOREAN.shadowed)
    assert one(spark, scan, s="중소기업 확인서") == ["중소기업"]
    assert one(spark, scan, s="중소기업 및 소기업") == ["중소기업", "소기업"]


def test_notice_requirements(spark):
    row = (1, "서울", "", "", "", "", "", "", "", "", "참가자격: 조경식재공사업 면허\n제출서류 사업자 등록증\n공고일시 안내\n성남시 소재")
    names = "notice_id region_text license_text presmpt_prce bdgt_amt bssamt bid_ntce_dt bid_begin_dt bid_clse_dt openg_dt text".split()
    got = rq.notice_requirements(spark.createDataFrame([row], names)).first()
    assert got.regions == ["서울", "성남시"] and got.licenses == ["조경식재"] and got.required_documents == ["사업자등록증"]
    assert len(got.requirement_lines) == 2


def test_matching(spark):
    needs = spark.createDataFrame(
        [(1, "license", "조경식재"), (1, "license", "전기공사업"), (1, "region", "경기도"), (1, "money", "추정가격: 1원"), (1, "company_type", "소기업")],
        ["notice_id", "requirement_type", "required_value"],
    )
    pairs = spark.createDataFrame([(1, 7)], ["notice_id", "company_id"])
    profile = spark.createDataFrame(
        [(7, "license", 0, "조경식재공사업"), (7, "license", 1, "전기, 소방, 통신자재"), (7, "region", 0, "경기도 성남시")],
        ["company_id", "requirement_type", "pos", "value"],
    )
    got = {r.required_value: r.status for r in ma.compare(needs, pairs, profile).collect()}
    assert got == {
        "조경식재": "prepared", "전기공사업": "possibly_missing", "경기도": "prepared", "추정가격: 1원": "needs_review", "소기업": "not_found",
    }


def test_merged_search(spark):
    rows = [("C", "", s, i, d) for s, i, d in ((0, 0, "3"), (2, 5, "9"))] + [("S", "000", 1, 1, "2"), ("G", "000", 2, 2, "1")]
    items = spark.createDataFrame(rows, ["no", "ord", "source_rank", "arrival", "date_text"])
    assert [(r.no, r.source_rank) for r in co.search_page(items, 1, 2).collect()] == [("C", 0), ("S", 1)]
    assert [r.no for r in co.search_page(items, 2, 2).collect()] == ["G"]
    totals = spark.createDataFrame([(i, 1, "") for i in range(4)], ["source_rank", "total_count", "error"])
    told = co.search_totals(items, totals, 1, 2).first()
    assert told.total_count == 4 and told.distinct_items == 3 and told.has_next_page


def test_suggestions_never_invent_a_match(spark):
    rows = [
        ("missing", "matched", 0.91, "", False, "needs_review"), ("matched", "needs_review", 0.72, "x", True, "needs_review"),
        ("missing", "needs_review", 0.6, "", False, "needs_review"), ("needs_review", "missing", 0.6, "", False, "missing"),
        ("matched", "missing", 0.4, "x", True, "matched"), ("missing", "eligible", 0.9, "", False, "missing"),
    ]
    frame = spark.createDataFrame(rows, ["rule", "sug", "sure", "value", "cited", "want"])
    final, _source = ju.merged_status(*[F.col(c) for c in ("rule", "sug", "sure", "value", "cited")])
    assert all(r.final == r.want for r in frame.select("want", final.alias("final")).collect())


# ---- nothing is cut -------------------------------------------------------------------------------------------
def test_all_rule_lines_of_a_passage(spark):
    text = "\n".join(f"license thing number {i} " + "x" * 500 for i in range(13))
    chunks = spark.createDataFrame([(1, text)], "chunk_id long, chunk_text string")
    rows = ru.source_lines(chunks, DEMO).collect()
    assert [r.pos for r in rows] == list(range(13)) and all(len(r.line) > 500 for r in rows)
    plain = spark.createDataFrame([(1, "nothing here " * 100)], "chunk_id long, chunk_text string")
    assert ru.source_lines(plain, DEMO).count() == 1


def test_all_requirement_lines_and_findings(spark):
    text = "\n".join(f"attion {i} " + "y" * 300 for i in range(20))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert len(frame.select(rq.requirement_lines(F.col("text"), DEMO).alias("l")).first().l) == 20
    broken = spark.createDataFrame([(1, "\n".join(["\ufffd " + "z" * 200] * 21))], "doc_id long, text string")
    found = qa.encoding_findings(broken, ("\ufffd",)).collect()
    assert len(found) == 21 and all(len(r.excerpt) == 202 for r in found)


def test_all_table_like_lines(spark):
    text = "\n".join(f"attion nicht {i:04d} | {i} | eauou" for i in range(81))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = frame.select(qa.table_like_lines(F.col("text"), lambda i: F.floor(i / 10) + 1, DEMO).alias("r")).first().r
    assert len(rows) == 81


def test_short_needles_are_found(spark):
    needles = spark.createDataFrame([(1, "b c"), (2, "beta gamma delta eps"), (3, "q"), (4, "zz zz"), (5, "")], "needle_id long, needle string")
    hays = spark.createDataFrame([(1, "a b c d"), (2, "alpha beta gamma delta epsilon"), (3, "qqq")], "hay_id long, hay string")
    assert {(r.needle_id, r.hay_id) for r in text_pairs(needles, hays).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_a_larger_k_or_page_is_an_error():
    for call in (lambda: se.checked_k(21), lambda: se.checked_k(0), lambda: co.checked_page(1, 101), lambda: co.checked_page(0, 10)):
        with pytest.raises(ValueError):
            call()


def test_every_notice_is_sorted(spark):
    rows = spark.range(501).selectExpr("id AS notice_id", "date_format(date_add(date'2024-01-01', int(id)), 'yyyy-MM-dd HH:mm') AS bid_ntce_dt", "'' AS bid_clse_dt", "'' AS presmpt_prce", "'' AS bdgt_amt", "'' AS bssamt")
    assert [r.notice_id for r in co.multi_sort(rows, [("posted", "desc")]).collect()] == list(range(500, -1, -1))


# ---- masking --------------------------------------------------------------------------------------------------
def test_masking_reaches_inside(spark):
    frame = spark.sql("""SELECT map('user', map('name', array('call 900101-1234567'), 'api_key', array('k')), 'token', map('x', array('secret'))) AS m,
      'https://h/p?access_token=abc&x=1' AS url""")
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    got = frame.select(tx.sensitive_keys_mask(F.col("m"), kind).alias("m"), tx.pii_mask(F.col("url")).alias("u")).first()
    assert got.m == {"user": {"name": ["call [REDACTED_RRN]"], "api_key": ["[REDACTED]"]}, "token": {"x": ["[REDACTED]"]}}
    assert "abc" not in got.u and "x=1" in got.u


def test_unread_rows_of_a_source_make_a_next_page(spark):
    items = spark.createDataFrame([("1", "000", 0, 1, "2024")], "no string, ord string, source_rank int, arrival int, date_text string")
    for told, want in ((1, False), (5, True)):
        totals = spark.createDataFrame([(0, told, "")], "source_rank int, total_count long, error string")
        assert co.search_totals(items, totals, 1, 10).first().has_next_page is want


def test_token_counts_stay_in_the_row(spark):
    frame = spark.createDataFrame([(1, "bb aa BB cc aa aa"), (2, ""), (3, None)], "chunk_id long, chunk_text string")
    got = sorted(map(tuple, ix.term_frequencies(frame).collect()))
    assert got == [(1, "aa", 3), (1, "bb", 2), (1, "cc", 1)]
    assert "Exchange" not in ix.term_frequencies(frame)._jdf.queryExecution().executedPlan().toString()
