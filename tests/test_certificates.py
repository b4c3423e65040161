"""Certificates of every kind: their type, fields and state, and lists of kinds of business."""

import json
import time

import pytest
from pyspark.sql import functions as F

from bidlens.functions import evidence_types as et
from bidlens.operators import certificates as ce
from bidlens.operators import evidence as ev
from bidlens.plans import evidence_queries as eq

CASES = [
    ("G-PASS기업 지정서\n지정번호 : GP-1\n기업명 : 테스트 법인", "gpass_company_certificate", "G-PASS기업 지정: GP-1", None),
    ("ISO9001 인증서\n인증범위 : 소프트웨어 개발", "iso_quality_certificate", "ISO9001 인증: 소프트웨어 개발", None),
    ("벤처기업확인서\n기업명 : 테스트 법인", "venture_business_confirmation", "벤처기업확인서: 테스트 법인", None),
    ("기술혁신형 중소기업 확인서\n확인번호 : INNO-1", "innobiz_confirmation", "기술혁신형중소기업(Inno-Biz) 확인서: INNO-1", None),
    ("공장등록증명서\n공장소재지 : 경기도 성남시\n업종 : 전기장비 제조", "factory_registration_certificate", "공장등록증명서: 경기도 성남시", None),
    ("기업부설연구소 인정서\n연구소명 : 테스트 연구소", "research_institute_certificate", "기업부설연구소 인정서: 테스트 연구소", None),
    ("소프트웨어사업자일반현황관리확인서\n신고번호 : SW-1\n사업분야 : 컴퓨터 관련 서비스", "software_business_certificate",
     "소프트웨어사업자확인서: 컴퓨터 관련 서비스", "컴퓨터 관련 서비스"),
    ("소프트웨어사업자일반현황관리확인서\n신고번호 : SW-2\n기업명 : 테스트 법인", "software_business_certificate", "소프트웨어사업자확인서: 테스트 법인", None),
    ("소프트웨어품질인증서\n제품명 : 조달 분석 시스템", "software_quality_certificate", "소프트웨어품질인증서: 조달 분석 시스템", "조달 분석 시스템"),
    ("녹색기술인증서\n기술명 : 저전력 제어 기술\n인증번호 : GT-1", "green_technology_certificate", "녹색기술인증서: 저전력 제어 기술", "저전력 제어 기술"),
    ("녹색기술제품확인서\n제품명 : 친환경 제어기", "green_product_confirmation", "녹색기술제품확인서: 친환경 제어기", "친환경 제어기"),
    ("우수제품지정증서\n제품명 : 스마트 조달 단말", "excellent_product_certificate", "우수제품지정증서: 스마트 조달 단말", "스마트 조달 단말"),
    ("특허증\n발명의 명칭 : 스마트 조달 분석 장치\n등록번호 : 10-1234567", "patent_certificate", "특허증: 스마트 조달 분석 장치", "스마트 조달 분석 장치"),
    ("저작권등록증\n저작물의 명칭 : 조달 분석 프로그램", "copyright_registration_certificate", "저작권등록증: 조달 분석 프로그램", "조달 분석 프로그램"),
    ("옥외광고사업 등록증\n업종 : 옥외광고업", "outdoor_advertising_business_registration", "옥외광고사업 등록증: 옥외광고업", None),
    ("통신판매업신고증\n판매방식 : 인터넷", "online_sales_business_registration", "통신판매업신고증: 인터넷", None),
    ("조합원증\n조합원명 : 테스트 법인\n가입일 : 2026.01.01", "industry_association_membership", "조합원증: 테스트 법인", None),
    ("출자증권\n출자좌수 : 10좌", "investment_share_certificate", "출자증권: 10좌", None),
    ("고용안정장려금 승인서\n사업명 : 고용지원", "employment_support_approval", "고용안정장려금 승인: 고용지원", None),
    ("책임보험가입증명서\n보험종목 : 영업배상책임보험", "insurance_policy_certificate", "책임보험가입증명서: 영업배상책임보험", None),
    ("건강기능식품영업신고증\n업종 : 특수 영업", "special_business_license", "특수 영업/등록/신고증: 특수 영업", None),
    ("기술등급확인서\n기술등급 : T-2", "technology_grade_confirmation", "기술등급확인서: 확인서", None),  # the title holds the label
    ("기술평가우수기업인증서\n기술명칭 : 전자칠판 제조 기술", "technology_evaluation_excellent_certificate",
     "기술평가우수기업인증서: 전자칠판 제조 기술", "전자칠판 제조 기술"),
    ("조달청 경쟁입찰참가자격등록증\n업체명 : 주식회사 온세이엔씨\n등록업종 : 전기공사업", "procurement_registration_certificate",
     "등록증 업체명 : 주식회사 온세이엔씨 등록업종 : 전기공사업", None),  # the title holds a label, up to two lines continue it
    ("전기공사업 등록증\n상호 : 주식회사 온세이엔씨\n업종명 : 전기공사업", "license_registration_certificate", "전기공사업", None),
    ("기업신용평가등급확인서\n평가등급 : B+\n유효기간 : 2026.01.01 ~ 2026.12.31", "credit_rating_certificate", "기업신용평가등급 B+", None),
    ("국세 납세증명서\n체납액 없음\n유효기간 : 2026.05.31", "tax_payment_certificate", "국세 납세: 체납 없음", None),
    ("실적증명서\n사업명 : 저감숲 조성사업\n계약금액 : 120,000,000원\n수행기간 : 2025.01.01 ~ 2025.12.31", "performance_certificate",
     "저감숲 조성사업 / 120,000,000원 / 2025.01.01 ~ 2025.12.31", None),
    ("표준재무제표증명\n사업연도 : 2025", "financial_statement_certificate", "재무/매출 증빙 2025", None),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = ev.status(spark.createDataFrame([(i, c[0], None, "auto") for i, c in enumerate(CASES)], "evidence_id int, text string, file_name string, requested_type string"))
    found = ce.certificate_fields(rows.select("evidence_id", "text", "document_type"))
    fields = {}
    for r in found.collect():
        fields.setdefault(r.evidence_id, {}).setdefault(r.field_key, r.extracted_value)
    return {r.evidence_id: r.document_type for r in rows.collect()}, fields


def test_kinds_and_summaries(read):
    kinds, fields = read
    for i, (text, kind, summary, item) in enumerate(CASES):
        assert kinds[i] == kind, text
        assert fields[i]["license_summary"] == summary, text
        assert fields[i].get("business_item") == item, text


def test_fields_of_single_kinds(spark):
    texts = [
        (1, "중소기업확인서\n기업명 : 주식회사 온세이엔씨\n사업자등록번호 : 142-81-28387\n대표자 : 안영식\n기업규모 : 소기업\n유효기간 : 2026.01.01 ~ 2026.12.31",
         "small_business_confirmation"),
        (2, "직접생산확인증명서\n기업명 : 주식회사 온세이엔씨\n세부품명 : 전산업무 개발, 시스템관리\n유효기간 : 2026.01.01 ~ 2026.12.31", "direct_production_confirmation"),
        (3, None, "patent_certificate"), (4, "", "iso_quality_certificate"), (5, "임의의 회사 소개서입니다.", "unknown"),
    ]
    rows = spark.createDataFrame(texts, "evidence_id int, text string, document_type string").withColumns({"slot": F.lit("clash"), "head": F.lit("clash")})
    got = {}
    for r in ce.certificate_fields(rows).collect():
        got.setdefault(r.evidence_id, {})[r.field_key] = r.extracted_value
    assert got[1]["company_size_classification"] == "소기업" and got[1]["business_registration_number"] == "142-81-28387"
    assert got[1]["name"] == "주식회사 온세이엔씨" and got[1]["evidence_expiry_summary"] == "2026.01.01 ~ 2026.12.31"
    assert json.loads(got[1]["preference_tags_json"]) == ["중소기업"] and json.loads(got[1]["certifications_json"]) == ["중소기업확인서"]
    assert json.loads(got[2]["direct_production_items_json"]) == ["전산업무 개발", "시스템관리"] and got[2]["business_item"] == "전산업무 개발, 시스템관리"
    assert got[3] == {"certifications_json": '["특허증"]', "license_summary": "특허증"} and set(got[4]) == {"certifications_json", "license_summary"}
    assert 5 not in got


def test_every_kind_has_a_bound_text_of_its_kind(spark):
    texts = eq.kind_texts()
    rows = ev.status(spark.createDataFrame([(n, t, None, "auto") for n, t in texts], "evidence_id int, text string, file_name string, requested_type string"))
    assert {r.document_type for r in rows.collect()} >= set(et.KINDS) - set(et.REGISTRATION_KINDS)


def test_planning_is_short(spark):
    rows = spark.createDataFrame([(1, "특허증", "patent_certificate")], "evidence_id int, text string, document_type string")

    def seconds():
        started = time.perf_counter()
        ce.certificate_fields(rows)._jdf.queryExecution().executedPlan()
        return time.perf_counter() - started

    assert min(seconds() for _ in range(4)) < 3  # under 2 on an idle machine


def test_given_kind_lists(spark):
    given = spark.createDataFrame(
        [(["사업의 종류", "업태 건설업", "도매 및\n소매업"], ["종목 전기공사,신재생에너지설비설치전문기\n업", "건설업 정보통신공사업, 토목공사업"]), ([], []), (None, None)],
        "types array<string>, items array<string>",
    )
    got = [r.p for r in given.select(ev.given_kind_values(F.col("types"), F.col("items")).alias("p")).collect()]
    assert got[0].types == ["건설업", "도매 및 소매업"]
    assert {"전기공사", "신재생에너지설비설치전문기업", "정보통신공사업", "토목공사업"} <= set(got[0].items)
    assert not any("종목" in item for item in got[0].items)


def test_certificates_are_dealt_out_and_classified_once(spark):
    from pyspark.sql import functions as F

    from bidlens.plans import evidence_queries
    from bidlens.plans.bindings import Tables

    rows = ev.status(evidence_queries.all_certificates(Tables(spark, "/root/testdata/sf0.001")))
    assert rows.filter("evidence_id > 0").select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
    plan = rows.filter(F.col("document_type").isin("patent_certificate", "unknown"))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter " in line and "isnotnull" not in line]
    assert filters and all(line.split("Filter ")[1].startswith("document_type#") for line in filters)
