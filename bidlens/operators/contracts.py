"""Contract drafts: derived fields, checks, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx
from bidlens.operators.collection import keyword_filter

CONTACT_LABELS = {
    "corporation_representative_name": "대표자", "corporation_address": "주소", "corporate_registration_number": "법인등록번호",
    "corporation_phone": "전화번호",
}


def contract_list(contracts: DataFrame, notices: DataFrame, companies: DataFrame, keyword="", **equal) -> DataFrame:
    rows = contracts
    for column, value in equal.items():
        if value:
            rows = rows.filter(F.col(column) == value)
    rows = rows.join(notices.select("notice_id", "bid_ntce_nm"), "notice_id", "left").join(
        companies.select("company_id", F.col("name").alias("company_name")), "company_id", "left"
    )
    return keyword_filter(rows, keyword, ["title", "file_name", "bid_ntce_nm", "company_name"]).orderBy(F.desc("contract_id"))


def notice_number() -> Column:
    number, order = tx.clean_text(F.col("bid_ntce_no")), tx.clean_text(F.col("bid_ntce_ord"))
    return F.when((number != "") & ~order.isin("", "0", "00", "000"), F.concat(number, F.lit("-"), order)).otherwise(number)


def generated_fields(rows: DataFrame) -> DataFrame:
    """The 19 contract fields.  ``rows``: notice and company columns and a ``custom`` map of given values."""
    def custom(key):
        return tx.clean_text(F.try_element_at("custom", F.lit(key)))

    fields = {key: custom(key) for key in fv.CONTRACT_CUSTOM_FIELDS}
    fields.update(
        {
            "notice_number": notice_number(),
            "buyer_name": F.coalesce(F.nullif(custom("buyer_name"), F.lit("")), tx.first_present(F.col("ntce_instt_nm"), F.col("dminstt_nm"))),
            "corporation_name": tx.clean_text(F.col("name")),
            "corporation_address": tx.first_present(F.col("business_address"), F.col("headquarters_address")),
            "corporation_representative_name": tx.clean_text(F.col("representative_name")),
            "corporate_registration_number": tx.clean_text(F.col("corporate_number")),
            "service_name": tx.clean_text(F.col("bid_ntce_nm")),
            "contract_amount": F.coalesce(
                F.nullif(custom("contract_amount"), F.lit("")), tx.first_present(F.col("bssamt"), F.col("presmpt_prce"), F.col("bdgt_amt"))
            ),
        }
    )
    return rows.withColumns(fields)


def validate(rows: DataFrame) -> DataFrame:
    """Adds errors, warnings and valid to rows of generated fields."""
    about = F.concat_ws(" ", *[tx.present(F.col(c)) for c in ("bid_ntce_nm", "license_text", "analysis_summary")])
    errors = [
        F.when(tx.clean_text(F.col("service_name")) == "", "공고명이 없어 계약서 초안을 생성할 수 없습니다."),
        F.when(tx.clean_text(F.col("corporation_name")) == "", "법인명이 없어 계약서 초안을 생성할 수 없습니다."),
    ]
    warnings = [
        F.when(
            ~tx.contains_any(about, fv.SERVICE_WORDS),
            "선택한 공고가 용역 공고인지 명확하지 않습니다. 표준계약서 초안 적용 전 원문 검토가 필요합니다.",
        )
    ] + [F.when(tx.clean_text(F.col(c)) == "", f"계약상대자 {label} 값이 비어 있습니다.") for c, label in CONTACT_LABELS.items()]
    out = rows.withColumns({"errors": F.array_compact(F.array(*errors)), "warnings": F.array_compact(F.array(*warnings))})
    return out.withColumn("valid", F.size("errors") == 0)


def contract_judgments(contracts: DataFrame, runs: DataFrame) -> DataFrame:
    """Whether the judgment a contract names belongs to its notice and company."""
    named = runs.select(F.col("run_id").alias("judgment_id"), F.col("notice_id").alias("run_notice"), F.col("company_id").alias("run_company"))
    fits = (F.col("run_notice") == F.col("notice_id")) & (F.col("run_company") == F.col("company_id"))
    state = (
        F.when(F.col("judgment_id").isNull(), "none").when(F.col("run_notice").isNull(), "judgment_not_found")
        .when(fits, "ok").otherwise("judgment_mismatch")
    )
    return contracts.join(named, "judgment_id", "left").withColumn("judgment_state", state).drop("run_notice", "run_company")
