"""Requirements mined from bid notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx
from bidlens.functions.dictionaries import KOREAN, Dictionaries
from bidlens.operators import rules as ru

RESULT_COLUMNS = ("regions", "licenses", "company_types", "required_documents", "requirement_lines")


def notice_regions(region_text: Column, text: Column, d: Dictionaries = KOREAN) -> Column:
    return tx.ordered_distinct(F.concat(F.array(F.coalesce(region_text, F.lit(""))), ru.region_terms(text, d)))


def requirement_lines(text: Column, d: Dictionaries = KOREAN, max_lines: int | None = None, line_chars: int | None = None) -> Column:
    """Distinct lines that hold a keyword; both limits are for callers that show lines."""
    wanted = F.filter(tx.filled_lines(text), lambda x: tx.contains_any(x, d.requirement_keywords))
    return tx.ordered_distinct(F.transform(tx.first_items(wanted, max_lines), lambda x: tx.first_chars(x, line_chars)))


def notice_requirements(notices: DataFrame, d: Dictionaries = KOREAN, saved: DataFrame | None = None) -> DataFrame:
    """Adds the requirement lists to each notice; a saved result, where present, is used as it is."""
    text = F.coalesce("text", F.lit(""))
    lists = {
        "regions": notice_regions(F.col("region_text"), text, d),
        "licenses": tx.ordered_distinct(
            F.concat(F.array(F.coalesce("license_text", F.lit(""))), ru.labels(text, d.licenses, d.shadowed))
        ),
        "company_types": ru.labels(text, d.companies, d.shadowed),
        "required_documents": ru.labels(text, d.documents, d.shadowed),
        "requirement_lines": requirement_lines(text, d),
    }
    if saved is None:
        return notices.withColumns(lists)
    stored = saved.select("notice_id", F.struct(*RESULT_COLUMNS).alias("saved"))
    rows = notices.join(stored, "notice_id", "left")
    return rows.withColumns(
        {k: F.when(F.col("saved").isNotNull(), F.col(f"saved.{k}")).otherwise(v) for k, v in lists.items()}
    ).drop("saved")


def _candidate(type_: str, value: Column, key: Column | None = None, source: Column | None = None) -> Column:
    value = tx.clean_text(value)
    return F.struct(
        F.lit(type_).alias("requirement_type"), (key if key is not None else tx.compact_key(value)).alias("requirement_key"),
        value.alias("required_value"), tx.compact_key(value).alias("normalized_value"),
        F.lit(fv.REQUIREMENT_CONFIDENCE[type_]).alias("confidence"),
        (source if source is not None else F.lit(fv.REQUIREMENT_SOURCE_TEXT[type_])).alias("source_text"),
    )


def candidate_array(extracted: DataFrame) -> Column:
    def each(type_, column):
        return F.transform(column, lambda v: _candidate(type_, v))

    def named(type_, table, shown):
        filled = [
            F.when(tx.clean_text(F.col(k)) != "", _candidate(type_, F.concat(F.lit(label + ": "), shown(F.col(k))), F.lit(k)))
            for k, label in table.items()
        ]
        return F.array_compact(F.array(*filled))

    every = F.concat(
        each("region", "regions"), each("license", "licenses"), each("company_type", "company_types"),
        each("required_document", "required_documents"),
        named("money", fv.MONEY_LABELS, tx.won_format), named("date", fv.DATE_LABELS, lambda c: c),
        F.transform("requirement_lines", lambda v: _candidate("requirement_line", v, None, v)),
    )

    def first_of_each(rows):
        identity = F.transform(
            rows,
            lambda r: F.concat_ws("\x01", r["requirement_type"], F.coalesce(F.nullif(r["normalized_value"], F.lit("")), r["required_value"])),
        )
        return tx.let(
            F.struct(rows.alias("r"), identity.alias("k")),
            lambda s: F.filter(
                s["r"], lambda r, i: (r["required_value"] != "") & (F.array_position(s["k"], F.get(s["k"], i)) == i + 1)
            ),
        )

    return tx.let(every, first_of_each)


def requirement_candidates(extracted: DataFrame) -> DataFrame:
    """One row per distinct requirement of a notice.  A notice's lists sit in its row, so nothing is shuffled."""
    rows = extracted.select("notice_id", F.posexplode(candidate_array(extracted)).alias("pos", "c"))
    label = F.create_map(*[F.lit(x) for kv in fv.REQUIREMENT_TYPE_LABELS.items() for x in kv])
    return rows.select(
        "notice_id", "pos", "c.*", F.try_element_at(label, F.col("c.requirement_type")).alias("label"), F.lit("candidate").alias("status")
    )


def type_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("notice_id", "requirement_type").agg(F.count("*").alias("requirement_count"))


def requirement_inputs(candidates: DataFrame, d: Dictionaries = KOREAN) -> DataFrame:
    """What a judgment needs to know about a requirement."""
    type_, value = F.col("requirement_type"), tx.clean_text(F.col("required_value"))
    documents = tx.let(
        ru.labels(value, d.documents, d.shadowed), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(value))
    )
    evidence = F.when(type_ == "required_document", documents).otherwise(ru.evidence_types(type_, value, d))
    manual = type_.isin(*fv.MANUAL_TYPES) | (value == "")
    return candidates.withColumns(
        {
            "required_evidence_types": evidence,
            "related_profile_fields": ru.profile_fields(type_, fv.REQUIREMENT_PROFILE_FIELDS),
            "needs_review": manual,
            "comparison_strategy": F.when(manual, "manual_review").otherwise("controlled_text_match"),
        }
    )


def input_summary(inputs: DataFrame) -> DataFrame:
    types = [F.count_if(F.col("requirement_type") == k).alias(f"{k}_count") for k in fv.REQUIREMENT_TYPE_LABELS]
    return inputs.groupBy("notice_id").agg(
        F.count("*").alias("requirement_count"), F.count_if("needs_review").alias("needs_review_count"), *types
    )


def replace_requirements(stored: DataFrame, fresh: DataFrame, force: bool = False) -> DataFrame:
    """A new extraction replaces a notice's requirements; without ``force`` notices that have some keep them."""
    if force:
        return stored.join(fresh.select("notice_id").distinct(), "notice_id", "left_anti").unionByName(fresh)
    return stored.unionByName(fresh.join(stored.select("notice_id").distinct(), "notice_id", "left_anti"))


def drop_dependents(dependents: DataFrame, replaced: DataFrame) -> DataFrame:
    """Comparisons and judgments of notices whose requirements were replaced are void."""
    return dependents.join(replaced.select("notice_id").distinct(), "notice_id", "left_anti")


def preserve_on_partial(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Keep an earlier result when the new analysis is partial.

    ``previous``: notice_id, result_count; ``current``: notice_id, supported_count, failed_count, result_count.
    """
    old = previous.select("notice_id", F.col("result_count").alias("old_count"))
    new = current.select("notice_id", "supported_count", "failed_count", F.col("result_count").alias("new_count"))
    rows = old.join(new, "notice_id", "full_outer")
    had = F.coalesce("old_count", F.lit(0)) > 0
    ran = F.col("supported_count").isNotNull()
    partial = ran & ((had & (F.col("supported_count") == 0)) | (F.col("failed_count") > 0))
    keep = ~ran | (had & partial)
    return rows.select(
        "notice_id", F.when(~ran, "not_run").when(partial, "partial_failed").otherwise("completed").alias("analysis_status"),
        F.when(keep, "previous").otherwise("current").alias("kept"),
        F.when(keep, F.col("old_count")).otherwise(F.col("new_count")).alias("result_count"),
        F.when(ran & had & partial & (F.col("supported_count") == 0), "no_supported_attachment")
        .when(ran & had & partial, "failed_download").otherwise("").alias("preserve_reason"),
    )


def notice_summary_text(notices: DataFrame, texts: str = "attachment_texts", attachment_chars: int | None = None) -> DataFrame:
    """Label lines of a notice followed by its numbered attachment texts."""
    shown = [
        ("공고명", F.col("bid_ntce_nm")), ("공고번호", F.concat("bid_ntce_no", F.lit("-"), "bid_ntce_ord")),
        ("공고기관", F.col("ntce_instt_nm")), ("수요기관", F.col("dminstt_nm")), ("공고일시", F.col("bid_ntce_dt")),
        ("입찰개시", F.col("bid_begin_dt")), ("입찰마감", F.col("bid_clse_dt")), ("개찰일시", F.col("openg_dt")),
        ("추정가격", tx.won_format(F.col("presmpt_prce"))), ("기초금액", tx.won_format(F.col("bssamt"))),
        ("지역", F.col("region_text")), ("면허/업종 제한", F.col("license_text")),
    ]
    head = F.concat_ws("\n", *[F.concat(F.lit(k + ": "), F.coalesce(v, F.lit(""))) for k, v in shown], F.lit(""), F.lit("첨부문서 추출 내용:"))
    parts = F.transform(
        F.coalesce(texts, F.array().cast("array<string>")),
        lambda x, i: F.concat(F.lit("[첨부 "), (i + 1).cast("string"), F.lit("]\n"), tx.first_chars(x, attachment_chars), F.lit("\n")),
    )
    return notices.select("notice_id", tx.clean_text(F.concat_ws("\n", head, F.array_join(parts, "\n"))).alias("summary_text"))
