"""Notice search pages, collection runs, caches and list filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx

MAX_PAGE = 100


def first_by_source(items: DataFrame) -> DataFrame:
    """One row per (no, ord): the earlier source wins, then arrival.  Items without a number are dropped."""
    order = F.coalesce(F.nullif(tx.clean_text(F.col("ord")), F.lit("")), F.lit(fv.DEFAULT_NOTICE_ORDER))
    rows = items.withColumns({"no": tx.clean_text(F.col("no")), "ord": order}).filter(F.col("no") != "")
    others = [c for c in items.columns if c not in ("no", "ord")]
    return rows.groupBy("no", "ord").agg(F.min_by(F.struct(*others), F.struct("source_rank", "arrival")).alias("r")).select("no", "ord", "r.*")


def checked_page(page: int, page_size: int) -> tuple[int, int]:
    """Both as they are; an error outside the bounds, never fewer rows than asked for."""
    if page < 1 or not 1 <= page_size <= MAX_PAGE:
        raise ValueError(f"pages start at 1 and hold 1 to {MAX_PAGE} rows")
    return page, page_size


def search_page(items: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page over all sources, newest date text first.

    ``items``: no, ord, source_rank, arrival, date_text.  Equal dates keep source and arrival order.  The page is a
    limit in order, so each task keeps at most offset + size rows.
    """
    page, size = checked_page(page, page_size)
    ordered = first_by_source(items).orderBy(F.desc("date_text"), "source_rank", "arrival", "no", "ord")
    return ordered.offset((page - 1) * size).limit(size)


def search_totals(items: DataFrame, totals: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """One row: total (sum of what the sources say), failing sources, and whether another page follows,
    here or because a source has more than it delivered.

    ``totals``: source_rank, total_count, error.
    """
    page, size = checked_page(page, page_size)
    good = F.col("error") == ""
    told = totals.agg(
        F.coalesce(F.sum(F.when(good, F.col("total_count"))), F.lit(0)).alias("total_count"), F.count_if(~good).alias("failed_sources"),
        F.count_if(good).alias("answered_sources"),
    )
    delivered = items.groupBy("source_rank").agg(F.count("*").alias("n"))
    unread = totals.join(delivered, "source_rank", "left").filter(good & (F.col("total_count") > F.coalesce("n", F.lit(0))))
    found = first_by_source(items).agg(F.count("*").alias("n"))
    told = told.withColumns({"distinct_items": found.select("n").scalar(), "unread_sources": unread.agg(F.count("*").alias("u")).select("u").scalar()})
    return told.select(
        "total_count", "failed_sources", "distinct_items", ((F.col("distinct_items") > page * size) | (F.col("unread_sources") > 0)).alias("has_next_page"),
        F.when(F.col("answered_sources") == 0, "failed").when(F.col("failed_sources") > 0, "partial_failed").otherwise("00").alias("result_code"),
    )


def run_summary(outcomes: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts and state of each collection run.  ``runs``: run_id, configured, error; ``outcomes``: run_id, outcome."""
    o = F.col("outcome")
    counts = outcomes.groupBy("run_id").agg(
        F.count("*").alias("searched"), F.count_if(o == "saved").alias("saved"), F.count_if(o != "saved").alias("skipped"),
        F.count_if(o == "failed").alias("save_failures"),
    )
    rows = runs.join(counts, "run_id", "left").fillna(0, ["searched", "saved", "skipped", "save_failures"])
    state = (
        F.when(~F.col("configured"), "not_configured").when(F.col("error") == "all", "failed")
        .when((F.col("saved") > 0) & (F.col("save_failures") > 0), "partial_failed").when(F.col("error") != "", "partial_failed").otherwise("completed")
    )
    return rows.withColumn("status", state).withColumn("retryable", F.col("status") != "completed")


def keyword_filter(rows: DataFrame, keyword: str, columns) -> DataFrame:
    """Rows where any of the columns holds the keyword, case aside."""
    low = keyword.strip().lower()
    return rows.filter(tx.any_of(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(low) for c in columns)) if low else rows


def run_list(runs: DataFrame, columns, status: str = "", keyword: str = "", key: str = "run_id") -> DataFrame:
    out = runs.filter(F.col("status") == status) if status else runs
    return keyword_filter(out, keyword, columns).orderBy(F.desc(key))


def saved_search(notices: DataFrame, keyword: str) -> DataFrame:
    """Keyword anywhere in four fields taken as one text (a match may span two fields)."""
    text = F.lower(F.concat_ws(" ", "bid_ntce_nm", "ntce_instt_nm", "dminstt_nm", "bid_ntce_no"))
    return notices.filter(text.contains(keyword.strip().lower())).orderBy(F.desc("notice_id"))


def time_value(c: Column) -> Column:
    """Digits yyyyMMddHHmm of a date text as a number; null when there are fewer."""
    d = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    return F.when(F.length(d) >= 12, F.substring(d, 1, 12).cast("long"))


def sort_values() -> dict[str, Column]:
    amount = tx.first_present(*[F.col(c) for c in fv.MONEY_LABELS])
    return {
        "posted": time_value(F.col("bid_ntce_dt")), "deadline": time_value(F.col("bid_clse_dt")),
        "amount": F.when(amount != "", tx.money_decimal(amount)),
    }


def multi_sort(notices: DataFrame, rules) -> DataFrame:
    """All notices by any of posted, deadline, amount, each asc or desc: a range sort over all tasks.

    Missing values come last, equal ones by id.
    """
    values = sort_values()
    order = [values[name].asc_nulls_last() if direction == "asc" else values[name].desc_nulls_last() for name, direction in rules]
    return notices.orderBy(*order, "notice_id")


def cache_lookup(requests: DataFrame, analyses: DataFrame, keys) -> DataFrame:
    """Latest analysis with the same inputs, per request; ``cache`` is hit or miss."""
    keys = list(keys)
    latest = analyses.groupBy(*keys).agg(F.max("analysis_id").alias("analysis_id"))
    return requests.join(latest, keys, "left").withColumn("cache", F.when(F.col("analysis_id").isNotNull(), "hit").otherwise("miss"))


def project_documents_filter(documents: DataFrame, projects: DataFrame, companies: DataFrame, keyword="", status="") -> DataFrame:
    rows = documents.join(projects, "project_id", "left").join(companies, "company_id", "left")
    rows = rows.filter(F.col("analysis_status") == status) if status else rows
    return keyword_filter(rows, keyword, ["file_name", "project_name", "company_name", "document_type"])


COMPANY_SEARCH = (
    "name", "management_group_name", "business_category", "region", "business_registration_number", "representative_name", "license_summary",
)


def company_filter(companies: DataFrame, keyword: str) -> DataFrame:
    """Keyword in any of nine columns; list columns are searched as comma text."""
    lists = {c + "_text": F.array_join(tx.json_list(F.col(c)), ", ") for c in ("preference_tags_json", "direct_production_items_json")}
    return keyword_filter(companies.withColumns(lists), keyword, [*COMPANY_SEARCH, *lists]).drop(*lists)


def company_groups(companies: DataFrame) -> DataFrame:
    name = tx.clean_text(F.col("management_group_name"))
    return companies.select(F.coalesce(F.nullif(name, F.lit("")), F.lit(fv.DEFAULT_GROUP)).alias("management_group")).distinct()


def notice_attachments(notices: DataFrame, files: DataFrame) -> DataFrame:
    """A notice with its attachments as a list in id order (a notice names a dozen at most)."""
    listed = files.groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("attachment_id", "file_name", "support_status"))).alias("attachments"))
    return notices.join(listed, "notice_id", "left")
