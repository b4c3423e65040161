"""Operations reporting: run log, failures, queues, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.operators.collection import keyword_filter


def numbered(rows: DataFrame, key: str, order: str, slot: Column, name: str) -> DataFrame:
    """Row number per key in the given order, without one task per key.

    ``slot`` rises with the order (a day, say).  Rows are numbered inside (key, slot), and each slot starts where the
    ones before it end; only the small table of slot counts is windowed by key.
    """
    rows = rows.withColumn("_slot", slot)
    counts = rows.groupBy(key, "_slot").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(key, "_slot", F.coalesce(before, F.lit(0)).alias("_start"))
    local = F.row_number().over(W.partitionBy(key, "_slot").orderBy(order))
    return rows.withColumn("_local", local).join(starts, [key, "_slot"]).withColumn(name, F.col("_start") + F.col("_local")).drop(
        "_slot", "_local", "_start"
    )


def record_runs(runs: DataFrame, slot: Column) -> DataFrame:
    """Adds retry_count: which retry of the same run this is; 0 for first tries.  ``runs``: run_id, retry_of, ..."""
    retries = numbered(runs.filter(F.col("retry_of").isNotNull()), "retry_of", "run_id", slot, "retry_count")
    first = runs.filter(F.col("retry_of").isNull()).withColumn("retry_count", F.lit(0).cast("long"))
    return first.unionByName(retries)


RUN_SEARCH = ("operation_type", "target_type", "request_json", "result_json", "error_message")


def run_list(runs: DataFrame, status="", operation_type="", keyword="") -> DataFrame:
    out = runs.filter(F.col("status") == status) if status else runs
    out = out.filter(F.col("operation_type") == operation_type) if operation_type else out
    return keyword_filter(out, keyword, RUN_SEARCH).orderBy(F.desc("run_id"))


def error_code(status: Column, message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    failed = status.isin("failed", "partial_failed")
    return (
        F.when(status == "not_configured", "missing_api_key")
        .when(failed & (low.contains("timeout") | low.contains("network") | low.contains("urlopen")), "network_error")
        .when(failed & low.contains("ocr"), "ocr_failed").when(failed & low.contains("stored file not found"), "storage_error")
        .when(failed, "unknown_error").otherwise("")
    )


def first_bad(columns) -> Column:
    """First of the status columns that tells a failure."""
    return F.coalesce(*[F.when(F.col(c).isin(*fv.FAILURE_STATUSES), F.col(c)) for c in columns])


def failures(sources) -> DataFrame:
    """All failing rows of several tables in one schema.

    ``sources``: (operation, frame, status columns in order of importance, label column); frames have id,
    error_message, updated_at.
    """
    parts = []
    for operation, frame, statuses, label in sources:
        bad = first_bad(statuses)
        message = F.coalesce(F.nullif("error_message", F.lit("")), F.lit("No failure detail was recorded."))
        parts.append(
            frame.filter(bad.isNotNull()).select(
                F.lit(operation).alias("operation"), "id", F.col(label).cast("string").alias("label"), bad.alias("status"),
                message.alias("error_message"), "updated_at",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def recent_failures(sources, limit: int = 8) -> DataFrame:
    """Newest failures over all tables: a limit in order, so a task keeps ``limit`` rows and nothing is sorted whole."""
    return failures(sources).orderBy(F.desc("updated_at"), "operation", F.desc("id")).limit(limit)


def failures_since(sources, since: Column) -> DataFrame:
    return failures(sources).filter(F.col("updated_at") >= since).agg(F.count("*").alias("failed_jobs"))


def review_queues(queues: dict) -> DataFrame:
    """(queue, count) of pending rows; empty queues are left out.  ``queues``: name -> (frame, condition)."""
    parts = [
        frame.agg(F.count_if(pending).alias("pending_count")).select(F.lit(name).alias("queue"), "pending_count")
        for name, (frame, pending) in queues.items()
    ]
    return reduce(DataFrame.unionByName, parts).filter(F.col("pending_count") > 0)


def counters(named: dict) -> DataFrame:
    """One row of counters; those of one table are one aggregate over it.  ``named``: name -> (frame, condition)."""
    by_table: dict[int, tuple[DataFrame, list]] = {}
    for name, (frame, cond) in named.items():
        by_table.setdefault(id(frame), (frame, []))[1].append(F.count_if(cond).alias(name))
    first, *rest = [frame.agg(*counts) for frame, counts in by_table.values()]
    for other in rest:
        first = first.withColumn("_other", other.select(F.struct("*").alias("r")).scalar()).select("*", "_other.*").drop("_other")
    return first.select(*named)


def overall_status(failed: Column, warning: Column, pending: Column) -> Column:
    return F.when(failed > 0, "action_required").when(warning | (pending > 0), "warning").otherwise("ok")


def latest_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Newest row per key: an aggregate, so each task sends one row per key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(key, "r.*")


def cascade_delete(projects_gone: DataFrame, documents: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and analyses that stay when projects go."""
    doomed = documents.join(projects_gone.select("project_id"), "project_id", "left_semi").select("document_id")
    return documents.join(projects_gone.select("project_id"), "project_id", "left_anti"), analyses.join(doomed, "document_id", "left_anti")
