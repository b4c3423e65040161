"""The token index: build, check, manifest, swap of runs, removal of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions import text as tx


def token_counts(text: Column) -> Column:
    """array<struct<token, tf>> of a passage: equal tokens are neighbours once sorted, so all stays in the row."""
    def counted(tokens: Column) -> Column:
        starts = F.array_compact(F.transform(tokens, lambda x, i: F.when((i == 0) | (F.get(tokens, i - 1) != x), i)))
        return tx.let(starts, lambda at: F.zip_with(
            at, F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(tokens))),
            lambda i, end: F.struct(F.get(tokens, i).alias("token"), (end - i).cast("long").alias("tf")),
        ))

    return F.filter(tx.let(F.array_sort(tx.tokenize(text)), counted), lambda r: r["token"].isNotNull())


def term_frequencies(chunks: DataFrame) -> DataFrame:
    """(chunk_id, token, tf), counted in the row that owns the passage: no shuffle."""
    return chunks.select("chunk_id", F.explode(token_counts(F.col("chunk_text"))).alias("r")).select("chunk_id", "r.token", "r.tf")


def postings(chunks: DataFrame) -> DataFrame:
    """Distinct tokens of each passage, for scoring; keeps the other columns but the text."""
    kept = [c for c in chunks.columns if c != "chunk_text"]
    return chunks.select(*kept, F.explode(F.array_distinct(tx.tokenize(F.col("chunk_text")))).alias("token"))


def vector_id(chunks: DataFrame | None = None) -> Column:
    return F.concat_ws("-", F.lit("basis"), F.col("doc_id"), F.col("chunk_id"), F.substring("chunk_hash", 1, 12))


def build(chunks: DataFrame) -> DataFrame:
    """Index items with their token map; a passage never leaves its row."""
    return chunks.select(
        "doc_id", "chunk_id", "chunk_index", "chunk_hash", vector_id().alias("vector_id"),
        F.substring("chunk_text", 1, 400).alias("text_preview"), "section_title", "char_start", "char_end",
        F.map_from_entries(token_counts(F.col("chunk_text"))).alias("tokens"),
    )


def searchable(chunks: DataFrame, category: str = "", version: str = "") -> DataFrame:
    """Passages that may be searched: completed documents, indexed passages, optional category / version.

    ``chunks`` carry their document's category, document_version, processing_status and index_status, so nothing is
    joined and the filters on documents sink below the cutting.
    """
    good = chunks.filter((F.col("processing_status") == "completed") & (F.col("index_status") == "completed"))
    if category:
        good = good.filter(F.col("category") == category)
    if version:
        good = good.filter(F.col("document_version") == version)
    good = good.filter((F.col("vector_status") == "indexed") & (F.col("vector_id") != ""))
    return good.drop("processing_status", "index_status", "quality")


def differences(table: DataFrame, index: DataFrame) -> DataFrame:
    """Full outer comparison of searchable passages and index items; one row per vector id and finding.

    ``index`` has vector_id, doc_id, chunk_id, chunk_hash and tokens_ok.
    """
    left = table.select("vector_id", *[F.col(c).alias(f"t_{c}") for c in ("doc_id", "chunk_id", "chunk_hash")])
    right = index.select(
        "vector_id", *[F.col(c).alias(f"i_{c}") for c in ("doc_id", "chunk_id", "chunk_hash")], "tokens_ok"
    )
    both = left.join(right, "vector_id", "full_outer")
    in_table, in_index = F.col("t_chunk_id").isNotNull(), F.col("i_chunk_id").isNotNull()
    same = (
        F.col("t_doc_id").eqNullSafe(F.col("i_doc_id")) & F.col("t_chunk_id").eqNullSafe(F.col("i_chunk_id"))
        & F.col("t_chunk_hash").eqNullSafe(F.col("i_chunk_hash"))
    )
    # an item without a token map is reported as that, and is not compared further
    finding = (
        F.when(~in_index, "missing_from_index")
        .when(~in_table & ~F.col("tokens_ok"), "missing_from_table+invalid_item")
        .when(~in_table, "missing_from_table")
        .when(~F.col("tokens_ok"), "invalid_item")
        .when(~same, "mismatched")
        .otherwise("ok")
    )
    return both.select("vector_id", finding.alias("finding"), in_index.alias("in_index"), in_table.alias("in_table"))


def validate(table: DataFrame, index: DataFrame) -> DataFrame:
    """One row: counts of each finding, status, and whether search is allowed."""
    f = F.col("finding")
    counts = differences(table, index).agg(
        F.count_if("in_table").alias("table_count"),
        F.count_if("in_index").alias("index_count"),
        F.count_if(f == "missing_from_index").alias("missing_from_index"),
        F.count_if(f.startswith("missing_from_table")).alias("missing_from_table"),
        F.count_if(f == "mismatched").alias("mismatched"),
        F.count_if(f.contains("invalid_item")).alias("invalid_items"),
    )
    broken = F.col("missing_from_index") + F.col("missing_from_table") + F.col("mismatched") + F.col("invalid_items") > 0
    lost = (F.col("index_count") == 0) & (F.col("table_count") > 0)
    return counts.withColumns(
        {
            "status": F.when(lost, "missing").when(broken, "inconsistent").otherwise("ok"),
            "valid": ~broken,
            "can_search": ~broken & (F.col("index_count") > 0),
            "rebuild_required": broken,
        }
    )


def manifest(index: DataFrame, schema_version: str = "token-index-v1", model: str = "token-frequency") -> DataFrame:
    """One row: count and a checksum that does not depend on row order.

    Row hashes are folded by xor and by sum, both of which combine per partition; nothing is collected.
    """
    row = F.sha2(F.concat_ws("|", "vector_id", "doc_id", "chunk_id", "chunk_index", "chunk_hash", "token_kinds", "token_total"), 256)
    part = [F.conv(F.substring(F.col("h"), start, 15), 16, 10).cast("long") for start in (1, 16)]
    folded = index.select(row.alias("h")).agg(
        F.count("*").alias("chunk_count"), F.coalesce(F.bit_xor(part[0]), F.lit(0)).alias("x"),
        F.coalesce(F.sum(part[1].cast("decimal(38,0)")), F.lit(0)).alias("s"),
    )
    return folded.select(
        F.lit(schema_version).alias("schema_version"), F.lit(model).alias("model"), "chunk_count",
        F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", "chunk_count", "x", F.col("s").cast("string")), 256)).alias("checksum"),
    )


def current_runs(runs: DataFrame) -> DataFrame:
    """Latest successful run of each document; a failed run leaves the one before in place."""
    return runs.filter(F.col("status") == "completed").groupBy("doc_id").agg(F.max("run_id").alias("run_id"))


def swap_runs(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    return chunks.join(current_runs(runs), ["doc_id", "run_id"], "left_semi")


def write_runs(chunks: DataFrame, path: str) -> None:
    """Write passages by run; only the partitions of the runs written are replaced, readers pick with ``swap_runs``."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def drop_documents(rows: DataFrame, deletions: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rows of documents that are not deleted; with an invalid index the deletion is refused."""
    allowed = deletions.filter(verdict.select("valid").scalar()).select("doc_id")
    return rows.join(allowed, "doc_id", "left_anti")


def document_rollup(documents: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Page, passage and vector counts with the resulting states, per document."""
    by_chunk = chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunk_count"),
        F.count_if((F.col("vector_status") == "indexed") & (F.col("vector_id") != "")).alias("vector_count"),
    )
    by_page = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    joined = documents.join(by_chunk, "doc_id", "left").join(by_page, "doc_id", "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("chunk_count", "vector_count", "page_count")}
    out = joined.withColumns(counts)
    return out.select(
        "doc_id", *counts,
        F.when(F.col("chunk_count") > 0, "completed").otherwise("failed").alias("chunk_status"),
        F.when(F.col("processing_status") != "completed", "failed")
        .when((F.col("chunk_count") > 0) & (F.col("vector_count") == F.col("chunk_count")), "completed").otherwise("failed")
        .alias("index_status"),
    )


def chunk_list(chunks: DataFrame, documents: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Passages of chosen documents in index order with the document's own columns."""
    chosen = chunks.join(doc_ids.select("doc_id"), "doc_id", "left_semi")
    return chosen.join(documents, "doc_id").orderBy("doc_id", "chunk_index")
