"""Parsed document layout: page text, tables, reading order, recognised pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx


def assemble_pages(elements: DataFrame) -> DataFrame:
    """Page text of (doc_id, page_number, ord, text) elements, with its place in the document text.

    Pages that have text follow each other two characters apart.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda e: e["text"])
    pages = elements.groupBy("doc_id", "page_number").agg(
        tx.basis_normalize(F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")).alias("page_text")
    )
    n = F.length("page_text")
    before = F.coalesce(
        F.sum(F.when(n > 0, n + 2).otherwise(0)).over(
            W.partitionBy("doc_id").orderBy("page_number").rowsBetween(W.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    start = F.when(n > 0, before).otherwise(F.greatest(before - 2, F.lit(0)))
    return pages.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + n)


def document_text(pages: DataFrame) -> DataFrame:
    """Document text: its non-empty pages in order (a document is one row by definition)."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("page_text") != "", F.struct("page_number", "page_text"))))
    return pages.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["page_text"]), "\n\n").alias("text"), F.count("*").alias("page_count")
    )


def filled_rows(rows: Column) -> Column:
    return F.filter(rows, lambda r: F.exists(r["cells"], lambda c: tx.clean_text(c) != ""))


def flatten_table_rows(tables: DataFrame) -> DataFrame:
    """One row per table row that is not blank; the first one holds the headers."""
    rows = tables.select("doc_id", "page_number", "table_id", F.posexplode(filled_rows(F.col("rows"))).alias("pos", "row"))
    return rows.select(
        "doc_id", "page_number", "table_id", F.col("row.row_index").alias("row_index"),
        F.transform("row.cells", tx.clean_text).alias("cells"), (F.col("pos") == 0).alias("is_header"),
    )


def table_measures(tables: DataFrame) -> DataFrame:
    cells = F.filter(F.flatten(F.transform("rows", lambda r: r["cells"])), lambda c: tx.clean_text(c) != "")
    return tables.withColumns(
        {
            "row_count": F.size("rows"),
            "column_count": F.array_max(F.transform("rows", lambda r: F.size(r["cells"]))),
            "filled_count": F.size(cells),
            "text_length": F.aggregate(cells, F.lit(0), lambda a, c: a + F.length(tx.clean_text(c))),
            "header_text": F.lower(F.array_join(F.get("rows", F.lit(0))["cells"], " ")),
        }
    )


def meaningful_tables(tables: DataFrame, header_terms=tuple(fv.TABLE_HEADER_TERMS)) -> DataFrame:
    m = table_measures(tables)
    shape = (F.col("row_count") >= 2) & (F.col("column_count") >= 2) & (F.col("filled_count") >= 3)
    large = (F.col("row_count") >= 3) & (F.col("column_count") >= 3) & (F.col("text_length") >= 40)
    return m.filter(shape & (tx.contains_any(F.col("header_text"), header_terms) | large))


def table_markdown(rows: Column) -> Column:
    """Pipe table of a rows array; short rows are padded, a blank header becomes col_i."""
    cells = F.transform(rows, lambda r: F.transform(r["cells"], lambda c: F.replace(tx.clean_text(c), F.lit("|"), F.lit("\\|"))))

    def render(matrix):
        width = F.array_max(F.transform(matrix, F.size))

        def pad(row):
            return F.slice(F.concat(row, F.array_repeat(F.lit(""), width)), F.lit(1), width)

        def line(values):
            return F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))

        head = pad(F.get(matrix, F.lit(0)))
        named = F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("col_"), i.cast("string")))
        shown = F.when(F.exists(head, lambda c: c != ""), head).otherwise(named)
        body = F.transform(F.slice(matrix, F.lit(2), F.size(matrix)), lambda r: line(pad(r)))
        return F.array_join(F.concat(F.array(line(shown), line(F.array_repeat(F.lit("---"), width))), body), "\n")

    return F.when(F.size(rows) == 0, "").otherwise(tx.let(cells, render))


def table_previews(tables: DataFrame, limit: int = 10) -> DataFrame:
    """First tables of each document with their size and headers (a rank, so a task passes on ten rows per document)."""
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("page_number", "table_id"))
    first = table_measures(tables).withColumn("position", order).filter(F.col("position") <= limit)
    return first.select(
        "doc_id", "position", "table_id", "page_number", "row_count", "column_count", F.get("rows", F.lit(0))["cells"].alias("headers")
    )


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks (page_id, block_id, x0, y0, page_width) with their place: two columns are read left first."""
    page = W.partitionBy("page_id")
    right = (F.col("x0") >= F.col("page_width") * 0.52).cast("int")
    both = (F.max(right).over(page) == 1) & (F.min(right).over(page) == 0)
    rows = blocks.withColumn("column", F.when(both, right).otherwise(0))
    order = page.orderBy("column", "y0", "x0", "block_id")
    return rows.withColumn("position", F.row_number().over(order))


def ocr_need(documents: DataFrame, min_chars: int = fv.OCR_MIN_CHARS) -> DataFrame:
    """Whether recognition is due, and the text to go on with (recognised if there is any)."""
    need = F.coalesce("force_ocr", F.lit(False)) | (F.length(tx.clean_text(F.col("text"))) < min_chars)
    final = F.when(need, F.coalesce(F.nullif("ocr_text", F.lit("")), F.col("text"))).otherwise(F.col("text"))
    return documents.withColumns({"needs_ocr": need, "final_text": final})


def page_rollup(pages: DataFrame) -> DataFrame:
    """Recognised pages (doc_id, page_number, page_text, confidence, status, error_message) per document.

    Only completed pages give text and confidence; messages of the others are joined.
    """
    done = F.col("status") == "completed"
    text = F.array_sort(F.collect_list(F.when(done & (F.col("page_text") != ""), F.struct("page_number", "page_text"))))
    message = F.concat(F.lit("page "), F.col("page_number").cast("string"), F.lit(": "), "error_message")
    errors = F.array_sort(F.collect_list(F.when(~done & (F.col("error_message") != ""), F.struct("page_number", message.alias("m")))))
    out = pages.groupBy("doc_id").agg(
        tx.clean_text(F.array_join(F.transform(text, lambda p: p["page_text"]), "\n\n")).alias("text"),
        F.avg(F.when(done, F.col("confidence"))).alias("average_confidence"), F.count_if(done).alias("page_count"),
        F.array_join(F.transform(errors, lambda e: e["m"]), "; ").alias("error_message"),
    )
    return out.withColumn("status", F.when(F.col("text") != "", "completed").otherwise("failed"))
