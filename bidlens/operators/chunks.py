"""Passages of rule documents: paragraph windows, table rows, page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx

SPAN = "struct<s:int,e:int>"


def window_spans(length: Column, size: int = fv.CHUNK_CHARS, step: int = fv.CHUNK_STEP, offset: Column | int = 0) -> Column:
    """Fixed-step spans [s, e) that cover ``length`` characters from ``offset`` on."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return F.transform(
        F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(step)),
        lambda s: F.struct((offset + s).alias("s"), (offset + F.least(s + size, length)).alias("e")),
    ).cast(f"array<{SPAN}>")


def _cut(docs: DataFrame, spans: Column, id_col: str, text_col: str) -> DataFrame:
    """One row per span with the stripped text and its true offsets.  Each piece is cut once, in the row of its text."""
    kept = [c for c in docs.columns if c != text_col]

    def piece(span):
        def stripped(raw):
            lead = F.length(raw) - F.length(F.ltrim(raw, F.lit(tx.WS_CHARS)))
            return F.struct((span["s"] + lead).alias("start"), tx.clean_text(raw).alias("text"))

        return tx.let(F.substring(F.col(text_col), span["s"] + 1, span["e"] - span["s"]), stripped)

    rows = docs.select(*kept, F.posexplode(F.transform(spans, piece)).alias("chunk_index", "_piece"))
    out = rows.select(*kept, "chunk_index", F.col("_piece.text").alias("chunk_text"), F.col("_piece.start").alias("char_start"))
    return out.filter(F.col("chunk_text") != "").withColumn("char_end", F.col("char_start") + F.length("chunk_text"))


def long_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts longer than a chunk as fixed-step windows; shorter ones as a single window."""
    def spans(n):
        whole = F.array(F.struct(F.lit(0).alias("s"), n.alias("e"))).cast(f"array<{SPAN}>")
        return F.when(n > fv.CHUNK_CHARS, window_spans(n)).otherwise(whole)

    return _cut(docs, tx.let(F.length(text_col), spans), id_col, text_col)  # the length is counted once, not a window


def paragraph_spans(text: Column, size: int = fv.CHUNK_CHARS, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """Pack the paragraphs of a normalised text into spans.

    The fold carries offsets only.  Normalised paragraphs are exactly two line feeds apart, so
    a packed passage is always a contiguous piece of the source and no text is copied here.
    """
    lengths = F.transform(F.split(text, "\n\n"), lambda p: F.length(p))
    start = F.struct(
        F.array().cast(f"array<{SPAN}>").alias("spans"), F.lit(0).alias("start"), F.lit(-1).alias("stop"), F.lit(0).alias("pos")
    )

    def merge(acc, n):
        here, end = acc["pos"], acc["pos"] + n
        open_, long_ = acc["stop"] >= 0, n > size
        flush = open_ & (end - acc["start"] > size)
        tail = F.substring(text, acc["stop"] - overlap + 1, F.lit(overlap))
        tail_start = acc["stop"] - overlap + F.length(F.regexp_extract(tail, f"^{tx.WS}*", 0))
        carries = flush & (acc["stop"] - acc["start"] > overlap)
        spans = F.when(
            flush, F.concat(acc["spans"], F.array(F.struct(acc["start"].alias("s"), acc["stop"].alias("e"))).cast(f"array<{SPAN}>"))
        ).otherwise(acc["spans"])
        spans = F.when(long_, F.concat(spans, window_spans(n, size, size - overlap, here))).otherwise(spans)
        first = F.when(carries, tail_start).when(open_ & ~flush, acc["start"]).otherwise(here)
        return F.struct(
            spans.alias("spans"), first.alias("start"), F.when(long_, F.lit(-1)).otherwise(end).alias("stop"), (end + 2).alias("pos")
        )

    def finish(acc):
        last = F.array(F.struct(acc["start"].alias("s"), acc["stop"].alias("e"))).cast(f"array<{SPAN}>")
        return F.when(acc["stop"] >= 0, F.concat(acc["spans"], last)).otherwise(acc["spans"])

    return F.aggregate(lengths, start, merge, finish)


def paragraph_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of at most ~1,600 characters with a 180-character overlap; text must be normalised.

    Rows keep the other columns of ``docs``; a ``pages`` array of (page_number, start, end) is
    turned into page_start / page_end.
    """
    out = _cut(docs, paragraph_spans(F.col(text_col)), id_col, text_col)
    return describe(out)


def describe(chunks: DataFrame) -> DataFrame:
    """Title, hash, token count and pages of each passage."""
    out = chunks.withColumns(
        {
            "section_title": tx.heading(F.col("chunk_text")),
            "chunk_hash": tx.content_hash(F.col("chunk_text")),
            "token_count": F.size(tx.raw_tokens(F.col("chunk_text"))),
        }
    )
    if "pages" in chunks.columns:
        pages = F.col("pages")
        out = out.withColumns(
            {"page_start": page_for_offset(pages, F.col("char_start")), "page_end": page_for_offset(pages, F.col("char_end"))}
        ).drop("pages")
    return out


def page_for_offset(pages: Column, offset: Column) -> Column:
    """First page whose range holds the offset, else the last page.  Pages sit in the row: no range join."""
    hit = F.filter(pages, lambda p: (p["start"] <= offset) & (offset <= p["end"]))
    return F.coalesce(F.get(hit, F.lit(0))["page_number"], F.try_element_at(pages, F.lit(-1))["page_number"])


def page_ranges(pages: DataFrame, lengths: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Character range of each page.

    ``pages``: id, page_number, char_start, char_end, char_count; ``lengths``: id, text_length.
    Given offsets are used when every page of the document has valid ones, else running
    character counts, where the last page is stretched to the end of the text.
    """
    doc = W.partitionBy(id_col)
    order = doc.orderBy("page_number")
    valid = (F.col("char_start") >= 0) & (F.col("char_end") >= F.col("char_start"))
    count = F.greatest(F.coalesce("char_count", F.lit(0)), F.lit(0))
    rows = pages.join(lengths, id_col).withColumns(
        {
            "explicit": F.min(F.coalesce(valid, F.lit(False)).cast("int")).over(doc) == 1,
            "run_end": F.sum(count).over(order),
            "last": F.lead("page_number").over(order).isNull(),
        }
    )
    limit = F.col("text_length")
    run_start = F.col("run_end") - count
    end = F.greatest(F.least(F.col("run_end"), limit), run_start)
    return rows.select(
        id_col, "page_number",
        F.when(F.col("explicit"), F.least("char_start", limit)).otherwise(run_start).cast("long").alias("start"),
        F.when(F.col("explicit"), F.least("char_end", limit))
        .otherwise(F.when(F.col("last"), F.greatest(end, limit)).otherwise(end)).cast("long").alias("end"),
    )


def with_pages(docs: DataFrame, ranges: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents with their page ranges as an ordered array (bounded by the document itself)."""
    pages = ranges.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("page_number", "start", "end"))).alias("pages")
    )
    return docs.join(pages, id_col, "left").withColumn(
        "pages", F.coalesce("pages", F.array().cast("array<struct<page_number:bigint,start:bigint,end:bigint>>"))
    )


def table_row_chunks(tables: DataFrame, text_counts: DataFrame | None = None) -> DataFrame:
    """Each data row of a table as a passage ``header: cell`` per line.

    ``tables``: doc_id, table_id, page_number, rows array<struct<row_index, cells>> with the
    header in the first row.  ``text_counts`` (doc_id, text_chunks) lets the index go on after
    the text passages of the document.
    """
    headers = F.transform(F.get("rows", F.lit(0))["cells"], tx.clean_text)
    rows = tables.filter(F.size("rows") >= 2).select(
        "doc_id", "table_id", "page_number", headers.alias("headers"),
        F.explode(F.slice("rows", F.lit(2), F.size("rows"))).alias("row"),
    )
    cells = F.transform("row.cells", tx.clean_text)

    def line(cell, i):
        name = F.nullif(F.get("headers", i), F.lit(""))
        return F.when(cell != "", F.concat(F.coalesce(name, F.concat(F.lit("col_"), (i + 1).cast("string"))), F.lit(": "), cell))

    texts = rows.withColumn("_lines", F.array_compact(F.transform(cells, line))).filter(F.size("_lines") > 0)
    page = F.col("page_number").cast("string")
    chunk = F.concat_ws(
        "\n", F.concat(F.lit("[table_id: "), F.coalesce(F.nullif("table_id", F.lit("")), F.lit("unknown")), F.lit("]")),
        F.concat(F.lit("[page: "), F.coalesce(page, F.lit("")), F.lit("]")), F.array_join("_lines", "\n"),
    )
    out = texts.select(
        "doc_id", "table_id", "page_number", F.col("row.row_index").alias("row_index"), tx.clean_text(chunk).alias("chunk_text")
    )
    # running number inside a document without one task per document: count per table, then add offsets
    per_table = out.groupBy("doc_id", "page_number", "table_id").agg(F.count("*").alias("n"))
    before = W.partitionBy("doc_id").orderBy("page_number", "table_id").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_table.select("doc_id", "page_number", "table_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy("doc_id", "page_number", "table_id").orderBy("row_index")) - 1
    out = out.withColumn("_local", local).join(offsets, ["doc_id", "page_number", "table_id"])
    base = F.lit(0)
    if text_counts is not None:
        out = out.join(text_counts, "doc_id", "left")
        base = F.coalesce("text_chunks", F.lit(0))
    return out.withColumn("chunk_index", (base + F.col("_before") + F.col("_local")).cast("long")).drop("_before", "_local", "text_chunks")
