"""Queries over sources and layout (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx
from bidlens.plans import sql as q
from bidlens.plans.chunk_queries import DOCS, PAGES, TABLE_ROWS
from bidlens.plans.registry import query
from bidlens.sources import envelopes, layout, notices

# ---- service bodies made from orders: one form per priority --------------------------------------------------


def _bodies(t):
    key, price = F.col("o_orderkey").cast("string"), F.floor("o_totalprice").cast("string")
    one = F.concat(F.lit('{"bidNtceNo": "'), key, F.lit('", "presmptPrce": "'), price, F.lit('"}'))
    two = F.concat(F.lit('{"bidNtceNo": "'), key, F.lit('", "bidNtceOrd": "001"}'))
    xml = F.concat(F.lit("<item><bidNtceNo>"), key, F.lit("</bidNtceNo><presmptPrce>"), price, F.lit("</presmptPrce></item>"))
    p = F.col("o_orderpriority")
    body = (
        F.when(p == "1-URGENT", F.concat(F.lit(' {"response": {"header": {"resultCode": "00"}, "body": {"items": {"item": ['), one, F.lit(", "), two, F.lit(']}, "totalCount": 7}}}')))
        .when(p == "2-HIGH", F.concat(F.lit('{"response": {"body": {"items": {"item": '), one, F.lit('}, "totalCount": "x"}}}')))
        .when(p == "3-MEDIUM", F.concat(F.lit('{"body": {"items": ['), two, F.lit("]}}")))
        .when(p == "5-LOW", F.concat(F.lit("<response><header><resultCode>00</resultCode></header><body><items>"), xml, xml, F.lit("</items><totalCount>3</totalCount></body></response>")))
        .otherwise(" \n")
    )
    return t.orders.select("o_orderkey", body.alias("body"))


@query(
    "envelope_parse",
    """WITH a AS (SELECT o_orderkey, o_orderpriority AS p, o_orderkey::VARCHAR AS k, floor(o_totalprice)::BIGINT::VARCHAR AS price FROM orders),
    i AS (SELECT o_orderkey, 'json' AS format, 7 AS total_count, 0 AS item_pos, k AS no, NULL AS ord, price FROM a WHERE p = '1-URGENT'
      UNION ALL SELECT o_orderkey, 'json', 7, 1, k, '001', NULL FROM a WHERE p = '1-URGENT' UNION ALL SELECT o_orderkey, 'json', 0, 0, k, NULL, price FROM a WHERE p = '2-HIGH'
      UNION ALL SELECT o_orderkey, 'json', 1, 0, k, '001', NULL FROM a WHERE p = '3-MEDIUM' UNION ALL SELECT o_orderkey, 'xml', 3, unnest([0, 1]), k, NULL, price FROM a WHERE p = '5-LOW'
      UNION ALL SELECT o_orderkey, 'empty', 0, NULL, NULL, NULL, NULL FROM a WHERE p = '4-NOT SPECIFIED')
    SELECT o_orderkey, format, total_count::BIGINT AS total_count, item_pos::BIGINT AS item_pos, no, ord, price FROM i""",
)
def _(t):
    parsed = envelopes.parse(_bodies(t))
    rows = parsed.select("o_orderkey", "format", "total_count", F.posexplode_outer("items").alias("item_pos", "item"))

    def field(key):
        return F.try_element_at(F.col("item"), F.lit(key))

    return rows.select(
        "o_orderkey", "format", F.col("total_count").cast("long").alias("total_count"), F.col("item_pos").cast("long").alias("item_pos"),
        field("bidNtceNo").alias("no"), field("bidNtceOrd").alias("ord"), field("presmptPrce").alias("price"),
    )


def _items(t):
    """Raw items: keys come and go with the order's priority; pages of the same number give the attachments."""
    p = F.col("o_orderpriority")
    rows = t.orders.join(t.pages, F.col("o_orderkey") == F.col("page_id"), "left")
    url = F.coalesce("url", F.lit(""))
    pdf = F.concat(F.regexp_extract(url, "^([^?#]*)", 1), F.lit("/Plan.PDF?x=1"))
    pairs = F.create_map(
        F.lit("bidNtceNo"), F.concat(F.lit(" "), F.col("o_orderkey").cast("string")), F.lit("bidNtceOrd"), F.when(p == "1-URGENT", "002").otherwise(" "),
        F.lit("presmptPrce"), F.when(p == "2-HIGH", F.floor("o_totalprice").cast("string")).otherwise(""),
        F.lit("asignBdgtAmt"), F.floor("o_totalprice").cast("string"), F.lit("bsnsDivNm"), p,
        F.lit("cnstrtsiteRgnNm"), F.col("o_orderstatus"), F.lit("ntceSpecFileNm1"), F.when(p == "3-MEDIUM", "terms.docx").otherwise(""),
        F.lit("ntceSpecDocUrl1"), url, F.lit("ntceSpecDocUrl2"), F.when(url != "", pdf).otherwise(""), F.lit("ntceSpecDocUrl3"), F.when(url != "", pdf).otherwise(""),
        F.lit("stdNtceDocUrl"), F.when(p == "5-LOW", url).otherwise(""), F.lit("eorderAtchFileNm"), F.when(p == "2-HIGH", "order.hwp").otherwise(""),
    )
    return rows.select(F.col("o_orderkey").alias("notice_id"), pairs.alias("item"))


_PATH = r"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def _ext(x: str) -> str:
    return rf"lower(regexp_extract({x}, '[^/](\.[^./]+)$', 1))"


ATTACH = f"""it AS (SELECT o_orderkey AS notice_id, o_orderpriority AS p, o_orderstatus, o_totalprice, coalesce(url, '') AS url,
  CASE WHEN url IS NULL THEN '' ELSE regexp_extract(url, '^([^?#]*)', 1) || '/Plan.PDF?x=1' END AS pdf FROM orders LEFT JOIN pages ON page_id = o_orderkey),
at0 AS (SELECT notice_id, 1 AS o, 'ntceSpecDocUrl1' AS source_field, CASE WHEN p = '3-MEDIUM' THEN 'terms.docx' ELSE '' END AS n, url AS u FROM it
  UNION ALL SELECT notice_id, 2, 'ntceSpecDocUrl2', '', pdf FROM it UNION ALL SELECT notice_id, 3, 'ntceSpecDocUrl3', '', pdf FROM it
  UNION ALL SELECT notice_id, 11, 'stdNtceDocUrl', '표준공고문.pdf', url FROM it WHERE p = '5-LOW' AND url <> ''
  UNION ALL SELECT notice_id, 12, 'eorderAtchFileUrl', CASE WHEN p = '2-HIGH' THEN 'order.hwp' ELSE '' END, '' FROM it),
at1 AS (SELECT notice_id, o, source_field, u AS source_url, coalesce(nullif(n, ''), nullif(regexp_extract({_PATH.format(u='u')}, '([^/]+)/*$', 1), ''), source_field) AS file_name FROM at0),
at2 AS (SELECT *, coalesce(nullif({_ext('file_name')}, ''), {_ext(_PATH.format(u='source_url'))}) AS file_extension FROM at1 WHERE NOT (source_url = '' AND file_name = source_field)
  QUALIFY row_number() OVER (PARTITION BY notice_id, file_name, source_url ORDER BY o) = 1),
att AS (SELECT notice_id, file_name, source_url, source_field, file_extension, CASE WHEN source_url <> '' AND file_extension IN ('.pdf', '.docx') THEN 'supported' ELSE 'unsupported' END AS support_status FROM at2)"""


@query(
    "notice_normalize",
    f"""WITH {ATTACH}, n AS (SELECT notice_id, count(*) AS c, count(*) FILTER (support_status = 'supported') AS s FROM att GROUP BY 1)
    SELECT it.notice_id, it.notice_id::VARCHAR AS bid_ntce_no, CASE WHEN p = '1-URGENT' THEN '002' ELSE '000' END AS bid_ntce_ord, floor(o_totalprice)::BIGINT::VARCHAR AS presmpt_prce,
      floor(o_totalprice)::BIGINT::VARCHAR AS bdgt_amt, '' AS bssamt, p AS business_type, o_orderstatus AS region_text, '' AS license_text, coalesce(c, 0) AS attachment_count, coalesce(s, 0) AS supported_attachment_count
    FROM it LEFT JOIN n USING (notice_id)""",
)
def _(t):
    rows = notices.normalize(_items(t))
    counts = [F.col(c).cast("long").alias(c) for c in ("attachment_count", "supported_attachment_count")]
    return rows.select(
        "notice_id", "bid_ntce_no", "bid_ntce_ord", "presmpt_prce", "bdgt_amt", "bssamt", "business_type", "region_text", "license_text", *counts
    )


@query("attachments_explode", f"WITH {ATTACH} SELECT * FROM att")
def _(t):
    return notices.attachments(_items(t)).drop("pos")


@query(
    "attachment_support_stats",
    f"WITH {ATTACH} SELECT notice_id, count(*) AS total_count, count(*) FILTER (support_status = 'supported') AS supported_count, count(*) FILTER (support_status <> 'supported') AS unsupported_count FROM att GROUP BY 1",
)
def _(t):
    return notices.attachment_stats(notices.attachments(_items(t)))


_MERGE_FIELDS = ("region_text", "license_text")


@query(
    "notice_merge_details",
    """WITH d AS (SELECT l_orderkey AS notice_id, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS ord, CASE WHEN l_returnflag = 'A' THEN ' ' ELSE 'r' || l_suppkey END AS r, CASE WHEN l_linestatus = 'O' THEN '' ELSE 'l' || l_partkey END AS l FROM lineitem)
    SELECT o_orderkey AS notice_id, CASE WHEN o_orderstatus = 'F' THEN 'base' ELSE coalesce((SELECT arg_min(r, ord) FROM d WHERE notice_id = o_orderkey AND r <> ' '), ' ') END AS region_text,
      coalesce((SELECT arg_min(l, ord) FROM d WHERE notice_id = o_orderkey AND l <> ''), '') AS license_text FROM orders""",
)
def _(t):
    base = t.orders.select(
        F.col("o_orderkey").alias("notice_id"), F.when(F.col("o_orderstatus") == "F", "base").otherwise(" ").alias("region_text"), F.lit("").alias("license_text")
    )
    details = t.lineitem.select(
        F.col("l_orderkey").alias("notice_id"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ord"),
        F.when(F.col("l_returnflag") == "A", " ").otherwise(F.concat(F.lit("r"), F.col("l_suppkey").cast("string"))).alias("region_text"),
        F.when(F.col("l_linestatus") == "O", "").otherwise(F.concat(F.lit("l"), F.col("l_partkey").cast("string"))).alias("license_text"),
    )
    return notices.merge_details(base, details, _MERGE_FIELDS)


_KIND_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN ' Servc' WHEN '2-HIGH' THEN '물품' WHEN '3-MEDIUM' THEN 'etc' WHEN '5-LOW' THEN 'ALL' ELSE 'unknown' END"


def _kind():
    p = F.col("o_orderpriority")
    return F.when(p == "1-URGENT", " Servc").when(p == "2-HIGH", "물품").when(p == "3-MEDIUM", "etc").when(p == "5-LOW", "ALL").otherwise("unknown")


@query(
    "business_type_normalize",
    f"""WITH a AS (SELECT o_orderkey, trim(lower({_KIND_SQL})) AS k FROM orders), b AS (SELECT o_orderkey, CASE k WHEN 'servc' THEN 'service' WHEN '물품' THEN 'goods' WHEN 'etc' THEN 'etc' WHEN 'all' THEN 'all' END AS n FROM a)
    SELECT o_orderkey, coalesce(n, 'construction') AS business_type, unnest(CASE WHEN n IS NULL OR n = 'all' THEN {q.slist(fv.BUSINESS_TYPES)} ELSE [n] END) AS search_type FROM b""",
)
def _(t):
    return t.orders.select("o_orderkey", notices.business_type(_kind()).alias("business_type"), F.explode(notices.search_types(_kind())).alias("search_type"))


@query(
    "business_type_backfill",
    """SELECT o_orderkey, CASE WHEN up THEN inferred ELSE cur END AS business_type, up AS updated FROM (SELECT o_orderkey, cur, inferred, cur IN ('construction', '') AND inferred <> '' AND inferred <> cur AS up FROM (
      SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'service' WHEN 'O' THEN 'construction' ELSE '' END AS cur,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'service' WHEN '2-HIGH' THEN 'goods' WHEN '3-MEDIUM' THEN 'etc' WHEN '5-LOW' THEN '' ELSE 'construction' END AS inferred FROM orders))""",
)
def _(t):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    raw = (
        F.when(p == "1-URGENT", '{"businessType": "용역", "x": "물품"}').when(p == "2-HIGH", '{"op": "getBidPblancListInfoThng", "x": "용역"}')
        .when(p == "3-MEDIUM", '{"bsnsDivNm": "전체", "note": "기타"}').when(p == "5-LOW", "").otherwise('{"name": "도로 공사"}')
    )
    rows = t.orders.select("o_orderkey", F.when(s == "F", "service").when(s == "O", "construction").otherwise("").alias("business_type"), raw.alias("raw_json"))
    return notices.backfill_business_type(rows).drop("raw_json")


@query(
    "date_windows",
    """WITH a AS (SELECT o_orderkey, o_orderdate::DATE AS date_from, (o_orderdate + to_days((o_custkey % 40)::INTEGER))::DATE AS date_to FROM orders),
    b AS (SELECT *, unnest(range(0, (date_to - date_from) // 7 + 1)) AS w FROM a)
    SELECT o_orderkey, w::BIGINT AS "window", strftime(greatest(date_from, (date_to - to_days((w * 7 + 6)::INTEGER))::DATE), '%Y-%m-%d') AS window_start, strftime((date_to - to_days((w * 7)::INTEGER))::DATE, '%Y-%m-%d') AS window_end FROM b""",
)
def _(t):
    start = F.to_date("o_orderdate")
    ranges = t.orders.select("o_orderkey", start.alias("date_from"), F.date_add(start, (F.col("o_custkey") % 40).cast("int")).alias("date_to"))
    rows = notices.date_windows(ranges, 7)
    return rows.select("o_orderkey", F.col("window").cast("long").alias("window"), F.col("window_start").cast("string").alias("window_start"), F.col("window_end").cast("string").alias("window_end"))


@query(
    "api_datetime_key",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y%m%d') || '0000' WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y%m%d') || '0000' WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y.%m.%d') ELSE '' END AS value FROM orders""",
)
def _(t):
    p, d = F.col("o_orderpriority"), F.col("o_orderdate")
    raw = (
        F.when(p == "1-URGENT", F.date_format(d, " yyyy-MM-dd ")).when(p == "2-HIGH", F.date_format(d, "yyyyMMdd")).when(p == "3-MEDIUM", F.date_format(d, "yyyy.MM.dd"))
    )
    return t.orders.select("o_orderkey", notices.api_datetime_key(raw, "0000").alias("value"))


# ---- layout ----------------------------------------------------------------------------------------------------
ELEMENTS = f"""el0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents),
pgs AS (SELECT doc_id, ord // 4 + 1 AS page_number, {q.basis_normalize("coalesce(string_agg(CASE WHEN length(line) >= 12 THEN line END, chr(10) || chr(10) ORDER BY ord), '')")} AS page_text FROM el0 GROUP BY 1, 2),
pgo AS (SELECT *, coalesce(sum(CASE WHEN page_text <> '' THEN length(page_text) + 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM pgs),
pga AS (SELECT doc_id, page_number::BIGINT AS page_number, page_text, (CASE WHEN page_text <> '' THEN b ELSE greatest(b - 2, 0) END)::BIGINT AS char_start FROM pgo)"""


def _elements(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return rows.select(
        "doc_id", (F.floor(F.col("ord") / 4) + 1).alias("page_number"), "ord", F.when(F.length("line") >= 12, F.col("line")).otherwise("").alias("text")
    )


@query("page_assemble", f"WITH {ELEMENTS} SELECT doc_id, page_number, page_text, char_start, char_start + length(page_text) AS char_end FROM pga")
def _(t):
    rows = layout.assemble_pages(_elements(t))
    return rows.select("doc_id", "page_number", "page_text", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query(
    "document_assemble",
    f"WITH {ELEMENTS} SELECT doc_id, coalesce(string_agg(nullif(page_text, ''), chr(10) || chr(10) ORDER BY page_number), '') AS text, count(*) AS page_count FROM pga GROUP BY 1",
)
def _(t):
    return layout.document_text(layout.assemble_pages(_elements(t)))


@query(
    "table_rows_flatten",
    f"WITH {TABLE_ROWS} SELECT doc_id, page_number::BIGINT AS page_number, table_id, row_index::BIGINT AS row_index, array_to_string(cells, '|') AS cells, row_index = 1 AS is_header FROM trows",
)
def _(t):
    rows = layout.flatten_table_rows(t.parsed_tables)
    return rows.select("doc_id", F.col("page_number").cast("long").alias("page_number"), "table_id", F.col("row_index").cast("long").alias("row_index"), F.array_join("cells", "|").alias("cells"), "is_header")


_MEASURES = f"""{TABLE_ROWS},
tm AS (SELECT doc_id, table_id, page_number, count(*) AS row_count, max(len(cells)) AS column_count, sum(len(list_filter(cells, lambda c: c <> ''))) AS filled_count,
  sum(length(array_to_string(cells, ''))) AS text_length, any_value(array_to_string(cells, ' ')) FILTER (row_index = 1) AS header_text, any_value(array_to_string(cells, '|')) FILTER (row_index = 1) AS headers FROM trows GROUP BY 1, 2, 3)"""


@query(
    "meaningful_table_filter",
    f"""WITH {_MEASURES} SELECT doc_id, table_id, row_count, column_count, filled_count::BIGINT AS filled_count FROM tm WHERE row_count >= 2 AND column_count >= 2 AND filled_count >= 3
      AND (contains(lower(header_text), 'r_name') OR (row_count >= 3 AND column_count >= 3 AND text_length >= 150))""".replace("text_length >= 150", "text_length >= 40"),
)
def _(t):
    rows = layout.meaningful_tables(t.parsed_tables, ("r_name",))
    return rows.select("doc_id", "table_id", *[F.col(c).cast("long").alias(c) for c in ("row_count", "column_count", "filled_count")])


@query(
    "table_markdown",
    f"""WITH {TABLE_ROWS}, w AS (SELECT doc_id, page_number, max(len(cells)) AS n FROM trows GROUP BY 1, 2),
    l AS (SELECT doc_id, page_number, row_index, '| ' || array_to_string(cells, ' | ') || ' |' AS line FROM trows UNION ALL SELECT doc_id, page_number, 1.5, '| ' || array_to_string(list_transform(range(n), lambda z: '---'), ' | ') || ' |' FROM w)
    SELECT doc_id, page_number::BIGINT AS page_number, string_agg(line, chr(10) ORDER BY row_index) AS markdown FROM l GROUP BY 1, 2""",
)
def _(t):
    return t.parsed_tables.select("doc_id", F.col("page_number").cast("long").alias("page_number"), layout.table_markdown(F.col("rows")).alias("markdown"))


@query(
    "table_previews",
    f"""WITH {_MEASURES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, table_id) AS position, table_id, row_count, column_count, headers FROM tm QUALIFY position <= 10""",
)
def _(t):
    rows = layout.table_previews(t.parsed_tables)
    return rows.select(
        "doc_id", F.col("position").cast("long").alias("position"), "table_id", F.col("row_count").cast("long").alias("row_count"),
        F.col("column_count").cast("long").alias("column_count"), F.array_join("headers", "|").alias("headers"),
    )


@query(
    "two_column_reading_order",
    """WITH b AS (SELECT l_orderkey AS page_id, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey AS block_id, l_quantity * 10 AS x0, l_discount * 100 AS y0, CASE WHEN l_quantity * 10 >= 500 * 0.52 THEN 1 ELSE 0 END AS r FROM lineitem),
    c AS (SELECT *, CASE WHEN max(r) OVER (PARTITION BY page_id) = 1 AND min(r) OVER (PARTITION BY page_id) = 0 THEN r ELSE 0 END AS col FROM b)
    SELECT page_id, block_id, row_number() OVER (PARTITION BY page_id ORDER BY col, y0, x0, block_id) AS position FROM c""",
)
def _(t):
    blocks = t.lineitem.select(
        F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("block_id"),
        (F.col("l_quantity") * 10).alias("x0"), (F.col("l_discount") * 100).alias("y0"), F.lit(500.0).alias("page_width"),
    )
    return layout.reading_order(blocks).select("page_id", "block_id", F.col("position").cast("long").alias("position"))


@query(
    "ocr_need_flag",
    f"""WITH a AS (SELECT d.doc_id, text, coalesce(toxic = 1, false) AS f, CASE WHEN n_chars % 3 = 0 THEN '' ELSE 'scan ' || text END AS o FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), b AS (SELECT *, f OR length({q.clean('text')}) < 80 AS needs_ocr FROM a)
    SELECT doc_id, needs_ocr, CASE WHEN needs_ocr AND o <> '' THEN o ELSE text END AS final_text FROM b""",
)
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "text", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("force_ocr"),
        F.when(F.col("n_chars") % 3 == 0, "").otherwise(F.concat(F.lit("scan "), "text")).alias("ocr_text"),
    )
    return layout.ocr_need(rows).select("doc_id", "needs_ocr", "final_text")


@query(
    "page_confidence_rollup",
    f"""WITH {PAGES}, s AS (SELECT *, CASE WHEN length(page_text) < 300 THEN 'failed' ELSE 'completed' END AS st, CASE WHEN page_number % 4 = 0 THEN NULL ELSE length(page_text) END AS cf FROM pg)
    SELECT doc_id, coalesce({q.clean("string_agg(CASE WHEN st = 'completed' AND page_text <> '' THEN page_text END, chr(10) || chr(10) ORDER BY page_number)")}, '') AS text,
      avg(CASE WHEN st = 'completed' THEN cf END) AS average_confidence, count(*) FILTER (st = 'completed') AS page_count,
      coalesce(string_agg(CASE WHEN st = 'failed' THEN 'page ' || page_number || ': too short' END, '; ' ORDER BY page_number), '') AS error_message,
      CASE WHEN coalesce({q.clean("string_agg(CASE WHEN st = 'completed' THEN page_text END, '' ORDER BY page_number)")}, '') <> '' THEN 'completed' ELSE 'failed' END AS status FROM s GROUP BY 1""",
)
def _(t):
    n = F.length("page_text")
    rows = t.pages_of_documents.select(
        "doc_id", "page_number", "page_text", F.when(F.col("page_number") % 4 != 0, n).alias("confidence"),
        F.when(n < 300, "failed").otherwise("completed").alias("status"), F.when(n < 300, "too short").otherwise("").alias("error_message"),
    )
    return layout.page_rollup(rows)


@query(
    "discovered_save",
    """WITH f AS (SELECT l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey AS arrival, CASE WHEN l_quantity < 5 THEN '' ELSE (l_orderkey // 2)::VARCHAR END AS no, CASE WHEN l_returnflag = 'A' THEN '001' ELSE '000' END AS ord FROM lineitem),
    u AS (SELECT no, ord, min(arrival) AS arrival FROM f WHERE no <> '' GROUP BY 1, 2), s AS (SELECT DISTINCT o_orderkey::VARCHAR AS no, '000' AS ord FROM orders WHERE o_orderstatus = 'F')
    SELECT f.no, f.ord, f.arrival, CASE WHEN f.no = '' THEN 'failed' WHEN u.no IS NOT NULL AND s.no IS NULL THEN 'saved' ELSE 'skipped' END AS outcome
    FROM f LEFT JOIN u ON u.no = f.no AND u.ord = f.ord AND u.arrival = f.arrival LEFT JOIN s ON s.no = f.no AND s.ord = f.ord""",
)
def _(t):
    return discovered(t)


def discovered(t):
    found = t.lineitem.select(
        (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("arrival"),
        F.when(F.col("l_quantity") < 5, " ").otherwise(F.floor(F.col("l_orderkey") / 2).cast("string")).alias("no"),
        F.when(F.col("l_returnflag") == "A", "001").otherwise("").alias("ord"),
    )
    saved = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").cast("string").alias("no"), F.lit("000").alias("ord"))
    return notices.save_discovered(found, saved).select("no", "ord", "arrival", "outcome")
