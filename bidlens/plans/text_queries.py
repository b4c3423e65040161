"""Queries over the text functions (T)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx
from bidlens.plans import sql as q
from bidlens.plans.registry import query


def _per_document(t, **columns):
    return t.documents.select("doc_id", *[c.alias(n) for n, c in columns.items()])


@query("clean_text", f"SELECT doc_id, {q.clean('text')} AS value FROM documents")
def _(t):
    return _per_document(t, value=tx.clean_text(F.col("text")))


@query("compact_key", f"SELECT doc_id, {q.compact('text')} AS value FROM documents")
def _(t):
    return _per_document(t, value=tx.compact_key(F.col("text")))


@query("space_compact", f"SELECT doc_id, {q.space_compact('text')} AS value FROM documents")
def _(t):
    return _per_document(t, value=tx.space_compact(F.col("text")))


@query(
    "tokenize",
    f"""SELECT doc_id, array_to_string({q.tokens('text')}, ' ') AS tokens,
      len({q.tokens('text')})::BIGINT AS token_count FROM documents""",
)
def _(t):
    tokens = tx.tokenize(F.col("text"))
    return _per_document(t, tokens=F.array_join(tokens, " "), token_count=F.size(tokens).cast("long"))


# double line feeds, tabs and carriage returns make the normalisers work
def _rough():
    return F.concat(F.lit(" \t"), F.regexp_replace(F.col("text"), "\n", " \r\n\t \n\n"), F.lit("\r"))


_ROUGH_SQL = r"(' ' || chr(9) || regexp_replace(text, '\n', ' ' || chr(13) || chr(10) || chr(9) || ' ' || chr(10) || chr(10), 'g') || chr(13))"


@query("basis_normalize", f"SELECT doc_id, {q.basis_normalize(_ROUGH_SQL)} AS value FROM documents")
def _(t):
    return _per_document(t, value=tx.basis_normalize(_rough()))


@query("reference_normalize", f"SELECT doc_id, {q.reference_normalize(_ROUGH_SQL)} AS value FROM documents")
def _(t):
    return _per_document(t, value=tx.reference_normalize(_rough()))


_FLAT = ["입찰 공고 1. 목적 가. 나라.마을 12. A항 ", "나.다.라. 끝 (계약)2024. 5. 6 완료한다 - 다음 다다가 ", "34.나 5.6 7", "․ 다\t-끝 이다다 \n8. b 하\n가. c"]


def _flat_sql() -> str:
    """Lost line breaks, in letters of the binding: look-arounds are said by marks and passes over what they leave."""
    letter = "[가-힣A-Za-z]"
    text = rf"""regexp_replace(replace(concat(coalesce(text, ''), {', '.join(x for part in _FLAT for x in (_breaks(part), 'doc_id'))}), '․', '.'), '[ \t]{{2,}}|\t', ' ', 'g')"""
    return rf"""WITH a AS (SELECT doc_id, string_split(regexp_replace({text}, '([0-9]+)(\.{q.WS}*{letter})', chr(1) || '\1' || chr(2) || '\2', 'g'), chr(1)) AS p FROM documents),
    b AS (SELECT doc_id, p[1] || array_to_string(list_transform(p[2:], lambda x, i: CASE WHEN p[i][-1] = chr(10)
      THEN substr(regexp_replace(split_part(x, chr(2), 1), '([0-9])', chr(10) || '\1', 'g'), 2) ELSE regexp_replace(split_part(x, chr(2), 1), '([0-9])', chr(10) || '\1', 'g') END
      || substr(x, length(split_part(x, chr(2), 1)) + 2)), '') AS v FROM a),
    c AS (SELECT doc_id, regexp_replace(v, '(^|[^\n])([가-힣]\.{q.WS}*{letter})', '\1' || chr(10) || '\2', 'g') AS v FROM b),
    d AS (SELECT doc_id, regexp_replace(v, '(^|[^\n])([가-힣]\.{q.WS}*{letter})', '\1' || chr(10) || '\2', 'g') AS v FROM c),
    e AS (SELECT doc_id, regexp_replace(v, '([가-힣)])([0-9]{{4}}\.{q.WS}*[0-9]{{1,2}}\.{q.WS}*[0-9]{{1,2}})', '\1' || chr(10) || '\2', 'g') AS v FROM d),
    f AS (SELECT doc_id, regexp_replace(v, '다({q.WS}*[-가-힣])', '다' || chr(3) || '\1', 'g') AS v FROM e),
    g AS (SELECT doc_id, replace(regexp_replace(v, '다({q.WS}*[-가-힣])', '다' || chr(3) || '\1', 'g'), chr(3), chr(10)) AS v FROM f)
    SELECT doc_id, {q.basis_normalize('v')} AS value FROM g"""


def _breaks(part: str) -> str:
    return "(" + " || ".join(f"{q.s(x)}" if x not in ("\n", "\t") else f"chr({ord(x)})" for x in re.split("([\n\t])", part) if x) + ")"


@query("procurement_boundary_restore", _flat_sql())
def _(t):
    parts = [x for part in _FLAT for x in (F.lit(part), F.col("doc_id").cast("string"))]
    return _per_document(t, value=tx.procurement_boundary_restore(F.concat(F.coalesce("text", F.lit("")), *parts)))


@query("evidence_normalize", f"SELECT doc_id, {q.evidence_normalize(_ROUGH_SQL)} AS value FROM documents")
def _(t):
    return _per_document(t, value=tx.evidence_normalize(_rough()))


_AMOUNT_CASES = [
    ("plain", lambda: F.col("cents").cast("string"), "cents::VARCHAR"),
    ("suffixed", lambda: F.concat(F.col("cents").cast("string"), F.lit(".00 원")), "cents::VARCHAR || '.00 원'"),
    ("decimal", lambda: F.concat(F.lit(" "), F.col("cents").cast("string"), F.lit(".5")), "' ' || cents::VARCHAR || '.5'"),
]


@query(
    "won_format",
    f"""WITH a AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
    v AS ({" UNION ALL ".join(f"SELECT o_orderkey, '{n}' AS form, {sql} AS raw FROM a" for n, _, sql in _AMOUNT_CASES)}),
    b AS (SELECT *, {q.clean('raw')} AS txt,
      regexp_extract(regexp_replace(regexp_replace({q.clean('raw')}, '[, ]', '', 'g'), '원$', ''), '^([0-9]+)(?:\\.0+)?$', 1) AS amt FROM v)
    SELECT o_orderkey, form, CASE WHEN amt <> '' THEN format('{{:,}}', TRY_CAST(amt AS BIGINT)) || '원' ELSE txt END AS value FROM b""",
)
def _(t):
    cents = F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")
    forms = F.array(*[F.struct(F.lit(n).alias("form"), c().alias("raw")) for n, c, _ in _AMOUNT_CASES])
    rows = t.orders.select("o_orderkey", cents).select("o_orderkey", F.explode(forms).alias("v"))
    return rows.select("o_orderkey", "v.form", tx.won_format(F.col("v.raw")).alias("value"))


_REG_SQL = "(lpad(c_custkey::VARCHAR, CASE WHEN c_acctbal < 0 THEN 13 WHEN c_acctbal < 6000 THEN 10 ELSE 7 END, '0'))"


@query(
    "registration_number",
    f"""WITH a AS (SELECT c_custkey, ' :' || {_REG_SQL} || ' ' AS raw FROM customer),
    b AS (SELECT *, {q.digits('raw')} AS d FROM a)
    SELECT c_custkey, d AS match_key, CASE WHEN length(d) = 10 THEN d[1:3] || '-' || d[4:5] || '-' || d[6:10]
      WHEN length(d) = 13 THEN d[1:6] || '-' || d[7:13] ELSE {q.clean_value('raw')} END AS value FROM b""",
)
def _(t):
    width = F.when(F.col("c_acctbal") < 0, 13).when(F.col("c_acctbal") < 6000, 10).otherwise(7)
    raw = F.concat(F.lit(" :"), F.lpad(F.col("c_custkey").cast("string"), width, F.lit("0")), F.lit(" "))
    return t.customer.select("c_custkey", tx.digits(raw).alias("match_key"), tx.registration_number(raw).alias("value"))


@query(
    "date_normalize",
    f"""WITH a AS (SELECT o_orderkey, CASE o_orderpriority
      WHEN '1-URGENT' THEN year(o_orderdate) || '년 ' || month(o_orderdate) || '월 ' || day(o_orderdate) || '일'
      WHEN '2-HIGH' THEN year(o_orderdate) || '.' || month(o_orderdate) || '.' || day(o_orderdate)
      WHEN '3-MEDIUM' THEN year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate)
      ELSE 'about ' || year(o_orderdate) END AS raw FROM orders),
    b AS (SELECT o_orderkey, {q.clean_value('raw')} AS txt FROM a),
    c AS (SELECT *, regexp_extract(txt, '([0-9]{{4}})(?:년|[./-])', 1) AS y,
      regexp_extract(txt, '[0-9]{{4}}(?:년 |[./-])([0-9]{{1,2}})', 1) AS m,
      regexp_extract(txt, '[0-9]{{4}}(?:년 |[./-])[0-9]{{1,2}}(?:월 |[./-])([0-9]{{1,2}})', 1) AS d FROM b)
    SELECT o_orderkey, CASE WHEN d <> '' THEN y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') ELSE txt END AS value FROM c""",
)
def _(t):
    y, m, d = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    p = F.col("o_orderpriority")
    raw = (
        F.when(p == "1-URGENT", F.concat(y, F.lit("년 "), m, F.lit("월 "), d, F.lit("일")))
        .when(p == "2-HIGH", F.concat_ws(".", y, m, d))
        .when(p == "3-MEDIUM", F.concat_ws("/", y, m, d))
        .otherwise(F.concat(F.lit("about "), y))
    )
    return t.orders.select("o_orderkey", tx.date_normalize(raw).alias("value"))


@query(
    "region_derive",
    f"""WITH a AS (SELECT c_custkey, n_name || CASE WHEN c_acctbal < 3000 THEN '도' ELSE '' END || '  ' || c_mktsegment || '구 12' AS raw
      FROM customer JOIN nation ON n_nationkey = c_nationkey),
    b AS (SELECT c_custkey, string_split({q.clean_value('raw')}, ' ') AS w FROM a)
    SELECT c_custkey, CASE WHEN len(w) >= 2 AND regexp_matches(w[1], '(도|시)$') THEN w[1] || ' ' || w[2] ELSE w[1] END AS value FROM b""",
)
def _(t):
    raw = F.concat("n_name", F.when(F.col("c_acctbal") < 3000, "도").otherwise(""), F.lit("  "), "c_mktsegment", F.lit("구 12"))
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select("c_custkey", tx.region_derive(raw).alias("value"))


# a JSON list for some parts, comma text for others; both with blanks and repeats
_LIST_SQL = """CASE WHEN p_size < 25 THEN '["' || p_type || '", " ' || p_name || ' ", "' || p_type || '", ""]'
  ELSE p_name || ' , ' || p_type || ',, ' || p_name END"""


def _list_items(raw: str) -> str:
    items = f"CASE WHEN {raw} LIKE '[%' THEN CAST({raw} AS JSON)::VARCHAR[] ELSE string_split({raw}, ',') END"
    return f"list_filter(list_transform({items}, lambda y: {q.clean('y')}), lambda y: y <> '')"


def _list_column():
    json_form = F.concat(F.lit('["'), "p_type", F.lit('", " '), "p_name", F.lit(' ", "'), "p_type", F.lit('", ""]'))
    return F.when(F.col("p_size") < 25, json_form).otherwise(
        F.concat("p_name", F.lit(" , "), "p_type", F.lit(",, "), "p_name")
    )


@query(
    "json_list_parse",
    f"""WITH a AS (SELECT p_partkey, {_LIST_SQL} AS raw FROM part), b AS (SELECT p_partkey, {_list_items('raw')} AS v FROM a)
    SELECT p_partkey, array_to_string({q.distinct_ordered('v')}, '|') AS value, len({q.distinct_ordered('v')})::BIGINT AS n FROM b""",
)
def _(t):
    items = tx.json_list(_list_column())
    return t.part.select("p_partkey", F.array_join(items, "|").alias("value"), F.size(items).cast("long").alias("n"))


@query(
    "json_list_merge",
    f"""WITH a AS (SELECT p_partkey, {_LIST_SQL} AS raw, p_brand || ',' || p_type AS more FROM part),
    b AS (SELECT p_partkey, list_concat({_list_items('raw')}, {_list_items('more')}) AS v FROM a)
    SELECT p_partkey, array_to_string({q.distinct_ordered('v')}, '|') AS value FROM b""",
)
def _(t):
    merged = tx.json_list_merge(_list_column(), F.concat_ws(",", "p_brand", "p_type"))
    return t.part.select("p_partkey", F.array_join(merged, "|").alias("value"))


_B = r"[^\p{L}\p{N}_]"
_MASK_SOURCE_SQL = "('call 123-45-67890 or 900101-1234567, Bearer abc.DEF+' || doc_id || ': ' || text)"


def mask_sql(x: str) -> str:
    """The look-around form of the patterns, said with captured edges (run twice for shared edges)."""
    x = rf"regexp_replace({x}, '(?i)(^|{_B})(Bearer|Basic){q.WS}+[A-Za-z0-9._~+/=-]+', '\1\2 {fv.REDACTED}', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|{_B})[0-9]{{6}}-[0-9]{{7}}($|{_B})', '\1{fv.REDACTED_RRN}\2', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|{_B})([0-9]{{3}})-?[0-9]{{2}}-?[0-9]{{5}}($|{_B})', '\1\2-**-*****\3', 'g')"
    return x


@query(
    "pii_mask",
    f"""WITH a AS (SELECT doc_id, {mask_sql(_MASK_SOURCE_SQL)} AS v FROM documents)
    SELECT doc_id, v AS value FROM a""",
)
def _(t):
    source = F.concat(
        F.lit("call 123-45-67890 or 900101-1234567, Bearer abc.DEF+"), F.col("doc_id").cast("string"), F.lit(": "), F.col("text")
    )
    return _per_document(t, value=tx.pii_mask(source))


_URL_SQL = r"""(regexp_extract(url, '^([^#]*)', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END
  || 'access_token=t' || page_id || '&page=9' || regexp_extract(url, '(#.*)$', 1))"""


def _url_column():
    url = F.col("url")
    return F.concat(
        F.regexp_extract(url, "^([^#]*)", 1), F.when(url.contains("?"), "&").otherwise("?"), F.lit("access_token=t"),
        F.col("page_id").cast("string"), F.lit("&page=9"), F.regexp_extract(url, "(#.*)$", 1),
    )


@query(
    "url_redact",
    rf"""SELECT page_id, regexp_replace({_URL_SQL}, 'access_token=[^&#]*', 'access_token=%5BREDACTED%5D') AS value, url AS untouched
    FROM pages""",
)
def _(t):
    return t.pages.select("page_id", tx.url_redact(_url_column()).alias("value"), tx.url_redact(F.col("url")).alias("untouched"))


@query(
    "sensitive_keys_mask",
    f"""WITH a AS (SELECT event_id, unnest([{{'k': 'user_id', 'v': user_id::VARCHAR}}, {{'k': 'Api-Key', 'v': props}},
      {{'k': 'auth_token_hint', 'v': event_type}}, {{'k': 'note', 'v': event_type || ' Basic ' || event_id || ' done'}}]) AS p FROM events)
    SELECT event_id, p.k AS key, CASE WHEN p.k IN ('Api-Key', 'auth_token_hint') THEN '{fv.REDACTED}' ELSE {mask_sql('p.v')} END AS value FROM a""",
)
def _(t):
    pairs = F.create_map(
        F.lit("user_id"), F.col("user_id").cast("string"), F.lit("Api-Key"), F.col("props"), F.lit("auth_token_hint"),
        F.col("event_type"), F.lit("note"),
        F.concat("event_type", F.lit(" Basic "), F.col("event_id").cast("string"), F.lit(" done")),
    )
    return t.events.select("event_id", F.explode(tx.sensitive_keys_mask(pairs)).alias("key", "value"))


@query(
    "sha256_keys",
    f"""SELECT doc_id, sha256(text) AS content_hash,
    CASE WHEN {q.compact('text')} = '' THEN '' ELSE sha256({q.compact('text')})[1:16] END AS source_hash FROM documents""",
)
def _(t):
    return _per_document(t, content_hash=tx.content_hash(F.col("text")), source_hash=tx.source_hash(F.col("text")))


def _replace_sql(x: str) -> str:
    for old, new in fv.DISPLAY_REPLACEMENTS:
        x = f"replace({x}, {q.s(old)}, {q.s(new)})"
    return x


_COPY_SQL = "(' ' || event_type || ' 보강 필요, 보강이 필요: citation ' || event_id || ' 보강')"


@query("user_copy_replace", f"SELECT event_id, {_replace_sql(q.clean(_COPY_SQL))} AS value FROM events")
def _(t):
    source = F.concat(F.lit(" "), "event_type", F.lit(" 보강 필요, 보강이 필요: citation "), F.col("event_id").cast("string"), F.lit(" 보강"))
    return t.events.select("event_id", tx.display_copy(source).alias("value"))


@query(
    "extractive_summary",
    f"""WITH a AS (SELECT doc_id, text, {q.filled_lines('text')} AS l FROM documents)
    SELECT doc_id, CASE WHEN text = '' THEN '문서에서 추출 가능한 텍스트가 부족합니다.'
      ELSE left(array_to_string(l[1:4], ' '), 500) END AS summary, array_to_string(l[5:10], '|') AS requirements FROM a""",
)
def _(t):
    return _per_document(
        t, summary=tx.extractive_summary(F.col("text")), requirements=F.array_join(tx.extractive_requirements(F.col("text")), "|")
    )


@query(
    "secret_mask",
    """SELECT event_id, CASE WHEN x = '' THEN '' WHEN length(x) <= 12 THEN left(x, 2) || repeat('*', greatest(length(x) - 4, 0)) || right(x, 2)
      ELSE left(x, 4) || repeat('*', length(x) - 8) || right(x, 4) END AS value
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN props WHEN 'error' THEN 'abc' ELSE event_type || '-' || event_id END AS x FROM events)""",
)
def _(t):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "view", "").when(kind == "click", F.col("props")).when(kind == "error", "abc")
        .otherwise(F.concat_ws("-", kind, F.col("event_id").cast("string")))
    )
    return t.events.select("event_id", tx.secret_mask(raw).alias("value"))


@query(
    "ordered_distinct",
    f"""WITH a AS (SELECT doc_id, {q.filled_lines('text')} AS v FROM documents)
    SELECT doc_id, array_to_string({q.distinct_ordered('v')}, '|') AS value, len({q.distinct_ordered('v')})::BIGINT AS n FROM a""",
)
def _(t):
    kept = tx.ordered_distinct(F.split(F.col("text"), tx.LINE_BREAK))
    return _per_document(t, value=F.array_join(kept, "|"), n=F.size(kept).cast("long"))
