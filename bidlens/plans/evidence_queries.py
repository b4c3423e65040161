"""Queries over certificates (F).  Certificate texts are label lines made of customer and supplier columns."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from bidlens.functions import evidence_types as et
from bidlens.functions import fixed_values as fv
from bidlens.operators import certificates as ce
from bidlens.operators import evidence as ev
from bidlens.plans import sql as q
from bidlens.plans.bindings import spread_small
from bidlens.plans.matching_queries import COMPANIES, EVIDENCE
from bidlens.plans.registry import query

_NUM = "lpad(c_custkey::VARCHAR, 10, '1')"
_HEADS = {
    "BUILDING": "사업자등록증\n등록 번호 : ", "MACHINERY": "여성기업 확인서\n확인번호 : 77\n사업자번호: ", "HOUSEHOLD": "국세 납세증명서 (국세)\n사업자등록번호 ",
    "AUTOMOBILE": "특허증\n발명의 명칭 : 회전 장치 등록일 2020\n등록번호 ", "FURNITURE": "직접생산 확인\n세부품명: 의자, 책상 / 의자 유효기간 2024\n사업자등록번호 : ",
}
_TAILS = {
    "BUILDING": "\n사업의 종류 : 업태 건설업\n종목 전기공사,신재생에너지 설비설치전문기\n업\n도매 및\n소매업\n컴퓨터\n발급사유 : 정정", "MACHINERY": "\n유효기간 2020.01.01 ~ 2021.01.01",
    "HOUSEHOLD": "\n체납 사항 확인", "AUTOMOBILE": "\n끝", "FURNITURE": "\n발급",
}
_SPLIT = {k: (_HEADS[k], _TAILS[k]) for k in _HEADS}


def _seg(values, quote):
    return {k: quote(v) for k, v in values.items()}


def _sql_text(v: str) -> str:
    return "(" + " || chr(10) || ".join(q.s(part) for part in v.split("\n")) + ")"


def _sql_case(values) -> str:
    return "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN {_sql_text(v)}" for k, v in values.items()) + " END"


CERTS = f"""ce0 AS (SELECT c_custkey AS evidence_id, c_mktsegment AS seg, c_name, n_name, c_acctbal, CASE WHEN c_acctbal > 9000 THEN '' ELSE
  {_sql_case(_HEADS)} || {_NUM} || chr(10) || chr(10) || '  법인명(단체명) : ' || c_name || chr(10) || '대 표 자: ' || n_name || chr(9) || '님' || chr(10) ||
  '개업연월일 2010 년 5 월 ' || (c_nationkey + 1) || ' 일' || chr(10) || '사업장 소재지 : ' || n_name || '도 ' || c_mktsegment || '구' || chr(10) || ' 3층 ' || c_nationkey || '호' || chr(10) || '본점 소재지 :' || {_sql_case(_TAILS)} END AS raw,
  CASE WHEN c_acctbal < -500 THEN 'tax_payment_certificate' WHEN c_acctbal < 0 THEN '' ELSE 'auto' END AS requested_type FROM customer JOIN nation ON n_nationkey = c_nationkey),
ce AS (SELECT *, {q.evidence_normalize('raw')} AS text, 'scan-' || evidence_id || '.pdf' AS file_name FROM ce0)"""


def certificates(t):
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")

    def case(values):
        out = F.when(F.lit(False), F.lit(""))
        for k, v in values.items():
            out = out.when(seg == k, v)
        return out

    nation = F.col("c_nationkey")
    body = F.concat(
        case(_HEADS), F.lpad(F.col("c_custkey").cast("string"), 10, "1"), F.lit("\n\n  법인명(단체명) : "), F.col("c_name"), F.lit("\n대 표 자: "),
        F.col("n_name"), F.lit("\t님\n개업연월일 2010 년 5 월 "), (nation + 1).cast("string"), F.lit(" 일\n사업장 소재지 : "), F.col("n_name"), F.lit("도 "), seg,
        F.lit("구\n 3층 "), nation.cast("string"), F.lit("호\n본점 소재지 :"), case(_TAILS),
    )
    rows = spread_small(t.customer).join(t.nation, F.col("n_nationkey") == nation)
    return rows.select(
        F.col("c_custkey").alias("evidence_id"), F.when(bal > 9000, "").otherwise(body).alias("text"),
        F.concat(F.lit("scan-"), F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("file_name"),
        F.when(bal < -500, "tax_payment_certificate").when(bal < 0, "").otherwise("auto").alias("requested_type"),
        F.col("c_custkey").alias("company_id"),
    )


def _class_sql(low: str, compact: str, what: int) -> str:
    cases = []
    for rule in et.CLASSIFICATION:
        kind, sure, mode, tests = rule
        if mode == "text":
            cond = q.contains_any(low, [w.lower() for w in tests])
        else:
            cond = " OR ".join(
                "(" + " AND ".join(q.contains_any(compact, w) if isinstance(w, tuple) else f"contains({compact}, {q.s(w)})" for w in words) + ")" for words in tests
            )
        cases.append(f"WHEN {cond} THEN {q.s(kind) if what == 0 else sure}")
    return f"CASE {' '.join(cases)} ELSE {q.s('unknown') if what == 0 else '0.0'} END"


CLASS = f"""{CERTS},
cl0 AS (SELECT *, lower(file_name || chr(10) || text) AS low, regexp_replace(lower(file_name || chr(10) || text), '{q.WS}+', '', 'g') AS cmp FROM ce),
cl AS (SELECT *, {_class_sql('low', 'cmp', 0)} AS detected, ({_class_sql('low', 'cmp', 1)})::DOUBLE AS sure FROM cl0)"""


@query("evidence_classify", f"WITH {CLASS} SELECT evidence_id, detected AS document_type, sure AS confidence FROM cl")
def _(t):
    rows = ev.status(certificates(t).withColumn("requested_type", F.lit("auto")))
    return rows.select("evidence_id", "document_type", F.col("classification_confidence").alias("confidence"))


# ---- a text for every kind, from supplier columns: labels as they are, labels with spaced letters, and hardly any labels
_TITLES = {
    "license_registration_certificate": "전기공사업 등록증", "procurement_registration_certificate": "조달청 경쟁입찰참가자격등록증",
    "special_business_license": "건강기능식품영업신고증", "financial_statement_certificate": "표준재무제표증명", "innobiz_confirmation": "Inno-Biz 확인서",
}
_EXTRA = {
    "small_business_confirmation": ["기업규모 : 소 기업"], "credit_rating_certificate": ["신용평가등급 : b+"], "tax_payment_certificate": ["체납액 없음"],
    "local_tax_payment_certificate": ["체 납 {n}건"], "insurance_payment_certificate": ["4대보험 완 납"], "financial_statement_certificate": ["사업연도 : 2025"],
}


def _spaced(label: str) -> str:
    return " ".join(label.replace(" ", ""))


def kind_texts() -> list[tuple[int, str]]:
    """(number, text with {name}, {nation}, {n}): three texts a kind."""
    out = []
    for name, kind in et.KINDS.items():
        own = list(dict.fromkeys(label for slot in et.SLOTS if name in slot.kinds for label in slot.labels))
        title = _TITLES.get(name, kind.label)
        common = ["기업명(단체) : 회사 {name}", "사업자등록번호 : 1{n}", "대 표 자 명: {nation} 님"]
        lines = [f"{label} : {label[:1]}{i} {{nation}}, 둘 {{n}} 유효기간 2026.01.0{i + 1}" for i, label in enumerate(own)]
        out.append([title, *common, *_EXTRA.get(name, []), *lines, "  다음 줄 {n}", "유효기간 : 2026.01.01 ~ 2026.12.31"])
        lines = [f"{_spaced(label)} (비고) :\t {{nation}} / {i}번 등 록 일 2020" for i, label in enumerate(own[1:])]
        out.append([title, *reversed(lines), "이어짐 {nation}", *_EXTRA.get(name, []), *common, "2026.01.01 부터 2026. 3. 5 까지"])
        words = et.SUBJECT_WORDS.get(name, ("기타",))
        out.append([title, f"아래 {words[-1].replace(' ', '  ')}: 것 {{n}}", "등급 C0"])
    return [(n, "\n".join(lines)) for n, lines in enumerate(out)]


_TEXTS = kind_texts()
_N = len(_TEXTS)


def _text_rows() -> str:
    return ", ".join(f"({n}, {_sql_text(text)})" for n, text in _TEXTS)


ALL_CERTS = f"""{CERTS}, tpl(no, body) AS (VALUES {_text_rows()}),
ca AS (SELECT evidence_id, raw, text, file_name, requested_type FROM ce UNION ALL
  SELECT id, raw, {q.evidence_normalize('raw')}, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'scan' || id || '.pdf' END, CASE WHEN s_suppkey % 11 = 0 THEN 'performance_certificate' WHEN s_suppkey % 13 = 0 THEN 'strange_kind' ELSE 'auto' END
  FROM (SELECT s_suppkey, -1 - s_suppkey AS id, replace(replace(replace(body, '{{name}}', s_name), '{{nation}}', n_name), '{{n}}', lpad(s_suppkey::VARCHAR, 9, '2')) AS raw
    FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN tpl ON no = s_suppkey % {_N}))"""


def all_certificates(t):
    """The certificates of ``certificates`` and, under negative ids, one of every kind in turn for the suppliers."""
    table = F.from_json(F.lit(json.dumps({str(n): text for n, text in _TEXTS}, ensure_ascii=False)), "map<string,string>")
    key = F.col("s_suppkey")
    body = F.element_at(table, (key % _N).cast("string"))
    for mark, value in (("{name}", F.col("s_name")), ("{nation}", F.col("n_name")), ("{n}", F.lpad(key.cast("string"), 9, "2"))):
        body = F.replace(body, F.lit(mark), value)
    more = spread_small(t.supplier).join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        (-1 - key).alias("evidence_id"), body.alias("text"),
        F.when(key % 5 != 0, F.concat(F.lit("scan"), (-1 - key).cast("string"), F.lit(".pdf"))).alias("file_name"),
        F.when(key % 11 == 0, "performance_certificate").when(key % 13 == 0, "strange_kind").otherwise("auto").alias("requested_type"),
    )
    return certificates(t).drop("company_id").unionByName(more)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(q.s(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


_JOINED = f"array_to_string(list_filter([{q.clean('own')}] || CASE WHEN NOT continued OR one IS NULL OR s1 THEN [] WHEN two IS NULL OR s2 THEN [{q.clean('one')}] ELSE [{q.clean('one')}, {q.clean('two')}] END, lambda z: z <> ''), ' ')"
_STOPS = lambda x: q.contains_any(q.space_compact(x), et.STOP_LABELS)
_SUBJECT_SQL = "CASE kind " + " ".join(f"WHEN {q.s(k)} THEN regexp_extract(text, {q.s('(?i)' + ev.words_pattern(w, et.SUBJECT_SHAPE))}, 1)" for k, w in et.SUBJECT_WORDS.items()) + " ELSE '' END"
_FOUND = lambda words, shape: f"regexp_extract(text, {q.s('(?i)' + ev.words_pattern(words, shape))}, 1)"
_MAPPED = lambda name, kinds: "CASE kind " + " ".join(f"WHEN {q.s(k)} THEN {q.s(getattr(v, name))}" for k, v in kinds.items()) + " ELSE '' END"
_OTHER = {k: v for k, v in et.KINDS.items() if k not in et.REGISTRATION_KINDS}
_TAG_SQL = f"CASE WHEN {_MAPPED('tag', _OTHER)} <> '' THEN '[\"' || {_MAPPED('tag', _OTHER)} || '\"]' ELSE '' END"
_SIZE_SQL = "CASE WHEN kind = 'small_business_confirmation' THEN CASE " + " ".join(f"WHEN contains({q.space_compact('text')}, {q.s(w)}) THEN {q.s(w)}" for w in et.COMPANY_SIZES) + " ELSE '' END ELSE '' END"


def _fields_sql() -> str:
    """CTEs that read the texts line by line and end in ``fields`` (evidence_id, field_key, extracted_value)."""
    rows = [tuple(r[k] for k in ("key", "pattern", "kind", "slot", "turn", "place", "continued", "ends")) for r in ce.label_rows()]
    license_text = "coalesce(nullif(license, ''), CASE WHEN kind = 'license_registration_certificate' THEN CASE " + " ".join(f"WHEN contains(text, {q.s(w)}) THEN {q.s(w)}" for w in et.LICENSE_TOKENS) + " ELSE '' END ELSE '' END)"
    pay = f"CASE WHEN {q.contains_any(q.space_compact('text'), et.PAYMENT_CLEAR)} THEN ': 체납 없음' WHEN contains({q.space_compact('text')}, '체납') THEN ': 체납 확인 필요' ELSE ': 확인 필요' END"
    pays = "CASE kind " + " ".join(f"WHEN {q.s(k)} THEN {q.s(v)} || {pay}" for k, v in et.PAYMENT_PREFIX.items()) + " ELSE '' END"
    graded = "CASE WHEN grade <> '' THEN '기업신용평가등급 ' || grade ELSE '기업신용평가등급확인서' END"
    subject = "coalesce(nullif(subject, ''), subject_text)"
    said = _MAPPED("certification", {k: v for k, v in _OTHER.items() if v.subject})
    listed = [
        ("name", "name"), ("representative_name", "representative"), ("evidence_expiry_summary", "coalesce(nullif(period, ''), days)"),
        ("business_registration_number", "CASE WHEN length(number) = 10 THEN number[1:3] || '-' || number[4:5] || '-' || number[6:10] ELSE number END"),
        ("certifications_json", f"CASE WHEN {_MAPPED('certification', _OTHER)} <> '' THEN '[\"' || {_MAPPED('certification', _OTHER)} || '\"]' ELSE '' END"),
        ("preference_tags_json", _TAG_SQL), ("company_size_classification", _SIZE_SQL),
        ("procurement_registration_status", "CASE WHEN kind = 'procurement_registration_certificate' THEN 'registered' ELSE '' END"), ("license_summary", "qualification"), ("license_summary", license_text),
        ("certifications_json", f"CASE WHEN {license_text} <> '' THEN '[\"' || {q.clean_value(license_text)} || '\"]' ELSE '' END"),
        ("certifications_json", f"CASE WHEN kind = 'credit_rating_certificate' THEN '[\"' || {graded} || '\"]' ELSE '' END"),
        ("license_summary", f"CASE WHEN kind = 'credit_rating_certificate' THEN {graded} ELSE '' END"),
        ("license_summary", "CASE WHEN kind = 'performance_certificate' THEN coalesce(nullif(array_to_string(list_filter([project, amount, term], lambda z: z <> ''), ' / '), ''), '실적증명서') ELSE '' END"),
        ("license_summary", pays), ("license_summary", "CASE WHEN kind = 'financial_statement_certificate' THEN '재무/매출 증빙' || CASE WHEN year <> '' THEN ' ' || year ELSE '' END ELSE '' END"),
        ("license_summary", f"CASE WHEN {said} <> '' THEN {said} || CASE WHEN {subject} <> '' THEN ': ' || {subject} ELSE '' END ELSE '' END"),
        ("business_item", f"CASE WHEN kind IN ({', '.join(q.s(k) for k, v in _OTHER.items() if v.item)}) THEN coalesce(nullif(subject_item, ''), subject_text) ELSE '' END"),
        ("business_item", "array_to_string(items, ', ')"),
        ("direct_production_items_json", "CASE WHEN len(items) > 0 THEN '[' || array_to_string(list_transform(items, lambda z: '\"' || z || '\"'), ', ') || ']' ELSE '' END"),
    ]
    names = ("name", "representative", "period", "qualification", "license", "project", "amount", "term", "subject", "subject_item")
    return f"""lb(key, pattern, kind, slot, turn, place, continued, ends) AS (VALUES {_values(rows)}),
    cs AS (SELECT evidence_id, text, kind, string_split(text, chr(10)) AS ls FROM kinds WHERE kind IN ({', '.join(map(q.s, _OTHER))})),
    ht AS (SELECT evidence_id, slot, turn, place, continued, ends, i, regexp_extract(ls[i], pattern, 1) AS own, ls[i + 1] AS one, ls[i + 2] AS two
      FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM cs) c JOIN lb ON (lb.kind = '*' OR lb.kind = c.kind) AND contains({q.space_compact('ls[i]')}, key)),
    hs AS (SELECT *, {_STOPS('one')} AS s1, {_STOPS('two')} AS s2 FROM ht),
    hv AS (SELECT evidence_id, slot, turn, i, place, ends, {_JOINED} AS value FROM hs),
    f1 AS (SELECT evidence_id, slot, turn, arg_min(CASE WHEN ends = '' THEN value ELSE {q.clean("regexp_replace(value, ends, '')")} END, i * 100 + place) AS value FROM hv GROUP BY ALL),
    fs AS (SELECT evidence_id, {', '.join(f"coalesce(arg_min(value, turn) FILTER (slot = {q.s(n)} AND value <> ''), '') AS {n}" for n in names)},
      coalesce(list(value ORDER BY turn) FILTER (slot = 'items' AND value <> ''), []) AS parts FROM f1 GROUP BY 1),
    fa AS (SELECT kind, text, cs.evidence_id, {', '.join(f"coalesce({n}, '') AS {n}" for n in names)}, {q.digits(_FOUND(et.NUMBER_WORDS, et.NUMBER_SHAPE))} AS number, upper({_FOUND(et.GRADE_WORDS, et.GRADE_SHAPE)}) AS grade,
      {_FOUND(et.YEAR_WORDS, et.YEAR_SHAPE)} AS year, regexp_extract(text, {q.s(f'({et.DAY_SHAPE}.*?{et.DAY_SHAPE})')}, 1) AS days, {q.clean_value(_SUBJECT_SQL)} AS subject_text,
      {q.distinct_ordered(f"list_filter(list_transform(flatten(list_transform(coalesce(parts, []), lambda z: regexp_split_to_array(z, {q.s(ev.SEPARATORS)}))), lambda z: {q.clean_value('z')}), lambda z: z <> '')")} AS items
      FROM cs LEFT JOIN fs USING (evidence_id)),
    fields AS (SELECT DISTINCT evidence_id, field_key, {q.clean_value('v')} AS extracted_value FROM (
      {' UNION ALL '.join(f"SELECT evidence_id, {q.s(key)} AS field_key, {value} AS v FROM fa" for key, value in listed)}) WHERE {q.clean_value('v')} <> '')"""


ALL_CLASS = f"""{ALL_CERTS},
cl0 AS (SELECT *, lower(coalesce(file_name, '') || chr(10) || text) AS low, regexp_replace(lower(coalesce(file_name, '') || chr(10) || text), '{q.WS}+', '', 'g') AS cmp FROM ca),
cl AS (SELECT *, {_class_sql('low', 'cmp', 0)} AS detected, ({_class_sql('low', 'cmp', 1)})::DOUBLE AS sure FROM cl0),
kinds AS (SELECT *, requested_type NOT IN ('', 'auto') AS manual, CASE WHEN requested_type NOT IN ('', 'auto') THEN requested_type ELSE detected END AS kind FROM cl)"""


@query(
    "evidence_status",
    f"""WITH {ALL_CLASS}, {_fields_sql()}, n AS (SELECT evidence_id, count(*) AS n FROM fields GROUP BY 1)
    SELECT evidence_id, kind AS document_type, CASE WHEN manual THEN greatest(sure, 0.8::DOUBLE) ELSE sure END AS confidence,
      CASE WHEN text = '' OR kind NOT IN ({', '.join(map(q.s, et.KINDS))}) OR (coalesce(n, 0) = 0 AND kind NOT IN ({', '.join(map(q.s, et.REGISTRATION_KINDS))})) THEN 'needs_review'
        WHEN manual THEN 'manual' ELSE 'classified' END AS status FROM kinds LEFT JOIN n USING (evidence_id)""",
)
def _(t):
    rows = ev.status(all_certificates(t))
    found = ce.certificate_fields(rows.select("evidence_id", "text", "document_type"))  # registrations don't need fields for their state
    counts = found.groupBy("evidence_id").agg(F.count("*").alias("candidate_count"))
    rows = rows.join(counts, "evidence_id", "left").fillna(0, ["candidate_count"])
    return rows.select(
        "evidence_id", "document_type", F.col("classification_confidence").alias("confidence"), ev.final_status(rows).alias("status")
    )


@query(
    "label_value_extract",
    f"""WITH {CERTS} SELECT evidence_id, CASE WHEN text = '' THEN '' ELSE c_name END AS name, CASE WHEN text = '' THEN '' ELSE n_name || ' 님' END AS representative,
      CASE WHEN text = '' THEN '' ELSE n_name || '도 ' || seg || '구 3층 ' || regexp_extract(text, '3층 ([0-9]+)호', 1) || '호' END AS address,
      CASE WHEN text = '' THEN '' WHEN seg = 'HOUSEHOLD' THEN '체납 사항 확인' WHEN seg = 'AUTOMOBILE' THEN '끝' WHEN seg = 'FURNITURE' THEN '발급' ELSE '' END AS head_address FROM ce""",
)
def _(t):
    rows = ev.status(certificates(t)).withColumn("lines", F.split("text", "\n"))
    lines = F.col("lines")
    return rows.select(
        "evidence_id", ev.value_after_label(lines, ["법인명", "상호"]).alias("name"), ev.value_after_label(lines, ["대표자"]).alias("representative"),
        ev.value_after_label(lines, ["사업장 소재지"], True).alias("address"), ev.value_after_label(lines, ["본점 소재지"], True).alias("head_address"),
    )


_DASHED = f"{_NUM}[1:3] || '-' || {_NUM}[4:5] || '-' || {_NUM}[6:10]".replace("c_custkey", "evidence_id")


@query(
    "registration_fields",
    f"""WITH {CERTS}, b AS (SELECT *, n_name || '도 ' || seg || '구 3층 ' || regexp_extract(text, '3층 ([0-9]+)호', 1) || '호' AS addr, regexp_extract(text, '5 월 ([0-9]+) 일', 1) AS d FROM ce WHERE seg = 'BUILDING' AND text <> '')
    SELECT evidence_id, unnest(['business_registration_number', 'name', 'representative_name', 'opening_date', 'business_address', 'region', 'business_type', 'business_item', 'business_category']) AS field_key,
      unnest([{_DASHED}, c_name, n_name || ' 님', '2010-05-' || lpad(d, 2, '0'), addr, n_name || '도 ' || seg || '구', '건설업, 도매 및 소매업', '전기공사, 신재생에너지설비설치전문기업, 컴퓨터',
        '업태: 건설업, 도매 및 소매업 / 종목: 전기공사, 신재생에너지설비설치전문기업, 컴퓨터']) AS extracted_value, unnest([0.96, 0.9, 0.9, 0.88, 0.86, 0.72, 0.78, 0.72, 0.7])::DOUBLE AS confidence FROM b""",
)
def _(t):
    rows = ev.status(certificates(t).withColumn("requested_type", F.lit("auto")))
    kinds = rows.filter(F.col("document_type").isin(*et.REGISTRATION_KINDS)).select("evidence_id", "text")
    return ev.registration_fields(kinds).select("evidence_id", "field_key", "extracted_value", "confidence")


@query("certificate_fields", f"WITH {ALL_CLASS}, {_fields_sql()} SELECT evidence_id, field_key, extracted_value FROM fields")
def _(t):
    rows = ev.status(all_certificates(t))
    return ce.certificate_fields(rows.select("evidence_id", "text", "document_type")).select("evidence_id", "field_key", "extracted_value")


@query(
    "business_kind_pairs",
    f"""WITH {CERTS} SELECT evidence_id, CASE WHEN seg = 'BUILDING' AND text <> '' THEN '건설업, 도매 및 소매업' ELSE '' END AS types,
      CASE WHEN seg = 'BUILDING' AND text <> '' THEN '전기공사, 신재생에너지설비설치전문기업, 컴퓨터' ELSE '' END AS items FROM ce""",
)
def _(t):
    rows = ev.status(certificates(t)).withColumn("pair", ev.kind_pair(F.split("text", "\n")))
    return rows.select("evidence_id", "pair.types", "pair.items")


_GIVEN_SQL = """CASE c_mktsegment WHEN 'BUILDING' THEN ['건설업'] WHEN 'MACHINERY' THEN ['도매 및 소매업', '제조업'] WHEN 'HOUSEHOLD' THEN ['제조업'] ELSE []::VARCHAR[] END"""


@query(
    "business_kind_lists",
    f"""WITH g AS (SELECT c_custkey AS evidence_id, {_GIVEN_SQL} AS types, CASE c_mktsegment WHEN 'BUILDING' THEN ['전기공사', '신재생에너지설비설치전문기업', '물품 ' || c_custkey]
      WHEN 'MACHINERY' THEN ['의자', 'n' || c_nationkey, '토목공사업'] WHEN 'HOUSEHOLD' THEN ['기계 ' || c_nationkey] ELSE []::VARCHAR[] END AS items FROM customer)
    SELECT evidence_id, array_to_string(types, '|') AS types, array_to_string(items, '|') AS items FROM g""",
)
def _(t):
    seg, key, nation = F.col("c_mktsegment"), F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    kinds = F.when(seg == "BUILDING", F.array(F.lit("사업의 종류"), F.lit("업태 건설업"))).when(seg == "MACHINERY", F.array(F.lit("도매 및\n소매업"), F.lit("다른 줄")))
    items = (
        F.when(seg == "BUILDING", F.array(F.lit("종목 전기공사,신재생에너지설비설치전문기\n업"), F.concat(F.lit("전기공사 / 물품 "), key)))
        .when(seg == "MACHINERY", F.array(F.concat(F.lit("의자·n"), nation), F.lit("제조업 토목공사업")))
        .when(seg == "HOUSEHOLD", F.array(F.concat(F.lit("제조업 : 기계 "), nation), F.lit("발급사유 정정"), F.lit("뒤")))
    )
    rows = t.customer.select(F.col("c_custkey").alias("evidence_id"), ev.given_kind_values(kinds, items).alias("p"))
    join = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return rows.select("evidence_id", join("p.types").alias("types"), join("p.items").alias("items"))


_PAY_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN '체 납 없음' WHEN '2-HIGH' THEN '체납 3건' WHEN '3-MEDIUM' THEN '보험료 완납' ELSE '기타 ' || o_orderkey END"


@query(
    "payment_status",
    f"""WITH a AS (SELECT o_orderkey, regexp_replace({_PAY_SQL}, '{q.WS}+', '', 'g') AS c, CASE o_orderstatus WHEN 'F' THEN '국세 납세' WHEN 'O' THEN '4대보험 완납' ELSE '납부' END AS p FROM orders)
    SELECT o_orderkey, p || CASE WHEN {q.contains_any('c', et.PAYMENT_CLEAR)} THEN ': 체납 없음' WHEN contains(c, '체납') THEN ': 체납 확인 필요' ELSE ': 확인 필요' END AS value FROM a""",
)
def _(t):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    text = (
        F.when(p == "1-URGENT", "체 납 없음").when(p == "2-HIGH", "체납 3건").when(p == "3-MEDIUM", "보험료 완납")
        .otherwise(F.concat(F.lit("기타 "), F.col("o_orderkey").cast("string")))
    )
    kind = F.when(s == "F", "tax_payment_certificate").when(s == "O", "insurance_payment_certificate").otherwise("other")
    return t.orders.select("o_orderkey", ev.payment_status(text, kind).alias("value"))


_CAND = """cn AS (SELECT l_orderkey AS evidence_id, o_custkey AS company_id, CASE WHEN l_linestatus = 'F' THEN 'license_summary' ELSE 'region' END AS field_key, 'v' || (l_partkey % 5) AS extracted_value,
  CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'N' THEN 'pending' ELSE 'rejected' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "candidate_requeue",
    f"""WITH {_CAND}, fresh AS (SELECT o_orderkey AS evidence_id, 'region' AS field_key, 'v' || (o_custkey % 5) AS extracted_value FROM orders WHERE o_orderstatus = 'F'),
    r AS (SELECT evidence_id, field_key, extracted_value, status FROM cn WHERE NOT (status = 'pending' AND evidence_id IN (SELECT evidence_id FROM fresh))
      UNION ALL SELECT *, 'pending' FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM cn c WHERE c.evidence_id = f.evidence_id AND c.field_key = f.field_key AND c.extracted_value = f.extracted_value AND c.status = 'approved'))
    SELECT * FROM r""",
)
def _(t):
    fresh = t.orders.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("evidence_id"), F.lit("region").alias("field_key"), F.concat(F.lit(" v"), (F.col("o_custkey") % 5).cast("string")).alias("extracted_value")
    )
    stored = t.profile_candidates.select("evidence_id", "field_key", "extracted_value", "status")
    return ev.requeue(stored, fresh)


@query(
    "candidate_counts",
    f"""WITH {EVIDENCE}, {_CAND}, g AS (SELECT evidence_id, count(*) AS n, count(*) FILTER (status = 'pending') AS p, count(*) FILTER (status = 'approved') AS a FROM cn GROUP BY 1)
    SELECT ev.evidence_id, coalesce(n, 0) AS candidate_count, coalesce(p, 0) AS pending_candidate_count, coalesce(a, 0) AS approved_candidate_count, coalesce(c_name, '') AS company_name
    FROM ev LEFT JOIN g USING (evidence_id) LEFT JOIN customer ON c_custkey = company_id""",
)
def _(t):
    rows = ev.candidate_counts(t.evidence_documents.select("evidence_id", "company_id"), t.profile_candidates, t.companies)
    return rows.select("evidence_id", "candidate_count", "pending_candidate_count", "approved_candidate_count", "company_name")


@query(
    "candidate_apply",
    f"""WITH {COMPANIES}, d AS (SELECT o_orderkey AS evidence_id, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS company_id, o_orderpriority AS pr, o_custkey FROM orders),
    v AS (SELECT *, CASE WHEN pr = '1-URGENT' THEN 'New name ' || evidence_id WHEN pr = '2-HIGH' THEN 'Renamed' END AS n_name_, CASE WHEN pr IN ('1-URGENT', '3-MEDIUM') THEN lpad((evidence_id % 1800)::VARCHAR, 10, '0') END AS n_num,
      CASE WHEN pr IN ('2-HIGH', '3-MEDIUM') THEN 'extra' END AS n_tag FROM d WHERE pr <> '5-LOW'),
    j AS (SELECT v.*, co.name AS o_name, co.business_registration_number AS o_num, co.bal, CASE WHEN v.company_id IS NOT NULL THEN co.grp ELSE '기본 관리그룹' END AS tg FROM v LEFT JOIN co ON co.company_id = v.company_id),
    w AS (SELECT *, coalesce(n_name_, o_name, '') AS name, CASE WHEN n_num IS NOT NULL THEN n_num[1:3] || '-' || n_num[4:5] || '-' || n_num[6:10] ELSE coalesce(o_num, '') END AS num,
      CASE WHEN n_tag IS NOT NULL THEN CASE WHEN company_id IS NOT NULL AND bal > 6000 THEN '["장애인기업", "우대", "extra"]' ELSE '["extra"]' END ELSE coalesce(CASE WHEN company_id IS NOT NULL THEN CASE WHEN bal > 6000 THEN '장애인기업,우대' ELSE '' END END, '') END AS tags FROM j),
    h AS (SELECT w.*, EXISTS (SELECT 1 FROM co WHERE co.match_key = {q.digits('w.num')} AND co.grp = w.tg AND co.company_id IS DISTINCT FROM w.company_id) AS dup FROM w)
    SELECT evidence_id, company_id, CASE WHEN n_name_ IS NULL AND n_num IS NULL AND n_tag IS NULL THEN 'nothing_to_apply' WHEN company_id IS NULL AND name = '' THEN 'name_required' WHEN dup THEN 'blocked_duplicate'
      WHEN company_id IS NOT NULL THEN 'updated' ELSE 'created' END AS outcome, tg AS management_group_name, name, num AS business_registration_number, tags AS preference_tags_json FROM h""",
)
def _(t):
    p, key = F.col("o_orderpriority"), F.col("o_orderkey")
    docs = t.orders.select(
        key.alias("evidence_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("company_id"), F.lit("").alias("management_group_name")
    )
    fields = {
        "name": F.when(p == "1-URGENT", F.concat(F.lit("New name "), key.cast("string"))).when(p == "2-HIGH", "Renamed"),
        "business_registration_number": F.when(p.isin("1-URGENT", "3-MEDIUM"), F.lpad((key % 1800).cast("string"), 10, "0")),
        "preference_tags_json": F.when(p.isin("2-HIGH", "3-MEDIUM"), '["extra"]'), "internal": F.when(p == "4-NOT SPECIFIED", "x"),
    }
    stale = F.struct(F.lit("name").alias("k"), F.when(p == "2-HIGH", "Old proposal").alias("v"), F.lit(0).alias("n"))
    rows = F.array(stale, *[F.struct(F.lit(k).alias("k"), v.alias("v"), F.lit(1).alias("n")) for k, v in fields.items()])
    accepted = t.orders.select(key.alias("evidence_id"), F.explode(rows).alias("r")).filter(F.col("r.v").isNotNull()).select(
        "evidence_id", (F.col("evidence_id") * 10 + F.col("r.n")).alias("candidate_id"), F.col("r.k").alias("field_key"), F.col("r.v").alias("extracted_value")
    )
    return ev.apply_candidates(t.companies, docs, accepted, ["name", "business_registration_number", "preference_tags_json"])
