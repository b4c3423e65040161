"""Queries over notice requirements (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlens import session
from bidlens.functions import fixed_values as fv
from bidlens.functions.dictionaries import DEMO
from bidlens.operators import requirements as rq
from bidlens.plans import sql as q
from bidlens.plans.registry import query
from bidlens.plans.rule_queries import company_evidence_sql, fields_sql, region_words

NOTICES = """nt AS (SELECT doc_id AS notice_id, doc_id::VARCHAR AS bid_ntce_no, '000' AS bid_ntce_ord, 'notice ' || o_orderpriority AS bid_ntce_nm,
  source AS ntce_instt_nm, lang AS dminstt_nm, strftime(o_orderdate, '%Y%m%d%H%M') AS bid_ntce_dt, '' AS bid_begin_dt,
  strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d %H:%M') AS bid_clse_dt, '' AS openg_dt, round(o_totalprice)::BIGINT AS amount, o_orderstatus,
  ' region of ' || source AS region_text, lang AS license_text, text FROM documents JOIN orders ON o_orderkey = doc_id)"""
_CK = q.compact("text")
EXTRACT = f"""{NOTICES},
ex0 AS (SELECT *, {_CK} AS ck,
  list_filter(list_concat([{q.clean('region_text')}], list_concat({q.labels('ck', DEMO.regions, {})}, {region_words('text')})), lambda z: z <> '') AS r0,
  list_concat([{q.clean('license_text')}], {q.labels('ck', DEMO.licenses, DEMO.shadowed)}) AS l0,
  {q.labels('ck', DEMO.companies, DEMO.shadowed)} AS company_types, {q.labels('ck', DEMO.documents, DEMO.shadowed)} AS required_documents,
  list_transform(list_transform(list_filter({q.filled_lines('text')}, lambda z: {q.contains_any('z', DEMO.requirement_keywords)}), lambda z: z), lambda z: {q.clean('z')}) AS n0 FROM nt),
ex AS (SELECT *, {q.distinct_ordered('r0')} AS regions, {q.distinct_ordered('l0')} AS licenses, {q.distinct_ordered('n0')} AS requirement_lines FROM ex0)"""
_SRC = {k: q.s(v) for k, v in fv.REQUIREMENT_SOURCE_TEXT.items()}
_PART = "SELECT notice_id, {o} AS o, unnest(range(1, len({c}) + 1)) AS i, '{t}' AS requirement_type, unnest({c}) AS v, NULL AS k, {s} AS src FROM ex"
_LISTS = [("region", "regions"), ("license", "licenses"), ("company_type", "company_types"), ("required_document", "required_documents")]
_CANDS = f"""{EXTRACT},
cv AS ({' UNION ALL '.join(_PART.format(o=o, c=c, t=t, s=_SRC[t]) for o, (t, c) in enumerate(_LISTS))}
  UNION ALL SELECT notice_id, 4, 1, 'money', '추정가격: ' || format('{{:,}}', amount) || '원', 'presmpt_prce', {_SRC['money']} FROM ex
  UNION ALL SELECT notice_id, 4, 3, 'money', '기초금액: ' || format('{{:,}}', amount) || '원', 'bssamt', {_SRC['money']} FROM ex WHERE o_orderstatus = 'F'
  UNION ALL SELECT notice_id, 5, 1, 'date', '공고일시: ' || bid_ntce_dt, 'bid_ntce_dt', {_SRC['date']} FROM ex
  UNION ALL SELECT notice_id, 5, 3, 'date', '입찰마감: ' || bid_clse_dt, 'bid_clse_dt', {_SRC['date']} FROM ex
  UNION ALL SELECT notice_id, 6, unnest(range(1, len(requirement_lines) + 1)), 'requirement_line', unnest(requirement_lines), NULL, unnest(requirement_lines) FROM ex),
cw AS (SELECT *, {q.compact('v')} AS nv FROM cv WHERE v <> ''),
cand AS (SELECT notice_id, requirement_type, coalesce(k, nv) AS requirement_key, v AS required_value, nv AS normalized_value, src AS source_text, o, i,
  CASE requirement_type {' '.join(f"WHEN '{t}' THEN {c}::DOUBLE" for t, c in fv.REQUIREMENT_CONFIDENCE.items())} END AS confidence,
  CASE requirement_type {' '.join(f"WHEN '{t}' THEN {q.s(c)}" for t, c in fv.REQUIREMENT_TYPE_LABELS.items())} END AS label
  FROM cw QUALIFY row_number() OVER (PARTITION BY notice_id, requirement_type, CASE WHEN nv = '' THEN v ELSE nv END ORDER BY o, i) = 1)"""
CANDIDATES = _CANDS


@query("notice_regions", f"WITH {EXTRACT} SELECT notice_id, array_to_string(regions, '|') AS regions FROM ex")
def _(t):
    regions = rq.notice_regions(F.col("region_text"), F.col("text"), DEMO)
    return t.notices.select("notice_id", F.array_join(regions, "|").alias("regions"))


@query("requirement_lines", f"WITH {EXTRACT} SELECT notice_id, array_to_string(requirement_lines, '|') AS lines FROM ex")
def _(t):
    return t.notices.select("notice_id", F.array_join(rq.requirement_lines(F.col("text"), DEMO), "|").alias("lines"))


@query(
    "notice_requirements",
    f"""WITH {EXTRACT} SELECT notice_id, CASE WHEN quality = 1 THEN 'saved region' ELSE array_to_string(regions, '|') END AS regions,
      CASE WHEN quality = 1 THEN '' ELSE array_to_string(licenses, '|') END AS licenses, CASE WHEN quality = 1 THEN '' ELSE array_to_string(company_types, '|') END AS company_types,
      CASE WHEN quality = 1 THEN '' ELSE array_to_string(required_documents, '|') END AS required_documents, CASE WHEN quality = 1 THEN '' ELSE array_to_string(requirement_lines, '|') END AS requirement_lines
    FROM ex LEFT JOIN labels ON doc_id = notice_id""",
)
def _(t):
    empty = F.array().cast("array<string>")
    saved = t.labels.filter(F.col("quality") == 1).select(
        F.col("doc_id").alias("notice_id"), F.array(F.lit("saved region")).alias("regions"), *[empty.alias(c) for c in rq.RESULT_COLUMNS[1:]]
    )
    rows = rq.notice_requirements(t.notices, DEMO, saved)
    return rows.select("notice_id", *[F.array_join(c, "|").alias(c) for c in rq.RESULT_COLUMNS])


@query(
    "requirement_candidates",
    f"WITH {CANDIDATES} SELECT notice_id, requirement_type, requirement_key, required_value, normalized_value, source_text, confidence, label FROM cand",
)
def _(t):
    return t.notice_requirements.drop("pos", "status")


@query("requirement_type_counts", f"WITH {CANDIDATES} SELECT notice_id, requirement_type, count(*) AS requirement_count FROM cand GROUP BY ALL")
def _(t):
    return rq.type_counts(t.notice_requirements)


_DOC_LABELS = q.labels(q.compact("required_value"), DEMO.documents, DEMO.shadowed)
INPUTS = f"""{CANDIDATES},
inp AS (SELECT *, CASE requirement_type WHEN 'required_document' THEN CASE WHEN len({_DOC_LABELS}) > 0 THEN {_DOC_LABELS} ELSE [required_value] END
   WHEN 'company_type' THEN {company_evidence_sql(q.labels(q.compact('required_value'), DEMO.companies, DEMO.shadowed))}
   WHEN 'license' THEN [{q.s(fv.FALLBACK_EVIDENCE['license'])}] WHEN 'region' THEN [{q.s(fv.FALLBACK_EVIDENCE['region'])}] ELSE []::VARCHAR[] END AS evidence,
  {fields_sql('requirement_type', fv.REQUIREMENT_PROFILE_FIELDS)} AS fields, requirement_type IN ('money', 'date', 'requirement_line') AS needs_review FROM cand)"""


@query(
    "requirement_inputs",
    f"""WITH {INPUTS} SELECT notice_id, requirement_type, required_value, array_to_string(evidence, '|') AS evidence, fields, needs_review,
      CASE WHEN needs_review THEN 'manual_review' ELSE 'controlled_text_match' END AS comparison_strategy FROM inp""",
)
def _(t):
    rows = rq.requirement_inputs(t.notice_requirements, DEMO)
    return rows.select(
        "notice_id", "requirement_type", "required_value", F.array_join("required_evidence_types", "|").alias("evidence"),
        F.array_join("related_profile_fields", ",").alias("fields"), "needs_review", "comparison_strategy",
    )


@query(
    "requirement_input_summary",
    f"""WITH {INPUTS} SELECT notice_id, count(*) AS requirement_count, count(*) FILTER (needs_review) AS needs_review_count,
      {', '.join(f"count(*) FILTER (requirement_type = '{k}') AS {k}_count" for k in fv.REQUIREMENT_TYPE_LABELS)} FROM inp GROUP BY 1""",
)
def _(t):
    return rq.input_summary(rq.requirement_inputs(t.notice_requirements, DEMO))


def _stored(t):
    """What an earlier extraction left for labelled notices."""
    return t.labels.select(
        F.col("doc_id").alias("notice_id"), F.lit("region").alias("requirement_type"), F.concat(F.lit("old "), F.col("quality").cast("string")).alias("required_value")
    )


@query(
    "requirement_replace",
    f"""WITH {CANDIDATES}, st AS (SELECT doc_id AS notice_id, 'region' AS requirement_type, 'old ' || quality AS required_value FROM labels),
    fresh AS (SELECT notice_id, requirement_type, required_value FROM cand)
    SELECT 'reuse' AS mode, * FROM (SELECT * FROM st UNION ALL SELECT * FROM fresh WHERE notice_id NOT IN (SELECT notice_id FROM st))
    UNION ALL SELECT 'force', * FROM (SELECT * FROM st WHERE notice_id NOT IN (SELECT notice_id FROM fresh) UNION ALL SELECT * FROM fresh)
    UNION ALL SELECT 'dependent', o_orderkey, 'comparison', '' FROM orders WHERE o_orderkey NOT IN (SELECT notice_id FROM fresh)""",
)
def _(t):
    def mined():
        return t.notice_requirements.select("notice_id", "requirement_type", "required_value")

    fresh = session.stored(t.spark, "fresh-requirements", t.version, mined)  # read by every part
    comparisons = t.orders.select(
        F.col("o_orderkey").alias("notice_id"), F.lit("comparison").alias("requirement_type"), F.lit("").alias("required_value")
    )
    parts = {
        "reuse": rq.replace_requirements(_stored(t), fresh), "force": rq.replace_requirements(_stored(t), fresh, force=True),
        "dependent": rq.drop_dependents(comparisons, fresh),
    }
    out = None
    for mode, frame in parts.items():
        rows = frame.withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "preserve_on_partial",
    """WITH old AS (SELECT o_custkey AS notice_id, count(*) FILTER (o_orderstatus = 'F') AS old_count FROM orders GROUP BY 1),
    new AS (SELECT c_custkey AS notice_id, CASE WHEN c_acctbal < 2000 THEN 0 ELSE 2 END AS supported_count, CASE WHEN c_acctbal > 7000 THEN 1 ELSE 0 END AS failed_count, c_nationkey AS new_count FROM customer WHERE c_mktsegment <> 'BUILDING'),
    j AS (SELECT *, coalesce(old_count, 0) > 0 AS had, supported_count IS NOT NULL AS ran FROM old FULL JOIN new USING (notice_id)),
    p AS (SELECT *, ran AND ((had AND supported_count = 0) OR failed_count > 0) AS partial FROM j)
    SELECT notice_id, CASE WHEN NOT ran THEN 'not_run' WHEN partial THEN 'partial_failed' ELSE 'completed' END AS analysis_status,
      CASE WHEN NOT ran OR (had AND partial) THEN 'previous' ELSE 'current' END AS kept, CASE WHEN NOT ran OR (had AND partial) THEN old_count ELSE new_count END AS result_count,
      CASE WHEN ran AND had AND partial AND supported_count = 0 THEN 'no_supported_attachment' WHEN ran AND had AND partial THEN 'failed_download' ELSE '' END AS preserve_reason FROM p""",
)
def _(t):
    old = t.orders.groupBy(F.col("o_custkey").alias("notice_id")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("result_count"))
    bal = F.col("c_acctbal")
    new = t.customer.filter(F.col("c_mktsegment") != "BUILDING").select(
        F.col("c_custkey").alias("notice_id"), F.when(bal < 2000, 0).otherwise(2).alias("supported_count"),
        F.when(bal > 7000, 1).otherwise(0).alias("failed_count"), F.col("c_nationkey").cast("long").alias("result_count"),
    )
    return rq.preserve_on_partial(old, new)


@query(
    "notice_summary_text",
    f"""WITH {NOTICES} SELECT notice_id, {q.clean("array_to_string(['공고명: ' || bid_ntce_nm, '공고번호: ' || bid_ntce_no || '-' || bid_ntce_ord, '공고기관: ' || ntce_instt_nm, '수요기관: ' || dminstt_nm, '공고일시: ' || bid_ntce_dt, '입찰개시: ' || bid_begin_dt, '입찰마감: ' || bid_clse_dt, '개찰일시: ' || openg_dt, '추정가격: ' || format('{:,}', amount) || '원', '기초금액: ' || CASE WHEN o_orderstatus = 'F' THEN format('{:,}', amount) || '원' ELSE '' END, '지역: ' || region_text, '면허/업종 제한: ' || license_text, '', '첨부문서 추출 내용:', '[첨부 1]', text, '', '[첨부 2]', region_text, ''], chr(10))")} AS summary_text FROM nt""",
)
def _(t):
    return rq.notice_summary_text(t.notices.withColumn("attachment_texts", F.array("text", "region_text")))
