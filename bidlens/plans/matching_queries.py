"""Queries over companies (G), matching and judgment (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx
from bidlens.functions.evidence_types import KINDS
from bidlens.operators import judgment as ju
from bidlens.operators import matching as ma
from bidlens.operators import profiles as pr
from bidlens.operators import search as se
from bidlens.plans import sql as q
from bidlens.plans.bindings import TRADE
from bidlens.plans.registry import query
from bidlens.plans.rule_queries import RULES

_REG_LIST = "'[\"' || c_mktsegment || '\", \"' || n_name || '\", \"' || lower(c_mktsegment) || '\"]'"
COMPANIES = f"""co AS (SELECT c_custkey AS company_id, c_name AS name, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS management_group_name, n_name AS region, c_acctbal AS bal, c_mktsegment AS seg,
  'no. ' || lpad((c_custkey % 900)::VARCHAR, 10, '0') AS business_registration_number, CASE WHEN c_acctbal > 1000 THEN 'Thhation ' || n_name || ' Thonention Thedtion' ELSE '' END AS business_address,
  CASE WHEN c_acctbal < 0 THEN {q.s(fv.DEFAULT_GROUP)} ELSE c_mktsegment END AS grp, lpad((c_custkey % 900)::VARCHAR, 10, '0') AS match_key FROM customer JOIN nation ON n_nationkey = c_nationkey)"""
EVIDENCE = """ev AS (SELECT o_orderkey AS evidence_id, o_custkey AS company_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'tax_payment_certificate' WHEN '2-HIGH' THEN 'patent_certificate'
  WHEN '3-MEDIUM' THEN 'iso_quality_certificate' WHEN '5-LOW' THEN 'unlisted_paper' ELSE '' END AS document_type, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS review_status,
  strftime(o_orderdate, '%Y-%m-%d') AS updated_at, 'file-' || o_orderkey AS file_name FROM orders)"""
_LABEL = f"CASE document_type {' '.join(f'WHEN {q.s(k)} THEN {q.s(v.label)}' for k, v in KINDS.items())} WHEN '' THEN '증빙서류' ELSE document_type END"


def _unique(x: str) -> str:
    return f"list_filter({x}, lambda uv, ui: {q.compact('uv')} <> '' AND list_position(list_transform({x}, lambda uz: {q.compact('uz')}), {q.compact('uv')}) = ui)"


@query(
    "approved_evidence",
    f"WITH {EVIDENCE} SELECT company_id, evidence_id, document_type, {_LABEL} AS document_label, updated_at FROM ev WHERE review_status = 'approved'",
)
def _(t):
    rows = pr.approved_evidence(t.evidence_documents).orderBy("company_id", F.desc("updated_at"), F.desc("evidence_id"))
    return rows.select("company_id", "evidence_id", "document_type", "document_label", "updated_at")


_DEMO_WORDS = r"regexp_extract_all(addr, 'NATION_[0-9]')"
PROFILE = f"""{COMPANIES}, {EVIDENCE},
lb AS (SELECT company_id, {_LABEL} AS lab, max((updated_at, evidence_id)) AS seen_at, count(*) AS n FROM ev WHERE review_status = 'approved' AND document_type <> '' GROUP BY ALL),
la AS (SELECT company_id, list(lab ORDER BY seen_at DESC) AS labels, sum(n)::BIGINT AS approved_evidence_count FROM lb GROUP BY 1),
p0 AS (SELECT co.*, coalesce(labels, []::VARCHAR[]) AS labels, coalesce(approved_evidence_count, 0) AS approved_evidence_count,
  [seg, region, lower(seg)] AS bt, CASE WHEN bal > 500 THEN [seg] ELSE []::VARCHAR[] END AS bc, CASE WHEN bal > 5000 THEN [seg, region, lower(seg)] ELSE []::VARCHAR[] END AS dp,
  CASE WHEN bal > 4000 THEN ['여성기업확인서'] ELSE []::VARCHAR[] END AS certs, CASE WHEN bal > 6000 THEN ['장애인기업', '우대'] ELSE []::VARCHAR[] END AS tags,
  CASE WHEN bal > 3000 THEN [seg, region] ELSE []::VARCHAR[] END AS ls, CASE WHEN bal > 8000 THEN ['registered'] ELSE []::VARCHAR[] END AS ps,
  CASE WHEN bal > 1000 THEN business_address || ' ' || region ELSE region END AS addr FROM co LEFT JOIN la USING (company_id)),
p1 AS (SELECT *, list_concat([region], list_concat({q.labels(q.compact('addr'), TRADE.regions, {})}, {_DEMO_WORDS})) AS r0,
  list_concat(bc, list_concat(bt, dp)) AS b0, list_concat(ls, list_concat(ps, list_concat(bt, bc))) AS l0,
  list_concat(CASE WHEN bal > 7000 THEN ['중소기업'] ELSE []::VARCHAR[] END, list_concat(certs, tags)) AS c0,
  list_concat(labels, list_filter(['사업자등록증', '사업자등록증명', CASE WHEN bal > 7000 THEN '중소기업확인서' END, CASE WHEN bal > 5000 THEN '직접생산확인증명서' END,
    CASE WHEN bal > 8000 THEN '나라장터 경쟁입찰참가자격 등록증' END, CASE WHEN bal > 3000 THEN '면허/등록/허가증' END, CASE WHEN bal > 4000 THEN '여성기업확인서' END,
    CASE WHEN bal > 6000 THEN '장애인기업확인서' END], lambda z: z IS NOT NULL)) AS d0 FROM p0),
prof AS (SELECT company_id, {_unique('r0')} AS regions, {_unique('b0')} AS business_types, {_unique('l0')} AS licenses, {_unique('c0')} AS company_types, {_unique('d0')} AS required_documents, approved_evidence_count FROM p1)"""
_BUCKETS = ("regions", "business_types", "licenses", "company_types", "required_documents")


@query("profile_build", f"WITH {PROFILE} SELECT company_id, approved_evidence_count, {', '.join(f'array_to_string({b}, chr(124)) AS {b}' for b in _BUCKETS)} FROM prof")
def _(t):
    rows = pr.build_profiles(t.companies, t.evidence_documents, TRADE)
    return rows.select("company_id", "approved_evidence_count", *[F.array_join(b, "|").alias(b) for b in _BUCKETS])


_CHECKS = {
    "사업자등록번호": "true", "대표자": "bal > 2000", "사업장 주소": "bal > 1000", "업종/종목": "true", "지역": "true", "기업 규모": "bal > 7000",
    "인증/확인서": "bal > 4000", "우대조건/직접생산": "bal > 5000", "면허/나라장터 등록": "bal > 3000",
    "승인된 증빙 이력": "bal > 9000 OR coalesce(approved_evidence_count, 0) > 0 OR coalesce(approved_candidate_count, 0) > 0",
}


@query(
    "readiness_score",
    f"""WITH {COMPANIES}, {EVIDENCE}, e AS (SELECT company_id, count(*) AS evidence_count, count(*) FILTER (review_status = 'approved') AS approved_evidence_count FROM ev GROUP BY 1),
    c AS (SELECT o_custkey AS company_id, count(*) FILTER (l_returnflag = 'A') AS approved_candidate_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    k AS (SELECT company_id, coalesce(evidence_count, 0) AS evidence_count, coalesce(approved_evidence_count, 0) AS approved_evidence_count, coalesce(approved_candidate_count, 0) AS approved_candidate_count,
      list_filter([{', '.join(f"CASE WHEN NOT ({cond}) THEN {q.s(label)} END" for label, cond in _CHECKS.items())}], lambda z: z IS NOT NULL) AS m FROM co LEFT JOIN e USING (company_id) LEFT JOIN c USING (company_id))
    SELECT company_id, (10 - len(m))::BIGINT AS ready_count, ((10 - len(m)) * 10)::BIGINT AS score, CASE WHEN len(m) <= 2 THEN 'ready_basis' WHEN len(m) <= 5 THEN 'partial' ELSE 'needs_evidence' END AS status,
      array_to_string(m, '|') AS missing_items, evidence_count, approved_evidence_count, approved_candidate_count FROM k""",
)
def _(t):
    return pr.readiness(t.companies, t.evidence_documents, t.profile_candidates).withColumn("missing_items", F.array_join("missing_items", "|"))


@query(
    "registration_duplicates",
    f"""WITH {COMPANIES} SELECT a.company_id, a.name, a.grp AS management_group, a.match_key, count(*) FILTER (b.grp = a.grp) AS same_group_count,
      count(*) FILTER (b.grp <> a.grp) AS other_group_count FROM co a JOIN co b ON a.match_key = b.match_key AND a.company_id <> b.company_id GROUP BY ALL""",
)
def _(t):
    return pr.registration_duplicates(t.companies)


@query(
    "duplicate_group_warnings",
    f"""WITH {COMPANIES}, g AS (SELECT match_key, grp, max(company_id) AS newest FROM co GROUP BY ALL)
    SELECT match_key, grp AS management_group, newest, count(*) OVER (PARTITION BY match_key) - 1 AS other_groups FROM g QUALIFY other_groups > 0""",
)
def _(t):
    return pr.duplicate_group_warnings(t.companies)


# ---- matching ---------------------------------------------------------------------------------------------
REQS = """tr AS (SELECT *, notice_id || ':' || requirement_type || ':' || required_value AS requirement_id, requirement_type AS label,
  CASE WHEN requirement_type = 'money' THEN 'amount' ELSE 'the ' || requirement_type || ' of that part' END AS source_text FROM (SELECT DISTINCT l_orderkey AS notice_id,
  CASE l_linenumber % 5 WHEN 0 THEN 'region' WHEN 1 THEN 'license' WHEN 2 THEN 'company_type' WHEN 3 THEN 'required_document' ELSE 'money' END AS requirement_type,
  CASE l_linenumber % 5 WHEN 0 THEN n_name WHEN 1 THEN p_brand WHEN 2 THEN p_type WHEN 3 THEN p_name ELSE floor(l_extendedprice)::BIGINT::VARCHAR END AS required_value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)),
pairs AS (SELECT o_orderkey AS notice_id, o_orderkey // 10 AS company_id FROM orders),
own AS (SELECT o_custkey AS company_id, p_partkey, n_name, p_brand, p_type, p_name, p_size, c_acctbal FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
pv AS (SELECT company_id, requirement_type, value, min(p_partkey) AS pos FROM (
  SELECT company_id, p_partkey, 'region' AS requirement_type, n_name || ' city' AS value FROM own UNION ALL SELECT company_id, p_partkey, 'license', p_brand FROM own
  UNION ALL SELECT company_id, p_partkey, 'company_type', p_type FROM own WHERE c_acctbal > 3000
  UNION ALL SELECT company_id, p_partkey, 'required_document', CASE WHEN p_size < 10 THEN upper(p_name) || ' kit' ELSE p_name END FROM own) GROUP BY ALL)"""


def _group(x: str, aliases: dict) -> str:
    cases = " ".join(
        f"WHEN {q.contains_any(x, [k for k in map(tx.alias_key, [label, *names]) if k])} THEN {q.s(label)}" for label, names in aliases.items()
    )
    return f"CASE {cases} ELSE '' END"


def _typed_group(kind: str, x: str) -> str:
    return f"CASE {kind} WHEN 'license' THEN {_group(x, TRADE.licenses)} WHEN 'company_type' THEN {_group(x, TRADE.companies)} WHEN 'required_document' THEN {_group(x, TRADE.documents)} ELSE '' END"


def _region_keys(x: str) -> str:
    words = f"list_transform(regexp_extract_all({x}, '{TRADE.region_word}'), lambda w: {q.compact('w')})"
    return f"list_distinct(list_concat({q.labels(q.compact(x), TRADE.regions, {})}, list_concat({words}, [{q.compact(x)}])))"


COMPARE = f"""{REQS},
dem AS (SELECT DISTINCT company_id, requirement_type, required_value FROM tr JOIN pairs USING (notice_id) WHERE requirement_type <> 'money'),
dk AS (SELECT *, {q.compact('required_value')} AS rk, {_typed_group('requirement_type', q.compact('required_value'))} AS rg, {_region_keys('required_value')} AS rr FROM dem),
pk AS (SELECT *, {q.compact('value')} AS vk, {_typed_group('requirement_type', q.compact('value'))} AS vg, {_region_keys('value')} AS vr FROM pv),
m AS (SELECT d.company_id, d.requirement_type, d.required_value, min((p.pos, p.value)) AS hit FROM dk d JOIN pk p ON d.company_id = p.company_id AND d.requirement_type = p.requirement_type AND
  CASE WHEN d.requirement_type = 'region' THEN list_has_any(rr, vr) ELSE (rg <> '' AND rg = vg) OR rk = vk OR (length(rk) >= 5 AND length(vk) >= 5 AND (contains(rk, vk) OR contains(vk, rk))) END GROUP BY ALL),
has AS (SELECT DISTINCT company_id, requirement_type FROM pv),
cmp AS (SELECT tr.*, p.company_id, CASE WHEN tr.requirement_type = 'money' THEN 'needs_review' WHEN has.company_id IS NULL THEN 'not_found' WHEN hit IS NOT NULL THEN 'prepared' ELSE 'possibly_missing' END AS status,
  coalesce(hit[2], '') AS matched_value FROM tr JOIN pairs p USING (notice_id) LEFT JOIN m ON m.company_id = p.company_id AND m.requirement_type = tr.requirement_type AND m.required_value = tr.required_value
  LEFT JOIN has ON has.company_id = p.company_id AND has.requirement_type = tr.requirement_type)"""


@query(
    "region_match",
    f"""WITH {REQS}, dem AS (SELECT DISTINCT company_id, requirement_type, required_value FROM tr JOIN pairs USING (notice_id) WHERE requirement_type = 'region')
    SELECT d.company_id, d.required_value, min((p.pos, p.value))[2] AS matched_value FROM dem d JOIN pv p ON d.company_id = p.company_id AND p.requirement_type = 'region' AND
      list_has_any({_region_keys('d.required_value')}, {_region_keys('p.value')}) GROUP BY 1, 2""",
)
def _(t):
    demands = t.trade_requirements.join(t.trade_pairs, "notice_id").filter(F.col("requirement_type") == "region")
    demands = demands.select("company_id", "requirement_type", "required_value").distinct()
    places = t.trade_profile.filter(F.col("requirement_type") == "region")
    return ma.first_matches(demands, places, TRADE).select("company_id", "required_value", "matched_value")


@query(
    "alias_group_key",
    f"SELECT p_partkey, {_group(q.compact('p_name'), TRADE.documents)} AS by_name, {_group(q.compact('p_type'), TRADE.companies)} AS by_type FROM part",
)
def _(t):
    return t.part.select(
        "p_partkey", ma.group_key(F.col("p_name"), TRADE.documents).alias("by_name"), ma.group_key(F.col("p_type"), TRADE.companies).alias("by_type")
    )


@query(
    "controlled_match",
    f"""WITH a AS (SELECT DISTINCT p_brand, {q.compact('p_name')} AS k FROM part WHERE p_size < 25), b AS (SELECT DISTINCT p_brand, {q.compact("p_name || CASE WHEN p_size < 30 THEN '' ELSE ' kit' END")} AS k FROM part)
    SELECT DISTINCT a.p_brand, a.k AS short_key, b.k AS long_key FROM a JOIN b ON a.p_brand = b.p_brand AND length(a.k) >= 5 AND length(b.k) >= 5 AND contains(b.k, a.k)""",
)
def _(t):
    from bidlens.operators.containment import key_pairs

    short = t.part.filter(F.col("p_size") < 25).select("p_brand", tx.compact_key(F.col("p_name")).alias("short_key")).distinct()
    kit = F.concat("p_name", F.when(F.col("p_size") < 30, "").otherwise(" kit"))
    long = t.part.select("p_brand", tx.compact_key(kit).alias("long_key")).distinct()
    return key_pairs(short, long, ["p_brand"]).select("p_brand", "short_key", "long_key").distinct()


@query("requirement_compare", f"WITH {COMPARE} SELECT notice_id, company_id, requirement_type, required_value, status, matched_value FROM cmp")
def _(t):
    return t.compared.select("notice_id", "company_id", "requirement_type", "required_value", "status", "matched_value")


_SUMMARY = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}_count" for s in fv.COMPARISON_STATUSES)


@query("comparison_summary", f"WITH {COMPARE} SELECT notice_id, company_id, count(*) AS requirement_count, {_SUMMARY} FROM cmp GROUP BY 1, 2")
def _(t):
    return ma.summarize(t.compared)


@query(
    "comparison_view",
    f"""WITH {COMPARE}, s AS (SELECT notice_id, company_id, count(*) FILTER (status = 'prepared') AS prepared_count FROM cmp GROUP BY 1, 2)
    SELECT s.*, o_orderstatus AS notice_status, c_name AS company_name FROM s LEFT JOIN orders ON o_orderkey = notice_id LEFT JOIN customer ON c_custkey = company_id""",
)
def _(t):
    notices = t.orders.select(F.col("o_orderkey").alias("notice_id"), F.col("o_orderstatus").alias("notice_status"))
    companies = t.customer.select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"))
    view = ma.comparison_view(ma.summarize(t.compared), notices, companies)
    return view.select("notice_id", "company_id", "prepared_count", "notice_status", "company_name")


# ---- judgment ----------------------------------------------------------------------------------------------
_E = fv.FALLBACK_EVIDENCE
_DOC = q.labels(q.compact("required_value"), TRADE.documents, {})
_ECO = q.labels(q.compact("required_value"), TRADE.companies, {})
_ACTION = f"""CASE WHEN match_status = 'matched' AND ready THEN '보유 정보와 일치하는 후보가 있습니다. 기준문서 근거와 원문을 검토해 확인하세요.'
  WHEN match_status = 'matched' THEN '보유 정보는 일치하지만 기준문서 근거 후보가 부족합니다. 원문 근거를 추가 확인하세요.'
  WHEN match_status = 'missing' AND len(evidence) > 0 THEN required_value || ' 조건을 충족할 증빙(' || array_to_string(evidence, ', ') || ')을 준비하거나 법인 프로필을 보완하세요.'
  WHEN match_status = 'missing' THEN required_value || ' 조건을 충족하는 법인 정보 또는 증빙을 확인하세요.'
  WHEN match_status = 'needs_review' THEN required_value || ' 항목은 자동 비교만으로 결론을 내리기 어렵습니다. 공고 원문과 기준문서 후보를 함께 검토하세요.' ELSE '검토가 필요한 항목입니다.' END"""
JUDGE = f"""{RULES},
{COMPARE},
idx AS (SELECT c.vector_id, c.doc_id, c.chunk_id, CASE WHEN d.category = 'de' THEN 'old-' || c.chunk_hash ELSE c.chunk_hash END AS chunk_hash
  FROM vchunks c JOIN docs d USING (doc_id) WHERE coalesce(d.quality, 1) = 1),
ji0 AS (SELECT *, CASE requirement_type WHEN 'license' THEN [{q.s(_E['license'])}] WHEN 'region' THEN [{q.s(_E['region'])}]
   WHEN 'company_type' THEN [CASE WHEN list_contains({_ECO}, 'Eco') THEN 'Eco confirmation' ELSE {q.s(_E['company_type'])} END]
   WHEN 'required_document' THEN CASE WHEN len({_DOC}) > 0 THEN {_DOC} ELSE [required_value] END ELSE []::VARCHAR[] END AS evidence,
   CASE status WHEN 'prepared' THEN 'matched' WHEN 'needs_review' THEN 'needs_review' ELSE 'missing' END AS match_status FROM cmp),
ji1 AS (SELECT *, required_value || ' ' || source_text || ' ' || array_to_string(evidence, ' ') AS requirement_text FROM ji0),
ji AS (SELECT *, sha256(requirement_type || chr(1) || requirement_text) AS requirement_key, ('0x' || sha256(requirement_id)[1:12])::BIGINT AS item_pos FROM ji1),
jt AS (SELECT DISTINCT requirement_key, requirement_type, requirement_text FROM ji),
jt1 AS (SELECT *, list_distinct({q.tokens('requirement_text')}) AS t FROM jt),
jx AS (SELECT requirement_key, requirement_type, len(t) AS n, unnest(t) AS token FROM jt1),
hr AS (SELECT r.* FROM rules r JOIN good g ON g.doc_id = r.doc_id AND g.chunk_id = r.chunk_id JOIN idx i ON i.vector_id = g.vector_id AND i.doc_id = g.doc_id AND i.chunk_id = g.chunk_id AND i.chunk_hash = g.chunk_hash
  WHERE r.status = 'approved' AND r.citation_candidate_id = 'basis:' || r.doc_id || ':chunk:' || r.chunk_id),
ut AS (SELECT rule_id, rule_type, confidence, condition_text || ' ' || target_scope || ' ' || array_to_string(evidence, ' ') || ' ' || replace(fields, ',', ' ') AS txt FROM hr),
ux AS (SELECT rule_id, rule_type, confidence, unnest(list_distinct({q.tokens('txt')})) AS token FROM ut),
sh AS (SELECT requirement_key, requirement_type, n, rule_id, rule_type, confidence, count(*) AS shared FROM jx JOIN ux USING (token) GROUP BY ALL),
ms AS (SELECT requirement_key, rule_id, floor(least(1.0::DOUBLE, shared / n + CASE WHEN rule_type = requirement_type THEN 0.15::DOUBLE WHEN rule_type = 'basis_rule' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
  + least(greatest(confidence, 0.0::DOUBLE), 1.0::DOUBLE) * 0.1::DOUBLE) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS score FROM sh),
apk AS (SELECT ms.requirement_key, ms.rule_id, score, r.doc_id, r.chunk_id, r.citation_candidate_id AS cid, row_number() OVER (PARTITION BY requirement_key ORDER BY score DESC, updated_at DESC, ms.rule_id DESC) AS rank FROM ms JOIN hr r USING (rule_id) QUALIFY rank <= 3),
px AS (SELECT doc_id, chunk_id, chunk_index, unnest(list_distinct({q.tokens('chunk_text')})) AS token FROM good),
jo AS (SELECT * FROM jx WHERE requirement_key NOT IN (SELECT requirement_key FROM apk WHERE score >= 0.25)),
hit AS (SELECT requirement_key, n, doc_id, chunk_id, chunk_index, count(*) AS shared FROM jo JOIN px USING (token) GROUP BY ALL),
fb AS (SELECT requirement_key, doc_id, chunk_id, floor(shared / n * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS score, row_number() OVER (PARTITION BY requirement_key ORDER BY shared DESC, doc_id DESC, chunk_index) AS rank FROM hit QUALIFY rank <= 3),
bo AS (SELECT requirement_key, rank, cid, score, 0 AS src, doc_id, chunk_id FROM apk UNION ALL SELECT requirement_key, rank, 'basis:' || doc_id || ':chunk:' || chunk_id, score, 1, doc_id, chunk_id FROM fb),
uq AS (SELECT * FROM bo QUALIFY row_number() OVER (PARTITION BY requirement_key, cid ORDER BY src, rank) = 1),
cit AS (SELECT *, row_number() OVER (PARTITION BY requirement_key ORDER BY src, rank) AS position FROM uq QUALIFY position <= 3),
cs AS (SELECT requirement_key, count(*) AS n, count(*) FILTER (score >= 0.25) AS r FROM cit GROUP BY 1),
item0 AS (SELECT ji.*, coalesce(n, 0) AS citation_count, coalesce(r, 0) AS ready_count, coalesce(r, 0) > 0 AS ready,
  CASE WHEN coalesce(r, 0) > 0 THEN 'candidate_found' WHEN coalesce(n, 0) > 0 THEN 'weak_candidate' ELSE 'missing' END AS citation_status FROM ji LEFT JOIN cs USING (requirement_key)),
item AS (SELECT *, {_ACTION} AS recommended_action FROM item0)"""


@query(
    "judgment_items",
    f"WITH {JUDGE} SELECT requirement_id, company_id, match_status, matched_value, citation_status, citation_count, ready_count, ready AS review_evidence_ready, recommended_action FROM item",
)
def _(t):
    items, _cited = t.judged
    return items.select(
        "requirement_id", "company_id", "match_status", "matched_value", "citation_status", "citation_count", "ready_count",
        "review_evidence_ready", "recommended_action",
    )


SUGGEST = f"""sg0 AS (SELECT CASE WHEN requirement_type = 'money' THEN 'x' || requirement_id ELSE requirement_id END AS requirement_id,
  CASE length(required_value) WHEN 5 THEN 'missing' WHEN 6 THEN 'matched' WHEN 7 THEN 'needs_review' WHEN 8 THEN 'uncertain' ELSE 'certain' END AS suggested_status,
  notice_id % 140 / 100.0::DOUBLE - 0.2::DOUBLE AS c, 'see 근거 ' || required_value AS suggested_reason FROM tr WHERE requirement_type <> 'region'),
sg AS (SELECT requirement_id, suggested_status, least(greatest(c, 0.0::DOUBLE), 1.0::DOUBLE) AS confidence, suggested_reason FROM sg0
  WHERE suggested_status <> 'certain' AND requirement_id IN (SELECT requirement_id FROM tr))"""
FINAL = f"""{JUDGE}, {SUGGEST},
fj AS (SELECT item.*, match_status AS d, suggested_status AS a, coalesce(sg.confidence, 0.0::DOUBLE) AS c, suggested_reason,
  match_status = 'matched' OR (matched_value <> '' AND ready) AS loc FROM item LEFT JOIN sg ON sg.requirement_id = item.requirement_id),
fr AS (SELECT *, CASE WHEN a IS NULL THEN [d, 'fallback'] WHEN c >= 0.7 AND a = 'matched' AND NOT loc THEN ['needs_review', 'gemini_assisted'] WHEN c >= 0.7 THEN [a, 'gemini_weighted']
  WHEN c < 0.5 THEN [d, 'deterministic'] WHEN d = 'matched' AND a <> 'matched' THEN ['needs_review', 'gemini_assisted'] WHEN d = 'matched' THEN ['matched', 'gemini_assisted']
  WHEN a = 'matched' THEN [d, 'deterministic'] WHEN a IN ('needs_review', 'uncertain') THEN ['needs_review', 'gemini_assisted']
  WHEN d IN ('needs_review', 'uncertain') AND a = 'missing' THEN ['missing', 'gemini_assisted'] ELSE [d, 'deterministic'] END AS r FROM fj),
fs AS (SELECT * EXCLUDE (match_status, recommended_action), r[1] AS match_status, r[2] AS status_source, c AS suggestion_confidence,
  CASE WHEN r[2] LIKE 'gemini%' THEN coalesce(suggested_reason, '') ELSE '' END AS gap_reason FROM fr),
fin AS (SELECT *, {_ACTION} AS recommended_action FROM fs)"""


def _final(t):
    return ju.finished(t.judged[0], ju.sanitize_suggestions(_suggestions(t), t.trade_requirements))


_JS = ", ".join(f"count(*) FILTER (match_status = '{s}') AS {s}_count" for s in fv.JUDGMENT_STATUSES)
SUMMARY = f"""{FINAL},
summ AS (SELECT notice_id, company_id, count(*) AS requirement_count, {_JS}, count(*) FILTER (ready) / count(*) AS citation_coverage FROM fin GROUP BY 1, 2)"""


@query("judgment_summary", f"WITH {SUMMARY} SELECT * FROM summ")
def _(t):
    return ju.judgment_summary(_final(t))


@query(
    "risk_notes",
    f"""WITH {SUMMARY} SELECT notice_id, company_id, 1 AS position, {q.s(fv.RISK_REVIEW)} AS note FROM summ WHERE needs_review_count + uncertain_count > 0
    UNION ALL SELECT notice_id, company_id, 2, {q.s(fv.RISK_COVERAGE)} FROM summ WHERE requirement_count > 0 AND citation_coverage < 1""",
)
def _(t):
    return ju.risk_notes(ju.judgment_summary(_final(t)))


def _suggestions(t):
    """Outside suggestions: one per requirement with a company type, its state and confidence from the value."""
    size = F.length("required_value")
    status = (
        F.when(size == 5, "missing").when(size == 6, "matched").when(size == 7, " needs_review ").when(size == 8, "uncertain").otherwise("certain")
    )
    rows = t.trade_requirements.filter(F.col("requirement_type") != "region")
    part = F.pmod(F.col("notice_id"), F.lit(140)) / 100 - 0.2
    return rows.select(
        F.when(F.col("requirement_type") == "money", F.concat(F.lit("x"), "requirement_id")).otherwise(F.col("requirement_id")).alias("requirement_id"),
        status.alias("suggested_status"), part.cast("string").alias("confidence"), F.concat(F.lit(" see citation "), "required_value").alias("suggested_reason"),
    )


@query("suggestion_sanitize", f"WITH {REQS}, {SUGGEST} SELECT * FROM sg")
def _(t):
    return ju.sanitize_suggestions(_suggestions(t), t.trade_requirements)


@query(
    "suggestion_merge",
    f"WITH {FINAL} SELECT requirement_id, company_id, match_status AS final_status, status_source, suggestion_confidence, gap_reason, recommended_action FROM fin",
)
def _(t):
    return _final(t).select(
        "requirement_id", "company_id", F.col("match_status").alias("final_status"), "status_source", "suggestion_confidence", "gap_reason", "recommended_action"
    )


@query(
    "preparation_guide",
    f"""WITH {FINAL}, un AS (SELECT * FROM fin WHERE match_status IN ('missing', 'needs_review', 'uncertain')),
    g AS (SELECT notice_id, company_id, item_pos, unnest(range(len(evidence))) AS sub_pos, 'document' AS kind, unnest(evidence) AS value, NULL AS note FROM un
      UNION ALL SELECT notice_id, company_id, item_pos, 0, 'action', replace(recommended_action, 'citation', '근거'), NULL FROM un
      UNION ALL SELECT notice_id, company_id, item_pos, 0, 'note', label || ' / ' || required_value || CASE citation_status WHEN 'missing' THEN ': 기준문서 근거 후보가 없습니다.' ELSE ': 기준문서 근거 후보 점수가 낮아 원문 검토가 필요합니다.' END, NULL FROM fin WHERE citation_status <> 'candidate_found'),
    u AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY notice_id, company_id, kind, CASE WHEN kind = 'document' THEN {q.compact('value')} ELSE value END ORDER BY item_pos, sub_pos, value) = 1)
    SELECT notice_id, company_id, kind, value, item_pos, sub_pos::BIGINT AS sub_pos FROM u WHERE value <> ''""",
)
def _(t):
    return ju.preparation_guide(_final(t)).withColumn("sub_pos", F.col("sub_pos").cast("long"))


_GROUPS = [(name, kind, [*words, *extra]) for (name, kind, words), extra in zip(fv.PRIORITY_GROUPS, [["Brand"], ["ECONOMY"], ["ring"], ["widget", "1"], []])]


def _group_case() -> str:
    cases = []
    for name, kind, words in _GROUPS:
        conds = ([f"requirement_type = '{kind}'"] if kind else []) + ([q.contains_any("txt", words)] if words else [])
        cases.append(f"WHEN {' OR '.join(conds)} THEN {q.s(name)}")
    return f"CASE {' '.join(cases)} ELSE {q.s(fv.PRIORITY_GROUP_OTHER)} END"


@query(
    "priority_groups",
    f"""WITH {FINAL}, a AS (SELECT *, label || ' ' || required_value || ' ' || source_text AS txt FROM fin WHERE match_status IN ('missing', 'needs_review', 'uncertain')),
    b AS (SELECT *, {_group_case()} AS priority_group FROM a),
    c AS (SELECT notice_id, company_id, priority_group, count(*) AS item_count, min(item_pos) AS first_pos, arg_min(requirement_id, item_pos) AS first_requirement,
      replace(arg_min(recommended_action, item_pos), 'citation', '근거') AS next_step, arg_min(gap_reason, item_pos) AS reason, array_to_string(arg_min(evidence, item_pos), ',') AS documents, string_agg(requirement_id, ',' ORDER BY item_pos) AS related_ids FROM b GROUP BY ALL)
    SELECT *, row_number() OVER w AS position FROM c WINDOW w AS (PARTITION BY notice_id, company_id ORDER BY first_pos)""",
)
def _(t):
    rows = ju.priority_groups(_final(t), groups=_GROUPS)
    return rows.withColumns({"position": F.col("position").cast("long"), "documents": F.array_join("documents", ","), "related_ids": F.array_join("related_ids", ",")})


@query(
    "headline_status",
    f"""WITH {COMPARE}, s AS (SELECT notice_id, company_id, {_SUMMARY} FROM cmp GROUP BY 1, 2)
    SELECT notice_id, company_id, CASE WHEN possibly_missing_count > 0 OR not_found_count > 0 THEN '준비 필요' WHEN needs_review_count > 0 THEN '사람 확인 필요' WHEN prepared_count > 0 THEN '대체로 준비됨' ELSE '검토 필요' END AS headline FROM s""",
)
def _(t):
    s = ma.summarize(t.compared)
    text = ju.headline(*[F.col(f"{c}_count") for c in ("prepared", "possibly_missing", "needs_review", "not_found")])
    return s.select("notice_id", "company_id", text.alias("headline"))


@query(
    "evidence_links",
    f"""WITH {JUDGE}, {EVIDENCE}, runs AS (SELECT DISTINCT notice_id, company_id FROM item),
    top12 AS (SELECT company_id, evidence_id, row_number() OVER (PARTITION BY company_id ORDER BY updated_at DESC, evidence_id DESC) AS sub_pos FROM ev WHERE review_status = 'approved'),
    l AS (SELECT notice_id, company_id, 'corporation_evidence' AS link_type, evidence_id::VARCHAR AS ref_id, -1::BIGINT AS ip, sub_pos AS sp FROM top12 JOIN runs USING (company_id)
      UNION ALL SELECT notice_id, company_id, 'notice_requirement', requirement_id, item_pos, 0 FROM item
      UNION ALL SELECT notice_id, company_id, 'basis_chunk', doc_id || ':' || chunk_id, item_pos, position FROM item JOIN cit USING (requirement_key)),
    u AS (SELECT notice_id, company_id, link_type, ref_id, min((ip, sp)) AS first_at FROM l GROUP BY ALL)
    SELECT notice_id, company_id, link_type, ref_id, row_number() OVER (PARTITION BY notice_id, company_id ORDER BY first_at, link_type, ref_id) AS position FROM u""",
)
def _(t):
    items, cited = t.judged
    runs = t.trade_requirements.select("notice_id").distinct().join(t.trade_pairs, "notice_id")
    links = ju.evidence_links(items, pr.approved_evidence(t.evidence_documents), cited, runs)
    return links.withColumn("position", F.col("position").cast("long"))


@query(
    "invalidate_dependents",
    f"""WITH {COMPARE}, changed AS (SELECT c_custkey FROM customer WHERE c_acctbal > 8000 OR c_mktsegment = 'BUILDING')
    SELECT DISTINCT notice_id, company_id FROM cmp WHERE company_id NOT IN (SELECT c_custkey FROM changed)""",
)
def _(t):
    before = t.companies.select("company_id", "name", "region", "representative_name", F.nullif("management_group_name", F.lit("x")).alias("management_group_name"))
    rich, seg = t.customer.select(F.col("c_custkey").alias("company_id"), "c_acctbal", "c_mktsegment"), F.col("c_mktsegment")
    after = before.join(rich, "company_id").select(
        "company_id", F.when(F.col("c_acctbal") > 8000, F.upper(F.concat("name", F.lit("!")))).otherwise(F.col("name")).alias("name"), "region",
        F.lit("other").alias("representative_name"),
        F.when(seg == "BUILDING", F.lit(None)).otherwise(F.col("management_group_name")).alias("management_group_name"),
    )
    pairs = t.compared.select("notice_id", "company_id").distinct()
    return ma.invalidate_dependents(pairs, ma.changed_companies(before, after))


@query(
    "action_items",
    f"""WITH {COMPARE}, it AS (SELECT *, CASE status WHEN 'prepared' THEN 'matched' WHEN 'needs_review' THEN 'needs_review' ELSE 'missing' END AS match_status FROM cmp)
    SELECT notice_id, company_id, requirement_type AS action_id, requirement_id FROM it WHERE requirement_type = 'license'
    UNION ALL SELECT notice_id, company_id, 'words-review', requirement_id FROM it WHERE match_status IN ('needs_review', 'uncertain')
    UNION ALL SELECT notice_id, company_id, 'words-missing', requirement_id FROM it WHERE match_status = 'missing'""",
)
def _(t):
    items = t.compared.withColumn("match_status", ju.judged(F.col("status")))
    # the action names the licence requirements of its run: a few per run, given here as data
    named = items.filter(F.col("requirement_type") == "license").select(
        "notice_id", "company_id", F.lit("license").alias("action_id"), F.lit("확인").alias("action_text"), F.array("requirement_id").alias("related_ids")
    )
    none = F.array().cast("array<string>")
    runs = t.trade_pairs.join(t.trade_requirements.select("notice_id").distinct(), "notice_id")
    words = runs.select("notice_id", "company_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("id"), F.lit(v).alias("text")) for k, v in (("words-review", "금액 검토"), ("words-missing", "증빙 서류를 갖춤"))
    ])).alias("a")).select("notice_id", "company_id", F.col("a.id").alias("action_id"), F.col("a.text").alias("action_text"), none.alias("related_ids"))
    return ju.action_items(named.unionByName(words), items)
