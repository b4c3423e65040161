"""Queries over collection runs, contracts (I) and operations (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.operators import collection as co
from bidlens.operators import contracts as ct
from bidlens.operators import ops
from bidlens.operators import profiles as pr
from bidlens.plans import sql as q
from bidlens.plans.matching_queries import COMPANIES, EVIDENCE, _CHECKS
from bidlens.plans.registry import query
from bidlens.plans.requirement_queries import NOTICES
from bidlens.plans.source_queries import ATTACH, _items, discovered
from bidlens.sources import notices

# ---- sources of a merged search: the five priorities fall into four sources, one order in two -------------------
SEARCH = """si AS (SELECT (o_orderkey // 2)::VARCHAR AS no, CASE WHEN o_orderstatus = 'F' THEN '001' ELSE '000' END AS ord, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 3 ELSE 2 END AS source_rank,
  o_orderkey AS arrival, strftime(o_orderdate, '%Y%m%d%H%M') AS date_text FROM orders),
su AS (SELECT * FROM si QUALIFY row_number() OVER (PARTITION BY no, ord ORDER BY source_rank, arrival) = 1)"""


def _search_items(t):
    p = F.col("o_orderpriority")
    return t.orders.select(
        F.floor(F.col("o_orderkey") / 2).cast("string").alias("no"), F.when(F.col("o_orderstatus") == "F", "001").otherwise("").alias("ord"),
        F.when(p == "1-URGENT", 0).when(p == "2-HIGH", 1).when(p == "5-LOW", 3).otherwise(2).alias("source_rank"),
        F.col("o_orderkey").alias("arrival"), F.date_format("o_orderdate", "yyyyMMddHHmm").alias("date_text"),
    )


@query(
    "merged_search_page",
    f"""WITH {SEARCH}, pg AS (SELECT * FROM su ORDER BY date_text DESC, source_rank, arrival, no, ord LIMIT 30 OFFSET 60)
    SELECT *, (SELECT count(*) FROM si WHERE source_rank <> 3) AS total_count, (SELECT count(*) > 90 FROM su) AS has_next_page FROM pg""",
)
def _(t):
    items = _search_items(t)
    totals = items.groupBy("source_rank").agg(F.count("*").alias("total_count")).withColumn("error", F.when(F.col("source_rank") == 3, "timeout").otherwise(""))
    told = co.search_totals(items, totals, 3, 30)
    return co.search_page(items, 3, 30).withColumns(
        {"total_count": told.select("total_count").scalar(), "has_next_page": told.select("has_next_page").scalar()}
    )


@query(
    "single_source_page",
    f"""WITH {SEARCH}, one AS (SELECT * FROM si WHERE source_rank = 2), u AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY no, ord ORDER BY arrival) = 1)
    SELECT no, ord, arrival, date_text, (SELECT count(*) FROM one) AS total_count FROM u ORDER BY date_text DESC, arrival, no, ord LIMIT 20""",
)
def _(t):
    items = _search_items(t).filter(F.col("source_rank") == 2)
    total = items.agg(F.count("*").alias("n"))
    return co.search_page(items, 1, 20).select("no", "ord", "arrival", "date_text", total.select("n").scalar().alias("total_count"))


RUNS = """ru AS (SELECT c_custkey AS run_id, c_mktsegment <> 'BUILDING' AS configured, CASE WHEN c_acctbal < -800 THEN 'all' WHEN c_acctbal < 0 THEN 'service' ELSE '' END AS error, c_name AS keyword, c_mktsegment AS mode FROM customer)"""


def _runs(t):
    bal = F.col("c_acctbal")
    return t.customer.select(
        F.col("c_custkey").alias("run_id"), (F.col("c_mktsegment") != "BUILDING").alias("configured"),
        F.when(bal < -800, "all").when(bal < 0, "service").otherwise("").alias("error"), F.col("c_name").alias("keyword"), F.col("c_mktsegment").alias("mode"),
    )


SUMMARY = f"""{RUNS},
oc AS (SELECT o_custkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'saved' WHEN o_orderstatus = 'O' THEN 'skipped' WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'skipped' END AS outcome FROM orders),
oa AS (SELECT run_id, count(*) AS searched, count(*) FILTER (outcome = 'saved') AS saved, count(*) FILTER (outcome <> 'saved') AS skipped, count(*) FILTER (outcome = 'failed') AS save_failures FROM oc GROUP BY 1),
rs AS (SELECT ru.*, coalesce(searched, 0) AS searched, coalesce(saved, 0) AS saved, coalesce(skipped, 0) AS skipped, coalesce(save_failures, 0) AS save_failures FROM ru LEFT JOIN oa USING (run_id)),
rr AS (SELECT *, CASE WHEN NOT configured THEN 'not_configured' WHEN error = 'all' THEN 'failed' WHEN saved > 0 AND save_failures > 0 THEN 'partial_failed' WHEN error <> '' THEN 'partial_failed' ELSE 'completed' END AS status FROM rs)"""


def _run_summary(t):
    s = F.col("o_orderstatus")
    outcome = F.when(s == "F", "saved").when(s == "O", "skipped").when(F.col("o_orderpriority") == "1-URGENT", "failed").otherwise("skipped")
    return co.run_summary(t.orders.select(F.col("o_custkey").alias("run_id"), outcome.alias("outcome")), _runs(t))


@query("collection_run_summary", f"WITH {SUMMARY} SELECT run_id, searched, saved, skipped, save_failures, status, status <> 'completed' AS retryable FROM rr")
def _(t):
    return _run_summary(t).select("run_id", "searched", "saved", "skipped", "save_failures", "status", "retryable")


@query("collection_run_list", f"WITH {SUMMARY} SELECT run_id, status, keyword FROM rr WHERE status = 'partial_failed' AND (contains(lower(keyword), '1') OR contains(lower(mode), '1') OR contains(lower(error), '1') OR contains(lower(status), '1'))")
def _(t):
    return co.run_list(_run_summary(t), ["keyword", "mode", "error", "status"], "partial_failed", "1").select("run_id", "status", "keyword")


@query("saved_notice_search", f"WITH {NOTICES} SELECT notice_id, bid_ntce_nm FROM nt WHERE contains(lower(concat_ws(' ', bid_ntce_nm, ntce_instt_nm, dminstt_nm, bid_ntce_no)), 'low src1')")
def _(t):
    return co.saved_search(t.notices, " LOW src1").select("notice_id", "bid_ntce_nm")


@query(
    "notice_multi_sort",
    """SELECT o_orderkey AS notice_id, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y%m%d%H%M')::BIGINT END AS posted,
      CASE WHEN o_orderpriority <> '5-LOW' THEN round(o_totalprice * 100)::BIGINT END AS cents FROM orders""",
)
def _(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("notice_id"), F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).otherwise("").alias("bid_ntce_dt"),
        F.lit("").alias("bid_clse_dt"), F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.format_number("o_totalprice", 2), F.lit(" 원"))).otherwise("").alias("presmpt_prce"),
        F.lit("").alias("bdgt_amt"), F.lit(" ").alias("bssamt"),
    )
    # every notice in order; the keys that order it are shown, a number for each row would need one task
    values = co.sort_values()
    ordered = co.multi_sort(rows, [("posted", "desc"), ("amount", "asc")])
    return ordered.select("notice_id", values["posted"].alias("posted"), F.round(values["amount"] * 100).cast("long").alias("cents"))


@query(
    "analysis_cache_lookup",
    """WITH a AS (SELECT conv_id * 1000 + turn AS analysis_id, conv_id AS document_id, sha256(text) AS input_hash, role AS prompt_version FROM conversations),
    r AS (SELECT conv_id AS document_id, turn, sha256(CASE WHEN turn % 2 = 0 THEN text ELSE text || '!' END) AS input_hash, role AS prompt_version FROM conversations)
    SELECT r.document_id, r.turn, r.input_hash, max(a.analysis_id) AS analysis_id, CASE WHEN max(a.analysis_id) IS NULL THEN 'miss' ELSE 'hit' END AS cache FROM r LEFT JOIN a USING (document_id, input_hash, prompt_version) GROUP BY r.document_id, r.turn, r.input_hash, r.prompt_version""",
)
def _(t):
    c = t.conversations
    analyses = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("analysis_id"), F.col("conv_id").alias("document_id"), F.sha2("text", 256).alias("input_hash"), F.col("role").alias("prompt_version"))
    changed = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!")))
    requests = c.select(F.col("conv_id").alias("document_id"), "turn", F.sha2(changed, 256).alias("input_hash"), F.col("role").alias("prompt_version"))
    out = co.cache_lookup(requests, analyses, ["document_id", "input_hash", "prompt_version"])
    return out.select("document_id", "turn", "input_hash", "analysis_id", "cache")


CONTRACTS = f"""{COMPANIES},
cd AS (SELECT o_orderkey AS contract_id, o_orderkey + 2 AS notice_id, o_custkey AS company_id, 'draft ' || o_orderpriority AS title, 'c' || o_orderkey || '.docx' AS file_name, CASE o_orderstatus WHEN 'F' THEN 'final' ELSE 'draft' END AS status,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderkey + o_custkey % 2 END AS judgment_id, o_totalprice FROM orders)"""


def _contracts(t):
    s = F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_orderkey").alias("contract_id"), (F.col("o_orderkey") + 2).alias("notice_id"), F.col("o_custkey").alias("company_id"),
        F.concat(F.lit("draft "), "o_orderpriority").alias("title"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string"), F.lit(".docx")).alias("file_name"),
        F.when(s == "F", "final").otherwise("draft").alias("status"), F.when(s != "O", F.col("o_orderkey") + F.col("o_custkey") % 2).alias("judgment_id"),
    )


def _order_notices(t):
    p, price = F.col("o_orderpriority"), F.floor("o_totalprice").cast("string")
    return t.orders.select(
        F.col("o_orderkey").alias("notice_id"), F.col("o_orderkey").cast("string").alias("bid_ntce_no"), F.when(p == "1-URGENT", "001").otherwise("000").alias("bid_ntce_ord"),
        F.when(p == "5-LOW", " ").when(p == "2-HIGH", "시설 유지관리").otherwise(F.concat(F.lit("notice "), p)).alias("bid_ntce_nm"), F.when(p == "3-MEDIUM", "").otherwise("agency").alias("ntce_instt_nm"),
        F.concat(F.lit("buyer "), "o_orderstatus").alias("dminstt_nm"), F.when(p == "1-URGENT", price).otherwise("").alias("bssamt"), F.when(p == "2-HIGH", price).otherwise("").alias("presmpt_prce"),
        F.lit("7").alias("bdgt_amt"), F.lit("").alias("license_text"), F.when(F.col("o_orderstatus") == "P", "용역").otherwise("").alias("analysis_summary"),
    )


@query(
    "contract_list",
    f"""WITH {CONTRACTS} SELECT contract_id, title, CASE o.o_orderpriority WHEN '5-LOW' THEN ' ' WHEN '2-HIGH' THEN '시설 유지관리' ELSE 'notice ' || o.o_orderpriority END AS bid_ntce_nm, co.name AS company_name FROM cd LEFT JOIN orders o ON o.o_orderkey = cd.notice_id LEFT JOIN co USING (company_id)
    WHERE cd.status = 'final' AND (contains(lower(title), '9') OR contains(file_name, '9') OR contains(CASE o.o_orderpriority WHEN '2-HIGH' THEN '' ELSE o.o_orderpriority END, '9') OR contains(co.name, '9'))""",
)
def _(t):
    out = ct.contract_list(_contracts(t), _order_notices(t), t.companies, "9", status="final")
    return out.select("contract_id", "title", "bid_ntce_nm", "company_name")


_AMT = "floor(n.o_totalprice)::BIGINT::VARCHAR"
FIELDS = f"""{CONTRACTS},
cf AS (SELECT contract_id, n.o_orderkey::VARCHAR || CASE WHEN n.o_orderpriority = '1-URGENT' THEN '-001' ELSE '' END AS notice_number, CASE WHEN cd.status = 'final' THEN 'given buyer' WHEN n.o_orderpriority = '3-MEDIUM' THEN 'buyer ' || n.o_orderstatus ELSE 'agency' END AS buyer_name,
  co.name AS corporation_name, {q.clean('co.business_address')} AS corporation_address, CASE WHEN bal > 2000 THEN co.name ELSE '' END AS corporation_representative_name, '' AS corporate_registration_number,
  CASE n.o_orderpriority WHEN '5-LOW' THEN '' WHEN '2-HIGH' THEN '시설 유지관리' ELSE 'notice ' || n.o_orderpriority END AS service_name, CASE WHEN n.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN {_AMT} ELSE '7' END AS contract_amount,
  CASE WHEN cd.status = 'final' THEN '02-1' ELSE '' END AS corporation_phone, n.o_orderstatus AS ns FROM cd JOIN orders n ON n.o_orderkey = cd.notice_id JOIN co ON co.company_id = cd.company_id)"""


def _fields(t):
    rows = _contracts(t).join(_order_notices(t), "notice_id").join(t.companies.withColumn("corporate_number", F.lit(" ")), "company_id")
    final = F.col("status") == "final"
    custom = F.create_map(F.lit("buyer_name"), F.when(final, "given buyer").otherwise(" "), F.lit("corporation_phone"), F.when(final, " 02-1 ").otherwise(""))
    return ct.generated_fields(rows.withColumn("custom", custom))


_FIELD_NAMES = ["notice_number", "buyer_name", "corporation_name", "corporation_address", "corporation_representative_name", "corporate_registration_number", "service_name", "contract_amount", "corporation_phone"]


@query("contract_fields", f"WITH {FIELDS} SELECT contract_id, {', '.join(_FIELD_NAMES)}, '' AS contract_number FROM cf")
def _(t):
    return _fields(t).select("contract_id", *_FIELD_NAMES, "contract_number")


@query(
    "contract_validate",
    f"""WITH {FIELDS} SELECT contract_id, service_name <> '' AS valid, CASE WHEN service_name = '' THEN '공고명이 없어 계약서 초안을 생성할 수 없습니다.' ELSE '' END AS errors,
      array_to_string(list_filter([CASE WHEN NOT (contains(service_name, '유지관리') OR ns = 'P') THEN '선택한 공고가 용역 공고인지 명확하지 않습니다. 표준계약서 초안 적용 전 원문 검토가 필요합니다.' END,
        CASE WHEN corporation_representative_name = '' THEN '계약상대자 대표자 값이 비어 있습니다.' END, CASE WHEN corporation_address = '' THEN '계약상대자 주소 값이 비어 있습니다.' END, '계약상대자 법인등록번호 값이 비어 있습니다.',
        CASE WHEN corporation_phone = '' THEN '계약상대자 전화번호 값이 비어 있습니다.' END], lambda z: z IS NOT NULL), '|') AS warnings FROM cf""",
)
def _(t):
    rows = ct.validate(_fields(t))
    return rows.select("contract_id", "valid", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))


@query(
    "contract_judgments",
    f"""WITH {CONTRACTS}, jr AS (SELECT o_orderkey AS run_id, o_orderkey + 2 AS notice_id, o_custkey AS company_id FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT contract_id, judgment_id, CASE WHEN judgment_id IS NULL THEN 'none' WHEN jr.run_id IS NULL THEN 'judgment_not_found' WHEN jr.notice_id = cd.notice_id AND jr.company_id = cd.company_id THEN 'ok' ELSE 'judgment_mismatch' END AS judgment_state
    FROM cd LEFT JOIN jr ON jr.run_id = judgment_id""",
)
def _(t):
    runs = t.orders.filter(F.col("o_orderpriority") != "5-LOW").select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") + 2).alias("notice_id"), F.col("o_custkey").alias("company_id")
    )
    return ct.contract_judgments(_contracts(t), runs).select("contract_id", "judgment_id", "judgment_state")


@query(
    "document_filter",
    """SELECT doc_id, 'doc-' || doc_id || '.pdf' AS file_name, o_orderpriority AS project_name, c_name AS company_name FROM documents LEFT JOIN orders ON o_orderkey = doc_id LEFT JOIN customer ON c_custkey = o_custkey
    WHERE lang = 'en' AND (contains('doc-' || doc_id || '.pdf', '77') OR contains(coalesce(lower(o_orderpriority), ''), '77') OR contains(coalesce(lower(c_name), ''), '77') OR contains(source, '77'))""",
)
def _(t):
    docs = t.documents.select(
        "doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"), F.col("doc_id").alias("project_id"),
        F.col("source").alias("document_type"), F.col("lang").alias("analysis_status"),
    )
    projects = t.orders.select(F.col("o_orderkey").alias("project_id"), F.col("o_orderpriority").alias("project_name"), F.col("o_custkey").alias("company_id"))
    companies = t.customer.select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"))
    return co.project_documents_filter(docs, projects, companies, "77", "en").select("doc_id", "file_name", "project_name", "company_name")


@query(
    "company_filter",
    f"""WITH {COMPANIES} SELECT 'company' AS kind, company_id, name FROM co WHERE contains(lower(name), 'nation_7') OR contains(lower(region), 'nation_7') OR (bal > 5000 AND contains(lower(region), 'nation_7')) OR (bal > 3000 AND contains(lower(region), 'nation_7'))
    UNION ALL SELECT DISTINCT 'group', NULL, grp FROM co""",
)
def _(t):
    found = co.company_filter(t.companies, "Nation_7").select(F.lit("company").alias("kind"), "company_id", "name")
    groups = co.company_groups(t.companies).select(F.lit("group").alias("kind"), F.lit(None).cast("long").alias("company_id"), F.col("management_group").alias("name"))
    return found.unionByName(groups)


@query(
    "basis_document_filter",
    """SELECT 'document' AS kind, doc_id, lang AS category FROM documents WHERE lang = 'en' AND (contains(lower(text), 'license') OR contains(lower(source), 'license') OR contains(lang, 'license'))
    UNION ALL SELECT DISTINCT 'category', NULL, lang FROM documents""",
)
def _(t):
    docs = t.documents.withColumnRenamed("lang", "category")
    hit = co.keyword_filter(docs.filter(F.col("category") == "en"), "LICENSE", ["text", "source", "category"]).select(F.lit("document").alias("kind"), "doc_id", "category")
    kinds = docs.select("category").distinct().orderBy("category").select(F.lit("category").alias("kind"), F.lit(None).cast("long").alias("doc_id"), "category")
    return hit.unionByName(kinds)


@query(
    "notice_with_attachments",
    f"WITH {ATTACH} SELECT it.notice_id, coalesce((SELECT string_agg(file_name || ':' || support_status, '|' ORDER BY source_field) FROM att WHERE att.notice_id = it.notice_id), '') AS attachments FROM it",
)
def _(t):
    files = notices.attachments(_items(t)).select("notice_id", F.col("source_field").alias("attachment_id"), "file_name", "support_status")
    rows = co.notice_attachments(_items(t).select("notice_id"), files)
    shown = F.transform("attachments", lambda a: F.concat_ws(":", a["file_name"], a["support_status"]))
    return rows.select("notice_id", F.coalesce(F.array_join(shown, "|"), F.lit("")).alias("attachments"))


# ---- operations ----------------------------------------------------------------------------------------------------
EVENTS = """op AS (SELECT event_id AS run_id, event_type AS operation_type, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' AND value > 20 THEN 'partial_failed' WHEN event_type = 'click' AND value < 1 THEN 'not_configured' ELSE 'completed' END AS status,
  user_id, props, ts, value, CASE WHEN event_type = 'error' THEN user_id END AS retry_of,
  CASE WHEN value < 5 THEN 'Network down' WHEN value < 10 THEN 'ocr engine' WHEN value < 12 THEN 'Stored file not found' ELSE '' END AS error_message FROM events)"""


def _ops(t):
    kind, value = F.col("event_type"), F.col("value")
    status = (
        F.when(kind == "error", "failed").when((kind == "signup") & (value > 20), "partial_failed").when((kind == "click") & (value < 1), "not_configured").otherwise("completed")
    )
    message = F.when(value < 5, "Network down").when(value < 10, "ocr engine").when(value < 12, "Stored file not found").otherwise("")
    return t.events.select(
        F.col("event_id").alias("run_id"), kind.alias("operation_type"), status.alias("status"), "user_id", F.col("props").alias("request_json"), "ts", "value",
        F.when(kind == "error", F.col("user_id")).alias("retry_of"), message.alias("error_message"), F.lit("user").alias("target_type"), F.lit("").alias("result_json"),
    )


@query("run_record", f"WITH {EVENTS} SELECT run_id, retry_of, CASE WHEN retry_of IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY retry_of ORDER BY run_id) END AS retry_count FROM op")
def _(t):
    rows = _ops(t).select("run_id", "retry_of")
    return ops.record_runs(rows, F.floor(F.col("run_id") / 1000)).select("run_id", "retry_of", "retry_count")


@query("run_list", f"WITH {EVENTS} SELECT run_id, operation_type, status FROM op WHERE status = 'failed' AND (contains(lower(props), '69') OR contains(lower(error_message), '69') OR contains(operation_type, '69'))")
def _(t):
    return ops.run_list(_ops(t), status="failed", keyword="69").select("run_id", "operation_type", "status")


@query(
    "error_code",
    f"""WITH {EVENTS} SELECT run_id, CASE WHEN status = 'not_configured' THEN 'missing_api_key' WHEN status NOT IN ('failed', 'partial_failed') THEN '' WHEN contains(lower(error_message), 'network') THEN 'network_error'
      WHEN contains(lower(error_message), 'ocr') THEN 'ocr_failed' WHEN contains(lower(error_message), 'stored file') THEN 'storage_error' ELSE 'unknown_error' END AS code FROM op""",
)
def _(t):
    return _ops(t).select("run_id", ops.error_code(F.col("status"), F.col("error_message")).alias("code"))


_TABLES = [
    ("document_analysis", ["analysis_status", "ocr_status", "parsing_status"]), ("evidence_analysis", ["extraction_status", "ocr_status", "classification_status"]),
    ("basis_processing", ["processing_status", "parse_status", "ocr_status", "chunk_status", "index_status"]), ("notice_analysis", ["analysis_status", "download_status", "save_status"]),
    ("attachment_processing", ["analysis_status", "parse_status", "download_status"]), ("collection", ["status"]), ("judgment_run", ["status"]), ("backup_create", ["status"]),
]


def _sources(t):
    """Eight tables: the run log dealt out by user; the first status column holds the outcome, a second one a stale state."""
    rows = _ops(t).select(
        F.col("run_id").alias("id"), "user_id", F.col("operation_type").alias("label"), "status", "error_message", F.col("ts").alias("updated_at"),
        F.when(F.col("value") > 60, "unavailable").otherwise("completed").alias("second"),
    )
    out = []
    for i, (name, columns) in enumerate(_TABLES):
        states = {c: F.col("status") if k == 0 else F.col("second") if k == 1 else F.lit("completed") for k, c in enumerate(columns)}
        frame = rows.filter(F.col("user_id") % 8 == i)
        if columns != ["status"]:
            frame = frame.withColumns(states)
        out.append((name, frame, columns, "label"))
    return out


_BADS = q.slist(fv.FAILURE_STATUSES)
FAILS = f"""{EVENTS},
fl AS (SELECT CASE user_id % 8 {' '.join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(_TABLES))} END AS operation, run_id AS id, operation_type AS label,
  CASE WHEN list_contains({_BADS}, status) THEN status WHEN user_id % 8 < 5 AND value > 60 THEN 'unavailable' END AS status, CASE WHEN error_message = '' THEN 'No failure detail was recorded.' ELSE error_message END AS error_message, ts FROM op)"""


@query("recent_failures", f"WITH {FAILS} SELECT operation, id, label, status, error_message, strftime(ts, '%Y-%m-%d %H:%M:%S') AS occurred_at FROM fl WHERE status IS NOT NULL ORDER BY ts DESC, operation, id DESC LIMIT 8")
def _(t):
    rows = ops.recent_failures(_sources(t))
    return rows.select("operation", "id", "label", "status", "error_message", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"))


def _day_ago(t):
    return t.events.agg((F.max("ts") - F.expr("interval 24 hours")).alias("since")).select("since").scalar()


@query("failures_24h", f"WITH {FAILS} SELECT count(*) AS failed_jobs FROM fl WHERE status IS NOT NULL AND ts >= (SELECT max(ts) - INTERVAL 24 HOUR FROM events)")
def _(t):
    return ops.failures_since(_sources(t), _day_ago(t))


def _queues(t):
    return {
        "rules": (t.labels, F.col("quality") == 0), "judgments": (t.orders, F.col("o_orderstatus") == "P"),
        "evidence": (t.evidence_documents, F.col("review_status") == "pending"), "profile_updates": (t.profile_candidates, F.col("status") == "none"),
    }


@query(
    "review_queues",
    """SELECT * FROM (SELECT 'rules' AS queue, count(*) FILTER (quality = 0) AS pending_count FROM labels UNION ALL SELECT 'judgments', count(*) FILTER (o_orderstatus = 'P') FROM orders
    UNION ALL SELECT 'evidence', count(*) FILTER (o_orderstatus = 'O') FROM orders UNION ALL SELECT 'profile_updates', 0) WHERE pending_count > 0""",
)
def _(t):
    return ops.review_queues(_queues(t))


COUNTS = f"""{EVENTS},
ct AS (SELECT (SELECT count(*) FROM op WHERE ts >= (SELECT max(ts) - INTERVAL 24 HOUR FROM events) AND status = 'failed') AS failed_jobs_24h,
  (SELECT count(*) FILTER (quality = 0) FROM labels) AS pending_reviews, (SELECT count(*) FROM labels WHERE toxic = 1) AS basis_processing,
  (SELECT count(*) FROM op WHERE operation_type = 'purchase' AND ts >= (SELECT max(ts) - INTERVAL 24 HOUR FROM events)) AS judgment_runs_24h,
  (SELECT count(*) FROM op WHERE operation_type = 'view' AND ts >= (SELECT max(ts) - INTERVAL 24 HOUR FROM events)) AS collection_runs_24h,
  (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS notices_processing, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS evidence_pending)"""


def _counters(t):
    rows, since = _ops(t), _day_ago(t)
    kind, fresh = F.col("operation_type"), F.col("ts") >= since
    return ops.counters(
        {
            "failed_jobs_24h": (rows, fresh & (F.col("status") == "failed")), "pending_reviews": (t.labels, F.col("quality") == 0),
            "basis_processing": (t.labels, F.col("toxic") == 1), "judgment_runs_24h": (rows, fresh & (kind == "purchase")),
            "collection_runs_24h": (rows, fresh & (kind == "view")), "notices_processing": (t.orders, F.col("o_orderpriority") == "1-URGENT"),
            "evidence_pending": (t.evidence_documents, F.col("review_status") == "pending"),
        }
    )


@query("operations_counts", f"WITH {COUNTS} SELECT * FROM ct")
def _(t):
    return _counters(t)


@query(
    "overall_status",
    f"""WITH {EVENTS}, d AS (SELECT user_id, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'not_configured') > 0 AS warn, count(*) FILTER (status = 'partial_failed') AS pending FROM op GROUP BY 1)
    SELECT user_id, CASE WHEN failed > 0 THEN 'action_required' WHEN warn OR pending > 0 THEN 'warning' ELSE 'ok' END AS overall_status FROM d""",
)
def _(t):
    s = F.col("status")
    rows = _ops(t).groupBy("user_id").agg(
        F.count_if(s == "failed").alias("failed"), (F.count_if(s == "not_configured") > 0).alias("warn"), F.count_if(s == "partial_failed").alias("pending")
    )
    return rows.select("user_id", ops.overall_status(F.col("failed"), F.col("warn"), F.col("pending")).alias("overall_status"))


@query(
    "latest_per_key",
    f"WITH {EVENTS} SELECT user_id, arg_max(run_id, (ts, run_id)) AS run_id, arg_max(status, (ts, run_id)) AS status FROM op GROUP BY 1",
)
def _(t):
    return ops.latest_per_key(_ops(t).select("user_id", "run_id", "status", "ts"), "user_id", "ts", "run_id").select("user_id", "run_id", "status")


@query(
    "dashboard_counts",
    f"""WITH {COMPANIES}, {EVIDENCE}, e AS (SELECT company_id, count(*) FILTER (review_status = 'approved') AS approved_evidence_count FROM ev GROUP BY 1),
    c AS (SELECT o_custkey AS company_id, count(*) FILTER (l_returnflag = 'A') AS approved_candidate_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    k AS (SELECT {' + '.join(f"CASE WHEN {cond} THEN 1 ELSE 0 END" for cond in _CHECKS.values())} AS n FROM co LEFT JOIN e USING (company_id) LEFT JOIN c USING (company_id))
    SELECT (SELECT count(*) FROM customer) AS companies, (SELECT count(*) FROM orders) AS projects, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending_documents,
      (SELECT count(*) FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic = 1) AS failed_documents, (SELECT count(*) FILTER (n < 5) FROM k) AS low_readiness_companies""",
)
def _(t):
    ready = pr.readiness(t.companies, t.evidence_documents, t.profile_candidates)
    everything = F.lit(True)
    return ops.counters(
        {
            "companies": (t.customer, everything), "projects": (t.orders, everything), "documents": (t.documents, everything),
            "pending_documents": (t.orders, F.col("o_orderstatus") == "P"), "failed_documents": (t.basis_documents, F.col("processing_status") == "failed"),
            "low_readiness_companies": (ready, F.col("score") < 50),
        }
    )


@query(
    "cascade_delete",
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    SELECT 'document' AS kind, o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)
    UNION ALL SELECT 'analysis', l_orderkey * 100 + l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))""",
)
def _(t):
    gone = t.customer.filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("project_id"))
    docs = t.orders.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("document_id"))
    analyses = t.lineitem.select(F.col("l_orderkey").alias("document_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"))
    kept, left = ops.cascade_delete(gone, docs, analyses)
    return kept.select(F.lit("document").alias("kind"), F.col("document_id").alias("id")).unionByName(left.select(F.lit("analysis").alias("kind"), "id"))
