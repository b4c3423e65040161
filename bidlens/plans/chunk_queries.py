"""Queries over passages, the index and search (B, C1-C5, C10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx
from bidlens.operators import block_index as bi
from bidlens.operators import chunks as ch
from bidlens.operators import index as ix
from bidlens.operators import search as se
from bidlens.plans import sql as q
from bidlens.plans.registry import query

DOCS = f"""docs AS (SELECT doc_id, category, document_version, processing_status, index_status, quality,
  {q.basis_normalize('text')} AS text FROM ({q.basis_documents()}))"""
CHUNKS = f"""{DOCS},
chunk_pos AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) > {fv.CHUNK_CHARS}
  THEN (length(text) - 1) // {fv.CHUNK_STEP} + 1 ELSE 1 END)) AS idx FROM docs WHERE text <> ''),
chunk_raw AS (SELECT doc_id, idx, idx * {fv.CHUNK_STEP} AS s, substring(text, (idx * {fv.CHUNK_STEP} + 1)::BIGINT, {fv.CHUNK_CHARS}) AS raw FROM chunk_pos),
chunks AS (SELECT doc_id, idx::BIGINT AS chunk_index, {q.clean('raw')} AS chunk_text,
  (s + length(regexp_extract(raw, '^{q.WS}*')))::BIGINT AS char_start,
  doc_id * 100000 + idx AS chunk_id, sha256({q.clean('raw')}) AS chunk_hash FROM chunk_raw),
vchunks AS (SELECT *, 'basis-' || doc_id || '-' || chunk_id || '-' || chunk_hash[1:12] AS vector_id FROM chunks)"""
SEARCHABLE = f"""{CHUNKS},
good AS (SELECT c.*, d.category, d.document_version FROM vchunks c JOIN docs d USING (doc_id)
  WHERE d.processing_status = 'completed' AND d.index_status = 'completed')"""


def topk_sql(k: int, where: str = "true") -> str:
    return f"""{SEARCHABLE},
qt AS (SELECT item_id AS query_id, list_distinct({q.tokens('text')}) AS t FROM benchmark),
qx AS (SELECT query_id, len(t) AS n, unnest(t) AS token FROM qt),
px AS (SELECT doc_id, chunk_id, chunk_index, unnest(list_distinct({q.tokens('chunk_text')})) AS token FROM good WHERE {where}),
hit AS (SELECT query_id, n, doc_id, chunk_id, chunk_index, count(*) AS shared FROM qx JOIN px USING (token) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc_id DESC, chunk_index) AS rank FROM hit),
top AS (SELECT query_id, rank::BIGINT AS rank, doc_id, chunk_id, chunk_index, shared, shared / n AS score FROM rk WHERE rank <= {k})"""


def _heading(x: str) -> str:
    hit = rf"list_filter({q.lines(x)}, lambda h: length(h) BETWEEN 1 AND 80 AND regexp_matches(h, '^(제{q.WS}*[0-9]+{q.WS}*[장조절관항]|[0-9]+[.)]|[가-힣]\.)'))"
    return f"coalesce({hit}[1], left({q.lines(x)}[1], 80))"


# ---- paragraph packing, said as a fold over paragraphs in SQL --------------------------------------------
_PACK = f"""WITH RECURSIVE {DOCS},
par AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM docs WHERE text <> ''),
lens AS (SELECT doc_id, text, list_transform(string_split(text, chr(10) || chr(10)), lambda p: length(p)) AS ls FROM par),
fold AS (
  SELECT doc_id, text, ls, 0::BIGINT AS i, 0::BIGINT AS cur, -1::BIGINT AS stop, 0::BIGINT AS pos, []::BIGINT[] AS ss, []::BIGINT[] AS es FROM lens
  UNION ALL
  SELECT doc_id, text, ls, i + 1,
    CASE WHEN stop >= 0 AND pos + n - cur > 1600 AND stop - cur > 180 THEN stop - 180 + length(regexp_extract(substring(text, stop - 179, 180), '^{q.WS}*'))
         WHEN stop >= 0 AND pos + n - cur <= 1600 THEN cur ELSE pos END,
    CASE WHEN n > 1600 THEN -1 ELSE pos + n END, pos + n + 2,
    list_concat(list_concat(ss, CASE WHEN stop >= 0 AND pos + n - cur > 1600 THEN [cur] ELSE [] END),
      CASE WHEN n > 1600 THEN list_transform(range(0, (n - 1) // 1420 + 1), lambda w: pos + w * 1420) ELSE [] END),
    list_concat(list_concat(es, CASE WHEN stop >= 0 AND pos + n - cur > 1600 THEN [stop] ELSE [] END),
      CASE WHEN n > 1600 THEN list_transform(range(0, (n - 1) // 1420 + 1), lambda w: pos + least(w * 1420 + 1600, n)) ELSE [] END)
  FROM (SELECT *, ls[i + 1] AS n FROM fold WHERE i < len(ls))
),
done AS (SELECT doc_id, text, CASE WHEN stop >= 0 THEN list_append(ss, cur) ELSE ss END AS ss,
  CASE WHEN stop >= 0 THEN list_append(es, stop) ELSE es END AS es FROM fold WHERE i = len(ls)),
spans AS (SELECT doc_id, text, unnest(ss) AS s, unnest(es) AS e, generate_subscripts(ss, 1) - 1 AS idx FROM done),
cut AS (SELECT doc_id, idx, s, substring(text, s + 1, e - s) AS raw FROM spans),
out AS (SELECT doc_id, idx::BIGINT AS chunk_index, {q.clean('raw')} AS chunk_text,
  s + length(regexp_extract(raw, '^{q.WS}*')) AS char_start FROM cut)
SELECT doc_id, chunk_index, chunk_text, char_start, char_start + length(chunk_text) AS char_end,
  sha256(chunk_text) AS chunk_hash, len({q.raw_tokens('chunk_text')})::BIGINT AS token_count, {_heading('chunk_text')} AS section_title
FROM out WHERE chunk_text <> ''"""


@query("chunk_paragraph_window", _PACK)
def _(t):
    docs = t.normalized_documents.select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    c = ch.paragraph_windows(docs)
    return c.select(
        "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text", F.col("char_start").cast("long").alias("char_start"),
        F.col("char_end").cast("long").alias("char_end"), "chunk_hash", F.col("token_count").cast("long").alias("token_count"), "section_title",
    )


@query(
    "chunk_long_windows",
    f"WITH {CHUNKS} SELECT doc_id, chunk_index, chunk_text, char_start, char_start + length(chunk_text) AS char_end FROM chunks WHERE chunk_text <> ''",
)
def _(t):
    return t.chunks.select("doc_id", "chunk_index", "chunk_text", "char_start", "char_end")


def _cells(name, table, key, columns):
    body = ", ".join(f"{c}::VARCHAR" for c in columns)
    head = q.slist(["", *columns[1:]])
    return f"""SELECT '{name}' AS doc_id, ({key} // 10)::INTEGER AS page_number, ({key} % 10 + 2)::INTEGER AS row_index, [{body}] AS cells FROM {table}
      UNION ALL SELECT DISTINCT '{name}', ({key} // 10)::INTEGER, 1, {head} FROM {table}"""


TABLE_ROWS = f"""raw_rows AS ({_cells('nation', 'nation', 'n_nationkey', ['n_nationkey', 'n_name', 'n_regionkey'])}
  UNION ALL {_cells('region', 'region', 'r_regionkey', ['r_regionkey', 'r_name'])}
  UNION ALL {_cells('part', 'part', 'p_partkey', ['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size'])}),
trows AS (SELECT *, 'p' || page_number || '-t1' AS table_id FROM raw_rows)"""


@query(
    "chunk_table_rows",
    f"""WITH {TABLE_ROWS},
    body AS (SELECT b.*, h.cells AS heads FROM trows b JOIN trows h ON h.doc_id = b.doc_id AND h.page_number = b.page_number AND h.row_index = 1 WHERE b.row_index > 1),
    txt AS (SELECT doc_id, table_id, page_number, row_index, '[table_id: ' || table_id || ']' || chr(10) || '[page: ' || page_number || ']' || chr(10) ||
      array_to_string(list_transform(cells, lambda c, i: CASE WHEN heads[i] = '' THEN 'col_' || i ELSE heads[i] END || ': ' || c), chr(10)) AS chunk_text FROM body)
    SELECT doc_id, table_id, row_index, chunk_text, (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, row_index) - 1)::BIGINT AS chunk_index FROM txt""",
)
def _(t):
    return ch.table_row_chunks(t.parsed_tables).select("doc_id", "table_id", "row_index", "chunk_text", "chunk_index")


PAGES = f"""{DOCS},
pg0 AS (SELECT doc_id, category, text, length(text) AS n, unnest(range(0, greatest(length(text) - 1, 0) // 1000 + 1)) AS p FROM docs),
pg AS (SELECT doc_id, n, p + 1 AS page_number, p * 1000 AS s, least(p * 1000 + 1000, n) AS e, category = 'en' AS explicit,
  substring(text, (p * 1000 + 1)::BIGINT, 1000) AS page_text FROM pg0)"""


@query("page_ranges", f'WITH {PAGES} SELECT doc_id, page_number::BIGINT AS page_number, s::BIGINT AS "start", e::BIGINT AS "end" FROM pg')
def _(t):
    lengths = t.normalized_documents.select("doc_id", F.length("text").alias("text_length"))
    ranges = ch.page_ranges(t.pages_of_documents, lengths)
    return ranges.withColumn("page_number", F.col("page_number").cast("long"))


def _ranges(t):
    lengths = t.normalized_documents.select("doc_id", F.length("text").alias("text_length"))
    return ch.page_ranges(t.pages_of_documents, lengths)


@query(
    "page_for_offset",
    f"""WITH {CHUNKS}, cc AS (SELECT doc_id, chunk_index, char_start, char_start + length(chunk_text) AS char_end FROM chunks)
    SELECT doc_id, chunk_index, (greatest(char_start - 1, 0) // 1000 + 1)::BIGINT AS page_start, (greatest(char_end - 1, 0) // 1000 + 1)::BIGINT AS page_end FROM cc""",
)
def _(t):
    rows = ch.with_pages(t.chunks.select("doc_id", "chunk_index", "char_start", "char_end"), _ranges(t))
    return rows.select(
        "doc_id", "chunk_index", ch.page_for_offset(F.col("pages"), F.col("char_start")).cast("long").alias("page_start"),
        ch.page_for_offset(F.col("pages"), F.col("char_end")).cast("long").alias("page_end"),
    )


# numbered lines in front, so that headings exist
@query(
    "section_title",
    f"""WITH {CHUNKS}, h AS (SELECT chunk_id, CASE WHEN chunk_index = 0 THEN chunk_text || chr(10) || doc_id || '. item' ELSE chunk_text END AS x FROM chunks)
    SELECT chunk_id, {_heading('x')} AS section_title FROM h""",
)
def _(t):
    numbered = F.concat("chunk_text", F.lit("\n"), F.col("doc_id").cast("string"), F.lit(". item"))
    text = F.when(F.col("chunk_index") == 0, numbered).otherwise(F.col("chunk_text"))
    return t.chunks.select("chunk_id", tx.heading(text).alias("section_title"))


@query(
    "term_frequencies",
    f"""WITH {CHUNKS} SELECT chunk_id, lower(token) AS token, count(*) AS tf FROM (SELECT chunk_id, unnest({q.raw_tokens('chunk_text')}) AS token FROM chunks) GROUP BY ALL""",
)
def _(t):
    return ix.term_frequencies(t.chunks)


_ITEMS = f"""{CHUNKS},
items AS (SELECT v.doc_id, v.chunk_id, v.chunk_index, v.chunk_hash, v.vector_id, left(chunk_text, 400) AS text_preview,
  len(list_distinct({q.tokens('chunk_text')}))::BIGINT AS token_kinds, len({q.tokens('chunk_text')})::BIGINT AS token_total FROM vchunks v)"""


def _items(t):
    built = ix.build(t.chunks)
    return built.select(
        "doc_id", "chunk_id", "chunk_index", "chunk_hash", "vector_id", "text_preview",
        F.size("tokens").cast("long").alias("token_kinds"),
        F.aggregate(F.map_values("tokens"), F.lit(0).cast("long"), lambda a, x: a + x).alias("token_total"),
    )


@query("index_build", f"WITH {_ITEMS} SELECT * FROM items")
def _(t):
    return _items(t)


@query(
    "index_searchable_chunks",
    f"WITH {SEARCHABLE} SELECT vector_id, doc_id, chunk_id, chunk_index, category, document_version FROM good WHERE category = 'en'",
)
def _(t):
    rows = ix.searchable(t.labelled_chunks, category="en")
    return rows.select("vector_id", "doc_id", "chunk_id", "chunk_index", "category", "document_version")


_DRIFT = f"""{SEARCHABLE},
idx AS (SELECT c.vector_id, c.doc_id, c.chunk_id, CASE WHEN d.category = 'de' THEN 'old-' || c.chunk_hash ELSE c.chunk_hash END AS chunk_hash,
  d.category <> 'es' AS tokens_ok FROM vchunks c JOIN docs d USING (doc_id) WHERE coalesce(d.quality, 1) = 1)"""


@query(
    "index_validate",
    f"""WITH {_DRIFT},
    f AS (SELECT (SELECT count(*) FROM good) AS table_count, (SELECT count(*) FROM idx) AS index_count,
      (SELECT count(*) FROM good WHERE vector_id NOT IN (SELECT vector_id FROM idx)) AS missing_from_index,
      (SELECT count(*) FROM idx WHERE vector_id NOT IN (SELECT vector_id FROM good)) AS missing_from_table,
      (SELECT count(*) FROM idx i JOIN good g USING (vector_id) WHERE i.tokens_ok AND (i.chunk_hash <> g.chunk_hash OR i.chunk_id <> g.chunk_id OR i.doc_id <> g.doc_id)) AS mismatched,
      (SELECT count(*) FROM idx WHERE NOT tokens_ok) AS invalid_items)
    SELECT *, CASE WHEN index_count = 0 AND table_count > 0 THEN 'missing' WHEN b THEN 'inconsistent' ELSE 'ok' END AS status, NOT b AS valid,
      NOT b AND index_count > 0 AS can_search, b AS rebuild_required
    FROM (SELECT *, missing_from_index + missing_from_table + mismatched + invalid_items > 0 AS b FROM f) ORDER BY 1""".replace(
        "SELECT *, CASE WHEN index_count", "SELECT * EXCLUDE (b), CASE WHEN index_count"
    ),
)
def _(t):
    return ix.validate(t.searchable_chunks, t.index_items)


@query(
    "index_manifest",
    f"""WITH {_ITEMS}, h AS (SELECT sha256(concat_ws('|', vector_id, doc_id, chunk_id, chunk_index, chunk_hash, token_kinds, token_total)) AS h FROM items),
    p AS (SELECT count(*) AS chunk_count, bit_xor(('0x' || h[1:15])::BIGINT) AS x, sum(('0x' || h[16:30])::BIGINT::HUGEINT) AS s FROM h)
    SELECT 'token-index-v1' AS schema_version, 'token-frequency' AS model, chunk_count, 'sha256:' || sha256(concat_ws('|', chunk_count, x, s)) AS checksum FROM p""",
)
def _(t):
    return ix.manifest(_items(t))


def _runs(t):
    """Every document ran once; labelled ones twice, where toxic ones failed the second time."""
    docs = t.basis_documents.select("doc_id", "quality", "processing_status")
    second = docs.filter(F.col("quality").isNotNull()).select("doc_id", F.lit(2).alias("run_id"), F.col("processing_status").alias("status"))
    return docs.select("doc_id", F.lit(1).alias("run_id"), F.lit("completed").alias("status")).unionByName(second)


@query(
    "index_run_swap",
    f"""WITH {CHUNKS}, runs AS (SELECT doc_id, 1 AS run_id, 'completed' AS status FROM docs UNION ALL
      SELECT doc_id, 2, processing_status FROM docs WHERE quality IS NOT NULL),
    cr AS (SELECT c.doc_id, c.chunk_id, r.run_id FROM chunks c JOIN runs r USING (doc_id)),
    best AS (SELECT doc_id, max(run_id) AS run_id FROM runs WHERE status = 'completed' GROUP BY 1)
    SELECT doc_id, chunk_id, run_id FROM cr JOIN best USING (doc_id, run_id)""",
)
def _(t):
    runs = _runs(t)
    chunks = t.chunks.select("doc_id", "chunk_id").join(runs.select("doc_id", "run_id"), "doc_id")
    return ix.swap_runs(chunks, runs).select("doc_id", "chunk_id", "run_id")


@query(
    "index_drop_document",
    f"""WITH {SEARCHABLE} SELECT chunk_id, doc_id, 'allowed' AS verdict FROM good WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
    UNION ALL SELECT chunk_id, doc_id, 'refused' FROM good""",
)
def _(t):
    rows = t.freeze_passage_keys().searchable_chunks
    gone = t.labels.filter(F.col("quality") == 0)
    clean = ix.validate(rows, rows.withColumn("tokens_ok", F.lit(True)))
    drifted = ix.validate(rows, t.index_items)
    keep = ("chunk_id", "doc_id")
    return (
        ix.drop_documents(rows.select(*keep), gone, clean).withColumn("verdict", F.lit("allowed"))
        .unionByName(ix.drop_documents(rows.select(*keep), gone, drifted).withColumn("verdict", F.lit("refused")))
    )


@query(
    "document_rollup",
    f"""WITH {CHUNKS}, n AS (SELECT doc_id, count(*) AS c FROM chunks WHERE chunk_text <> '' GROUP BY 1)
    SELECT d.doc_id, coalesce(c, 0) AS chunk_count, coalesce(c, 0) AS vector_count, (greatest(length(text) - 1, 0) // 1000 + 1)::BIGINT AS page_count,
      CASE WHEN coalesce(c, 0) > 0 THEN 'completed' ELSE 'failed' END AS chunk_status,
      CASE WHEN processing_status <> 'completed' OR coalesce(c, 0) = 0 THEN 'failed' ELSE 'completed' END AS index_status FROM docs d LEFT JOIN n USING (doc_id)""",
)
def _(t):
    return ix.document_rollup(t.basis_documents.select("doc_id", "processing_status"), t.chunks, t.pages_of_documents)


@query(
    "chunk_list",
    f"""WITH {CHUNKS} SELECT c.doc_id, c.chunk_index, c.chunk_hash, d.category, d.document_version FROM chunks c JOIN docs d USING (doc_id)
    WHERE c.doc_id IN (SELECT doc_id FROM labels)""",
)
def _(t):
    docs = t.basis_documents.select("doc_id", "category", "document_version")
    return ix.chunk_list(t.chunks.select("doc_id", "chunk_index", "chunk_hash"), docs, t.labels)


def search_results(t, k=5, category=""):
    index, folders = t.search_index
    return bi.topk(t.benchmark_queries, bi.only(index, category), k, folders)


@query("search_topk", f"WITH {topk_sql(5)} SELECT * FROM top")
def _(t):
    return search_results(t).withColumn("rank", F.col("rank").cast("long"))


@query(
    "search_gate",
    f"""WITH {_DRIFT}, n AS (SELECT
      (SELECT count(*) FROM good WHERE vector_id NOT IN (SELECT vector_id FROM idx)) AS a, (SELECT count(*) FROM idx WHERE vector_id NOT IN (SELECT vector_id FROM good)) AS b,
      (SELECT count(*) FROM idx i JOIN good g USING (vector_id) WHERE i.tokens_ok AND i.chunk_hash <> g.chunk_hash) AS c, (SELECT count(*) FROM idx WHERE NOT tokens_ok) AS d),
    top AS ({topk_sql(5).replace(SEARCHABLE + ",", "WITH ", 1)} SELECT * FROM top)
    SELECT 'drifted' AS index_name, 'inconsistent' AS status, false AS can_search, concat_ws('; ', CASE WHEN a > 0 THEN 'missing_from_index: ' || a END, CASE WHEN b > 0 THEN 'missing_from_table: ' || b END,
      CASE WHEN c > 0 THEN 'mismatched: ' || c END, CASE WHEN d > 0 THEN 'invalid_items: ' || d END) AS reason, 0::BIGINT AS results FROM n
    UNION ALL SELECT 'own', 'ok', true, '', count(*) FROM top""",
)
def _(t):
    """Results of the drifted index, and of the index of the passages themselves, as far as each may be searched."""
    table, out = t.searchable_chunks, None
    own = table.select("vector_id", "doc_id", "chunk_id", "chunk_hash", F.lit(True).alias("tokens_ok"))
    for name, index in (("drifted", t.index_items), ("own", own)):
        check = ix.validate(table, index)
        results = se.gated(search_results(t), check).agg(F.count("*").alias("n")).select("n").scalar()
        row = se.refusal(check).select(F.lit(name).alias("index_name"), "status", "can_search", "reason", results.alias("results"))
        out = row if out is None else out.unionByName(row)
    return out


_FILTER = "category = 'en'"


@query("search_filtered", f"WITH {topk_sql(3, _FILTER)} SELECT * FROM top")
def _(t):
    return search_results(t, 3, "en").withColumn("rank", F.col("rank").cast("long"))


EVAL = f"""{topk_sql(5)},
ex AS (SELECT b.item_id AS query_id, 'basis:' || c.doc_id || ':chunk:' || c.chunk_id AS cid FROM benchmark b JOIN chunks c ON contains(c.chunk_text, b.text)),
tc AS (SELECT *, 'basis:' || doc_id || ':chunk:' || chunk_id AS cid FROM top),
pq AS (SELECT b.item_id AS query_id, (SELECT count(*) FROM tc WHERE tc.query_id = b.item_id) AS result_count,
  coalesce((SELECT max(score) FROM tc WHERE tc.query_id = b.item_id), 0.0::DOUBLE) AS top_score,
  coalesce((SELECT string_agg(cid, ',' ORDER BY rank) FROM tc WHERE tc.query_id = b.item_id), '') AS ids,
  coalesce((SELECT string_agg(tc.cid, ',' ORDER BY rank) FROM tc JOIN ex ON ex.query_id = tc.query_id AND ex.cid = tc.cid WHERE tc.query_id = b.item_id), '') AS matched_ids,
  (SELECT count(*) FROM ex WHERE ex.query_id = b.item_id) AS expected_count,
  (SELECT count(*) FROM tc JOIN ex ON ex.query_id = tc.query_id AND ex.cid = tc.cid WHERE tc.query_id = b.item_id) AS matched_count FROM benchmark b),
ev AS (SELECT query_id, result_count, result_count > 0 AS result_hit, top_score, ids, matched_ids, expected_count, matched_count,
  expected_count - matched_count AS missed_count, CASE WHEN expected_count > 0 THEN matched_count > 0 END AS expected_hit,
  CASE WHEN expected_count > 0 THEN matched_count / expected_count END AS expected_coverage FROM pq)"""


def _evaluation(t):
    return se.evaluate_queries(t.benchmark_queries, search_results(t), t.expected_citations)


@query("retrieval_eval_queries", f"WITH {EVAL} SELECT * FROM ev")
def _(t):
    lists = {"ids": "citation_candidate_ids", "matched_ids": "matched_expected_ids"}
    out = _evaluation(t)
    for short, name in lists.items():
        out = out.withColumn(short, F.coalesce(F.array_join(name, ","), F.lit(""))).drop(name)
    return out


@query(
    "retrieval_eval_metrics",
    f"""WITH {EVAL}, m AS (SELECT count(*) AS query_count, count(*) FILTER (result_hit) / count(*) AS result_coverage,
      count(*) FILTER (expected_count > 0) AS expected_query_count,
      CASE WHEN count(*) FILTER (expected_count > 0) > 0 THEN count(*) FILTER (expected_hit) / count(*) FILTER (expected_count > 0) END AS expected_citation_coverage,
      round(coalesce(sum(CASE WHEN result_hit THEN top_score::DECIMAL(20,10) END)::DOUBLE / count(*) FILTER (result_hit), 0), 6) AS average_top_score FROM ev)
    SELECT query_count, result_coverage, expected_query_count, expected_citation_coverage,
      coalesce(expected_citation_coverage, result_coverage) AS citation_coverage, average_top_score FROM m""",
)
def _(t):
    return se.evaluation_metrics(_evaluation(t))


_LINES_SQL = "(text || ' | basis:1:chunk:2, basis:' || doc_id || ':chunk:7 ,' || chr(10) || '| x')"


@query(
    "eval_query_parse",
    f"""WITH a AS (SELECT doc_id, regexp_split_to_array({_LINES_SQL}, '\\r?\\n') AS ls FROM documents),
    b AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM a),
    c AS (SELECT doc_id, i, {q.clean("string_split(line, '|')[1]")} AS query,
      list_filter(list_transform(string_split(coalesce(string_split(line, '|')[2], ''), ','), lambda y: {q.clean('y')}), lambda y: y <> '') AS ids FROM b)
    SELECT doc_id AS input_id, 'q' || i AS query_id, query, array_to_string(ids, ',') AS expected_ids FROM c WHERE query <> ''""",
)
def _(t):
    tail = F.concat(F.lit(" | basis:1:chunk:2, basis:"), F.col("doc_id").cast("string"), F.lit(":chunk:7 ,\n| x"))
    rows = se.parse_queries(t.documents.select(F.col("doc_id").alias("input_id"), F.concat("text", tail).alias("body")))
    return rows.withColumn("expected_ids", F.array_join("expected_ids", ","))


_CID_SQL = "CASE WHEN c_acctbal < 0 THEN 'basis:' || c_custkey || ':chunk:' ELSE ' basis:' || c_custkey || ':chunk:' || c_nationkey || ' ' END"


@query(
    "citation_id_parse",
    f"""WITH a AS (SELECT c_custkey, {q.clean(_CID_SQL)} AS v FROM customer)
    SELECT c_custkey, TRY_CAST(nullif(regexp_extract(v, '^basis:([0-9]+):chunk:([0-9]+)$', 1), '') AS BIGINT) AS doc_id,
      TRY_CAST(nullif(regexp_extract(v, '^basis:([0-9]+):chunk:([0-9]+)$', 2), '') AS BIGINT) AS chunk_id,
      'basis:' || c_custkey || ':chunk:' || c_nationkey AS formatted FROM a JOIN customer USING (c_custkey)""",
)
def _(t):
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    good = F.concat(F.lit(" "), se.citation_id(key, nation), F.lit(" "))
    doc, chunk = se.citation_parts(F.when(F.col("c_acctbal") < 0, F.concat(F.lit("basis:"), key, F.lit(":chunk:"))).otherwise(good))
    return t.customer.select(
        "c_custkey", doc.alias("doc_id"), chunk.alias("chunk_id"), se.citation_id(key, nation).alias("formatted")
    )
