"""Queries over text quality (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx
from bidlens.functions.dictionaries import DEMO
from bidlens.operators import quality as qa
from bidlens.plans import sql as q
from bidlens.plans.chunk_queries import PAGES
from bidlens.plans.registry import query
from bidlens.plans.requirement_queries import CANDIDATES

PAIRS = f"""dn AS (SELECT doc_id, {q.reference_normalize('text')} AS x FROM documents),
pr AS (SELECT l.doc_id AS pair_id, l.x AS a, r.x AS b FROM dn l JOIN dn r ON r.doc_id = l.doc_id + 1)"""


def _pairs(t):
    docs = t.documents.select("doc_id", tx.reference_normalize(F.col("text")).alias("x"))
    left = docs.select(F.col("doc_id").alias("pair_id"), F.col("x").alias("a"))
    return left.join(docs.select((F.col("doc_id") - 1).alias("pair_id"), F.col("x").alias("b")), "pair_id")


def _recall(pieces, unique=False) -> str:
    a, b = pieces("a"), pieces("b")
    m = ("count(*) FILTER (n_a > 0 AND n_b > 0)", "count(*) FILTER (n_a > 0)", "count(*) FILTER (n_b > 0)") if unique else ("sum(least(n_a, n_b))", "sum(n_a)", "sum(n_b)")
    return f"""WITH {PAIRS}, px AS (SELECT pair_id, 0 AS side, unnest({a}) AS piece FROM pr UNION ALL SELECT pair_id, 1, unnest({b}) FROM pr),
    pc AS (SELECT pair_id, piece, count(*) FILTER (side = 0) AS n_a, count(*) FILTER (side = 1) AS n_b FROM px GROUP BY 1, 2),
    ps AS (SELECT pair_id, {m[0]}::DOUBLE AS m, {m[1]}::DOUBLE AS sa, {m[2]}::DOUBLE AS sb FROM pc GROUP BY 1)
    SELECT pair_id, CASE WHEN coalesce(sa, 0) > 0 THEN m / sa ELSE 1.0::DOUBLE END AS recall_a, CASE WHEN coalesce(sb, 0) > 0 THEN m / sb ELSE 1.0::DOUBLE END AS recall_b FROM pr LEFT JOIN ps USING (pair_id)"""


def _grams(x: str, n: int = 5) -> str:
    c = q.space_compact(x)
    return f"CASE WHEN {c} = '' THEN []::VARCHAR[] WHEN length({c}) < {n} THEN [{c}] ELSE list_transform(range(1, length({c}) - {n} + 2), lambda i: substring({c}, i, {n})) END"


@query("token_multiset_recall", _recall(q.tokens))
def _(t):
    return qa.multiset_recall(_pairs(t), tx.tokenize)


@query("unique_recall", _recall(q.tokens, unique=True))
def _(t):
    return qa.unique_recall(_pairs(t), tx.tokenize)


def _gram_sql() -> str:
    # the space-free text is made once per row, then cut
    grams = lambda x: f"CASE WHEN {x} = '' THEN []::VARCHAR[] WHEN length({x}) < 5 THEN [{x}] ELSE list_transform(range(1, length({x}) - 3), lambda i: substring({x}, i, 5)) END"
    body = _recall(grams)
    return body.replace("dn AS (SELECT doc_id, " + q.reference_normalize("text") + " AS x", "dn AS (SELECT doc_id, " + q.space_compact("text") + " AS x")


@query("char_ngram_recall", _gram_sql())
def _(t):
    return qa.ngram_recall(_pairs(t))


@query("numeric_recall", _recall(q.numbers))
def _(t):
    return qa.multiset_recall(_pairs(t), tx.numeric_tokens)


_TIDY = f"list_filter(list_transform(regexp_split_to_array(a, '{q.LINE_BREAK}'), lambda y: {q.clean(f'''regexp_replace(y, '{q.WS}+', ' ', 'g')''')}), lambda y: length(y) >= 12)"
LINES = f"""{PAIRS},
lc0 AS (SELECT pair_id, {_TIDY} AS ls, {q.space_compact('b')} AS bc FROM pr),
lc AS (SELECT pair_id, len(ls)::BIGINT AS line_count, list_filter(ls, lambda y: NOT contains(bc, {q.space_compact('y')})) AS miss FROM lc0)"""


@query(
    "line_coverage",
    f"WITH {LINES} SELECT pair_id, line_count, CASE WHEN line_count > 0 THEN (line_count - len(miss)) / line_count ELSE 1.0::DOUBLE END AS coverage, array_to_string(miss, '|') AS misses FROM lc",
)
def _(t):
    return qa.line_coverage(_pairs(t)).select("pair_id", F.col("line_count").cast("long").alias("line_count"), "coverage", F.array_join("misses", "|").alias("misses"))


# a pipe table made of each document's own lines: header, separator, then one row per line
def _table_text(text):
    body = F.concat(F.lit("| h1 | h2 |\n| --- | :---: |\n| "), F.regexp_replace(text, "\n", " | x |\n| "), F.lit(" | y |\nplain | text"))
    return F.concat(body, F.lit("\n|---|---|"))


_TABLE_SQL = r"('| h1 | h2 |' || chr(10) || '| --- | :---: |' || chr(10) || '| ' || replace(text, chr(10), ' | x |' || chr(10) || '| ') || ' | y |' || chr(10) || 'plain | text' || chr(10) || '|---|---|')"
_IS_ROW = "starts_with(y, '|') AND contains(y[2:], '|')"
_IS_SEP = r"len(list_filter(string_split(regexp_replace(y, '^\|+|\|+$', '', 'g'), '|'), lambda c: NOT regexp_matches(trim(c), '^:?-{3,}:?$'))) = 0"


@query(
    "markdown_rows",
    f"""WITH a AS (SELECT doc_id, {q.lines(_TABLE_SQL)} AS ls FROM documents)
    SELECT doc_id, array_to_string(list_filter(ls, lambda y: {_IS_ROW} AND NOT ({_IS_SEP})), chr(10)) AS rows, 1::BIGINT AS table_count FROM a""",
)
def _(t):
    text = _table_text(F.col("text"))
    return t.documents.select(
        "doc_id", F.array_join(qa.markdown_rows(text), "\n").alias("rows"), qa.markdown_table_count(text).cast("long").alias("table_count")
    )


def _table_pairs(t):
    docs = t.documents.select("doc_id", "text")
    left = docs.select(F.col("doc_id").alias("pair_id"), F.concat(F.lit("| "), F.regexp_replace("text", "\n", " |\n| "), F.lit(" |")).alias("a"))
    return left.join(docs.select((F.col("doc_id") - 1).alias("pair_id"), F.concat(F.lit("|"), "text", F.lit("|")).alias("b")), "pair_id")


TPAIRS = f"""tp AS (SELECT l.doc_id AS pair_id, '| ' || replace(l.text, chr(10), ' |' || chr(10) || '| ') || ' |' AS a, '|' || r.text || '|' AS b FROM documents l JOIN documents r ON r.doc_id = l.doc_id + 1),
tr AS (SELECT pair_id, b, list_filter({q.lines('a')}, lambda y: {_IS_ROW} AND NOT ({_IS_SEP})) AS rows FROM tp)"""


@query(
    "row_coverage",
    f"""WITH {TPAIRS}, c AS (SELECT pair_id, rows, {q.space_compact('b')} AS bc FROM tr)
    SELECT pair_id, len(rows)::BIGINT AS row_count, CASE WHEN len(rows) > 0 THEN len(list_filter(rows, lambda y: contains(bc, {q.space_compact('y')}))) / len(rows) ELSE 1.0::DOUBLE END AS coverage FROM c""",
)
def _(t):
    return qa.row_coverage(_table_pairs(t)).withColumn("row_count", F.col("row_count").cast("long"))


@query(
    "row_token_coverage",
    f"""WITH {TPAIRS}, r AS (SELECT pair_id, unnest(rows) AS line, generate_subscripts(rows, 1) AS i FROM tr), tk AS (SELECT pair_id, i, list_distinct({q.tokens('line')}) AS ts FROM r),
    x AS (SELECT pair_id, i, unnest(ts) AS token FROM tk), tg AS (SELECT pair_id, unnest(list_distinct({q.tokens('b')})) AS token FROM tp),
    h AS (SELECT pair_id, i, count(*) AS n, count(tg.token) AS k FROM x LEFT JOIN tg USING (pair_id, token) GROUP BY 1, 2),
    s AS (SELECT tk.pair_id, count(*) AS row_count, count(*) FILTER (n IS NULL OR k / n >= 0.65) AS hits FROM tk LEFT JOIN h USING (pair_id, i) GROUP BY 1)
    SELECT tp.pair_id, coalesce(row_count, 0) AS row_count, CASE WHEN coalesce(row_count, 0) > 0 THEN hits / row_count ELSE 1.0::DOUBLE END AS coverage FROM tp LEFT JOIN s USING (pair_id)""",
)
def _(t):
    return qa.row_token_coverage(_table_pairs(t))


@query(
    "required_term_coverage",
    f"WITH {PAIRS} SELECT pair_id, term, contains(a, term) AS in_a, contains(b, term) AS in_b FROM (SELECT *, unnest({q.slist(DEMO.required_terms)}) AS term FROM pr)",
)
def _(t):
    return qa.required_terms(_pairs(t), DEMO)


_SCORE = f"""(CASE WHEN {q.contains_any('l', DEMO.table_terms)} THEN 2 ELSE 0 END + CASE WHEN regexp_matches(l, '[0-9]{{2,}}|[A-Za-z]{{2,}}') THEN 1 ELSE 0 END
  + CASE WHEN len({q.raw_tokens('l')}) >= 4 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(raw, '\\t|\\||{q.WS}{{2,}}') THEN 1 ELSE 0 END + CASE WHEN length(l) BETWEEN 8 AND 160 THEN 1 ELSE 0 END)"""
TABLE_LINES = f"""tl0 AS (SELECT doc_id, regexp_split_to_array(text, '{q.LINE_BREAK}') AS ls FROM documents),
tl1 AS (SELECT doc_id, unnest(ls) AS raw, (generate_subscripts(ls, 1) - 1) // 10 + 1 AS page_number FROM tl0),
tl2 AS (SELECT *, {q.clean("regexp_replace(raw, '[ ]+', ' ', 'g')")} AS l FROM tl1),
tl3 AS (SELECT doc_id, page_number, l, {_SCORE} AS score FROM tl2 WHERE l <> ''),
tl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_number, l) AS position FROM tl3 WHERE score >= 3)"""


def _table_lines(t):
    return t.documents.select("doc_id", qa.table_like_lines(F.col("text"), lambda i: F.floor(i / 10) + 1, DEMO).alias("found"))


@query("table_like_lines", f"WITH {TABLE_LINES} SELECT doc_id, position, score::BIGINT AS score, page_number, l AS text FROM tl")
def _(t):
    rows = _table_lines(t).select("doc_id", F.posexplode("found").alias("pos", "r"))
    return rows.select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("position"), (-F.col("r.neg_score")).cast("long").alias("score"), F.col("r.page_number").alias("page_number"), "r.text"
    )


_NONNUM = f"list_filter({q.raw_tokens('l')}, lambda w: NOT regexp_matches(w, '^[0-9]+$'))"


@query(
    "line_queries",
    f"""WITH {TABLE_LINES}, lq AS (SELECT doc_id, position, array_to_string({_NONNUM}, ' ') AS qry FROM tl),
    lf AS (SELECT doc_id, qry, min(position) AS p FROM lq WHERE length(qry) >= 4 GROUP BY 1, 2), lg AS (SELECT doc_id, list(qry ORDER BY p) AS qs FROM lf GROUP BY 1),
    lm AS (SELECT d.doc_id, list_concat(coalesce(qs, []::VARCHAR[]), {q.slist(fv.DEFAULT_LINE_QUERIES)}) AS v FROM documents d LEFT JOIN lg USING (doc_id))
    SELECT doc_id, array_to_string({q.distinct_ordered('v')}, '|') AS queries FROM lm""",
)
def _(t):
    rows = _table_lines(t)
    texts = F.transform("found", lambda r: r["text"])
    return rows.select("doc_id", F.array_join(qa.line_queries(texts), "|").alias("queries"))


@query(
    "top_terms",
    f"""WITH w AS (SELECT lang, unnest({q.raw_tokens('text')}) AS term FROM documents), c AS (SELECT lang, term, count(*) AS term_count FROM w WHERE term NOT IN ('the', 'and', 'le') AND NOT regexp_matches(term, '^[0-9]+$') GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY term_count DESC, term) AS position FROM c QUALIFY position <= 20""",
)
def _(t):
    return qa.top_terms(t.documents.select("lang", "text"), "lang", ("the", "and", "le")).withColumn("position", F.col("position").cast("long"))


@query(
    "page_coverage",
    f"WITH {PAGES} SELECT doc_id, count(*) AS page_count, count(*) FILTER (length(page_text) > 500) / count(*) AS coverage FROM pg GROUP BY 1",
)
def _(t):
    # a page counts as filled from 500 characters on, so that short last pages show
    pages = t.pages_of_documents.withColumn("char_count", F.when(F.length("page_text") > 500, F.length("page_text")).otherwise(0))
    return qa.page_coverage(pages)


METRICS = f"""{PAIRS},
mx AS (SELECT pair_id, 0 AS side, unnest({q.tokens('a')}) AS piece FROM pr UNION ALL SELECT pair_id, 1, unnest({q.tokens('b')}) FROM pr),
mc AS (SELECT pair_id, piece, count(*) FILTER (side = 0) AS n_a, count(*) FILTER (side = 1) AS n_b FROM mx GROUP BY 1, 2),
ms AS (SELECT pair_id, sum(least(n_a, n_b))::DOUBLE AS m, sum(n_a)::DOUBLE AS sa, sum(n_b)::DOUBLE AS sb FROM mc GROUP BY 1),
mt AS (SELECT pair_id, length(a)::BIGINT AS char_count, CASE WHEN coalesce(sa, 0) > 0 THEN m / sa ELSE 1.0::DOUBLE END AS recall_a, CASE WHEN coalesce(sb, 0) > 0 THEN m / sb ELSE 1.0::DOUBLE END AS recall_b FROM pr LEFT JOIN ms USING (pair_id))"""


def _metrics(t):
    return qa.multiset_recall(_pairs(t), tx.tokenize, {"char_count": F.length("a").cast("long")})


@query(
    "qa_gates",
    f"""WITH {METRICS} SELECT pair_id, array_to_string(list_filter([CASE WHEN char_count < 400 THEN 'char_count' END, CASE WHEN recall_a < 0.2 THEN 'recall_a' END], lambda z: z IS NOT NULL), ',') AS errors,
      CASE WHEN recall_b < 0.3 THEN 'recall_b' ELSE '' END AS warnings, char_count >= 400 AND recall_a >= 0.2 AS passed FROM mt""",
)
def _(t):
    rows = qa.gates(_metrics(t), {"char_count": 400, "recall_a": 0.2}, {"recall_b": 0.3})
    return rows.select("pair_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "passed")


@query(
    "metric_rollup",
    f"""WITH {METRICS}, l AS (SELECT 'char_count' AS metric, char_count::DOUBLE AS value FROM mt UNION ALL SELECT 'recall_a', recall_a FROM mt UNION ALL SELECT 'recall_b', recall_b FROM mt)
    SELECT metric, count(*) AS row_count, round(sum(value::DECIMAL(28,10))::DOUBLE / count(*), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value FROM l GROUP BY 1""",
)
def _(t):
    return qa.metric_rollup(_metrics(t), ["char_count", "recall_a", "recall_b"])


@query(
    "encoding_findings",
    f"""WITH a AS (SELECT doc_id, regexp_split_to_array(text, '{q.LINE_BREAK}') AS ls FROM documents), b AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_number FROM a)
    SELECT doc_id, line_number::BIGINT AS line_number, line AS excerpt FROM b WHERE {q.contains_any('line', fv.MOJIBAKE_TOKENS)}""",
)
def _(t):
    return qa.encoding_findings(t.documents.select("doc_id", "text")).withColumn("line_number", F.col("line_number").cast("long"))


_FOUND = f"list_filter([{', '.join(f'CASE WHEN contains(low, {q.s(w)}) THEN {q.s(w)} END' for w in DEMO.forbidden_terms)}], lambda z: z IS NOT NULL)"


@query(
    "forbidden_terms",
    f"""WITH {CANDIDATES}, f AS (SELECT notice_id, requirement_type, required_value, lower(required_value) AS low FROM cand)
    SELECT notice_id, requirement_type, required_value, array_to_string({_FOUND}, ',') AS forbidden_found FROM f WHERE len({_FOUND}) > 0""",
)
def _(t):
    rows = qa.forbidden_terms(t.notice_requirements.select("notice_id", "requirement_type", "required_value"), "required_value", DEMO)
    return rows.withColumn("forbidden_found", F.array_join("forbidden_found", ","))


FULL = f"""{CANDIDATES},
fg AS (SELECT notice_id, count(*) AS candidate_count, count(*) FILTER (requirement_type IN ({', '.join(q.s(x) for x in fv.SEMANTIC_TYPES)})) AS semantic_count,
  string_agg(lower(required_value || chr(10) || source_text), chr(10)) AS low FROM cand GROUP BY 1),
ft AS (SELECT d.doc_id AS notice_id, length({q.clean('text')})::BIGINT AS text_chars, coalesce(candidate_count, 0) AS candidate_count, coalesce(semantic_count, 0) AS semantic_count, {_FOUND} AS found, text FROM documents d LEFT JOIN fg ON fg.notice_id = d.doc_id)"""


@query(
    "fulltext_gates",
    f"""WITH {FULL} SELECT notice_id, text_chars, candidate_count, semantic_count, array_to_string(found, ',') AS forbidden_found, text_chars >= 200 AND candidate_count >= 3 AND semantic_count >= 1 AND len(found) = 0 AS passed FROM ft""",
)
def _(t):
    rows = qa.fulltext_gates(t.documents, t.notice_requirements, DEMO)
    return rows.select(
        "notice_id", F.col("text_chars").cast("long").alias("text_chars"), "candidate_count", "semantic_count", F.array_join("forbidden_found", ",").alias("forbidden_found"), "passed"
    )


@query(
    "corpus_sample",
    f"""WITH {FULL}, g AS (SELECT sha256(text) AS text_hash, min(notice_id) AS doc_id FROM ft WHERE text_chars >= 200 AND candidate_count >= 3 AND semantic_count >= 1 AND len(found) = 0 GROUP BY 1)
    SELECT text_hash, doc_id FROM g ORDER BY sha256('20260505:' || text_hash), text_hash LIMIT 50""",
)
def _(t):
    gates = qa.fulltext_gates(t.documents, t.notice_requirements, DEMO).select(F.col("notice_id").alias("doc_id"), "passed")
    rows = t.documents.select("doc_id", "text").join(gates, "doc_id")
    return qa.corpus_sample(rows, "doc_id", "text", F.col("passed"), 50, seed=20260505)
