"""Keyword search over passages and its evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx


def checked_k(k: int) -> int:
    """``k`` as it is; an error outside 1 to 20, never fewer rows than asked for."""
    if not 1 <= k <= fv.MAX_TOP_K:
        raise ValueError(f"k must lie between 1 and {fv.MAX_TOP_K}")
    return k


def round4(c: Column) -> Column:
    """Four digits, the same arithmetic in every engine."""
    return F.floor(c * 10000 + 0.5) / 10000


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token, query_size) with distinct tokens."""
    tokens = F.array_distinct(tx.tokenize(F.col("query")))
    return queries.select("query_id", F.size(tokens).alias("query_size"), F.explode(tokens).alias("token"))


def salted(postings: DataFrame, tokens: DataFrame, salts: int) -> DataFrame:
    """Equi join on token, each hot token spread over ``salts`` tasks."""
    if salts <= 1:
        return postings.join(tokens, "token")
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int")
    fan = tokens.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return postings.withColumn("salt", salt).join(fan, ["token", "salt"]).drop("salt")


def overlaps(queries: DataFrame, postings: DataFrame, salts: int = 1) -> DataFrame:
    """Number of distinct query tokens in each passage that shares at least one."""
    matched = salted(postings.select("token", "doc_id", "chunk_id", "chunk_index"), query_tokens(queries), salts)
    return matched.groupBy("query_id", "query_size", "doc_id", "chunk_id", "chunk_index").agg(F.count("*").alias("shared"))


def topk(queries: DataFrame, postings: DataFrame, k: int = 5, salts: int = 1) -> DataFrame:
    """Best k passages per query.

    Ranked by the integer overlap (exact); ties by newest document, then passage order.  The rank filter
    becomes a group limit below the shuffle, so at most k rows per query and task travel.
    """
    order = W.partitionBy("query_id").orderBy(F.desc("shared"), F.desc("doc_id"), "chunk_index")
    ranked = overlaps(queries, postings, salts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= checked_k(k))
    return ranked.select(
        "query_id", "rank", "doc_id", "chunk_id", "chunk_index", "shared", (F.col("shared") / F.col("query_size")).alias("score")
    )


def gated(hits: DataFrame, check: DataFrame) -> DataFrame:
    """Search results of an index whose check (``index.validate``) allows search; none of any other."""
    return hits.filter(check.select("can_search").scalar())


def refusal(check: DataFrame) -> DataFrame:
    """One row: the check's status, whether search is allowed, and why it is not."""
    found = [F.when(F.col(c) > 0, F.concat(F.lit(c + ": "), F.col(c).cast("string"))) for c in ("missing_from_index", "missing_from_table", "mismatched", "invalid_items")]
    return check.select("status", "can_search", F.concat_ws("; ", *found).alias("reason"))


def citation_id(doc: Column, chunk: Column) -> Column:
    return F.concat(F.lit("basis:"), doc.cast("string"), F.lit(":chunk:"), chunk.cast("string"))


def citation_parts(c: Column) -> tuple[Column, Column]:
    """Document and passage id of a citation id; null when it is malformed."""
    pattern = "^basis:([0-9]+):chunk:([0-9]+)$"
    text = tx.clean_text(c)
    return tuple(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("long") for i in (1, 2))


def evaluate_queries(queries: DataFrame, results: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query: what was found, what was expected, and how much of it was hit.

    ``expected`` has (query_id, citation_candidate_id) rows.  Only the results (at most k per query) are listed
    in a row; expectations stay rows and are counted, however many a query has.
    """
    found = results.select("query_id", citation_id(F.col("doc_id"), F.col("chunk_id")).alias("citation_candidate_id"), "rank", "score", F.lit(True).alias("found"))
    # one join and one group a query, so that what is expected is looked for once
    met = found.join(expected.distinct().withColumn("expected", F.lit(True)), ["query_id", "citation_candidate_id"], "full_outer")

    def listed(keep):
        item = F.when(keep, F.struct("rank", "citation_candidate_id"))
        return F.transform(F.array_sort(F.collect_list(item)), lambda x: x["citation_candidate_id"])

    per_query = met.groupBy("query_id").agg(
        F.count("found").alias("result_count"), F.max("score").alias("top_score"),
        listed(F.col("found")).alias("citation_candidate_ids"), listed(F.col("found") & F.col("expected")).alias("matched_expected_ids"),
        F.count("expected").alias("expected_count"),
    )
    lists = {c: F.when(F.col("result_count") > 0, F.col(c)) for c in ("citation_candidate_ids", "matched_expected_ids")}
    out = queries.select("query_id").join(per_query, "query_id", "left").withColumns(lists)
    matched = F.coalesce(F.size("matched_expected_ids"), F.lit(0)).cast("long")
    n = F.coalesce("expected_count", F.lit(0))
    return out.select(
        "query_id", F.coalesce("result_count", F.lit(0)).alias("result_count"),
        (F.coalesce("result_count", F.lit(0)) > 0).alias("result_hit"),
        F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        "citation_candidate_ids", "matched_expected_ids", n.alias("expected_count"), matched.alias("matched_count"),
        (n - matched).alias("missed_count"), F.when(n > 0, matched > 0).alias("expected_hit"),
        F.when(n > 0, matched / n).alias("expected_coverage"),
    )


def missed_expectations(results: DataFrame, expected: DataFrame) -> DataFrame:
    found = results.select("query_id", citation_id(F.col("doc_id"), F.col("chunk_id")).alias("citation_candidate_id"))
    return expected.distinct().join(found, ["query_id", "citation_candidate_id"], "left_anti")


def evaluation_metrics(per_query: DataFrame) -> DataFrame:
    """One row of coverage figures over all queries."""
    n, hits = F.count("*"), F.count_if("result_hit")
    asked, right = F.count_if(F.col("expected_count") > 0), F.count_if(F.col("expected_hit"))
    result = F.when(n > 0, hits / n).otherwise(F.lit(0.0))
    wanted = F.when(asked > 0, right / asked)
    top = F.coalesce(F.sum(F.when(F.col("result_hit"), F.col("top_score").cast("decimal(20,10)"))).cast("double") / hits, F.lit(0.0))
    return per_query.agg(
        n.alias("query_count"), result.alias("result_coverage"), asked.alias("expected_query_count"),
        wanted.alias("expected_citation_coverage"), F.coalesce(wanted, result).alias("citation_coverage"),
        F.round(top, 6).alias("average_top_score"),
    )


def parse_queries(inputs: DataFrame) -> DataFrame:
    """Lines ``query | id,id`` to (query_id, query, expected ids); numbers keep the input position."""
    rows = inputs.select("input_id", F.posexplode(F.split("body", "\r?\n")).alias("pos", "line"))
    parts = F.split("line", r"\|")
    query = tx.clean_text(F.get(parts, F.lit(0)))
    ids = F.filter(F.transform(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), tx.clean_text), lambda x: x != "")
    return rows.select(
        "input_id", F.concat(F.lit("q"), (F.col("pos") + 1).cast("string")).alias("query_id"), query.alias("query"),
        ids.alias("expected_ids"),
    ).filter(F.col("query") != "")


SAME_TYPE, BASIS_TYPE = 0.15, 0.05  # what a rule of the text's own type, or of no particular one, adds to a score


def type_bonus() -> Column:
    return F.when(F.col("rule_type") == F.col("requirement_type"), SAME_TYPE).when(F.col("rule_type") == "basis_rule", BASIS_TYPE).otherwise(0.0)


def pair_score(shared: Column, bonus: Column | None = None) -> Column:
    """Share of a text's tokens, and what a rule's type and confidence add to it (0.25 at most); added in this order."""
    bonus = type_bonus() if bonus is None else bonus
    sure = F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 0.1
    return round4(F.least(F.lit(1.0), shared / F.col("query_size") + bonus + sure))


def match_scores(requirements: DataFrame, rules: DataFrame, carry: tuple = (), groups: int | None = None) -> DataFrame:
    """Score of every (requirement text, rule) pair that shares a token.

    ``requirements``: requirement_key, requirement_type, requirement_text (distinct texts, so a text that many
    notices repeat is scored once); ``rules``: rule_id, rule_type, rule_text, confidence.  ``groups``: see
    ``overlap.all_pairs``.
    """
    from bidlens.operators import overlap

    pairs = overlap.all_pairs(requirements, rules, carry, groups)
    return pairs.select("requirement_key", "rule_id", *carry, "shared", pair_score(F.col("shared"), F.col("bonus")).alias("score"))


def healthy_rules(rules: DataFrame, searchable: DataFrame, index: DataFrame) -> DataFrame:
    """Approved rules whose passage, document and index item agree and whose citation is their own."""
    own = citation_id(F.col("doc_id"), F.col("chunk_id"))
    approved = rules.filter((F.col("status") == "approved") & (F.col("citation_candidate_id") == own))
    passages = searchable.select("doc_id", "chunk_id", "vector_id", "chunk_hash")
    items = index.select("vector_id", "doc_id", "chunk_id", "chunk_hash")
    return approved.join(passages, ["doc_id", "chunk_id"]).join(items, ["vector_id", "doc_id", "chunk_id", "chunk_hash"])


def approved_topk(requirements: DataFrame, rules: DataFrame, k: int = 3) -> DataFrame:
    """Best approved rules per requirement text; newest rule first on equal scores.  ``rules`` cite their own passage
    and have rule_text, or its distinct ``tokens``."""
    from bidlens.operators import overlap

    columns = ("rule_id", "rule_type", "confidence", "tokens" if "tokens" in rules.columns else "rule_text", "updated_at", "doc_id", "chunk_id")
    best = overlap.topk(requirements, rules.select(*columns), [F.desc("updated_at"), F.desc("rule_id")], checked_k(k))
    return best.withColumn("citation_candidate_id", citation_id(F.col("doc_id"), F.col("chunk_id")))


def merge_citations(primary: DataFrame, fallback: DataFrame, k: int = 3) -> DataFrame:
    """Primary results first, then fallback; first of each citation id; k per requirement.

    Both inputs: requirement_key, rank, citation_candidate_id, doc_id, chunk_id, score, source_type, rule_id.
    """
    both = primary.withColumn("src", F.lit(0)).unionByName(fallback.withColumn("src", F.lit(1)))
    first = both.filter(F.col("citation_candidate_id") != "").groupBy("requirement_key", "citation_candidate_id").agg(
        F.min_by(F.struct("doc_id", "chunk_id", "score", "source_type", "rule_id", "src", "rank"), F.struct("src", "rank")).alias("r")
    )
    order = W.partitionBy("requirement_key").orderBy("r.src", "r.rank")
    return (
        first.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= checked_k(k))
        .select("requirement_key", "position", "citation_candidate_id", "r.doc_id", "r.chunk_id", "r.score", "r.source_type", "r.rule_id")
    )


def review_ready(rows: DataFrame) -> Column:
    return (
        (F.col("citation_candidate_id") != "") & F.col("doc_id").isNotNull() & F.col("chunk_id").isNotNull()
        & (round4(F.col("score")) >= fv.CITATION_MIN_SCORE)
    )


def with_readiness(rows: DataFrame, citations: DataFrame) -> DataFrame:
    """Rows with the counts of their requirement's citations and candidate_found, weak_candidate or missing."""
    counts = citations.groupBy("requirement_key").agg(
        F.count("*").alias("citation_count"), F.count_if(review_ready(citations)).alias("ready_count")
    )
    ready, n = F.coalesce("ready_count", F.lit(0)), F.coalesce("citation_count", F.lit(0))
    status = F.when(ready > 0, "candidate_found").when(n > 0, "weak_candidate").otherwise("missing")
    return rows.join(counts, "requirement_key", "left").withColumns({"citation_count": n, "ready_count": ready, "citation_status": status})


def citation_readiness(requirement_keys: DataFrame, citations: DataFrame) -> DataFrame:
    """Per requirement: candidate_found, weak_candidate or missing."""
    return with_readiness(requirement_keys.select("requirement_key"), citations)
