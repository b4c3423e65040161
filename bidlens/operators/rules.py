"""Rules mined from passages, and their review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx
from bidlens.functions.dictionaries import KOREAN, Dictionaries
from bidlens.operators import search as se

SCOPE = "procurement_readiness"
REVIEWED = ("approved", "rejected")
NOTE_CITATION = "재추출 결과 citation 후보가 변경되어 재검토 필요"
NOTE_VANISHED = "재추출 결과 현재 청크에서 같은 조건을 찾지 못해 재검토 필요"


def source_line_array(text: Column, d: Dictionaries = KOREAN, max_lines: int | None = None, line_chars: int | None = None) -> Column:
    """Lines with a keyword; a passage without one counts whole.  Both limits are for callers that show lines."""
    def wanted(line):
        return tx.contains_any(line, d.rule_keywords) | tx.let(F.lower(line), lambda low: tx.contains_any(low, d.rule_keywords))

    def of(text):
        picked = F.transform(tx.first_items(F.filter(tx.filled_lines(text), wanted), max_lines), lambda x: tx.first_chars(x, line_chars))
        whole = F.length(text) > 0 if line_chars is None else F.length(text).between(1, line_chars)
        return tx.let(picked, lambda p: F.when((F.size(p) == 0) & whole, F.array(text)).otherwise(p))

    return tx.let(text, of)


def source_lines(chunks: DataFrame, d: Dictionaries = KOREAN) -> DataFrame:
    """(…, pos, line): the lines of a passage that may state a rule.  Stays inside the row, no shuffle."""
    kept = [c for c in chunks.columns if c != "chunk_text"]
    return chunks.select(*kept, F.posexplode(source_line_array(tx.clean_text(F.col("chunk_text")), d)).alias("pos", "line"))


def region_terms(text: Column, d: Dictionaries = KOREAN) -> Column:
    """Canonical regions whose alias occurs, then every region-like word that is not a known false one."""
    words = F.filter(F.regexp_extract_all(text, F.lit(d.region_word), F.lit(0)), lambda w: ~w.isin(*d.region_false))
    return F.concat(labels(text, d.regions, {}), words)


def labels(text: Column, aliases: dict, shadowed: dict) -> Column:
    return tx.let(tx.compact_key(text), lambda c: tx.found_labels(c, aliases, shadowed))


def rule_types(line: Column, d: Dictionaries = KOREAN) -> Column:
    """Distinct rule types of a line, in detection order."""
    return tx.let(tx.compact_key(line), lambda compact: _types_of(line, compact, d))


def _types_of(line: Column, compact: Column, d: Dictionaries) -> Column:
    def flags(low):
        has = {
            "region": (F.size(tx.found_labels(compact, d.regions, {})) > 0)
            | (F.size(F.filter(F.regexp_extract_all(line, F.lit(d.region_word), F.lit(0)), lambda w: ~w.isin(*d.region_false))) > 0),
            "license": F.size(tx.found_labels(compact, d.licenses, d.shadowed)) > 0,
            "company_type": F.size(tx.found_labels(compact, d.companies, d.shadowed)) > 0,
            "required_document": F.size(tx.found_labels(compact, d.documents, d.shadowed)) > 0,
        }
        found = [F.when(cond, F.lit(name)) for name, cond in has.items()]
        found += [F.when(tx.contains_any(low, words), F.lit(name)) for name, words in d.lower_tokens.items()]
        found.append(F.when(tx.contains_any(line, d.modal) | tx.contains_any(low, d.modal_lower), F.lit("basis_rule")))
        return F.array_distinct(F.array_compact(F.array(*found)))

    return tx.let(F.lower(line), flags)


def company_evidence(found: Column, d: Dictionaries = KOREAN) -> Column:
    """Evidence for the company labels found in a text."""
    def holds(found, words):
        return F.exists(found, lambda x: tx.contains_any(x, words))

    def pick(found):
        out = F.when(F.lit(False), F.lit(""))
        for words, name in d.company_evidence:
            out = out.when(holds(found, words), name)
        return F.array(out.otherwise(fv.FALLBACK_EVIDENCE["company_type"]))

    return tx.let(found, pick)


def evidence_types(rule_type: Column, text: Column, d: Dictionaries = KOREAN) -> Column:
    """Evidence that proves a rule of a type."""
    return _evidence_of(rule_type, lambda aliases: labels(text, aliases, d.shadowed), d)


def _evidence_of(rule_type: Column, found, d: Dictionaries) -> Column:
    documents = tx.let(
        found(d.documents),
        lambda x: F.when(F.size(x) > 0, x).otherwise(tx.str_array([fv.FALLBACK_EVIDENCE["required_document"]])),
    )
    return (
        F.when(rule_type == "license", tx.str_array([fv.FALLBACK_EVIDENCE["license"]]))
        .when(rule_type == "region", tx.str_array([fv.FALLBACK_EVIDENCE["region"]]))
        .when(rule_type == "company_type", company_evidence(found(d.companies), d))
        .when(rule_type == "required_document", documents)
        .otherwise(tx.str_array([]))
    )


def profile_fields(type_: Column, table: dict = fv.RULE_PROFILE_FIELDS) -> Column:
    out = F.when(F.lit(False), tx.str_array([]))
    for name, fields in table.items():
        out = out.when(type_ == name, tx.str_array(fields))
    return out.otherwise(tx.str_array(fv.MANUAL_PROFILE_FIELDS))


def extraction_key(doc: Column, type_: Column, chunk_hash: Column, line_hash: Column) -> Column:
    return F.concat(
        F.lit("basis:"), doc.cast("string"), F.lit(":rule:"), type_, F.lit(":chunk_hash:"), chunk_hash, F.lit(":source:"), line_hash
    )


def line_rules(line: Column, d: Dictionaries = KOREAN) -> Column:
    """What a line states, as array<struct<rule_type, source_condition_hash, required_evidence_types>>; null for a line
    without letters and digits.  The line's compact text is made once."""
    def stated(compact):
        def rule(kind, condition):
            evidence = _evidence_of(kind, lambda aliases: tx.found_labels(compact, aliases, d.shadowed), d)
            return F.struct(kind.alias("rule_type"), condition.alias("source_condition_hash"), evidence.alias("required_evidence_types"))

        types, condition = _types_of(line, compact, d), F.substring(F.sha2(compact, 256), 1, 16)
        return F.when(compact != "", tx.let(condition, lambda hashed: F.transform(types, lambda kind: rule(kind, hashed))))

    return tx.let(tx.compact_key(line), stated)


def candidates(chunks: DataFrame, d: Dictionaries = KOREAN) -> DataFrame:
    """One row per (document, passage text, line, type).

    ``chunks``: doc_id, chunk_id, chunk_index, chunk_hash, chunk_text.  The extraction key holds passage hash and line
    hash, so one grouping on it removes repeats inside a passage and inside a document; the first place wins.  Passages
    meet by document before they are mined: they are smaller than what is mined from them.
    """
    lines = source_lines(chunks.select("doc_id", "chunk_id", "chunk_index", "chunk_hash", "chunk_text").repartition("doc_id"), d)
    typed = lines.select("*", F.posexplode(line_rules(F.col("line"), d)).alias("type_pos", "stated"))
    keyed = typed.select("*", "stated.*").drop("stated")
    keyed = keyed.withColumn(
        "extraction_key", extraction_key(F.col("doc_id"), F.col("rule_type"), F.col("chunk_hash"), F.col("source_condition_hash"))
    )
    place = F.struct("chunk_index", "pos", "type_pos")
    first = keyed.groupBy("doc_id", "rule_type", "source_condition_hash", "extraction_key").agg(
        F.min_by(F.struct("chunk_id", "chunk_index", "pos", "type_pos", "line", "required_evidence_types"), place).alias("r")
    )
    line = F.col("r.line")
    return first.select(
        "doc_id", F.col("r.chunk_id").alias("chunk_id"), F.col("r.chunk_index").alias("chunk_index"), F.col("r.pos").alias("pos"),
        F.col("r.type_pos").alias("type_pos"), "rule_type", line.alias("condition_text"), F.lit(SCOPE).alias("target_scope"),
        F.col("r.required_evidence_types").alias("required_evidence_types"),
        profile_fields(F.col("rule_type")).alias("related_profile_fields"),
        se.citation_id(F.col("doc_id"), F.col("r.chunk_id")).alias("citation_candidate_id"),
        F.when(F.col("rule_type") == "basis_rule", 0.58).otherwise(0.72).alias("confidence"),
        "source_condition_hash", "extraction_key", F.lit("needs_review").alias("status"),
    )


def ready_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents whose rules may be reconciled: completed, with at least one indexed passage."""
    indexed = chunks.filter((F.col("vector_status") == "indexed") & (F.col("vector_id") != ""))
    done = documents.filter((F.col("processing_status") == "completed") & (F.col("index_status") == "completed"))
    return done.join(indexed, "doc_id", "left_semi").select("doc_id")


def add_note(note: Column, text: str) -> Column:
    return F.when(F.coalesce(note, F.lit("")) == "", F.lit(text)).otherwise(F.concat(note, F.lit(" / " + text)))


def reconcile(generated: DataFrame, existing: DataFrame, ready: DataFrame) -> DataFrame:
    """Merge newly mined rules into the stored ones; one row per stored or new rule with its action.

    Rules meet on the extraction key; stored rules without one meet on (document, type, compact text, scope).  Of
    several stored rules with one key the oldest counts, the others are handled as vanished.  A rule id names one rule.
    """
    new_values = [
        "chunk_id", "condition_text", "citation_candidate_id", "confidence", "extraction_key",
    ]
    own = ["doc_id", "rule_type", "target_scope", *new_values, "status"]
    gen = generated.join(ready, "doc_id", "left_semi").select(
        *own, F.lit(None).cast("long").alias("rule_id"), F.lit("").alias("review_note"), F.lit(True).alias("new"),
        "chunk_index", "pos", "type_pos",
    )
    rows = gen.unionByName(existing.select(*own, "rule_id", "review_note", F.lit(False).alias("new")), allowMissingColumns=True)
    # one exchange: all that follows is within a document
    rows = rows.repartition("doc_id").withColumn("compact", tx.compact_key(F.col("condition_text")))
    new = F.col("new")

    def oldest(keyed, *keys):
        return F.min(F.when(~new & keyed, F.col("rule_id"))).over(W.partitionBy("doc_id", *keys))

    stable = oldest(F.col("extraction_key") != "", "extraction_key")
    legacy = oldest(F.col("extraction_key") == "", "rule_type", "target_scope", "compact")
    rows = rows.withColumns({"stable_id": stable, "legacy_id": legacy, "mined": F.max("new").over(W.partitionBy("doc_id"))})
    rows = rows.withColumn("met_id", F.when(new, F.coalesce("stable_id", "legacy_id")).otherwise(F.col("rule_id"))).drop("stable_id", "legacy_id", "compact")
    # several places may meet one legacy rule: the last one written stays
    last = F.max_by(F.struct(*new_values), F.when(new, F.struct("chunk_index", "pos", "type_pos", "extraction_key"))).over(W.partitionBy("doc_id", "met_id"))
    old = rows.withColumn("n", last).filter(~new | F.col("met_id").isNull())
    reviewed = F.col("status").isin(*REVIEWED)
    changed = (F.col("citation_candidate_id") != "") & (F.col("citation_candidate_id") != F.col("n.citation_candidate_id"))
    action = (
        F.when(new, "insert").when(~F.col("mined"), "keep")
        .when(F.col("n").isNotNull() & reviewed & changed, "revalidate_citation")
        .when(F.col("n").isNotNull() & reviewed, "update_source")
        .when(F.col("n").isNotNull(), "update")
        .when(reviewed, "revalidate_vanished")
        .when(F.col("status") != "archived", "delete")
        .otherwise("keep")
    )
    old = old.withColumn("action", action)
    act = F.col("action")
    again = act.startswith("revalidate")

    def value(name, when):
        return F.when(when, F.col(f"n.{name}")).otherwise(F.col(name)).alias(name)

    met = act.isin("revalidate_citation", "update_source", "update")
    return old.select(
        "rule_id", "doc_id", "rule_type", value("chunk_id", met), value("condition_text", act == "update"),
        F.when(again, "").when(act == "update", F.col("n.citation_candidate_id")).otherwise(F.col("citation_candidate_id"))
        .alias("citation_candidate_id"),
        value("confidence", act == "update"), value("extraction_key", met), F.when(again, "needs_review").otherwise(F.col("status")).alias("status"),
        F.when(act == "revalidate_citation", add_note(F.col("review_note"), NOTE_CITATION))
        .when(act == "revalidate_vanished", add_note(F.col("review_note"), NOTE_VANISHED)).otherwise(F.col("review_note")).alias("review_note"),
        "action",
    )


def reconcile_counts(actions: DataFrame) -> DataFrame:
    a = F.col("action")
    return actions.groupBy("doc_id").agg(
        F.count_if(a != "delete").alias("candidate_count"), F.count_if(a == "insert").alias("new_candidate_count"),
        F.count_if(a.startswith("update")).alias("updated_candidate_count"),
        F.count_if(a.startswith("revalidate")).alias("revalidation_candidate_count"), F.count_if(a == "delete").alias("deleted_candidate_count"),
    )


def approval_check(rules: DataFrame, documents: DataFrame, chunks: DataFrame, index: DataFrame) -> DataFrame:
    """First reason why a rule may not be approved; blank when it may."""
    docs = documents.select("doc_id", "processing_status", "index_status", F.lit(True).alias("doc_found"))
    passages = chunks.select("doc_id", "chunk_id", "vector_id", "vector_status", "chunk_hash")
    items = index.select(
        "vector_id", F.col("doc_id").alias("i_doc"), F.col("chunk_id").alias("i_chunk"), F.col("chunk_hash").alias("i_hash")
    )
    joined = rules.join(docs, "doc_id", "left").join(passages, ["doc_id", "chunk_id"], "left").join(items, "vector_id", "left")
    citation = tx.clean_text(F.col("citation_candidate_id"))
    cited_doc, cited_chunk = se.citation_parts(citation)
    done = (F.col("processing_status") == "completed") & (F.col("index_status") == "completed")
    reason = (
        F.when(tx.clean_text(F.col("condition_text")) == "", "condition_text_missing")
        .when(citation == "", "citation_missing")
        .when(cited_doc.isNull(), "citation_malformed")
        .when(cited_doc != F.col("doc_id"), "citation_other_document")
        .when(cited_chunk != F.col("chunk_id"), "citation_other_chunk")
        .when(F.col("doc_found").isNull(), "document_missing")
        .when(~done, "document_not_ready")
        .when(F.col("chunk_hash").isNull(), "chunk_missing")
        .when((F.col("vector_status") != "indexed") | (F.col("vector_id") == ""), "chunk_not_indexed")
        .when(F.col("i_doc").isNull(), "index_item_missing")
        .when(
            (F.col("i_doc") != F.col("doc_id")) | (F.col("i_chunk") != F.col("chunk_id")) | (F.col("i_hash") != F.col("chunk_hash")),
            "index_item_mismatch",
        )
        .otherwise("")
    )
    return joined.select(*rules.columns, reason.alias("reason"))


def apply_reviews(rules: DataFrame, edits: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """Apply review edits.  ``edits``: rule_id and any of new_status, new_text, new_note, reviewer, reviewed_at.

    Approving or rejecting stamps the review, reopening clears it, archiving keeps it.  Unknown states, and approvals of
    the rules in ``refused`` (rule_id, reason), leave the rule as it is and report an error.
    """
    rows = rules.join(edits, "rule_id", "left")
    if refused is not None:
        rows = rows.join(refused.filter(F.col("reason") != "").select("rule_id", "reason"), "rule_id", "left")
    else:
        rows = rows.withColumn("reason", F.lit(None).cast("string"))
    edited = F.col("new_status").isNotNull() | F.col("new_text").isNotNull() | F.col("new_note").isNotNull()
    target = F.coalesce("new_status", "status")
    error = (
        F.when(~target.isin(*fv.RULE_STATUSES), "unsupported_status")
        .when(edited & (target == "approved") & F.col("reason").isNotNull(), F.col("reason"))
        .otherwise("")
    )
    rows = rows.withColumn("error", error)
    ok = edited & (F.col("error") == "")
    changed = ok & (target != F.col("status"))
    who = F.coalesce(F.nullif(F.coalesce("reviewer", "reviewer_name"), F.lit("")), F.lit("local_admin"))
    return rows.select(
        "rule_id",
        F.when(ok, target).otherwise(F.col("status")).alias("status"),
        F.when(ok, F.coalesce("new_text", "condition_text")).otherwise(F.col("condition_text")).alias("condition_text"),
        F.when(ok, F.coalesce("new_note", "review_note")).otherwise(F.col("review_note")).alias("review_note"),
        F.when(changed & target.isin(*REVIEWED), F.col("reviewed_at")).when(changed & (target == "needs_review"), "")
        .otherwise(F.col("old_reviewed_at")).alias("reviewed_at"),
        F.when(changed & (target == "needs_review"), "")
        .when(changed & (target == "archived"), F.coalesce(F.nullif("reviewer_name", F.lit("")), who))
        .when(ok, who).otherwise(F.col("reviewer_name")).alias("reviewer_name"),
        "error",
    )


def revalidate_documents(rules: DataFrame, documents: DataFrame, note: str) -> DataFrame:
    """Rules of reprocessed documents go back to review: citation cleared, note appended."""
    touched = documents.select("doc_id").distinct().withColumn("touched", F.lit(True))
    hit = F.col("touched").isNotNull()
    return rules.join(touched, "doc_id", "left").withColumns(
        {
            "status": F.when(hit, "needs_review").otherwise(F.col("status")),
            "citation_candidate_id": F.when(hit, "").otherwise(F.col("citation_candidate_id")),
            "review_note": F.when(hit, add_note(F.col("review_note"), note)).otherwise(F.col("review_note")),
        }
    ).drop("touched")


def rule_filter(rules: DataFrame, doc_id=None, status="", rule_type="", keyword="") -> DataFrame:
    out = rules
    for column, value in (("doc_id", doc_id), ("status", status), ("rule_type", rule_type)):
        if value:
            out = out.filter(F.col(column) == value)
    if keyword:
        low = keyword.lower()
        out = out.filter(tx.any_of(F.lower(c).contains(low) for c in ("condition_text", "target_scope", "citation_candidate_id")))
    return out


def rule_list(rules: DataFrame, limit: int = 0, offset: int = 0, **filters) -> DataFrame:
    """Newest first; a page of at most 500 (the total is a count of ``rule_filter``)."""
    out = rule_filter(rules, **filters).orderBy(F.desc("rule_id"))
    return out.offset(max(offset, 0)).limit(limit) if limit > 0 else out


def rule_detail(rules: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    own = se.citation_id(F.col("doc_id"), F.col("chunk_id"))
    docs = documents.select("doc_id", "category", "document_version")
    passages = chunks.select("doc_id", "chunk_id", "section_title", F.substring("chunk_text", 1, 500).alias("text_preview"))
    return rules.join(docs, "doc_id", "left").join(passages, ["doc_id", "chunk_id"], "left").withColumns(
        {"expected_citation_candidate_id": own, "citation_candidate_valid": F.col("citation_candidate_id") == own}
    )


def status_counts(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in fv.RULE_STATUSES]
    )
