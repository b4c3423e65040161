"""Judgment runs: status, citations, suggestions and the guide drawn from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx
from bidlens.operators import search as se

RUN = ["notice_id", "company_id"]
UNMET = ["missing", "needs_review", "uncertain"]


def judged(status: Column) -> Column:
    return (
        F.when(status == "prepared", "matched").when(status.isin("possibly_missing", "not_found"), "missing")
        .when(status == "needs_review", "needs_review").otherwise("uncertain")
    )


def action_text(status: Column, value: Column, label: Column, evidence: Column, cited: Column) -> Column:
    what = F.coalesce(F.nullif(value, F.lit("")), F.nullif(label, F.lit("")), F.lit("요구조건"))
    listed = F.array_join(evidence, ", ")
    return (
        F.when((status == "matched") & cited, "보유 정보와 일치하는 후보가 있습니다. 기준문서 근거와 원문을 검토해 확인하세요.")
        .when(status == "matched", "보유 정보는 일치하지만 기준문서 근거 후보가 부족합니다. 원문 근거를 추가 확인하세요.")
        .when(
            (status == "missing") & (listed != ""),
            F.concat(what, F.lit(" 조건을 충족할 증빙("), listed, F.lit(")을 준비하거나 법인 프로필을 보완하세요.")),
        )
        .when(status == "missing", F.concat(what, F.lit(" 조건을 충족하는 법인 정보 또는 증빙을 확인하세요.")))
        .when(
            status == "needs_review",
            F.concat(what, F.lit(" 항목은 자동 비교만으로 결론을 내리기 어렵습니다. 공고 원문과 기준문서 후보를 함께 검토하세요.")),
        )
        .when(~cited, "관련 기준문서 근거 후보가 부족합니다. 기준문서 검색 품질을 먼저 확인하세요.")
        .otherwise("검토가 필요한 항목입니다.")
    )


def requirement_text(items: DataFrame) -> Column:
    return F.concat_ws(" ", "required_value", "source_text", F.array_join("required_evidence_types", " "))


def with_text_key(items: DataFrame) -> DataFrame:
    """Adds the text a requirement is cited by, and a key of (type, text)."""
    text = requirement_text(items)
    return items.withColumn("requirement_text", text).withColumn(
        "requirement_key", F.sha2(F.concat_ws("\x01", "requirement_type", "requirement_text"), 256)
    )


def texts_of(items: DataFrame) -> DataFrame:
    return items.select("requirement_key", "requirement_type", "requirement_text").distinct()


def citations(texts: DataFrame, rules: DataFrame, search: Callable[[DataFrame, int], DataFrame], k: int = 3) -> DataFrame:
    """Up to k citations per distinct requirement text.

    Approved rules first.  Only texts without a ready rule citation go to the passage search, so the search side
    shrinks to what is still open.  ``search(queries, k)`` gives the best passages of (query_id, query) rows.
    """
    columns = ["requirement_key", "rank", "citation_candidate_id", "doc_id", "chunk_id", "score", "source_type", "rule_id"]
    primary = se.approved_topk(texts, rules, k).withColumn("source_type", F.lit("approved_rule_candidate")).select(*columns)
    ready = primary.filter(se.review_ready(primary)).select("requirement_key").distinct()
    still_open = texts.join(ready, "requirement_key", "left_anti")
    queries = still_open.select(F.col("requirement_key").alias("query_id"), F.col("requirement_text").alias("query"))
    fallback = search(queries, k).select(
        F.col("query_id").alias("requirement_key"), "rank",
        se.citation_id(F.col("doc_id"), F.col("chunk_id")).alias("citation_candidate_id"), "doc_id", "chunk_id",
        se.round4(F.col("score")).alias("score"), F.lit("basis_search").alias("source_type"), F.lit(None).cast("long").alias("rule_id"),
    )
    return se.merge_citations(primary, fallback, k)


class Memo:
    """Citations by requirement text, stored for one version of the rules and passages.

    A row is a text that was cited, with its citations, none included.  A run cites only texts that no run before it did
    and appends them; over unchanged texts and rules it reads no passage.  Runs that cite the same text at once store it
    twice, and alike.
    """

    CITATION = "position: int, citation_candidate_id: string, doc_id: long, chunk_id: long, score: double, source_type: string, rule_id: long"

    def __init__(self, spark: SparkSession, path: str, version: str):
        self.spark, self.path = spark, f"{path}/version={version}"

    def rows(self) -> DataFrame:
        schema = f"requirement_key string, citations array<struct<{self.CITATION}>>"
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).dropDuplicates(["requirement_key"])

    def cite_new(self, texts: DataFrame, cite: Callable[[DataFrame], DataFrame]) -> bool:
        """Cites the texts that are not in the memo; whether there were any."""
        fresh = texts.join(self.rows().select("requirement_key"), "requirement_key", "left_anti")
        if fresh.isEmpty():
            return False
        found = cite(fresh).groupBy("requirement_key").agg(
            F.array_sort(F.collect_list(F.struct("position", "citation_candidate_id", "doc_id", "chunk_id", "score", "source_type", "rule_id"))).alias("citations")
        )
        fresh.select("requirement_key").join(found, "requirement_key", "left").write.mode("append").parquet(self.path)
        return True

    def citations(self) -> DataFrame:
        """One row per citation."""
        return self.rows().select("requirement_key", F.explode("citations").alias("c")).select("requirement_key", "c.*")


def judgment_items(compared: DataFrame, memo: Memo) -> tuple[DataFrame, DataFrame]:
    """(items, citations).

    ``compared``: comparison items with required_evidence_types and their text key.  Citations depend on the requirement
    text alone, so they are found once per distinct text, however many notices and runs repeat it, and joined back.  The
    citations are those of the whole memo: a few rows a text, whatever the number of items.
    """
    cited = memo.citations()
    rows = se.with_readiness(compared, cited).withColumn("match_status", judged(F.col("status")))
    ready = F.col("ready_count") > 0
    rows = rows.withColumns(
        {
            "review_evidence_ready": ready,
            "recommended_action": action_text(
                F.col("match_status"), F.col("required_value"), F.col("label"), F.col("required_evidence_types"), ready
            ),
        }
    )
    return rows, cited


def judgment_summary(items: DataFrame) -> DataFrame:
    n = F.count("*")
    return items.groupBy(*RUN).agg(
        n.alias("requirement_count"), *[F.count_if(F.col("match_status") == s).alias(f"{s}_count") for s in fv.JUDGMENT_STATUSES],
        (F.count_if("review_evidence_ready") / n).alias("citation_coverage"),
    )


def sanitize_suggestions(suggestions: DataFrame, items: DataFrame) -> DataFrame:
    """Suggestions for known items with an allowed state; confidence inside 0..1."""
    known = suggestions.join(items.select("requirement_id"), "requirement_id", "left_semi")
    sure = F.least(F.greatest(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    status = tx.clean_text(F.col("suggested_status"))
    return known.filter(status.isin(*fv.SUGGESTION_STATUSES)).select(
        "requirement_id", status.alias("suggested_status"), sure.alias("confidence"),
        tx.display_copy(F.col("suggested_reason")).alias("suggested_reason"),
    )


def merged_status(rule: Column, suggested: Column, sure: Column, matched_value: Column, cited: Column) -> tuple[Column, Column]:
    """Final status and where it comes from (outside suggestions never create a match without local proof)."""
    local = (rule == "matched") | ((tx.clean_text(matched_value) != "") & cited)
    allowed = F.coalesce(suggested, F.lit("")).isin(*fv.SUGGESTION_STATUSES)
    soft = suggested.isin("needs_review", "uncertain")
    cases = [
        (~allowed, rule, "fallback"),
        ((sure >= fv.SUGGESTION_TAKE) & (suggested == "matched") & ~local, F.lit("needs_review"), "gemini_assisted"),
        (sure >= fv.SUGGESTION_TAKE, suggested, "gemini_weighted"),
        (sure < fv.SUGGESTION_REVIEW, rule, "deterministic"),
        ((rule == "matched") & (suggested != "matched"), F.lit("needs_review"), "gemini_assisted"),
        (rule == "matched", F.lit("matched"), "gemini_assisted"),
        (suggested == "matched", rule, "deterministic"),
        (rule.isin("missing", "needs_review", "uncertain") & soft, F.lit("needs_review"), "gemini_assisted"),
        (rule.isin("needs_review", "uncertain") & (suggested == "missing"), F.lit("missing"), "gemini_assisted"),
    ]
    status, source = F.when(F.lit(False), rule), F.when(F.lit(False), F.lit(""))
    for cond, final, origin in cases:
        status, source = status.when(cond, final), source.when(cond, origin)
    return status.otherwise(rule), source.otherwise("deterministic")


def merge_suggestions(items: DataFrame, suggestions: DataFrame) -> DataFrame:
    rows = items.join(suggestions, "requirement_id", "left")
    sure = F.coalesce("confidence", F.lit(0.0))
    final, source = merged_status(
        F.col("match_status"), F.col("suggested_status"), sure, F.col("matched_value"), F.col("review_evidence_ready")
    )
    return rows.withColumns({"final_status": final, "status_source": source, "suggestion_confidence": sure}).drop("confidence")


def finished(items: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Items after the suggestions: ``match_status`` is the final one, action and reason follow it.

    Summary, guide, groups and links are built from these.  The rule's own state stays in ``deterministic_status``.
    """
    rows = merge_suggestions(items, suggestions).withColumnRenamed("match_status", "deterministic_status").withColumnRenamed("final_status", "match_status")
    led = F.col("status_source").isin("gemini_assisted", "gemini_weighted")
    return rows.withColumns({
        "recommended_action": action_text(
            F.col("match_status"), F.col("required_value"), F.col("label"), F.col("required_evidence_types"), F.col("review_evidence_ready")
        ),
        "gap_reason": F.when(led, F.coalesce("suggested_reason", F.lit(""))).otherwise(F.lit("")),
    })


def risk_notes(summary: DataFrame) -> DataFrame:
    """(run, position, note) of a judgment summary."""
    review = F.col("needs_review_count") + F.col("uncertain_count") > 0
    notes = F.array_compact(F.array(
        F.when(review, F.struct(F.lit(1).alias("position"), F.lit(fv.RISK_REVIEW).alias("note"))),
        F.when((F.col("requirement_count") > 0) & (F.col("citation_coverage") < 1), F.struct(F.lit(2).alias("position"), F.lit(fv.RISK_COVERAGE).alias("note"))),
    ))
    return summary.select(*RUN, F.explode(notes).alias("n")).select(*RUN, "n.position", "n.note")


def preparation_guide(items: DataFrame) -> DataFrame:
    """Rows (run, kind, position, value): documents, actions and notes of a run, the first of each key.

    ``items`` carry ``item_pos``, their order in the run.  The guide stays rows, whatever the size of a run.
    """
    def entry(at, kind, value, key):
        return F.struct(at.cast("int").alias("sub_pos"), F.lit(kind).alias("kind"), value.alias("value"), key.alias("key"))

    action = tx.display_copy(F.col("recommended_action"))
    about = F.concat_ws(" / ", "label", "required_value")
    note = (
        F.when(F.col("citation_status") == "missing", F.concat(about, F.lit(": 기준문서 근거 후보가 없습니다.")))
        .when(F.col("citation_status") == "weak_candidate", F.concat(about, F.lit(": 기준문서 근거 후보 점수가 낮아 원문 검토가 필요합니다.")))
    )
    unmet, none = F.col("match_status").isin(*UNMET), F.lit(0)
    # one list an item, so that the items, which are joined from several tables, are read once
    listed = [
        F.when(unmet, F.transform("required_evidence_types", lambda v, i: entry(i, "document", tx.clean_text(v), tx.compact_key(v)))),
        F.when(unmet, F.array(entry(none, "action", action, action))),
        F.when(note.isNotNull(), F.array(entry(none, "note", tx.display_copy(note), note))),
    ]
    entries = F.concat(*[F.coalesce(e, F.array().cast("array<struct<sub_pos:int,kind:string,value:string,key:string>>")) for e in listed])
    rows = items.select(*RUN, "item_pos", F.explode(entries).alias("e")).select(*RUN, "item_pos", "e.*").filter(F.col("key") != "")
    place = ("item_pos", "sub_pos")
    return rows.groupBy(*RUN, "kind", "key").agg(F.min(F.struct(*place, "value")).alias("r")).select(
        *RUN, "kind", F.col("r.item_pos").alias("item_pos"), F.col("r.sub_pos").alias("sub_pos"), F.col("r.value").alias("value")
    )


def priority_group(type_: Column, text: Column, groups=None) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, kind, words in groups or fv.PRIORITY_GROUPS:
        conds = ([type_ == kind] if kind else []) + ([tx.contains_any(text, words)] if words else [])
        out = out.when(tx.any_of(conds), name)
    return out.otherwise(fv.PRIORITY_GROUP_OTHER)


def priority_groups(items: DataFrame, status: str = "match_status", unmet=tuple(UNMET), groups=None) -> DataFrame:
    """Unmet items by kind of work: count, first item with its documents, reason and next step, ids in order."""
    text = F.concat_ws(" ", "label", "required_value", "source_text")
    rows = items.filter(F.col(status).isin(*unmet)).withColumn("priority_group", priority_group(F.col("requirement_type"), text, groups))
    rows = rows.repartition(*RUN)  # groups and their order are both of a run
    head = F.struct("item_pos", "requirement_id", "recommended_action", "gap_reason", "required_evidence_types")
    first = rows.groupBy(*RUN, "priority_group").agg(
        F.count("*").alias("item_count"), F.min_by(head, F.col("item_pos")).alias("f"),
        F.transform(F.array_sort(F.collect_list(F.struct("item_pos", "requirement_id"))), lambda x: x["requirement_id"]).alias("related_ids"),  # of one run
    ).select(
        *RUN, "priority_group", "item_count", F.col("f.item_pos").alias("first_pos"), F.col("f.requirement_id").alias("first_requirement"),
        tx.display_copy(F.col("f.recommended_action")).alias("next_step"), F.col("f.gap_reason").alias("reason"),
        F.col("f.required_evidence_types").alias("documents"), "related_ids",
    )
    order = F.row_number().over(W.partitionBy(*RUN).orderBy("first_pos"))
    return first.withColumn("position", order)


def headline(prepared: Column, missing: Column, review: Column, not_found: Column) -> Column:
    h = fv.HEADLINES
    return (
        F.when((missing > 0) | (not_found > 0), h["missing"]).when(review > 0, h["review"]).when(prepared > 0, h["ready"]).otherwise(h["other"])
    )


def evidence_links(items: DataFrame, evidence: DataFrame, citations: DataFrame, runs: DataFrame) -> DataFrame:
    """What a result rests on: the company's certificates, newest first, then each item's requirement and its citations."""
    latest = F.row_number().over(W.partitionBy("company_id").orderBy(F.desc("updated_at"), F.desc("evidence_id")))
    certificates = evidence.withColumn("sub_pos", latest).select(
        "company_id", F.lit("corporation_evidence").alias("link_type"), F.col("evidence_id").cast("string").alias("ref_id"), "sub_pos"
    ).join(runs, "company_id").withColumn("item_pos", F.lit(-1).cast("long"))
    needs = items.select(
        *RUN, F.lit("notice_requirement").alias("link_type"), F.col("requirement_id").cast("string").alias("ref_id"),
        F.lit(0).alias("sub_pos"), "item_pos",
    )
    cited = items.select(*RUN, "requirement_key", "item_pos").join(citations, "requirement_key").select(
        *RUN, F.lit("basis_chunk").alias("link_type"), F.concat_ws(":", "doc_id", "chunk_id").alias("ref_id"),
        F.col("position").alias("sub_pos"), "item_pos",
    )
    rows = certificates.unionByName(needs).unionByName(cited).repartition(*RUN)  # first rows and their order are both of a run
    first = rows.groupBy(*RUN, "link_type", "ref_id").agg(F.min(F.struct("item_pos", "sub_pos")).alias("at"))
    order = F.row_number().over(W.partitionBy(*RUN).orderBy("at", "link_type", "ref_id"))
    return first.withColumn("position", order).drop("at")


def action_items(actions: DataFrame, items: DataFrame) -> DataFrame:
    """Items behind an action: those it names, else those of the state its words point at.

    ``actions``: run, action_id, action_text, related_ids (array, may be empty).
    """
    named = actions.filter(F.size("related_ids") > 0).select(*RUN, "action_id", F.explode("related_ids").alias("requirement_id"))
    by_id = named.distinct().join(items.select(*RUN, "requirement_id"), [*RUN, "requirement_id"]).select(*RUN, "action_id", "requirement_id")
    text = F.col("action_text")
    states = (
        F.when(tx.contains_any(text, fv.ACTION_REVIEW_WORDS), tx.str_array(["needs_review", "uncertain"]))
        .when(tx.contains_any(text, fv.ACTION_MISSING_WORDS), tx.str_array(["missing"]))
    )
    by_word = actions.filter(F.size("related_ids") == 0).select(*RUN, "action_id", F.explode(states).alias("match_status"))
    by_state = by_word.join(items.select(*RUN, "requirement_id", "match_status"), [*RUN, "match_status"])
    return by_id.unionByName(by_state.select(*RUN, "action_id", "requirement_id"))
