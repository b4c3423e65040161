"""Notices matched against companies: does a profile value meet a requirement?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx
from bidlens.functions.dictionaries import KOREAN, Dictionaries

MIN_CONTAINED = 5


def region_names(compact: Column, value: Column, d: Dictionaries) -> Column:
    """``region_keys`` of a value whose compact key is at hand."""
    words = F.transform(F.regexp_extract_all(tx.clean_text(value), F.lit(d.region_word), F.lit(0)), tx.compact_key)
    return F.array_distinct(F.filter(F.concat(tx.found_labels(compact, d.regions, {}), words, F.array(compact)), lambda k: k != ""))


def region_keys(value: Column, d: Dictionaries = KOREAN) -> Column:
    """Keys under which a region is equal to another: canonical names, region words, the whole value."""
    return tx.let(tx.compact_key(value), lambda c: region_names(c, value, d))


def group_of(compact: Column, aliases: dict) -> Column:
    """``group_key`` of a compact key."""
    out = F.when(F.lit(False), F.lit(""))
    for label, names in aliases.items():
        keys = [k for k in map(tx.alias_key, [label, *names]) if k]
        out = out.when(tx.contains_any(compact, keys), label)
    return out.otherwise("")


def group_key(value: Column, aliases: dict) -> Column:
    """First dictionary label that is contained, by itself or by an alias; blank when none is."""
    return tx.let(tx.compact_key(value), lambda c: group_of(c, aliases))


def typed_group(type_: Column, compact: Column, d: Dictionaries = KOREAN) -> Column:
    return (
        F.when(type_ == "license", group_of(compact, d.licenses))
        .when(type_ == "company_type", group_of(compact, d.companies))
        .when(type_ == "required_document", group_of(compact, d.documents)).otherwise("")
    )


def match_marks(type_: Column, value: Column, d: Dictionaries = KOREAN) -> Column:
    """What two values of a type are compared by: key, null if blank; long, the key from MIN_CONTAINED characters on; label,
    that of the dictionary if there is one; regions, the names of a region, null for the other types."""
    return tx.let(tx.compact_key(value), lambda c: F.struct(
        F.nullif(c, F.lit("")).alias("key"), F.when(F.length(c) >= MIN_CONTAINED, c).alias("long"),
        F.nullif(typed_group(type_, c, d), F.lit("")).alias("label"), F.when((type_ == "region") & (c != ""), region_names(c, value, d)).alias("regions"),
    ))


def profile_lists(profile: DataFrame, d: Dictionaries = KOREAN) -> DataFrame:
    """One row per company and type: its values in order, with the marks of each."""
    listed = profile.groupBy("company_id", "requirement_type").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("values"))
    type_ = F.col("requirement_type")

    def marked(v):
        return tx.let(match_marks(type_, v["value"], d), lambda m: F.struct(
            v["pos"].alias("pos"), v["value"].alias("value"), m["key"].alias("key"), m["label"].alias("label"), m["regions"].alias("regions")
        ))

    return listed.withColumn("values", F.transform("values", marked))


def _meets(a: Column, v: Column) -> Column:
    """Whether a demand that is no region is met by a value: an equal label or key, or a key of MIN_CONTAINED characters
    inside the other.  Nulls meet nothing; what costs least is asked first."""
    inside = v["key"].contains(a["long"]) | (a["long"].contains(v["key"]) & (F.length(v["key"]) >= MIN_CONTAINED))
    return (v["key"] == a["key"]) | (v["label"] == a["label"]) | inside


def with_first_match(demands: DataFrame, profile: DataFrame, d: Dictionaries = KOREAN) -> DataFrame:
    """Demands with the first profile value that meets them: match_pos and matched_value, null where none does, and has_values.

    A demand meets the list of its company and type, so that a row a demand is all that moves, whatever its length; the
    list is the company's own.
    """
    type_, value = F.col("requirement_type"), F.col("required_value")
    listed = demands.join(profile_lists(profile, d), ["company_id", "requirement_type"], "left")

    def first(a):
        met = F.when(type_ == "region", F.filter("values", lambda v: F.arrays_overlap(a["regions"], v["regions"]))).otherwise(F.filter("values", lambda v: _meets(a, v)))
        return F.get(met, F.lit(0))

    hit = tx.let(match_marks(type_, value, d), first)
    rows = listed.withColumns({"hit": F.when(F.col("values").isNotNull(), hit), "has_values": F.col("values").isNotNull()}).drop("values")
    return rows.withColumns({"match_pos": F.col("hit.pos"), "matched_value": F.col("hit.value")}).drop("hit")


def first_matches(demands: DataFrame, profile: DataFrame, d: Dictionaries = KOREAN) -> DataFrame:
    """First profile value that meets each demand; demands that none meets are left out.

    ``demands``: distinct (company_id, requirement_type, required_value); ``profile``: company_id, requirement_type,
    pos, value.  Output: the demand with match_pos and matched_value.
    """
    return with_first_match(demands, profile, d).filter(F.col("match_pos").isNotNull()).drop("has_values")


def compare(requirements: DataFrame, pairs: DataFrame, profile: DataFrame, d: Dictionaries = KOREAN) -> DataFrame:
    """Status of every requirement of a notice for each company it is to be compared with.

    ``pairs`` (notice_id, company_id) are the requested comparisons.
    """
    items = requirements.join(pairs, "notice_id").withColumn("required_value", tx.clean_text(F.col("required_value")))
    rows = with_first_match(items, profile.filter(~F.col("requirement_type").isin(*fv.MANUAL_TYPES)), d)
    status = (
        F.when(F.col("requirement_type").isin(*fv.MANUAL_TYPES), "needs_review")
        .when(~F.col("has_values"), "not_found")
        .when(F.col("match_pos").isNotNull(), "prepared").otherwise("possibly_missing")
    )
    reason = (
        F.when(status == "needs_review", "자동 비교만으로 판단하기 어려운 항목입니다. 원문과 법인 보유 자료를 함께 확인해야 합니다.")
        .when(status == "not_found", "비교할 법인 프로필 또는 승인 증빙 정보가 아직 충분하지 않습니다.")
        .when(status == "prepared", F.concat(F.lit("법인 프로필 또는 승인 증빙에서 '"), "matched_value", F.lit("' 값을 찾았습니다.")))
        .otherwise(F.concat(F.lit("법인 정보에서 '"), "required_value", F.lit("'와 직접 일치하는 준비 항목을 찾지 못했습니다.")))
    )
    return rows.withColumns({"status": status, "reason": reason, "matched_value": F.coalesce("matched_value", F.lit(""))}).drop(
        "has_values", "match_pos"
    )


def summarize(items: DataFrame) -> DataFrame:
    return items.groupBy("notice_id", "company_id").agg(
        F.count("*").alias("requirement_count"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in fv.COMPARISON_STATUSES],
    )


def comparison_view(summaries: DataFrame, notices: DataFrame, companies: DataFrame) -> DataFrame:
    """Comparisons with their notice and company; either may be gone."""
    return summaries.join(notices, "notice_id", "left").join(companies, "company_id", "left")


def changed_companies(before: DataFrame, after: DataFrame, watched=fv.WATCHED_COMPANY_FIELDS) -> DataFrame:
    """Companies of which a watched field changed (null-safe)."""
    fields = [c for c in watched if c in before.columns and c in after.columns]
    old = before.select("company_id", F.struct(*fields).alias("old"))
    new = after.select("company_id", F.struct(*fields).alias("new"))
    return old.join(new, "company_id").filter(~F.col("old").eqNullSafe(F.col("new"))).select("company_id")


def invalidate_dependents(dependents: DataFrame, changed: DataFrame) -> DataFrame:
    return dependents.join(changed, "company_id", "left_anti")
