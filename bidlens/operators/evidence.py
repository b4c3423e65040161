"""Certificates: their type, the fields read from them, and what becomes of the fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import evidence_types as et
from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx
from bidlens.operators.profiles import registration_keys

SEPARATORS = "[,/·ㆍ]"


# ---- classification --------------------------------------------------------------------------------------
def _rule(mode: str, tests, low: Column, compact: Column) -> Column:
    if mode == "text":
        return tx.contains_any(low, [w.lower() for w in tests])
    def alternative(words):
        return tx.all_of(
            tx.contains_any(compact, w) if isinstance(w, tuple) else compact.contains(w) for w in words
        )

    return tx.any_of(alternative(words) for words in tests)


def classify(text: Column, file_name: Column, rules=None) -> Column:
    """struct(document_type, confidence): first rule that holds.  The file name counts as text."""
    low = F.lower(F.concat_ws("\n", F.coalesce(file_name, F.lit("")), F.coalesce(text, F.lit(""))))

    def pick(s):
        out = F.when(F.lit(False), F.struct(F.lit("").alias("document_type"), F.lit(0.0).alias("confidence")))
        for kind, sure, mode, tests in rules or et.CLASSIFICATION:
            out = out.when(
                _rule(mode, tests, s["low"], s["compact"]), F.struct(F.lit(kind).alias("document_type"), F.lit(sure).alias("confidence"))
            )
        return out.otherwise(F.struct(F.lit("unknown").alias("document_type"), F.lit(0.0).alias("confidence")))

    return tx.let(low, lambda x: tx.let(F.struct(x.alias("low"), tx.space_compact(x).alias("compact")), pick))


def status(documents: DataFrame, rules=None) -> DataFrame:
    """Type, confidence and state of each certificate; a requested type other than auto is taken as it is."""
    added = ("document_type", "classification_confidence", "first_status")
    rows = documents.drop(*added).withColumn("text", tx.evidence_normalize(F.col("text")))
    manual = ~F.coalesce("requested_type", F.lit("")).isin("", "auto")

    def decided(c):
        kind = F.when(manual, F.col("requested_type")).otherwise(c["document_type"])
        sure = F.when(manual, F.greatest(c["confidence"], F.lit(0.8))).otherwise(c["confidence"])
        first = F.when(manual, "manual").when(c["document_type"] != "unknown", "classified").otherwise("needs_review")
        return F.struct(*[value.alias(name) for name, value in zip(added, (kind, sure, first))])

    # rows of a generator: a filter on the type stays above it, so that no certificate is classified twice or in the scan
    found = F.transform(F.array(classify(F.col("text"), F.col("file_name"), rules)), decided)
    return rows.select("*", F.inline(found))


def final_status(rows: DataFrame) -> Column:
    """``rows`` need first_status, text, document_type and candidate_count."""
    kind = F.col("document_type")
    known = kind.isin(*et.KINDS)
    empty = (F.col("candidate_count") == 0) & ~kind.isin(*et.REGISTRATION_KINDS)
    return F.when((F.col("text") == "") | ~known | empty, "needs_review").otherwise(F.col("first_status"))


# ---- values after labels ------------------------------------------------------------------------------------
def label_pattern(label: str) -> str:
    return rf"{tx.WS}*".join(re.escape(ch) for ch in re.sub(r"\s+", "", label))


def value_after_label(lines: Column, labels, continuation: bool = False) -> Column:
    """Rest of the first line that holds any of the labels; '' when none does.

    Label letters may be spaced, a bracketed remark and a colon may follow.  With ``continuation`` up to two more lines
    are taken until one holds a stop label.
    """
    def found(line):
        out = F.when(F.lit(False), F.lit(""))
        for label in labels:
            pattern = rf"(?i){label_pattern(label)}{tx.WS}*(?:\([^)]*\))?{tx.WS}*[:：]?{tx.WS}*(.*)$"
            out = out.when(line.rlike(pattern), tx.clean_text(F.regexp_extract(line, pattern, 1)))
        return out

    hits = F.filter(
        F.transform(lines, lambda line, i: F.struct(found(line).alias("v"), i.alias("i"))), lambda h: h["v"].isNotNull()
    )
    def finish(h):
        if not continuation:
            return F.coalesce(h["v"], F.lit(""))

        def stops(line):
            return line.isNull() | tx.contains_any(tx.space_compact(line), et.STOP_LABELS)

        one, two = F.get(lines, h["i"] + 1), F.get(lines, h["i"] + 2)
        more = F.when(stops(one), tx.str_array([])).when(stops(two), F.array(one)).otherwise(F.array(one, two))
        parts = F.filter(F.transform(F.concat(F.array(h["v"]), more), tx.clean_text), lambda p: p != "")
        return F.coalesce(F.array_join(parts, " "), F.lit(""))

    return tx.let(F.get(hits, F.lit(0)), finish)


def strip_after(value: Column, labels) -> Column:
    out = value
    for label in labels:
        out = F.regexp_replace(out, rf"(?s){label_pattern(label)}.*$", "")
    return tx.clean_text(out)


def pattern_value(text: Column, pattern: str) -> Column:
    return tx.clean_text(F.regexp_extract(text, "(?i)" + pattern, 1))


def words_pattern(words, shape: str) -> str:
    """Any of the words, a colon at will, and what has the shape; blanks of a word may be missing or more."""
    return f"(?:{'|'.join(w.replace(' ', r'\s*') for w in words)})" + rf"\s*[:：]?\s*({shape})"


def field(key: str, value: Column, sure: float, source: Column | None = None, when: Column | None = None) -> Column:
    cleaned = tx.clean_value(value)
    row = F.struct(
        F.lit(key).alias("field_key"), F.lit(et.FIELD_LABELS[key]).alias("field_label"), cleaned.alias("extracted_value"),
        F.lit(sure).alias("confidence"), F.coalesce(F.nullif(source if source is not None else cleaned, F.lit("")), cleaned).alias("source_text"),
    )
    return row if when is None else F.when(when, row)


def explode_fields(rows: DataFrame, fields: list[Column] | Column) -> DataFrame:
    """One row per filled field (rows of ``field``); a (field, value) of a document counts once, at its first place."""
    def keep(listed):
        keys = F.transform(listed, lambda f: F.concat_ws("\x01", f["field_key"], f["extracted_value"]))
        return tx.let(
            F.struct(listed.alias("f"), keys.alias("k")),
            lambda s: F.filter(
                s["f"], lambda f, i: (f["extracted_value"] != "") & (F.array_position(s["k"], F.get(s["k"], i)) == i + 1)
            ),
        )

    listed = tx.let(fields if isinstance(fields, Column) else F.array_compact(F.array(*fields)), keep)
    return rows.select("evidence_id", F.posexplode(listed).alias("pos", "f")).select("evidence_id", "pos", "f.*")


def registration_fields(documents: DataFrame) -> DataFrame:
    """Candidate fields of registration certificates (evidence_id, text)."""
    text = F.col("text")
    rows = documents.withColumn("text", tx.evidence_normalize(text)).withColumn("lines", F.split("text", "\n"))
    lines = F.col("lines")
    rows = rows.withColumns(
        {
            "address": value_after_label(lines, ["사업장소재지"], True), "head_address": value_after_label(lines, ["본점소재지"], True),
            "opened": value_after_label(lines, ["개업연월일"]), "kind_pair": kind_pair(lines),
            "line_type": value_after_label(lines, ["업태"]), "line_item": value_after_label(lines, ["종목"], True),
        }
    )
    kind = strip_after(F.coalesce(F.nullif("kind_pair.types", F.lit("")), F.col("line_type")), ["종목"])
    rows = rows.withColumns(
        {"kind": kind, "item": F.coalesce(F.nullif("kind_pair.items", F.lit("")), F.col("line_item"))}
    ).withColumn("where_", F.coalesce(F.nullif("address", F.lit("")), F.col("head_address")))
    category = F.concat_ws(
        " / ", F.when(F.col("kind") != "", F.concat(F.lit("업태: "), "kind")), F.when(F.col("item") != "", F.concat(F.lit("종목: "), "item"))
    )
    number = pattern_value(text, words_pattern(("사업자 등록 번호", "등록 번호"), et.NUMBER_SHAPE))
    corporate = pattern_value(text, words_pattern(("법인 등록 번호",), r"[0-9]{6}\s*[-]?\s*[0-9]{7}"))
    return explode_fields(
        rows,
        [
            field("business_registration_number", tx.registration_number(number), 0.96),
            field("corporate_registration_number", tx.registration_number(corporate), 0.94),
            field("name", value_after_label(lines, ["법인명", "상호"]), 0.9),
            field("representative_name", value_after_label(lines, ["대표자"]), 0.9),
            field("opening_date", tx.date_normalize(F.col("opened")), 0.88, F.col("opened")),
            field("business_address", F.col("address"), 0.86), field("headquarters_address", F.col("head_address"), 0.84),
            field("region", tx.region_derive(F.col("where_")), 0.72, F.col("where_")), field("business_type", F.col("kind"), 0.78),
            field("business_item", F.col("item"), 0.72), field("business_category", category, 0.7),
        ],
    )


def json_text(values: Column) -> Column:
    kept = tx.ordered_distinct(F.transform(values, tx.clean_value))
    quoted = F.transform(kept, lambda v: F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def payment_status(text: Column, kind: Column) -> Column:
    prefix = F.when(F.lit(False), F.lit(""))
    for name, shown in et.PAYMENT_PREFIX.items():
        prefix = prefix.when(kind == name, shown)
    return tx.let(
        tx.space_compact(text),
        lambda c: F.concat(
            prefix.otherwise("납부"),
            F.when(tx.contains_any(c, et.PAYMENT_CLEAR), ": 체납 없음").when(c.contains("체납"), ": 체납 확인 필요").otherwise(": 확인 필요"),
        ),
    )


# ---- the kind-of-business section ----------------------------------------------------------------------------
def _kind_clean(line: Column) -> Column:
    out = F.regexp_replace(tx.clean_value(line), r"^\(?별지\s*출력\)?$", "")
    out = tx.clean_text(F.regexp_replace(out, label_pattern("사업의종류") + rf"{tx.WS}*[:：]?", ""))
    for label in ("업태", "종목"):
        out = tx.clean_text(F.regexp_replace(out, "^" + label_pattern(label) + rf"{tx.WS}*[:：]?", ""))
    return out


def _is_kind_label(line: Column) -> Column:
    return tx.space_compact(line).isin("사업의", "종류", "사업의종류", "업태", "종목")


def _is_kind_stop(line: Column) -> Column:
    return tx.contains_any(tx.space_compact(line), et.KIND_STOPS)


def _is_kind_token(line: Column) -> Column:
    return tx.space_compact(line).isin(*[re.sub(r"\s", "", t) for t in et.KIND_TOKENS])


def _rejoin(lines: Column) -> Column:
    """Lines cut by recognition are joined again: broken known words first, then one-letter endings."""
    text = F.regexp_replace(F.array_join(lines, "\n"), r"전문기\s*\n\s*업", "전문기업")
    text = F.regexp_replace(text, r"도매\s*및\s*\n\s*소매업", "도매 및 소매업")
    text = F.regexp_replace(text, r"신재생에너지\s*설비", "신재생에너지설비")
    text = F.regexp_replace(text, r"([가-힣])\s*,\s*([가-힣])", "$1, $2")
    return F.split(text, "[\n;]")


def _merge_fragments(lines: Column) -> Column:
    kept = F.filter(F.transform(lines, _kind_clean), lambda x: (x != "") & ~_is_kind_label(x))

    def add(acc, line):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & tx.space_compact(line).isin("업", "기", "사", "자") & ~_is_kind_token(F.get(acc, F.size(acc) - 1))
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(joins, F.concat(head, F.array(tx.clean_value(F.concat(F.get(acc, F.size(acc) - 1), line))))).otherwise(
            F.concat(acc, F.array(line))
        )

    def until_stop(rows):
        stops = F.filter(F.transform(rows, lambda x, i: F.when(_is_kind_stop(x), i)), lambda i: i.isNotNull())
        return F.slice(rows, F.lit(1), F.coalesce(F.get(stops, F.lit(0)), F.size(rows)))

    return F.aggregate(tx.let(kept, until_stop), F.array().cast("array<string>"), add)


def _leading_kind(line: Column) -> Column:
    """struct(kind, rest): a known kind of business at the start of a line and what follows it."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("kind"), F.lit("").alias("rest")))
    for token in et.KIND_TOKENS:
        pattern = f"^{tx.WS}*" + label_pattern(token)
        rest = F.regexp_replace(F.regexp_replace(line, pattern, ""), r"^[ :：,/·ㆍ]+|[ :：,/·ㆍ]+$", "")
        out = out.when(line.rlike(pattern), F.struct(F.lit(token).alias("kind"), rest.alias("rest")))
    return out.otherwise(F.struct(F.lit("").alias("kind"), line.alias("rest")))


def _split_items(value: Column) -> Column:
    def tidy(x):
        out = tx.clean_value(x)
        for label in ("종목", "업태"):
            out = tx.clean_text(F.regexp_replace(out, "^" + label_pattern(label) + rf"{tx.WS}*[:：]?", ""))
        return out

    return F.filter(
        F.transform(F.split(value, SEPARATORS), tidy),
        lambda x: (x != "") & ~_is_kind_label(x) & ~_is_kind_stop(x) & ~_is_kind_token(x),
    )


def _pair(lines: Column) -> Column:
    def build(parts):
        types = F.array_distinct(F.filter(F.transform(parts, lambda p: p["kind"]), lambda k: k != ""))
        items = F.array_distinct(F.flatten(F.transform(parts, lambda p: _split_items(p["rest"]))))
        return F.struct(F.array_join(types, ", ").alias("types"), F.array_join(items, ", ").alias("items"))

    return tx.let(F.transform(lines, _leading_kind), build)


def kind_pair(lines: Column) -> Column:
    """struct(types, items) of the kind-of-business section of a certificate."""
    def section(rows):
        compact = F.transform(rows, tx.space_compact)

        def at(c):
            starts = F.filter(
                F.transform(
                    c,
                    lambda x, i: F.when(
                        x.contains("사업의종류") | x.startswith("업태")
                        | ((x == "사업의") & F.coalesce(F.get(c, i + 1), F.lit("")).startswith("종류")), i,
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return F.get(starts, F.lit(0))

        def cut(s):
            part = F.when(s.isNotNull(), F.slice(rows, s + 1, F.size(rows))).otherwise(tx.str_array([]))
            stop = F.filter(
                F.transform(part, lambda x, i: F.when((i > 0) & _is_kind_stop(x), i)), lambda i: i.isNotNull()
            )
            return F.slice(part, F.lit(1), F.coalesce(F.get(stop, F.lit(0)), F.size(part)))

        return tx.let(tx.let(compact, at), cut)

    return tx.let(_merge_fragments(_rejoin(section(lines))), _pair)


def given_kind_values(types: Column, items: Column) -> Column:
    """struct(types, items) from given lists: kinds found in either list are types, the rest are items; null lists are empty."""
    types, items = (F.coalesce(given, tx.str_array([])) for given in (types, items))
    typed = F.transform(_merge_fragments(_rejoin(types)), _leading_kind)
    other = F.transform(_merge_fragments(_rejoin(items)), _leading_kind)

    def build(s):
        kinds = F.filter(F.transform(F.concat(s["t"], s["o"]), lambda p: p["kind"]), lambda k: k != "")
        from_types = F.transform(F.filter(s["t"], lambda p: p["kind"] != ""), lambda p: _split_items(p["rest"]))
        from_items = F.transform(s["o"], lambda p: _split_items(p["rest"]))
        return F.struct(
            F.array_distinct(kinds).alias("types"), F.array_distinct(F.flatten(F.concat(from_types, from_items))).alias("items")
        )

    return tx.let(F.struct(typed.alias("t"), other.alias("o")), build)


# ---- candidates ------------------------------------------------------------------------------------------------
def requeue(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """A new analysis drops a document's pending candidates and adds those not approved before with the same value.

    Both: evidence_id, field_key, extracted_value, status.
    """
    keys = ["evidence_id", "field_key", "extracted_value"]
    redone = fresh.select("evidence_id").distinct().withColumn("redone", F.lit(True))
    kept = stored.join(redone, "evidence_id", "left").filter(~((F.col("status") == "pending") & F.col("redone").isNotNull())).drop("redone")
    approved = stored.filter(F.col("status") == "approved").withColumn("extracted_value", tx.clean_text(F.col("extracted_value"))).select(*keys)
    new = fresh.withColumn("extracted_value", tx.clean_text(F.col("extracted_value"))).join(approved, keys, "left_anti")
    return kept.unionByName(new.withColumn("status", F.lit("pending")))


def candidate_counts(documents: DataFrame, candidates: DataFrame, companies: DataFrame) -> DataFrame:
    state = F.col("status")
    counts = candidates.groupBy("evidence_id").agg(
        F.count("*").alias("candidate_count"), F.count_if(state == "pending").alias("pending_candidate_count"),
        F.count_if(state == "approved").alias("approved_candidate_count"),
    )
    names = companies.select("company_id", F.col("name").alias("company_name"))
    out = documents.join(counts, "evidence_id", "left").join(names, "company_id", "left")
    return out.fillna(0, ["candidate_count", "pending_candidate_count", "approved_candidate_count"]).fillna("", ["company_name"])


def apply_candidates(companies: DataFrame, documents: DataFrame, accepted: DataFrame, fields) -> DataFrame:
    """Accepted values become company fields; one row per document with its outcome.

    ``documents``: evidence_id, company_id (null when unlinked), management_group_name; ``accepted``: evidence_id,
    candidate_id, field_key, extracted_value (the last one of a field counts).  List fields are merged with what the
    company has.  Blocked when another company of the same group holds the number.
    """
    listed = [f for f in fields if f in fv.LIST_PROFILE_FIELDS]
    value = F.when(F.col("extracted_value") != "", F.col("candidate_id"))
    wide = accepted.groupBy("evidence_id").agg(
        *[F.max_by("extracted_value", F.when(F.col("field_key") == f, value)).alias(f"new_{f}") for f in fields]
    )
    current = companies.select("company_id", *[F.col(f).alias(f"old_{f}") for f in fields], F.col("management_group_name").alias("old_group"))
    rows = documents.join(wide, "evidence_id").join(current, "company_id", "left")
    linked = F.col("company_id").isNotNull()

    def merged(f):
        new, old = F.col(f"new_{f}"), F.col(f"old_{f}")
        if f in listed:
            both = tx.json_list_merge(F.when(linked, old).otherwise(F.lit("")), new)
            return F.when(new.isNotNull(), json_text(both)).otherwise(old)
        plain = tx.registration_number(new) if f == "business_registration_number" else tx.clean_text(new)
        return F.when(new.isNotNull(), plain).otherwise(old)

    rows = rows.withColumns({f: F.coalesce(merged(f), F.lit("")) for f in fields})
    default = F.lit(fv.DEFAULT_GROUP)
    group = F.coalesce(
        F.nullif(tx.clean_text(F.when(linked, F.col("old_group")).otherwise(F.col("management_group_name"))), F.lit("")), default
    )
    rows = rows.withColumns({"target_group": group, "match_key": tx.digits(F.col("business_registration_number"))})
    # holders of a number in a group: their count and smallest id tell whether anyone else is among them
    holders = registration_keys(companies).groupBy("match_key", F.col("management_group").alias("target_group")).agg(
        F.count("*").alias("holders"), F.min("company_id").alias("one_holder")
    )
    rows = rows.join(holders, ["match_key", "target_group"], "left")
    others = (F.col("holders") > 1) | ((F.col("holders") == 1) & ~F.coalesce(F.col("one_holder") == F.col("company_id"), F.lit(False)))
    nothing = tx.all_of(F.col(f"new_{f}").isNull() for f in fields)
    outcome = (
        F.when(nothing, "nothing_to_apply").when(~linked & (F.col("name") == ""), "name_required")
        .when(F.coalesce(others, F.lit(False)), "blocked_duplicate").when(linked, "updated").otherwise("created")
    )
    return rows.select("evidence_id", "company_id", outcome.alias("outcome"), F.col("target_group").alias("management_group_name"), *fields)
