"""Fields of certificates other than registrations, read by a table of labels.

The labels of all kinds are rows (head, key, pattern, kind, slot, try, ...).  Lines are cut once, meet the table on the
first two letters of a label, and the hits are reduced to the first value of each (certificate, slot).  A new kind or
label is a new row of the table; the plan stays as it is.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.functions import evidence_types as et
from bidlens.functions import text as tx
from bidlens.operators.evidence import SEPARATORS, explode_fields, json_text, label_pattern, pattern_value, payment_status, words_pattern

LABEL_ROW = "head string, key string, pattern string, kind string, slot string, turn int, place int, continued boolean, ends string"
HEAD = 2  # letters that a line and a label meet on; every label has at least so many


def key_of(label: str) -> str:
    return "".join(label.split())


def value_pattern(label: str) -> str:
    """What follows a label on its line: its letters may be spaced, a bracketed remark and a colon may follow."""
    return rf"(?i){label_pattern(label)}{tx.WS}*(?:\([^)]*\))?{tx.WS}*[:：]?{tx.WS}*(.*)$"


def label_rows(slots=None) -> list[dict]:
    """The table: one row for each label of each slot and kind.  ``turn`` orders tries, ``place`` labels within a try."""
    rows = []
    for slot in slots or et.SLOTS:
        ends = f"(?s)(?:{'|'.join(map(label_pattern, slot.ends))}).*$" if slot.ends else ""
        for kind in slot.kinds:
            for n, label in enumerate(slot.labels):
                key = key_of(label)
                rows.append(
                    {
                        "head": key[:HEAD], "key": key, "pattern": value_pattern(label), "kind": kind, "slot": slot.name, "turn": n if slot.each else 0,
                        "place": n, "continued": slot.continued, "ends": ends,
                    }
                )
    return rows


def label_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The rows as a constant of the plan, small whatever is read."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{LABEL_ROW}>>")))


def by_kind(values: dict[str, str], kind: Column) -> Column:
    table = F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), "map<string,string>")
    return F.coalesce(F.element_at(table, kind), F.lit(""))


def _line_hits(lines: Column, heads: list[str]) -> Column:
    """Lines with the head of some label, once for each head, with the two lines that follow."""
    known = tx.str_array(heads)

    def of(line, i):
        def hit(compact):
            return F.transform(
                F.filter(known, lambda h: compact.contains(h)),
                lambda h: F.struct(
                    h.alias("head"), i.alias("pos"), line.alias("line"), compact.alias("compact"), F.get(lines, i + 1).alias("one"),
                    F.get(lines, i + 2).alias("two"), F.lit(None).cast("string").alias("found_slot"), F.lit(None).cast("string").alias("found"),
                ),
            )

        return tx.let(tx.space_compact(line), hit)

    return F.flatten(F.transform(lines, of))


def _text_hits(text: Column, kind: Column) -> Column:
    """What is read from the text as a whole, in the shape of line hits; the kind itself is always among them."""
    only = lambda names, value: F.when(kind.isin(*names), value)
    subject = F.lit("")
    for name, words in et.SUBJECT_WORDS.items():
        subject = F.when(kind == name, pattern_value(text, words_pattern(words, et.SUBJECT_SHAPE))).otherwise(subject)
    values = {
        "kind": kind, "number": pattern_value(text, words_pattern(et.NUMBER_WORDS, et.NUMBER_SHAPE)),
        "days": pattern_value(text, f"({et.DAY_SHAPE}.*?{et.DAY_SHAPE})"),
        "grade": only(["credit_rating_certificate"], F.upper(pattern_value(text, words_pattern(et.GRADE_WORDS, et.GRADE_SHAPE)))),
        "year": only(["financial_statement_certificate"], pattern_value(text, words_pattern(et.YEAR_WORDS, et.YEAR_SHAPE))),
        "size": only(
            ["small_business_confirmation"],
            tx.let(tx.space_compact(text), lambda c: F.coalesce(*[F.when(c.contains(w), w) for w in et.COMPANY_SIZES], F.lit(""))),
        ),
        "licensed": only(["license_registration_certificate"], F.coalesce(*[F.when(text.contains(w), w) for w in et.LICENSE_TOKENS], F.lit(""))),
        "payment": only(et.PAYMENT_PREFIX, payment_status(text, kind)), "subject_text": tx.clean_value(subject),
    }
    none = F.lit(None).cast("string")
    hits = [
        F.struct(
            none.alias("head"), F.lit(0).alias("pos"), none.alias("line"), none.alias("compact"), none.alias("one"), none.alias("two"),
            F.lit(slot).alias("found_slot"), value.alias("found"),
        )
        for slot, value in values.items()
    ]
    return F.filter(F.array(*hits), lambda h: F.coalesce(h["found"], F.lit("")) != "")


def _value() -> Column:
    """The value after a hit's label, with the lines that continue it and without what its end labels begin."""
    stops = lambda line: line.isNull() | tx.let(tx.space_compact(line), lambda c: F.exists(tx.str_array(et.STOP_LABELS), c.contains))
    one, two = F.col("one"), F.col("two")
    more = F.when(~F.col("continued") | stops(one), tx.str_array([])).when(stops(two), F.array(one)).otherwise(F.array(one, two))
    own = tx.clean_text(F.expr("regexp_extract(line, pattern, 1)"))
    parts = F.filter(F.transform(F.concat(F.array(own), more), tx.clean_text), lambda p: p != "")
    joined = F.coalesce(F.array_join(parts, " "), F.lit(""))
    return F.when(F.col("ends") == "", joined).otherwise(tx.clean_text(F.regexp_replace(joined, F.col("ends"), F.lit(""))))


def slot_values(documents: DataFrame, slots=None) -> DataFrame:
    """(evidence_id, document_type, values): array<struct<slot, turn, value>> of all that labels and patterns give.

    One exchange, of hits: the first line of each (slot, turn), then all slots of a certificate.
    """
    rows = label_rows(slots)
    text, kind = F.col("text"), F.col("document_type")
    cut = documents.withColumn("text", tx.evidence_normalize(text)).withColumn("lines", F.split("text", "\n"))
    hits = cut.select("evidence_id", "document_type", F.inline(F.concat(_line_hits(F.col("lines"), sorted({r["head"] for r in rows})), _text_hits(text, kind))))
    met = hits.join(label_table(documents.sparkSession, rows), "head", "left")
    fits = F.col("compact").contains(F.col("key")) & ((F.col("kind") == "*") | (F.col("kind") == kind))
    met = met.filter(F.col("found_slot").isNotNull() | fits)
    met = met.select(
        "evidence_id", "document_type", F.coalesce("found_slot", "slot").alias("slot"), F.coalesce("turn", F.lit(0)).alias("turn"),
        F.struct("pos", F.coalesce("place", F.lit(0)).alias("place")).alias("at"), F.coalesce("found", _value()).alias("value"),
    ).repartition("evidence_id")
    first = met.groupBy("evidence_id", "document_type", "slot", "turn").agg(F.min_by("value", "at").alias("value"))
    return first.groupBy("evidence_id", "document_type").agg(F.collect_list(F.struct("slot", "turn", "value")).alias("values"))


# slots with one value; "items" has one for each of its labels
SINGLE = [
    "name", "representative", "number", "period", "days", "grade", "year", "size", "licensed", "license", "payment", "qualification", "project", "amount",
    "term", "subject", "subject_item", "subject_text",
]


def _first_of(slot: str) -> str:
    """The first filled try of a slot, as SQL."""
    return f"coalesce(array_min(transform(filter(values, v -> v.slot = '{slot}' AND v.value <> ''), v -> struct(v.turn, v.value))).value, '')"


_ITEMS = f"flatten(transform(array_sort(transform(filter(values, v -> v.slot = 'items'), v -> struct(v.turn, v.value))), v -> split(v.value, '{SEPARATORS}')))"
_LICENSE = "coalesce(nullif(license, ''), licensed)"
_GRADED = "if(document_type = 'credit_rating_certificate', if(grade <> '', concat('기업신용평가등급 ', grade), '기업신용평가등급확인서'), '')"
_SUBJECT = "coalesce(nullif(subject, ''), subject_text)"
# field, confidence, value and source as SQL over the slots, in the order in which fields are listed; an empty value is no field
FIELDS = [
    ("business_registration_number", 0.94, "number", "''"), ("name", 0.84, "name", "''"), ("representative_name", 0.8, "representative", "''"),
    ("certifications_json", 0.86, """if(certification <> '', concat('["', certification, '"]'), '')""", "certification"),
    ("preference_tags_json", 0.86, """if(tag <> '', concat('["', tag, '"]'), '')""", "tag"),
    ("evidence_expiry_summary", 0.72, "coalesce(nullif(period, ''), days)", "''"), ("company_size_classification", 0.88, "size", "''"),
    ("direct_production_items_json", 0.86, "if(items <> '', items_json, '')", "items"), ("business_item", 0.68, "items", "''"),
    ("procurement_registration_status", 0.86, "if(document_type = 'procurement_registration_certificate', 'registered', '')", "''"),
    ("license_summary", 0.74, "qualification", "''"), ("license_summary", 0.82, _LICENSE, "''"),
    ("certifications_json", 0.72, f"""if({_LICENSE} <> '', concat('["', replace(replace({_LICENSE}, '\\\\', '\\\\\\\\'), '"', '\\\\"'), '"]'), '')""", "''"),
    ("certifications_json", 0.84, f"""if({_GRADED} <> '', concat('["', {_GRADED}, '"]'), '')""", _GRADED), ("license_summary", 0.72, _GRADED, "''"),
    ("license_summary", 0.74, """if(document_type = 'performance_certificate',
      coalesce(nullif(array_join(filter(array(project, amount, term), x -> x <> ''), ' / '), ''), '실적증명서'), '')""", "''"),
    ("license_summary", 0.74, "payment", "''"),
    ("license_summary", 0.7, "if(document_type = 'financial_statement_certificate', if(year <> '', concat('재무/매출 증빙 ', year), '재무/매출 증빙'), '')", "''"),
    ("license_summary", 0.74, f"if(said <> '' AND {_SUBJECT} <> '', concat(said, ': ', {_SUBJECT}), said)", "''"),
    ("business_item", 0.68, "if(has_item, coalesce(nullif(subject_item, ''), subject_text), '')", "''"),
]


def certificate_fields(documents: DataFrame, kinds=None) -> DataFrame:
    """Candidate fields of all certificate kinds but registrations (evidence_id, text, document_type).

    ``kinds``: only these.  One row per filled field, at its place; a (field, value) of a certificate counts once.  Rows
    that share an id are read as one certificate.
    """
    kinds = [k for k in (kinds or et.KINDS) if k not in et.REGISTRATION_KINDS]
    rows = slot_values(documents.filter(F.col("document_type").isin(*kinds)))
    kind = F.col("document_type")
    rows = rows.selectExpr("*", *[f"{_first_of(name)} AS {name}" for name in SINGLE], f"{_ITEMS} AS parts")
    rows = rows.withColumns(
        {
            "number": tx.registration_number(F.col("number")), "parts": F.filter(F.transform("parts", tx.clean_value), lambda v: v != ""),
            "certification": by_kind({k: v.certification for k, v in et.KINDS.items()}, kind), "tag": by_kind({k: v.tag for k, v in et.KINDS.items()}, kind),
            "said": by_kind({k: v.certification for k, v in et.KINDS.items() if v.subject}, kind),
            "has_item": by_kind({k: "yes" for k, v in et.KINDS.items() if v.item}, kind) != "",
        }
    ).withColumns({"items": F.expr("array_join(array_distinct(parts), ', ')"), "items_json": json_text(F.col("parts"))})
    raw = F.expr("array(" + ", ".join(f"struct('{key}' AS key, {sure}D AS sure, {value} AS value, {source} AS source)" for key, sure, value, source in FIELDS) + ")")

    def finish(f):
        value, source = tx.clean_value(f["value"]), F.nullif(f["source"], F.lit(""))
        return tx.let(
            value, lambda v: F.struct(
                f["key"].alias("field_key"), by_kind(et.FIELD_LABELS, f["key"]).alias("field_label"), v.alias("extracted_value"), f["sure"].alias("confidence"),
                F.coalesce(source, v).alias("source_text"),
            ),
        )

    return explode_fields(rows, F.transform(F.filter(raw, lambda f: F.coalesce(f["value"], F.lit("")) != ""), finish))
