"""Notices and their attachments from raw service items (``item``: map of text fields)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx


def item_first(keys, item: str = "item") -> Column:
    return tx.first_present(*[F.try_element_at(F.col(item), F.lit(k)) for k in keys])


def normalize(items: DataFrame) -> DataFrame:
    """The text fields of a notice, each the first filled one of its keys, plus two attachment counts."""
    fields = {name: item_first(keys) for name, keys in fv.NOTICE_FIELDS.items()}
    fields["bid_ntce_ord"] = F.coalesce(F.nullif(fields["bid_ntce_ord"], F.lit("")), F.lit(fv.DEFAULT_NOTICE_ORDER))
    out = items.withColumns(fields).withColumn("_files", attachment_array())
    return out.withColumns(
        {
            "attachment_count": F.size("_files"),
            "supported_attachment_count": F.size(F.filter("_files", lambda a: a["support_status"] == "supported")),
        }
    ).drop("_files")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def attachment_array(item: str = "item") -> Column:
    """Attachments of an item in field order, the first of each (name, url)."""
    def value(key):
        return tx.clean_text(F.try_element_at(F.col(item), F.lit(key)))

    def entry(name, url, field):
        shown = F.coalesce(
            F.nullif(name, F.lit("")), F.nullif(F.regexp_extract(url_path(url), "([^/]+)/*$", 1), F.lit("")), F.lit(field)
        )
        ext = F.coalesce(F.nullif(suffix(shown), F.lit("")), suffix(url_path(url)))
        good = (url != "") & ext.isin(*fv.SUPPORTED_EXTENSIONS)
        row = F.struct(
            shown.alias("file_name"), url.alias("source_url"), F.lit(field).alias("source_field"), ext.alias("file_extension"),
            F.when(good, "supported").otherwise("unsupported").alias("support_status"),
        )
        return F.when(~((url == "") & (shown == field)), row)

    entries = [entry(value(f"ntceSpecFileNm{i}"), value(f"ntceSpecDocUrl{i}"), f"ntceSpecDocUrl{i}") for i in range(1, 11)]
    standard = value("stdNtceDocUrl")
    entries.append(F.when(standard != "", entry(F.lit(fv.STANDARD_NOTICE_NAME), standard, "stdNtceDocUrl")))
    entries.append(entry(value("eorderAtchFileNm"), value("eorderAtchFileUrl"), "eorderAtchFileUrl"))

    def first_of_each(rows):
        keys = F.transform(rows, lambda r: F.concat_ws("\x01", r["file_name"], r["source_url"]))
        return tx.let(
            F.struct(rows.alias("r"), keys.alias("k")),
            lambda s: F.filter(s["r"], lambda r, i: F.array_position(s["k"], F.get(s["k"], i)) == i + 1),
        )

    return tx.let(F.array_compact(F.array(*entries)), first_of_each)


def attachments(items: DataFrame) -> DataFrame:
    """One row per attachment; other columns of the notice are kept."""
    kept = [c for c in items.columns if c != "item"]
    return items.select(*kept, F.posexplode(attachment_array()).alias("pos", "a")).select(*kept, "pos", "a.*")


def attachment_stats(files: DataFrame, key: str = "notice_id") -> DataFrame:
    good = F.col("support_status") == "supported"
    return files.groupBy(key).agg(
        F.count("*").alias("total_count"), F.count_if(good).alias("supported_count"), F.count_if(~good).alias("unsupported_count")
    )


def merge_details(base: DataFrame, details: DataFrame, fields, key: str = "notice_id") -> DataFrame:
    """Fill blank fields of a notice from its detail rows: the first filled value by arrival (``ord``)."""
    first = details.groupBy(key).agg(
        *[F.min_by(F.col(f), F.when(tx.clean_text(F.col(f)) != "", F.col("ord"))).alias(f"d_{f}") for f in fields]
    )
    filled = {f: F.when(tx.clean_text(F.col(f)) != "", F.col(f)).otherwise(F.coalesce(f"d_{f}", F.col(f))) for f in fields}
    return base.join(first, key, "left").withColumns(filled).drop(*[f"d_{f}" for f in fields])


def business_type(value: Column, default: str = "construction") -> Column:
    aliases = F.create_map(*[F.lit(x) for kv in fv.BUSINESS_TYPE_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, F.lower(tx.clean_text(value))), F.lit(default))


def search_types(value: Column) -> Column:
    """Business types to ask for: all four for ``all`` or anything unknown."""
    kind = business_type(value, "all")
    return F.when(kind == "all", tx.str_array(fv.BUSINESS_TYPES)).otherwise(F.array(kind))


def infer_business_type(raw: Column) -> Column:
    """Type told by a raw JSON item: named keys, then operation names, then words, in that order."""
    parsed = F.from_json(raw, "map<string,string>")
    named = [F.nullif(business_type(F.try_element_at(parsed, F.lit(k)), "all"), F.lit("all")) for k in fv.BUSINESS_TYPE_KEYS]
    low = F.lower(raw)
    spotted = [F.when(low.contains(word), kind) for word, kind in [*fv.BUSINESS_TYPE_OPERATIONS, *fv.BUSINESS_TYPE_WORDS]]
    return F.when(F.size(F.map_keys(parsed)) > 0, F.coalesce(*named, *spotted, F.lit(""))).otherwise("")


def backfill_business_type(notices: DataFrame) -> DataFrame:
    """Notices still at the default type get the inferred one; ``updated`` tells which."""
    current, inferred = business_type(F.col("business_type"), ""), F.coalesce(infer_business_type(F.col("raw_json")), F.lit(""))
    rows = notices.withColumns({"_current": current, "_inferred": inferred})
    update = F.col("_current").isin("", "construction") & (F.col("_inferred") != "") & (F.col("_inferred") != F.col("_current"))
    return rows.withColumns(
        {"updated": update, "business_type": F.when(update, F.col("_inferred")).otherwise(F.col("business_type"))}
    ).drop("_current", "_inferred")


def date_windows(ranges: DataFrame, days: int) -> DataFrame:
    """Ranges (date_from, date_to) cut backwards from the end into windows of ``days``; the earliest may be short."""
    ends = F.sequence(F.col("date_to"), F.col("date_from"), F.expr(f"interval -{days} days"))
    kept = [c for c in ranges.columns if c not in ("date_from", "date_to")]
    rows = ranges.filter(F.col("date_from") <= F.col("date_to")).select(*kept, "date_from", F.posexplode(ends).alias("window", "window_end"))
    return rows.select(*kept, "window", F.greatest("date_from", F.date_sub("window_end", days - 1)).alias("window_start"), "window_end")


def api_datetime_key(value: Column, suffix_: str) -> Column:
    text = tx.clean_text(value)
    return (
        F.when((F.length(text) == 10) & text.rlike("^.{4}-.{2}-"), F.concat(F.replace(text, F.lit("-"), F.lit("")), F.lit(suffix_)))
        .when(text.rlike("^[0-9]{8}$"), F.concat(text, F.lit(suffix_))).otherwise(text)
    )


def save_discovered(found: DataFrame, saved: DataFrame) -> DataFrame:
    """Outcome of each found notice: saved, skipped (known or repeated) or failed (no number).

    ``found``: no, ord, arrival.  The first arrival of a new (no, ord) is the one saved.
    """
    order = F.coalesce(F.nullif(tx.clean_text(F.col("ord")), F.lit("")), F.lit(fv.DEFAULT_NOTICE_ORDER))
    rows = found.withColumns({"no": tx.clean_text(F.col("no")), "ord": order})
    first = rows.filter(F.col("no") != "").groupBy("no", "ord").agg(F.min("arrival").alias("arrival"))
    known = saved.select("no", "ord").distinct()
    new = first.join(known, ["no", "ord"], "left_anti").withColumn("is_new", F.lit(True))
    outcome = F.when(F.col("no") == "", "failed").when(F.col("is_new"), "saved").otherwise("skipped")
    return rows.join(new, ["no", "ord", "arrival"], "left").withColumn("outcome", outcome).drop("is_new")
