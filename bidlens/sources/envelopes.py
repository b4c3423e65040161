"""Bodies of the notice service (JSON or XML) as rows of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions import text as tx

ITEMS = "array<map<string,string>>"
XML = "header map<string,string>, body struct<items:struct<item:array<map<string,string>>>,totalCount:string>"


def json_items(body: Column) -> Column:
    """Items of a JSON body: ``{item: [..]}``, ``{item: {..}}`` or a plain list; with or without a response wrapper."""
    holder = F.coalesce(F.get_json_object(body, "$.response.body.items"), F.get_json_object(body, "$.body.items"))
    inner = F.when(holder.startswith("["), holder).otherwise(F.get_json_object(holder, "$.item"))
    many = F.from_json(inner, ITEMS)
    one = F.array(F.from_json(inner, "map<string,string>"))
    return F.when(inner.startswith("["), many).when(inner.startswith("{"), one)


def parse(bodies: DataFrame) -> DataFrame:
    """Adds format, items and total_count to rows with a ``body``."""
    text = tx.clean_text(F.col("body"))
    is_json = F.col("format") == "json"
    rows = bodies.withColumn("_text", text).withColumn(
        "format", F.when(F.col("_text") == "", "empty").when(F.col("_text").rlike(r"^[{\[]"), "json").otherwise("xml")
    )
    rows = rows.withColumn("_xml", F.from_xml(F.when(F.col("format") == "xml", F.col("_text")), XML))
    items = F.when(is_json, json_items(F.col("_text"))).otherwise(F.col("_xml.body.items.item"))
    rows = rows.withColumn("items", F.coalesce(items, F.array().cast(ITEMS)))
    total = F.when(
        is_json,
        F.coalesce(F.get_json_object("_text", "$.response.body.totalCount"), F.get_json_object("_text", "$.body.totalCount")),
    ).otherwise(F.col("_xml.body.totalCount"))
    count = F.when(total.isNull(), F.size("items")).otherwise(F.coalesce(total.try_cast("int"), F.lit(0)))
    return rows.withColumn("total_count", count).drop("_text", "_xml")


def explode_items(parsed: DataFrame) -> DataFrame:
    kept = [c for c in parsed.columns if c != "items"]
    return parsed.select(*kept, F.posexplode("items").alias("item_pos", "item"))
