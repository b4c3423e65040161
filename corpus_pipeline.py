"""The corpus pipeline: stages over the documents, each written as Parquet and reread as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns
of ``documents``, whatever other columns a table has.  Rows without an id pass every stage that compares documents.  Of rows
that share an id and differ, near_duplicates keeps one.  Empty tables pass as empty ones; texts of any length go through
whole, one at a time where a stage handles a single text, in blocks where it compares them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.llm import byte_bpe, decontamination, jaccard_join, substring_dedup, toxicity
from bidlens.llm.tables import Scratch, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the convolutional classifier scores below its threshold."""
    model = toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs.select(*COLUMNS), model).filter(F.col("toxicity") < toxicity.CUT).drop("toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of similar texts (five words a shingle, 0.8 or more); one row an id.

    Of several rows with one id the one whose columns have the smallest digest stays.  Ids and digests choose; texts are
    read and moved once, by the last join.
    """
    docs, scratch = docs.select(*COLUMNS), Scratch(spark, "near_duplicates")
    groups = jaccard_join.near_components(docs, size=5, percent=80)
    stay = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named, digest = docs.filter(F.col("doc_id").isNotNull()), F.xxhash64(*COLUMNS)
    rows = named.select("doc_id", digest.alias("digest")).groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("digest").alias("least"))
    chosen = scratch.keep(rows.join(stay, "doc_id", "left_semi"), "chosen")
    single = named.join(chosen.filter(F.col("rows") == 1).select("doc_id"), "doc_id", "left_semi")
    several = named.join(chosen.filter(F.col("rows") > 1).select("doc_id", "least"), "doc_id").filter(digest == F.col("least"))
    several = several.select(*COLUMNS).dropDuplicates()
    return single.select(*COLUMNS).unionByName(several).unionByName(docs.filter(F.col("doc_id").isNull()))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; untouched texts stay as they are, emptied rows go."""
    cut = substring_dedup.without_repeats(docs.select(*COLUMNS), carry=("lang", "source"), whole=True)
    return cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars")
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item."""
    return decontamination.decontaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, as little-endian unsigned 32-bit integers, with digests of them and of what they decode to."""
    return byte_bpe.encode(docs).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("substring_dedup", cut_repeats), ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]
ORACLE_SQL = None  # a trained classifier, components and merges to a fixpoint: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
