"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded digest of their id and ranked within their source; sorted by fractional rank
((rank - 1/2) / rows of the source) the sources interleave in proportion, and equal cuts of that order are shards with the
mixture of the whole.  The law that holds is ``rows``: counts of shards differ by one at most.

Both ranks are distributed: rows fall into buckets of the sort key, a bucket is ranked by itself, and running sums of the
bucket counts give each bucket its first rank.  A source of any share is spread over all buckets.

A null source counts as the empty one, a null text as the empty text, a null id as the empty string.  Rows that agree in
all these keys may swap places, so repeated rows get neighbouring slots.  An empty table has no shards.  Other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens.llm.tables import Scratch

BUCKET_ROWS = 2048  # rows a bucket holds on average, up to 65,536 buckets
ORDER = ("digest", "doc_id", "size", "text_crc32")


def buckets_for(rows: int) -> int:
    """A power of two, at most 65,536."""
    return 1 << min(16, max(0, (rows // BUCKET_ROWS).bit_length()))


def first_ranks(counts: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """Rows before each bucket: running sums over at most 65,536 counts a stratum."""
    order = Window.partitionBy(*[F.col(c) for c in within] or [F.lit(0)]).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))


def ranked(rows: DataFrame, within: tuple[str, ...], order: tuple[str, ...], name: str) -> DataFrame:
    """Adds the rank from 0 of every row within its stratum; ``rows`` has a ``bucket`` that is monotone in ``order``."""
    key = [*within, "bucket"]
    counts = first_ranks(rows.groupBy(*key).agg(F.count("*").alias("n")), within)
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return numbered.join(counts.drop("n"), key).withColumn(name, F.col("before") + F.col("place") - 1).drop("before", "place", "bucket")


def shards(documents: DataFrame, n_shards: int, seed: str = "shards") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("digest"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    scratch = Scratch(documents.sparkSession, "shards")
    rows = scratch.keep(rows, "rows")
    total = rows.count()
    n = buckets_for(total)
    of_source = rows.groupBy("source").agg(F.count("*").alias("of_source"))
    digest_bucket = F.floor(F.conv(F.substring("digest", 1, 4), 16, 10).cast("long") * n / 65536)
    placed = ranked(rows.withColumn("bucket", digest_bucket), ("source",), ORDER, "rank")
    share = (F.col("rank") * 2 + 1) / (F.col("of_source") * 2)
    placed = scratch.keep(placed.join(of_source, "source").withColumn("share", share).drop("rank", "of_source"), "ranks")
    placed = ranked(placed.withColumn("bucket", F.floor(F.col("share") * n)), (), ("share", "source", *ORDER), "position")
    return placed.select("doc_id", "source", "size", "text_crc32", *cut("position", total, n_shards))


def cut(position: str, total: int, n_shards: int) -> list[Column]:
    """Equal cuts of positions 0 to total - 1: shard, and the place in it."""
    at, n = F.col(position).cast("long"), F.lit(max(total, 1)).cast("long")
    shard = F.expr(f"cast({position} as bigint) * {n_shards} div {max(total, 1)}")
    first = F.floor((shard * n + (n_shards - 1)) / n_shards)
    return [shard.cast("int").alias("shard"), (at - first).cast("long").alias("slot")]


def write_shards(documents: DataFrame, path: str, n_shards: int = 24, seed: str = "shards") -> None:
    """Writes every row with its text: a folder for each shard, rows by slot, a shard in as many files as its rows need.

    Places are found without texts; then each row gets its text by what the place was found with (id, source, size and
    CRC-32).  Repeated rows share one text, so their number moves no text.  Two different texts of one id, source, size and
    CRC-32 would be taken for one.
    """
    key = ["doc_id", "source", "size", "text_crc32"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = documents.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), text.alias("text"),
    ).dropDuplicates(key)
    placed, texts = shards(documents, n_shards, seed).alias("p"), texts.alias("t")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}")) for c in key]
    rows = placed.join(texts, same).select("p.*", "t.text")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_table(documents: DataFrame, n_shards: int = 24) -> DataFrame:
    """Digest of ``shards``: the law is ``rows``, so no grown shard is named."""
    return shards(documents, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def crc32_steps() -> list[int]:
    """What the reversed polynomial of CRC-32 makes of each half byte."""
    steps = list(range(16))
    for _ in range(4):
        steps = [(v >> 1) ^ (0xEDB88320 if v & 1 else 0) for v in steps]
    return steps


SQL = f"""
WITH halves AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text, md5('shards:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
    list_transform(list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g'), ''), lambda c: c <> ''),
      lambda c: CAST(instr('0123456789ABCDEF', c) - 1 AS UBIGINT)) AS parts
  FROM documents
), rows AS (
  SELECT doc_id, source, digest, strlen(text) + 8 AS size,
    CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), parts),
      lambda a, x: xor(a >> 4, CAST({crc32_steps()} AS UBIGINT[])[CAST(xor(a, x) & 15 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS text_crc32
  FROM halves
), ranks AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY digest, doc_id, size, text_crc32) - 1)
    / CAST(2 * count(*) OVER (PARTITION BY source) AS DOUBLE) AS share FROM rows
), places AS (
  SELECT *, row_number() OVER (ORDER BY share, source, digest, doc_id, size, text_crc32) - 1 AS position, count(*) OVER () AS total FROM ranks
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(position * 24 // total AS INTEGER) AS shard,
  CAST(position - ((position * 24 // total) * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM places
"""
