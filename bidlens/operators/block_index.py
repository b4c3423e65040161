"""A stored search index: postings in blocks of documents, of which a search reads those that can hold a result.

A row is one token in one block: a range of document ids of one category and version, at most ``PASSAGES`` passages.  A
frequent token is many rows, in many tasks, and a filter on category or version drops whole blocks.  Rows are sorted by
token, in folders by a hash of the token, so that a search opens the folders of its tokens only.

Queries that differ only in tokens which no passage holds are searched once.  A passage can't share more tokens with a
query than its block does.  A search first scores each query's most promising blocks; the k-th result found there is a
floor, and of the other blocks only those that can hold a better one are read: more tokens, or as many and newer documents.
A block's passages are counted for all its queries in the task that has it, and its best k of each query leave it.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions.text import NO_TOKEN  # a value: workers don't have the module
from bidlens.operators.search import checked_k, query_tokens

PASSAGES = 128  # of a block at most
DOCUMENTS = 64  # of a block on average
SEEDS = 2  # blocks of a query that are scored first
FOLDER_PASSAGES = 50_000  # for each folder of tokens
SPREAD = 8  # tasks over which a token's blocks are dealt where they meet the queries
ROWS = 20_000  # of the index in an Arrow batch
CELLS = 4_000_000  # passages by tokens of queries that are counted at once
NUMBERS = 1 << 40  # of classes in one of their buckets

# workers get what a task needs of this module from the driver
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def span_of(documents: DataFrame) -> int:
    """How many document ids make up a block, so that it has about ``DOCUMENTS`` documents of its category and version."""
    stats = documents.agg(
        F.count("*").alias("n"), (F.max("doc_id") - F.min("doc_id") + 1).alias("width"), F.approx_count_distinct(F.struct("category", "document_version")).alias("groups")
    ).first()
    return max(1, int((stats.width or 1) * max(stats.groups, 1) * DOCUMENTS // max(stats.n, 1)))


def _posted(batches, names: list[str]):
    """Rows (category, document_version, range, part, token, newest, passages) of a task's passages, which come in their order.

    A part is a range's next passages, ``PASSAGES`` at most; texts are cut into tokens in Arrow, postings grouped in numpy.
    """
    part = 0
    for batch in batches:
        if not len(batch):
            continue
        doc = batch["doc_id"].to_numpy(zero_copy_only=False)
        place = [pc.fill_null(batch[c], "").dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in ("category", "document_version")]
        changed = np.any([np.diff(c, prepend=-1) != 0 for c in (*place, batch["range"].to_numpy(zero_copy_only=False))], axis=0)
        changed[0] = True
        at = np.arange(len(doc))
        begins = np.maximum.accumulate(np.where(changed, at, 0))
        parts = np.cumsum(changed | ((at - begins) % PASSAGES == 0)) - 1
        written = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(batch["chunk_text"], "")), NO_TOKEN, " ")
        words = pc.split_pattern(written, " ")  # with the choice by length below, as tx.tokenize
        tokens = words.flatten().dictionary_encode()
        codes = tokens.indices.to_numpy(zero_copy_only=False)
        of = np.repeat(at, words.value_lengths().to_numpy(zero_copy_only=False))
        long = pc.greater_equal(pc.utf8_length(tokens.dictionary), 2).to_numpy(zero_copy_only=False)[codes]
        of, codes = of[long], codes[long]
        keys = parts[of] * np.int64(max(len(tokens.dictionary), 1)) + codes
        order = np.argsort(keys, kind="stable")  # a token's passages stay in their order
        once = np.ones(len(order), bool)
        once[1:] = (np.diff(keys[order]) != 0) | (np.diff(of[order]) != 0)
        order = order[once]
        starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
        ends = np.append(starts[1:], len(order)) if len(starts) else starts
        held, first = of[order], of[order[starts]]
        structs = pa.StructArray.from_arrays([batch[c].take(pa.array(held)) for c in names], names)
        passages = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), structs)
        token = tokens.dictionary.take(pa.array(codes[order[starts]]))
        columns = [batch[c].take(pa.array(first)) for c in ("category", "document_version", "range")]
        columns += [pa.array(parts[first] + part, pa.int64()), token, pa.array(doc[held[ends - 1]], pa.int64()), passages]
        for start in range(0, len(starts), ROWS):
            yield pa.RecordBatch.from_arrays([c.slice(start, ROWS) for c in columns], ["category", "document_version", "range", "part", "token", "newest", "passages"])
        part += int(parts[-1]) + 1


def build(passages: DataFrame, span: int, folders: int = 1) -> DataFrame:
    """Rows (folder, token, block, category, document_version, newest, passages) of searchable passages; ``newest``: the
    last document id of the row.

    One exchange, of texts: it deals out id ranges, within which passages are numbered and tokens grouped.
    """
    keys = [F.coalesce("category", F.lit("")).alias("category"), F.coalesce("document_version", F.lit("")).alias("document_version")]
    rows = passages.select(
        *keys, F.floor(F.col("doc_id") / span).alias("range"), "doc_id", "chunk_index", "chunk_id", "chunk_text"
    )
    place, names = ["category", "document_version", "range"], ["doc_id", "chunk_index", "chunk_id"]
    dealt = rows.repartition(*place).sortWithinPartitions(*place, "doc_id", "chunk_index")
    kinds = ", ".join(f"{c}: {dealt.schema[c].dataType.simpleString()}" for c in names)
    schema = f"category string, document_version string, range bigint, part bigint, token string, newest bigint, passages array<struct<{kinds}>>"
    out = dealt.mapInArrow(lambda batches: _posted(batches, names), schema)
    return out.select(
        _folder(folders).alias("folder"), "token", F.xxhash64(*place, "part").alias("block"), "category", "document_version", "newest", "passages"
    )


def write(index: DataFrame, path: str) -> None:
    """Sorted by token within folders; a folder is dealt to ``SPREAD`` tasks by block, so that no token is one task's."""
    dealt = index.repartition("folder", F.pmod("block", F.lit(SPREAD)))  # by range, the index would be made twice: to look where the ranges lie
    dealt.sortWithinPartitions("folder", "token", "block").write.partitionBy("folder").mode("overwrite").parquet(path)


def only(index: DataFrame, category: str = "", version: str = "") -> DataFrame:
    """Blocks of one category, version or both; the filters reach the scan."""
    if category:
        index = index.filter(F.col("category") == category)
    return index.filter(F.col("document_version") == version) if version else index


def _folder(folders: int) -> Column:
    return F.pmod(F.xxhash64("token"), F.lit(folders))


def _asked(queries: DataFrame, folders: int) -> DataFrame:
    return query_tokens(queries).withColumn("folder", _folder(folders))


def alike(asked: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens, members): queries that share the same tokens with the index are one class, which the search knows as one query.

    ``tokens``: as ``query_tokens``, a class by its number; ``members``: the class and size of each query that has one.
    """
    held = index.select("folder", "token").distinct()
    known = asked.join(held, ["folder", "token"], "left_semi").groupBy("query_id", "query_size").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    first = known.groupBy("tokens").agg(F.min("query_id").alias("first"))
    bucket = F.pmod(F.xxhash64("first"), F.lit(256))
    number = F.row_number().over(W.partitionBy("bucket").orderBy("first"))
    classes = first.withColumn("bucket", bucket).withColumn("class", F.col("bucket") * NUMBERS + number)
    members = known.join(classes.select("tokens", "class"), "tokens").select("query_id", "query_size", "class")
    tokens = classes.select(F.col("class").alias("query_id"), F.size("tokens").alias("query_size"), F.explode("tokens").alias("token"))
    return tokens, members


def block_bounds(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, query_size, block, bound, newest): how many of a query's tokens a block holds, and the last document that
    can hold them all.  Reads no passages."""
    fan = tokens.withColumn("spread", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    rows = index.select("folder", "token", "block", "newest", F.pmod("block", F.lit(SPREAD)).alias("spread"))
    return rows.join(fan, ["folder", "token", "spread"]).groupBy("query_id", "query_size", "block").agg(F.count("*").alias("bound"), F.min("newest").alias("newest"))


def met(chosen: DataFrame, tokens: DataFrame, index: DataFrame) -> DataFrame:
    """(block, passages, queries) of the chosen (query_id, block): a row is a token, with the queries that ask for it there.

    Postings move once, whole, to the task of their block.
    """
    asked = tokens.groupBy("folder", "token").agg(F.collect_list("query_id").alias("asking"))
    wanted = chosen.groupBy("block").agg(F.collect_list("query_id").alias("wanted"))
    posted = index.select("folder", "token", "block", "passages").join(asked, ["folder", "token"])
    return posted.join(wanted, "block").select("block", "passages", F.array_intersect("asking", "wanted").alias("queries"))


def scored(chosen: DataFrame, tokens: DataFrame, index: DataFrame) -> DataFrame:
    """Passages of the chosen (query_id, block) with the number of query tokens they hold.

    Postings are opened and counted in the task of their block, and no count moves.
    """
    rows = met(chosen, tokens, index).select("block", F.explode("queries").alias("query_id"), "passages")
    rows = rows.select("block", "query_id", F.explode("passages").alias("p"))
    return rows.groupBy("block", "query_id", "p.doc_id", "p.chunk_id", "p.chunk_index").agg(F.count("*").alias("shared")).drop("block")


def _best(rows: pa.Table, k: int) -> pa.Table:
    """The best k passages of each query in one block, from its rows (passages, queries)."""
    names = ["doc_id", "chunk_index", "chunk_id"]
    listed, asking = rows["passages"].combine_chunks(), rows["queries"].combine_chunks()
    held = listed.flatten()
    doc, place, chunk = (held.field(n).to_numpy(zero_copy_only=False) for n in names)
    order = np.lexsort((chunk, place, -doc))  # where as much is shared, the first is the best
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(c[order]) != 0 for c in (doc, place, chunk)], axis=0)
    firsts, number = order[new], np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    n, size = len(firsts), len(rows)
    of = np.repeat(np.arange(size), listed.value_lengths().to_numpy(zero_copy_only=False))
    holds = np.bincount(of * n + number, minlength=size * n).reshape(size, n).astype(np.int32)
    encoded = asking.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    by_query = np.argsort(codes, kind="stable")
    row = np.repeat(np.arange(size), asking.value_lengths().to_numpy(zero_copy_only=False))[by_query]
    begins = np.append(np.flatnonzero(np.diff(codes[by_query], prepend=-1)), len(codes))
    found = []
    start = 0
    while start < len(begins) - 1:
        stop = max(int(np.searchsorted(begins, begins[start] + CELLS // n, "right")) - 1, start + 1)
        counts = np.add.reduceat(holds[row[begins[start] : begins[stop]]], begins[start:stop] - begins[start], axis=0)
        value = counts.astype(np.int64) * n + (n - 1 - np.arange(n))  # all different
        best = np.argpartition(-value, min(k, n) - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), value.shape)
        shared = np.take_along_axis(counts, best, axis=1)
        query, at = np.nonzero(shared)
        found.append((query + start, best[query, at], shared[query, at]))
        start = stop
    query, passage, shared = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else [()] * 3))
    columns = [encoded.dictionary.take(pa.array(query)), *[held.field(c).take(pa.array(firsts[passage])) for c in ("doc_id", "chunk_id", "chunk_index")], pa.array(shared, pa.int64())]
    return pa.table(columns, ["query_id", "doc_id", "chunk_id", "chunk_index", "shared"])


def best_of_blocks(chosen: DataFrame, tokens: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """As ``scored``, but only the best k passages of a query in each block, counted in numpy in the task of the block."""
    rows = met(chosen, tokens, index).filter(F.size("queries") > 0)
    kinds = {f.name: f.dataType.simpleString() for f in index.schema["passages"].dataType.elementType.fields} | {"query_id": tokens.schema["query_id"].dataType.simpleString(), "shared": "bigint"}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "doc_id", "chunk_id", "chunk_index", "shared"))
    return rows.groupBy("block").applyInArrow(lambda group: _best(group, k), schema)


def chosen_blocks(queries: DataFrame, index: DataFrame, k: int, folders: int, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, blocks scored first, blocks that can still hold one of the best k)."""
    return blocks_for(_asked(queries, folders), index, k, seeds)


def blocks_for(tokens: DataFrame, index: DataFrame, k: int, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``chosen_blocks``, from tokens ``_asked``."""
    ranked = block_bounds(tokens, index).withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), F.desc("newest"), "block")))
    first = ranked.filter(F.col("place") <= seeds)
    order = W.partitionBy("query_id").orderBy(F.desc("shared"), F.desc("doc_id"))
    floors = scored(first, tokens, index).withColumn("n", F.row_number().over(order)).filter(F.col("n") == k).select(
        "query_id", F.col("shared").alias("floor"), F.col("doc_id").alias("floor_doc")
    )
    better = F.col("floor").isNull() | (F.col("bound") > F.col("floor")) | ((F.col("bound") == F.col("floor")) & (F.col("newest") >= F.col("floor_doc")))
    rest = ranked.filter(F.col("place") > seeds).join(floors, "query_id", "left").filter(better)
    return tokens, first, rest


def topk(queries: DataFrame, index: DataFrame, k: int = 5, folders: int = 1) -> DataFrame:
    """Best k passages per query: the integer overlap decides (exact), then the newest document, then passage order."""
    k = checked_k(k)
    tokens, members = alike(_asked(queries, folders), index)
    tokens, first, rest = blocks_for(tokens.withColumn("folder", _folder(folders)), index, k)
    found = best_of_blocks(first.select("query_id", "block").unionByName(rest.select("query_id", "block")), tokens, index, k)
    order = W.partitionBy("query_id").orderBy(F.desc("shared"), F.desc("doc_id"), "chunk_index")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumnRenamed("query_id", "class")
    sized = best.join(members, "class")
    return sized.select("query_id", "rank", "doc_id", "chunk_id", "chunk_index", "shared", (F.col("shared") / F.col("query_size")).alias("score"))
