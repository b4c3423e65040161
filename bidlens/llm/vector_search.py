"""Exact search for the largest inner products by vector-approximation files.

Vectors become whole numbers, floor(256 * x) of every component.  Equal vectors are one entry of the file with its smallest
ids, and equal queries one query, so that groups of copies cost one vector.  The file is a table of blocks: for each block a
grid that cuts every dimension between its own smallest and largest value into cells, each vector's cell numbers (one byte a
dimension), and apart from them, in a column that the first pass doesn't read, the vectors.

Cells bound every inner product from both sides.  The first pass reads only cells and finds, for each query, the k-th
largest lower bound over the whole file.  The second reads a block's vectors in the order of their upper bounds, largest
first, until the k-th exact result found so far, or the first pass' bound, is above all upper bounds that remain.  Bounds
and scores are whole numbers, exact in doubles or 64-bit integers, so ties are real ties and go to the smaller id.

Both passes deal the file into groups of blocks and the queries into groups, copy each query group to every block group (and
the reverse), and meet in a cogroup: work is queries x vectors, in blocks, and no task holds more than one group of each.

Vectors that are null, empty, or hold a null, a non-finite component or one of 2^18 and more (whose scores could leave 64
bits) take no part, nor do rows without an id.  Vectors of different lengths are not compared.  Rows that repeat id and
vector count once; an id with several vectors is a row for each, as a query (ranks start anew) and as an answer, also to
each other.  Fewer than k other vectors give fewer rows; an empty table gives none.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens.llm.tables import Scratch

SCALE, LARGEST = 256, 1 << 26  # of a whole-number component
CELLS = 64  # of a dimension
BLOCK_BYTES = 1 << 18  # cells of a block
GROUP_BYTES, LEAST_GROUP = 4 << 20, 1 << 17  # cells of a group of blocks: at most, and at least
QUERY_BYTES = 32 << 20  # whole numbers of a group of queries
TILE = 1 << 21  # bounds computed at once
FILE = "block long, dim int, n int, low binary, high binary, cells binary, vectors binary, ids binary"


def whole(vector: Column) -> Column:
    """floor(256 * x) of every component; null where the vector can take no part."""
    given = vector.cast("array<double>")
    numbers = F.transform(given, lambda x: F.floor(x * SCALE))
    fits = F.forall(given, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LARGEST // SCALE), F.lit(False)))
    return F.when((F.size(given) > 0) & fits, numbers.cast("array<int>"))


def integer_vectors(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Distinct (id, v) of all rows that take part."""
    rows = embeddings.select(F.col(id_column).cast("long").alias("id"), whole(F.col(vector)).alias("v"))
    return rows.filter("id IS NOT NULL AND v IS NOT NULL").distinct()


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(v, ids): every distinct vector with its k smallest ids, ascending.  The rank limits each task's rows before they move."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return vectors.withColumn("r", rank).filter(F.col("r") <= k).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def as_matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of 32-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(column), -1)


def grid_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, cells): smallest and largest number of each dimension's cells, and the cell of every component.

    A cell's ends are the numbers that can lie in it, so the bounds hold for any vector of the block.
    """
    least = v.min(axis=0).astype(np.int64)
    width = np.maximum(-(-(v.max(axis=0) - least + 1) // CELLS), 1)
    low = least + np.arange(CELLS)[:, None] * width
    return low, low + width - 1, ((v - least) // width).astype(np.uint8)


def file_blocks(distinct: DataFrame, k: int) -> DataFrame:
    """The vector-approximation file: rows of ``FILE``, each of at most ``BLOCK_BYTES`` of cells; a vector's ids follow their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            nonlocal made
            v, ids = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            low, high, cells = grid_of(v)
            made += 1
            binary = [low.astype("<i8"), high.astype("<i8"), cells, v.astype("<i4"), ids.astype("<i8")]
            arrays = [pa.array([made], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(v)], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in binary)]
            return pa.RecordBatch.from_arrays(arrays, names=["block", "dim", "n", "low", "high", "cells", "vectors", "ids"])

        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                rows = batch.filter(pa.array(sizes == dim))
                lists = rows.column(1)
                ids = np.full((len(lists), k + 1), -1, np.int64)
                counts = lists.value_lengths().to_numpy()
                ids[:, 0] = counts
                owner = np.repeat(np.arange(len(lists)), counts)
                ids[owner, 1 + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)] = lists.flatten().to_numpy()
                held.setdefault(dim, []).append((as_matrix(rows.column(0)), ids))
                most = max(BLOCK_BYTES // dim, 1)
                while (have := sum(len(p[0]) for p in held[dim])) >= most:
                    v, i = (np.concatenate([p[j] for p in held[dim]]) for j in (0, 1))
                    yield block(dim, [(v[:most], i[:most])])
                    held[dim] = [(v[most:], i[most:])] if have > most else []
        for dim, parts in held.items():
            if parts:
                yield block(dim, parts)

    return distinct.mapInArrow(run, FILE)


def query_rows(vectors: DataFrame) -> DataFrame:
    """(query, dim, v): the distinct vectors to be searched for, numbered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        for batch in batches:
            number = pa.array(range(made, made + batch.num_rows), pa.int64())
            made += batch.num_rows
            yield pa.RecordBatch.from_arrays([number, batch.column(0).value_lengths().cast(pa.int32()), batch.column(0)], names=["query", "dim", "v"])

    return vectors.select("v").distinct().mapInArrow(run, "query long, dim int, v array<int>")


def halves(q: np.ndarray) -> np.ndarray:
    """Positive and negative parts side by side: times the cells' ends in the right order they bound the inner product."""
    return np.hstack([np.maximum(q, 0), np.minimum(q, 0)]).astype(np.float64)


def blocks_of(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, dict]]:
    """(low ends, high ends) of the cells of every vector of each block, and the block's row."""
    for row in table.to_pylist():
        dim = row["dim"]
        low, high = (np.frombuffer(row[name], "<i8").reshape(CELLS, dim) for name in ("low", "high"))
        cells = np.frombuffer(row["cells"], np.uint8).reshape(-1, dim)
        at = np.arange(dim)
        yield low[cells, at].astype(np.float64), high[cells, at].astype(np.float64), row


def lower_bounds(file: pa.Table, q: np.ndarray, k: int) -> np.ndarray:
    """The k largest lower bounds of each query over some blocks, ascending; -inf where there are fewer vectors."""
    best, split = np.full((len(q), k), -np.inf), halves(q)
    for low, high, _ in blocks_of(file):
        ends = np.hstack([low, high]).T
        step = max(TILE // len(low), 1)
        for at in range(0, len(q), step):
            bounds = np.hstack([best[at:at + step], split[at:at + step] @ ends])
            best[at:at + step] = np.partition(bounds, bounds.shape[1] - k, axis=1)[:, -k:]
    return np.sort(best, axis=1)


def kth_of(rows: np.ndarray, scores: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th largest score of each of n rows, -inf where a row has fewer."""
    order = np.lexsort((-scores, rows))
    starts = np.searchsorted(rows[order], np.arange(n))
    ends = np.append(starts[1:], len(rows))
    out, has = np.full(n, -np.inf), ends - starts >= k
    out[has] = scores[order][starts[has] + k - 1]
    return out


def read_in_order(bounds: np.ndarray, q: np.ndarray, v: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of every vector read, and each query's k-th result so far.

    A query's vectors are read by descending upper bound, first k and then twice as many each time, while the next upper
    bound is not below the floor or the k-th result.
    """
    row, col = np.nonzero(bounds >= floor[:, None])
    order = np.lexsort((-bounds[row, col], row))
    row, col = row[order], col[order]
    upper, place = bounds[row, col], np.arange(len(row)) - np.searchsorted(row, row)
    read = [np.zeros(0, np.int64)] * 3
    after = k
    while len(row):
        now = place < after
        r, c = row[now], col[now]
        found = [r, c, np.einsum("ij,ij->i", q[r].astype(np.int64), v[c].astype(np.int64))]
        read = [np.concatenate(pair) for pair in zip(read, found)]
        floor = np.maximum(floor, kth_of(read[0], read[2], len(q), k))
        left = ~now & (upper >= floor[row])
        row, col, upper, place = row[left], col[left], upper[left], place[left]
        after *= 3
    return *read, floor


def best_rows(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's k first by score, then id."""
    order = np.lexsort((ids, -scores, rows))
    return order[np.arange(len(order)) - np.searchsorted(rows[order], rows[order]) < k]


def exact_results(file: pa.Table, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, id, score, equal): each query's k best of some blocks, those below the floor left out; equal: the query's own vector."""
    best, split = [np.zeros(0, np.int64)] * 4, halves(q)
    for low, high, row in blocks_of(file):
        v = np.frombuffer(row["vectors"], "<i4").reshape(len(low), -1)
        ids = np.frombuffer(row["ids"], "<i8").reshape(len(low), -1)
        ends = np.hstack([high, low]).T
        step = max(TILE // len(low), 1)
        for at in range(0, len(q), step):
            part = slice(at, at + step)
            r, c, scores, floor[part] = read_in_order(split[part] @ ends, q[part], v, floor[part], k)
            stay = scores >= floor[part][r]
            r, c, scores = r[stay] + at, c[stay], scores[stay]
            n = ids[c, 0]
            owner = np.repeat(np.arange(len(c)), n)
            named = ids[c[owner], 1 + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)]
            equal = (q[r] == v[c]).all(axis=1)
            best = [np.concatenate(pair) for pair in zip(best, (r[owner], named, scores[owner], equal[owner]))]
        kept = best_rows(*best[:3], k)
        best = [column[kept] for column in best]
    return tuple(best)


def dealt(file: DataFrame, queries: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The file and the queries with the keys (dim, g, h) at which every block group meets every query group."""
    spark = file.sparkSession
    cells = file.agg(F.sum(F.col("n").cast("double") * F.col("dim"))).first()[0] or 0
    asked = queries.agg(F.sum(F.col("dim").cast("double") * 4)).first()[0] or 0
    wanted = 2 * spark.sparkContext.defaultParallelism
    groups = max(-int(-cells // GROUP_BYTES), min(wanted, -int(-cells // LEAST_GROUP)), 1)
    query_groups = max(-int(-asked // QUERY_BYTES), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    blocks = file.select("dim", *columns, F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"), every(query_groups).alias("h"))
    rows = queries.select("*", F.pmod(F.xxhash64("query"), F.lit(query_groups)).alias("h"), every(groups).alias("g"))
    return blocks, rows


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(v, top): for every distinct query vector its k best (score, id) of all vectors, best first; ``equal`` marks its own vector.

    Takes (id, v) and (v) rows of whole numbers, as ``integer_vectors`` gives them.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    file = scratch.keep(file_blocks(distinct_vectors(vectors, k), k), "file")
    asked = scratch.keep(query_rows(queries), "queries")
    keys = ["dim", "g", "h"]

    def bound(table: pa.Table, given: pa.Table) -> pa.Table:
        if not table.num_rows or not given.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "bound": pa.array([], pa.int64())})
        found = lower_bounds(table, as_matrix(given["v"].combine_chunks()), k)
        query = np.repeat(given["query"].to_numpy(), k)
        real = np.isfinite(found.ravel())
        return pa.table({"query": query[real], "bound": found.ravel()[real].astype(np.int64)})

    blocks, rows = dealt(file, asked, ["low", "high", "cells"])
    bounds = blocks.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(bound, "query long, bound long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound")))
    floors = bounds.withColumn("place", place).filter(F.col("place") == k).select("query", F.col("bound").alias("floor"))
    floored = scratch.keep(asked.join(floors, "query", "left"), "floors")

    def exact(table: pa.Table, given: pa.Table) -> pa.Table:
        if not table.num_rows or not given.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in (("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("equal", pa.bool_()))})
        floor = given["floor"].cast(pa.float64()).fill_null(-np.inf).to_numpy().copy()
        row, ids, scores, equal = exact_results(table, as_matrix(given["v"].combine_chunks()), floor, k)
        return pa.table({"query": given["query"].to_numpy()[row], "id": ids, "score": scores, "equal": equal.astype(bool)})

    blocks, rows = dealt(file, floored, ["n", "low", "high", "cells", "vectors", "ids"])
    results = blocks.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(exact, "query long, id long, score long, equal boolean")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    results = results.withColumn("place", place).filter(F.col("place") <= k)
    top = results.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id", "equal"))).alias("top"))  # k at most
    return asked.select("query", "v").join(top, "query").select("v", "top")


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose id is divisible by ``every``.

    One more than k is searched for each distinct query vector; a query then leaves out its own id.
    """
    vectors = integer_vectors(embeddings)
    asking = vectors.filter(F.col("id") % every == 0)
    found = search(vectors, asking.select("v"), k + 1)
    others = F.filter("top", lambda t: ~(t["equal"] & (t["id"] == F.col("id"))))
    answers = asking.join(found, "v").select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("rank", "t"))
    return answers.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("t.id").alias("vec_id"), F.col("t.score").alias("score"))


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 262144)) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, q.v, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON (c.vec_id <> q.vec_id OR c.v <> q.v) AND len(c.v) = len(q.v)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 5
"""
