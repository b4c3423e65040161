"""How far the sources of a language differ in their words: smoothed term shares, exact, per source and for the language.

Terms are counted in tasks by an Arrow pipeline: A-Z lower-cased, texts split at everything that is no letter, the terms
dictionary-encoded, and their codes grouped per document and then per (language, source).  A task merges its batches'
partial counts and emits a bounded number of them at a time, so that a frequent word is a few rows whatever its text.  Spark
merges the partial counts by (language, term); the kept terms of a language are dealt into shards by term, and each shard is
one matrix, terms by sources, whose differences of shares are summed and ranked; shards meet again in sums of pairs
and in the 50 best terms of each.

A null text, language or source counts as the empty string.  A group without a kept term has the same share for every term.
Where a language keeps no term, its pairs have the value 0 and it has no terms.  An empty table gives no rows; repeated rows
count each; ids and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlens.llm.tables import Scratch

BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between terms
SMOOTH, UNIT = 5, 1_000_000_000
MIN_DOCS, TOP = 30, 50
HELD = 400_000  # partial counts that a task holds before it emits them
SLICE = 8 << 20  # bytes of text handled at once
SHARD_TERMS, CELLS = 256, 4_000_000  # terms of a shard at least; terms x sources of a wider one at most


def partial_counts(texts: pa.Array, groups: pa.Array) -> pa.Table:
    """(group, term, n, docs) of some texts and the numbers of their groups."""
    terms = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BREAKS)
    doc, coded = pc.list_parent_indices(terms), pc.list_flatten(terms).dictionary_encode()
    table = pa.table({"doc": doc, "code": coded.indices})
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:
        table = table.filter(pc.not_equal(table["code"], empty))
    table = table.group_by(["doc", "code"]).aggregate([([], "count_all")])
    table = pa.table({"group": pc.take(groups, table["doc"]), "code": table["code"], "n": table["count_all"]})
    table = table.group_by(["group", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    return pa.table({"group": table["group"], "term": pc.take(coded.dictionary, table["code"]), "n": table["n_sum"], "docs": table["count_all"]})


def slices(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``size`` bytes of text, as copies (Arrow's string kernels misread arrays that start
    at an offset); a longer text is alone."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    at = 0
    while at < batch.num_rows:
        n = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")) - at
        yield batch.take(pa.array(range(at, at + max(n, 1))))
        at += max(n, 1)


def term_counts(documents: DataFrame) -> DataFrame:
    """Partial counts (lang, source, term, n, docs) of all rows: several rows of one key have to be summed."""
    rows = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            table = pa.concat_tables(held).group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
            return pa.table({"group": table["group"], "term": table["term"], "n": table["n_sum"], "docs": table["docs_sum"]})

        def emitted(table: pa.Table) -> Iterator[pa.RecordBatch]:
            langs, sources = (pa.array([name[k] for name in names], pa.string()) for k in (0, 1))
            out = pa.table({
                "lang": pc.take(langs, table["group"]), "source": pc.take(sources, table["group"]), "term": table["term"].cast(pa.string()),
                "n": table["n"].cast(pa.int64()), "docs": table["docs"].cast(pa.int64()),
            })
            return iter(out.to_batches(max_chunksize=10_000))

        for batch in batches:
            for part in slices(batch):
                pairs = zip(part.column("lang").to_pylist(), part.column("source").to_pylist())
                groups = pa.array([names.setdefault(pair, len(names)) for pair in pairs], pa.int32())
                held.append(partial_counts(part.column("text").cast(pa.large_string()), groups))
                if sum(t.num_rows for t in held) > HELD:
                    held[:] = [merged()]
                    if held[0].num_rows > HELD // 2:
                        yield from emitted(held.pop())
                        names.clear()
        if held:
            yield from emitted(merged())

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 5) / (total + 5 * kept)), exact: a long division in three steps of a thousand."""
    divisor = total + SMOOTH * kept
    out, rest = np.zeros(np.broadcast(counts, divisor).shape, np.int64), counts + SMOOTH
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // divisor
        rest = rest % divisor
    return out + 1


def shard_rows(lang: str, sources: list[str], totals: np.ndarray, kept: int, terms: pa.Array, counts: np.ndarray) -> Iterator[dict[str, list]]:
    """Rows (lang, source, part, item, value) of one shard: sums of pairs, and the best terms of each source."""
    of_source = shares(counts, totals[None, :], kept)
    of_lang = shares(counts.sum(axis=1), totals.sum(), kept)
    for s, name in enumerate(sources):
        others = [o for o in range(len(sources)) if o != s]
        sums = np.abs(of_source - of_source[:, s:s + 1]).sum(axis=0)
        over = of_source[:, s] - of_lang
        at = np.flatnonzero((counts[:, s] > 0) & (over > 0))
        best = at[np.lexsort((at, -over[at]))[:TOP]]  # terms are in UTF-8 order
        items = [sources[o] for o in others] + terms.take(pa.array(best)).to_pylist()
        parts = ["pair"] * len(others) + ["term"] * len(best)
        yield {"lang": [lang] * len(items), "source": [name] * len(items), "part": parts, "item": items, "value": [*sums[others].tolist(), *over[best].tolist()]}


def divergences(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group."""
    scratch = Scratch(documents.sparkSession, "divergence")
    dealt = term_counts(documents).repartition("lang", "term")  # one exchange serves both groupings
    summed = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = summed.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("sources"), F.sum("docs").alias("docs"))
    kept = scratch.keep(by_term.filter(F.col("docs") >= min_docs).select("lang", "term", "sources"), "kept")
    found = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("total"))
    groups = scratch.keep(found.join(totals, ["lang", "source"], "left").fillna(0, ["total"]), "groups")
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("n_terms")), "lang", "left").fillna(0, ["n_terms"])
    wide = F.least(F.col("n_sources").cast("double"), CELLS / F.col("n_sources"))  # as many terms as sources: no more sums of pairs than cells
    n_shards = F.greatest(F.ceil(F.col("n_terms") / F.greatest(F.lit(SHARD_TERMS), wide)), F.lit(1)).cast("long")
    langs = scratch.keep(langs.select("lang", "n_terms", n_shards.alias("n_shards")), "langs")
    shards = kept.join(langs, "lang").select("lang", "term", "sources", F.pmod(F.xxhash64("term"), F.col("n_shards")).alias("shard"))
    every_shard = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_shards") - 1)).alias("shard")
    roles = groups.join(langs, "lang").select("lang", "source", "total", F.col("n_terms").alias("kept_terms"), every_shard)

    def run(key, terms: pa.Table, names: pa.Table) -> pa.Table:
        terms, names = terms.combine_chunks().sort_by("term"), names.sort_by("source")
        sources, kept_terms = names["source"].to_pylist(), names["kept_terms"][0].as_py()
        counts = np.zeros((terms.num_rows, len(sources)), np.int64)
        if terms.num_rows:
            lists = terms["sources"].combine_chunks()
            row, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
            counts[row, pc.index_in(flat.field("source"), pa.array(sources, pa.string())).to_numpy()] = flat.field("n").to_numpy()
        column = terms["term"].combine_chunks()
        rows = [pa.table(part, SHARD) for part in shard_rows(key[0].as_py(), sources, names["total"].to_numpy(), kept_terms, column, counts)]
        return pa.concat_tables(rows)

    parts = shards.groupBy("lang", "shard").cogroup(roles.groupBy("lang", "shard")).applyInArrow(run, "lang string, source string, part string, item string, value long")
    sums = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term is in one shard
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return sums.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= TOP))


SHARD = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM groups g LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
    1 + CAST((1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (n + 5 * v) AS BIGINT) AS p
  FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) JOIN totals t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT k.lang, k.term, 1 + CAST((1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (n + 5 * v) AS BIGINT) AS q
  FROM kept k JOIN sizes USING (lang) JOIN (SELECT lang, sum(n) AS n FROM totals GROUP BY lang) USING (lang)
    JOIN (SELECT lang, term, sum(c) AS c FROM counts GROUP BY ALL) USING (lang, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), terms AS (SELECT lang, source, term AS item, CAST(p.p - q.q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p.p > q.q),
every AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM every WHERE part = 'pair' OR rank <= 50
"""
