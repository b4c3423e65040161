"""Text quality: how much of one text another one holds, and checks on a corpus."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import fixed_values as fv
from bidlens.functions import text as tx
from bidlens.functions.dictionaries import KOREAN, Dictionaries

MIN_LINE, MIN_ROW_RECALL = 12, 0.65

# workers get what a task needs of this module from the driver
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _gram_codes(a: str, b: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for every n-gram of two texts, the same for the same gram and for no other one."""
    points = np.frombuffer((a + b).encode("utf-32-le"), np.uint32).astype(np.int64)
    if points.max(initial=0) >= 1 << 62 // n:
        points = np.unique(points, return_inverse=True)[1]
    kinds, ends, codes = int(points.max(initial=0)) + 1, len(points) - n + 1, points[: max(len(points) - n + 1, 0)]
    for i in range(1, n):
        if int(codes.max(initial=0)) >= (1 << 62) // kinds:
            codes = np.unique(codes, return_inverse=True)[1]
        codes = codes * kinds + points[i : max(ends + i, i)]
    return codes[: max(len(a) - n + 1, 0)], codes[len(a) :]  # without those that begin in one text and end in the other


def _shared_grams(a: str, b: str, n: int) -> tuple[int, int, int]:
    """(sum(min(n_a, n_b)), grams of a, grams of b); a text shorter than a gram is one gram, an empty one has none."""
    sizes = [max(len(x) - n + 1, min(len(x), 1)) for x in (a, b)]
    if min(len(a), len(b)) < n:
        return int(a == b and a != ""), *sizes
    (own, own_counts), (other, other_counts) = (np.unique(codes, return_counts=True) for codes in _gram_codes(a, b, n))
    _, i, j = np.intersect1d(own, other, assume_unique=True, return_indices=True)
    return int(np.minimum(own_counts[i], other_counts[j]).sum()), *sizes


def ngram_recall(pairs: DataFrame, n: int = 5) -> DataFrame:
    """``multiset_recall`` over all overlapping n-grams of the space-free texts; counted in numpy, a pair at a time."""
    def count(batches):
        for batch in batches:
            ids, a, b = batch.columns
            counts = [_shared_grams(x.as_py(), y.as_py(), n) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]], ["pair_id", "m", "sa", "sb"])

    texts = pairs.select("pair_id", tx.space_compact(F.col("a")).alias("a"), tx.space_compact(F.col("b")).alias("b"))
    kind = texts.schema["pair_id"].dataType.simpleString()
    return _ratios(texts.mapInArrow(count, f"pair_id {kind}, m long, sa long, sb long"))


def _piece_counts(a: pa.ListArray, b: pa.ListArray, unique: bool) -> list[np.ndarray]:
    """The same three numbers of every row of two columns of pieces; ``unique`` counts each piece of a text once."""
    n, sides = len(a), (a, b)
    lengths = [pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False) for side in sides]
    encoded = pa.concat_arrays([side.flatten() for side in sides]).dictionary_encode()
    codes, kinds = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(encoded.dictionary), 1)
    split = lengths[0].sum()
    keys = [np.repeat(np.arange(n), size) * kinds + own for size, own in zip(lengths, (codes[:split], codes[split:]))]
    (own, own_counts), (other, other_counts) = (np.unique(key, return_counts=True) for key in keys)
    if unique:
        own_counts[:], other_counts[:] = 1, 1
    met, i, j = np.intersect1d(own, other, assume_unique=True, return_indices=True)
    parts = ((met, np.minimum(own_counts[i], other_counts[j])), (own, own_counts), (other, other_counts))
    return [np.bincount(key // kinds, weights=count, minlength=n).astype(np.int64) for key, count in parts]


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(1.0))


def _ratios(rows: DataFrame, *kept: str) -> DataFrame:
    return rows.select("pair_id", *kept, _ratio(F.col("m"), F.col("sa")).alias("recall_a"), _ratio(F.col("m"), F.col("sb")).alias("recall_b"))


def multiset_recall(pairs: DataFrame, pieces, carry: dict[str, Column] | None = None, unique: bool = False) -> DataFrame:
    """sum(min(n_a, n_b)) / sum(n_a), and the other way round; 1.0 when the base is empty.

    ``pairs``: pair_id (one row each), a, b; ``carry``: further columns made from them.  Both texts sit in the row of a
    pair, so its pieces are counted in the task that has the row.
    """
    def count(batches):
        for batch in batches:
            *kept, a, b = batch.columns
            counts = [pa.array(c) for c in _piece_counts(a, b, unique)]
            yield pa.RecordBatch.from_arrays([*kept, *counts], [*batch.schema.names[:-2], "m", "sa", "sb"])

    carried = [c.alias(name) for name, c in (carry or {}).items()]
    rows = pairs.select("pair_id", *carried, pieces(F.col("a")).alias("a"), pieces(F.col("b")).alias("b"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]]
    return _ratios(rows.mapInArrow(count, ", ".join([*kinds, "m long, sa long, sb long"])), *(carry or {}))


def unique_recall(pairs: DataFrame, pieces) -> DataFrame:
    """The same over distinct pieces."""
    return multiset_recall(pairs, pieces, unique=True)


def _coverage(items: Column, target: Column) -> Column:
    """struct(total, hits, misses): items whose space-free form is inside the target's."""
    def measure(s):
        def hit(x):
            compact = tx.space_compact(x)
            return (compact != "") & s["t"].contains(compact)

        return F.struct(
            F.size(s["i"]).alias("total"), F.size(F.filter(s["i"], hit)).alias("hits"),
            F.filter(s["i"], lambda x: ~hit(x)).alias("misses"),
        )

    return tx.let(F.struct(items.alias("i"), tx.space_compact(target).alias("t")), measure)


def line_items(text: Column) -> Column:
    tidy = F.transform(F.split(F.coalesce(text, F.lit("")), tx.LINE_BREAK), lambda x: tx.clean_text(F.regexp_replace(x, f"{tx.WS}+", " ")))
    return F.filter(tidy, lambda x: F.length(x) >= MIN_LINE)


def _as_ratio(c: Column) -> Column:
    return F.when(c["total"] > 0, c["hits"] / c["total"]).otherwise(F.lit(1.0))


def line_coverage(pairs: DataFrame) -> DataFrame:
    """Share of the lines of a found in b, with those that are not.  Both texts sit in the row: no join."""
    rows = pairs.select("pair_id", _coverage(line_items(F.col("a")), F.col("b")).alias("c"))
    return rows.select("pair_id", F.col("c.total").alias("line_count"), _as_ratio(F.col("c")).alias("coverage"), F.col("c.misses").alias("misses"))


def markdown_rows(text: Column) -> Column:
    """Data rows of pipe tables (separator rows are left out)."""
    def is_row(x):
        return x.startswith("|") & F.substring(x, 2, 1 << 30).contains("|")

    def is_separator(x):
        cells = F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|")
        return F.forall(cells, lambda c: tx.clean_text(c).rlike("^:?-{3,}:?$"))

    return F.filter(tx.lines(text), lambda x: is_row(x) & ~is_separator(x))


def markdown_table_count(text: Column) -> Column:
    """Separator lines that follow a line starting with a bar."""
    sep = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"
    raw = F.split(F.coalesce(text, F.lit("")), tx.LINE_BREAK)
    return tx.let(
        raw,
        lambda rows: F.size(
            F.filter(rows, lambda x, i: (i > 0) & x.rlike(sep) & tx.clean_text(F.get(rows, i - 1)).startswith("|"))
        ),
    )


def row_coverage(pairs: DataFrame) -> DataFrame:
    rows = pairs.select("pair_id", _coverage(markdown_rows(F.col("a")), F.col("b")).alias("c"))
    return rows.select("pair_id", F.col("c.total").alias("row_count"), _as_ratio(F.col("c")).alias("coverage"))


def row_token_coverage(pairs: DataFrame, rows_of=markdown_rows, min_recall: float = MIN_ROW_RECALL) -> DataFrame:
    """Share of rows of a of which enough tokens occur in b; a row without tokens counts as found."""
    rows = pairs.select("pair_id", F.posexplode(rows_of(F.col("a"))).alias("row", "line"))
    tokens = rows.select("pair_id", "row", F.explode_outer(F.array_distinct(tx.tokenize(F.col("line")))).alias("token"))
    target = pairs.select("pair_id", F.explode(F.array_distinct(tx.tokenize(F.col("b")))).alias("token")).withColumn("hit", F.lit(1))
    per_row = tokens.join(target, ["pair_id", "token"], "left").groupBy("pair_id", "row").agg(
        F.count("token").alias("n"), F.count("hit").alias("h")
    )
    found = (F.col("n") == 0) | (F.col("h") / F.col("n") >= min_recall)
    sums = per_row.groupBy("pair_id").agg(F.count("*").alias("row_count"), F.count_if(found).alias("hits"))
    out = pairs.select("pair_id").join(sums, "pair_id", "left").fillna(0, ["row_count", "hits"])
    return out.select("pair_id", "row_count", _ratio(F.col("hits"), F.col("row_count")).alias("coverage"))


def required_terms(pairs: DataFrame, d: Dictionaries = KOREAN) -> DataFrame:
    listed = F.array(
        *[F.struct(F.lit(w).alias("term"), F.col("a").contains(w).alias("in_a"), F.col("b").contains(w).alias("in_b")) for w in d.required_terms]
    )
    return pairs.select("pair_id", F.explode(listed).alias("t")).select("pair_id", "t.*")


def line_score(line: Column, raw: Column, d: Dictionaries = KOREAN) -> Column:
    def point(cond, n=1):
        return F.when(cond, n).otherwise(0)

    return (
        point(tx.contains_any(line, d.table_terms), 2) + point(line.rlike("[0-9]{2,}|[A-Za-z]{2,}"))
        + point(F.size(tx.raw_tokens(line)) >= 4) + point(raw.rlike(rf"\t|\||{tx.WS}{{2,}}")) + point(F.length(line).between(8, 160))
    )


def table_like_lines(text: Column, page_of, d: Dictionaries = KOREAN, limit: int | None = None) -> Column:
    """Table-like lines of a text: array of (neg_score, page_number, text), best first.  ``page_of``: line index -> page."""
    def scored(raw, i):
        line = tx.clean_text(F.regexp_replace(raw, r"[ \t]+", " "))
        return tx.let(
            F.struct(line.alias("l"), raw.alias("r")),
            lambda s: F.struct((-line_score(s["l"], s["r"], d)).alias("neg_score"), page_of(i).alias("page_number"), s["l"].alias("text")),
        )

    rows = F.transform(F.split(F.coalesce(text, F.lit("")), tx.LINE_BREAK), scored)
    return tx.first_items(F.array_sort(F.filter(rows, lambda r: (r["neg_score"] <= -3) & (r["text"] != ""))), limit)


def line_queries(lines: Column, defaults=tuple(fv.DEFAULT_LINE_QUERIES), limit: int | None = None, words_each: int | None = None) -> Column:
    """Search texts from the lines: their tokens that are no numbers, then defaults; both limits are for callers that try a few."""
    def words(line):
        tokens = F.filter(tx.raw_tokens(line), lambda t: ~t.rlike("^[0-9]+$"))
        return F.array_join(tx.first_items(tokens, words_each), " ")

    made = F.array_distinct(F.filter(F.transform(lines, words), lambda q: F.length(q) >= 4))
    return tx.first_items(F.array_distinct(F.concat(made, tx.str_array(defaults))), limit)


def top_terms(texts: DataFrame, by: str, stopwords=tuple(fv.TERM_STOPWORDS), k: int = 20, min_length: int = 2) -> DataFrame:
    """Most frequent tokens per group without stopwords and numbers; ties by term."""
    words = texts.select(by, F.explode(tx.raw_tokens(F.col("text"))).alias("term")).filter(
        ~F.col("term").isin(*stopwords) & ~F.col("term").rlike("^[0-9]+$") & (F.length("term") >= min_length)
    )
    counts = words.groupBy(by, "term").agg(F.count("*").alias("term_count"))
    order = F.row_number().over(W.partitionBy(by).orderBy(F.desc("term_count"), "term"))
    return counts.withColumn("position", order).filter(F.col("position") <= k)


def page_coverage(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), (F.count_if(F.col("char_count") > 0) / F.count("*")).alias("coverage"))


def gates(rows: DataFrame, errors: dict, warnings: dict | None = None) -> DataFrame:
    """Metrics against least values: names of the failed ones.  A warning does not fail a row."""
    def below(table):
        return F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(0)) < least, c) for c, least in table.items()]))

    out = rows.withColumns({"errors": below(errors), "warnings": below(warnings) if warnings else tx.str_array([])})
    return out.withColumn("passed", F.size("errors") == 0)


def metric_rollup(rows: DataFrame, metrics) -> DataFrame:
    """Average, least and greatest value of each metric over all rows (exact sums, so order does not matter)."""
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    long = rows.select(F.explode(listed).alias("m")).select("m.*").filter(F.col("value").isNotNull())
    total = F.sum(F.col("value").cast("decimal(28,10)")).cast("double")
    return long.groupBy("metric").agg(
        F.count("*").alias("row_count"), F.round(total / F.count("*"), 6).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )


def encoding_findings(texts: DataFrame, tokens=tuple(fv.MOJIBAKE_TOKENS)) -> DataFrame:
    """Every line that holds a sign of broken encoding."""
    lines = F.transform(F.split("text", tx.LINE_BREAK), lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("line")))
    bad = F.filter(lines, lambda r: tx.contains_any(r["line"], tokens))
    return texts.select("doc_id", F.explode(bad).alias("f")).select("doc_id", "f.line_number", F.col("f.line").alias("excerpt"))


def forbidden_terms(rows: DataFrame, text: str, d: Dictionaries = KOREAN) -> DataFrame:
    """Rows whose text holds a banned word, with the words found."""
    low = F.lower(F.col(text))
    found = F.array_compact(F.array(*[F.when(low.contains(w), w) for w in d.forbidden_terms]))
    return rows.withColumn("forbidden_found", found).filter(F.size("forbidden_found") > 0)


def fulltext_gates(documents: DataFrame, candidates: DataFrame, d: Dictionaries = KOREAN, min_chars: int = 200, min_candidates: int = 3) -> DataFrame:
    """Per document: length, candidates, those that mean something, banned words, and whether it passes."""
    text = F.concat_ws("\n", "required_value", "source_text")
    low = F.lower(text)
    per = candidates.groupBy("notice_id").agg(
        F.count("*").alias("candidate_count"), F.count_if(F.col("requirement_type").isin(*fv.SEMANTIC_TYPES)).alias("semantic_count"),
        *[F.max(low.contains(w).cast("int")).alias(f"f{i}") for i, w in enumerate(d.forbidden_terms)],
    )
    rows = documents.select(F.col("doc_id").alias("notice_id"), F.length(tx.clean_text(F.col("text"))).alias("text_chars")).join(per, "notice_id", "left")
    found = F.array_compact(F.array(*[F.when(F.col(f"f{i}") == 1, w) for i, w in enumerate(d.forbidden_terms)]))
    rows = rows.withColumns({"forbidden_found": found}).fillna(0, ["candidate_count", "semantic_count"])
    passed = (
        (F.col("text_chars") >= min_chars) & (F.col("candidate_count") >= min_candidates) & (F.col("semantic_count") >= 1)
        & (F.size("forbidden_found") == 0)
    )
    return rows.select("notice_id", "text_chars", "candidate_count", "semantic_count", "forbidden_found", passed.alias("passed"))


def corpus_sample(rows: DataFrame, key: str, text: str, passed: Column, n: int, seed: int = 0) -> DataFrame:
    """A repeatable sample of ``n`` distinct texts that pass: order by a seeded hash, then a limit."""
    distinct = rows.filter(passed).groupBy(F.sha2(text, 256).alias("text_hash")).agg(F.min(key).alias(key))
    return distinct.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), "text_hash"), 256), "text_hash").limit(n)
