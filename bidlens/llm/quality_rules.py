"""Quality rules as a short-circuit cascade.

Every rule is a column expression over measures of the whole text.  On a sample the cascade times each rule and counts
what it rejects, and then asks the rules in the order of rejection per cost: the first that rejects ends the row.
The order changes what a run costs, never what it keeps.

A null text counts as the empty one.  Empty texts fail the base rule.  Repeated rows are judged alike, each by itself;
columns other than id and text are not looked at.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.tables import BLANKS, Scratch

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds an expression that ``body`` uses in its lambdas, so that it is evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def covered(starts: Column) -> Column:
    """Words in the union of windows with the given ascending starts."""
    steps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def repeated_starts(grams: Column) -> Column:
    """Ascending positions of grams that occur twice or more: equal ones are neighbours after sorting."""
    def positions(pairs: Column) -> Column:
        marked = F.transform(
            pairs,
            lambda pair, k: F.when((pair["g"] == F.get(pairs, k - 1)["g"]) | (pair["g"] == F.get(pairs, k + 1)["g"]), pair["i"]),
        )
        return F.array_sort(F.array_compact(marked))

    return let(F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), positions)


def repeat_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more in the text; sorts only where some window does."""
    def count(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(repeated_starts(grams), covered)).otherwise(0)

    def of(bound: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(bound) - WINDOW)
        grams = F.transform(starts, lambda i: F.xxhash64(*[F.get(bound, i + k) for k in range(WINDOW)]))
        return F.when(F.size(bound) > WINDOW, let(grams, count)).otherwise(0)

    return let(words, of)


def measures(documents: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row."""
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"words": words_of(F.col("text")), "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))})
    return rows.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def rules() -> dict[str, Column]:
    """Name -> what rejects a row.  All are whole-number comparisons."""
    text, words = F.col("text"), F.col("n_words")
    return {
        "symbols": F.col("n_symbols") * 10 > words,
        "dup_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * 30,
        "shouting": (F.length(text) - F.length(F.translate(text, "!", ""))) * 10 > words,
        "capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) * 2 > F.col("word_chars"),
        "word_length": (F.col("word_chars") < words * 2) | (F.col("word_chars") > words * 15),
    }


def cascade_order(documents: DataFrame, sample_rows: int = 2000, seed: int = 7) -> list[str]:
    """Rule names by rejection per second, both estimated on a random sample of about ``sample_rows`` rows."""
    scratch = Scratch(documents.sparkSession, "rules")
    total = documents.select("doc_id").count()
    if not total:
        return list(rules())
    sample = scratch.keep(measures(documents.sample(min(1.0, sample_rows / total), seed)), "sample")
    rejects = sample.select(*[F.avg(rule.cast("int")).alias(name) for name, rule in rules().items()]).first().asDict()
    seconds = {}
    for name, rule in rules().items():
        started = time.perf_counter()
        sample.select(rule).write.format("noop").mode("overwrite").save()
        seconds[name] = time.perf_counter() - started
    scratch.drop("sample")
    return sorted(seconds, key=lambda name: -(rejects[name] or 0) / seconds[name])


def cascade(order: list[str]) -> Column:
    """True for rows that no rule rejects; a rejected row is asked no further rule."""
    verdict = F.when(base_failed(), False)
    for name in order:
        verdict = verdict.when(rules()[name], False)
    return verdict.otherwise(True)


def judge(documents: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """Measures of every row, whether the base rule failed and whether the cascade keeps the row."""
    return measures(documents).withColumns({"base_failed": base_failed(), "kept": cascade(cascade_order(documents, sample_rows))})


def rule_table(documents: DataFrame) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(documents).select(*columns)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT id, i, words[i:i + 4] AS gram FROM (SELECT id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) > 5)
), twice AS (
  SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, gram) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT id, count(DISTINCT w) AS n FROM (SELECT id, unnest(range(i, i + 5)) AS w FROM twice) GROUP BY id
), m AS (
  SELECT d.doc_id, d.text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN repeated r USING (id)
), b AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 100 > n_lines * 30 OR length(regexp_replace(text, '[^!]', '', 'g')) * 10 > n_words
    OR length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) * 2 > word_chars OR word_chars < n_words * 2 OR word_chars > n_words * 15) AS kept
FROM b
"""
