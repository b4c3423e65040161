"""The k best rules of each requirement text by token overlap, without counting every pair that shares a token.

A text's tokens are ordered by how few rules hold them.  A rule that shares none of the first p of m tokens shares m - p at
most, so once a floor for the k-th score is known, only rules met on the first tokens can enter the best k, and of these
only those whose count so far can still reach the floor are scored.  The floor comes from exact scores of a few rules that
share most of the rarest tokens.  The most frequent tokens, which make most pairs, are joined only where the floor is low.
Texts of a type and length that differ only in tokens which no rule holds have the same best rules, found once.

``all_pairs`` counts every pair that shares a token.  Blocks of texts meet groups of rules, and a pair is counted in the
task that has both: no row for a shared token is made, and no pair is shuffled or held in a hash table.
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

from bidlens.functions import text as tx
from bidlens.functions.text import NO_TOKEN  # a value: workers don't have the module
from bidlens.operators.search import BASIS_TYPE, SAME_TYPE, pair_score

LARGEST_BONUS = 0.25  # type and confidence together
RARE = 3  # one in so many of a text's tokens, the rarest, find the rules that give the floor
SEEDS = 3  # times k rules are scored for the floor
BLOCK_TEXTS, GROUP_RULES = 1000, 2000  # of one block and of one group, about
CELLS = 2_000_000  # pairs, and tokens that they share, that are counted at once

# workers get what a task needs of this module from the driver
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def texts_by_rarity(requirements: DataFrame, rules: DataFrame) -> DataFrame:
    """(requirement_key, requirement_type, query_size, tokens): tokens that some rule holds, rarest first."""
    frequency = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    wanted = F.array_distinct(tx.tokenize(F.col("requirement_text")))
    left = requirements.select("requirement_key", "requirement_type", F.size(wanted).alias("query_size"), F.explode(wanted).alias("token"))
    known = left.join(frequency, "token").groupBy("requirement_key", "requirement_type", "query_size")
    listed = known.agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))  # one text's own tokens
    return listed.select("requirement_key", "requirement_type", "query_size", F.transform("ranked", lambda r: r["token"]).alias("tokens"))


def with_class(texts: DataFrame) -> DataFrame:
    """Texts ``texts_by_rarity`` with the first key of those that share type, size and tokens with them."""
    return texts.withColumn("first_key", F.min("requirement_key").over(W.partitionBy("requirement_type", "query_size", "tokens")))


def met(texts: DataFrame, rules: DataFrame, first: Column) -> DataFrame:
    """(requirement_key, rule_id, seen): rules that hold some of a text's ``first`` tokens, and how many."""
    asked = texts.select("requirement_key", F.explode(F.slice("tokens", F.lit(1), first)).alias("token"))
    posted = rules.select("rule_id", F.explode("tokens").alias("token"))
    return asked.join(posted, "token").groupBy("requirement_key", "rule_id").agg(F.count("*").alias("seen"))


def verified(pairs: DataFrame, texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Exact overlap and score of the given pairs; the shorter list, a text's, is the one that is hashed."""
    own = texts.select("requirement_key", F.col("tokens").alias("wanted"))
    both = pairs.join(own, "requirement_key").join(rules.select("rule_id", "tokens"), "rule_id")
    scored = both.withColumn("shared", F.size(F.array_intersect("tokens", "wanted")).cast("long")).drop("wanted", "tokens")
    return scored.withColumn("score", pair_score(F.col("shared")))


def described(pairs: DataFrame, texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs with what their score needs besides the overlap."""
    kinds = texts.select("requirement_key", "requirement_type", "query_size", F.size("tokens").alias("known"), *[c for c in ("first", "floor") if c in texts.columns])
    return pairs.join(kinds, "requirement_key").join(rules.drop("tokens"), "rule_id")


def with_floor(texts: DataFrame, rules: DataFrame, k: int) -> DataFrame:
    """Texts with the k-th best score among the seeds (null where there are fewer) and how many tokens can matter."""
    rare = F.greatest(F.lit(1), F.ceil(F.size("tokens") / RARE).cast("int"))
    pairs = described(met(texts, rules, rare), texts, rules)
    best = W.partitionBy("requirement_key").orderBy(F.desc(pair_score(F.col("seen"))), "rule_id")
    seeds = verified(pairs.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= SEEDS * k).drop("n"), texts, rules)
    place = W.partitionBy("requirement_key").orderBy(F.desc("score"), "rule_id")
    floors = seeds.withColumn("n", F.row_number().over(place)).filter(F.col("n") == k).select("requirement_key", F.col("score").alias("floor"))
    size = F.size("tokens")
    # a rule met on none of the first p tokens scores (m - p) / n + 0.25 at most; four digits are rounded
    enough = F.floor(size - F.col("query_size") * (F.col("floor") - LARGEST_BONUS - 0.0002)).cast("int") + 1
    first = F.when(F.col("floor").isNull(), size).otherwise(F.least(size, F.greatest(enough, F.lit(1))))
    return texts.join(floors, "requirement_key", "left").withColumn("first", first)


def contenders(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs that can reach the floor of their text, from texts ``with_floor``."""
    pairs = described(met(texts, rules, F.col("first")), texts, rules)
    most = pair_score(F.col("seen") + F.col("known") - F.col("first"))
    return pairs.filter(F.col("floor").isNull() | (most >= F.col("floor")))


def topk(requirements: DataFrame, rules: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The k best (requirement_key, rule) by score, then ``order``; equal to ranking every pair that shares a token.

    ``requirements``: requirement_key, requirement_type, requirement_text; ``rules``: rule_id, rule_type, confidence,
    rule_text, or its distinct ``tokens``, and columns that ``order`` or the caller needs.
    """
    if "tokens" not in rules.columns:
        rules = rules.withColumn("tokens", F.array_distinct(tx.tokenize(F.col("rule_text")))).drop("rule_text")
    every = with_class(texts_by_rarity(requirements, rules))
    texts = every.filter(F.col("requirement_key") == F.col("first_key")).drop("first_key")
    pairs = contenders(with_floor(texts, rules, k), rules)
    scores = verified(pairs, texts, rules).drop("seen", "known", "first", "floor")
    place = W.partitionBy("requirement_key").orderBy(F.desc("score"), *order)
    best = scores.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return best.withColumnRenamed("requirement_key", "first_key").join(every.select("requirement_key", "first_key"), "first_key").drop("first_key")


def _numbered(table: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each different combination of some columns, number of the combination of each row)."""
    codes = np.zeros(len(table), np.int64)
    for name in names:
        column = table[name].combine_chunks().dictionary_encode(null_encoding="encode")
        own = column.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes * (len(column.dictionary) + 1) + own, return_inverse=True)[1]
    return np.unique(codes, return_index=True)[1], codes


def _postings(texts: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(tokens of the texts, where the list of each begins and how long it is, numbers of the texts that hold them)."""
    tokens = texts["tokens"].combine_chunks()
    encoded = tokens.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    holders = np.repeat(np.arange(len(texts)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
    sizes = np.bincount(codes, minlength=len(encoded.dictionary))
    return encoded.dictionary, np.stack([np.cumsum(sizes) - sizes, sizes]), holders[np.argsort(codes, kind="stable")]


def _shared(postings, written: pa.StringArray, numbers: np.ndarray, texts: int, rules: int) -> np.ndarray:
    """Shared tokens of every (rule, text), rule by rule; ``numbers`` says which rule each written text is of."""
    vocabulary, (begins, sizes), holders = postings
    tokens = pc.split_pattern(pc.replace_substring_regex(pc.ascii_lower(written), NO_TOKEN, " "), " ")  # as tx.tokenize
    found = pc.index_in(tokens.flatten(), value_set=vocabulary)
    rows = np.repeat(np.arange(len(written)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
    rows, found = rows[found.is_valid().to_numpy(zero_copy_only=False)], found.drop_null().to_numpy(zero_copy_only=False)
    rows, found = np.divmod(np.unique(rows * max(len(vocabulary), 1) + found), max(len(vocabulary), 1))  # a text's token once
    owners, lengths = numbers[rows], sizes[found]
    place = np.arange(lengths.sum()) + np.repeat(begins[found] - np.cumsum(lengths) + lengths, lengths)
    return np.bincount(np.repeat(owners * texts, lengths) + holders[place], minlength=rules * texts)


def _meet(texts: pa.Table, rules: pa.Table, kept: list[str], names: list[str]) -> pa.Table:
    """Pairs of a block of texts and a group of rules that share a token."""
    firsts, numbers = _numbered(rules, kept)  # rows of one rule count together
    order = np.argsort(numbers, kind="stable")
    named, numbers, written = rules.select(kept).take(firsts), numbers[order], rules["rule_text"].take(order).combine_chunks()
    kinds = pa.concat_arrays([t[c].combine_chunks() for t, c in ((texts, "requirement_type"), (named, "rule_type"))]).dictionary_encode()
    codes = pc.fill_null(kinds.indices, -1).to_numpy(zero_copy_only=False)
    wanted, own = codes[: len(texts)], codes[len(texts) :]
    basis = np.where(pc.fill_null(pc.equal(named["rule_type"], "basis_rule"), False).to_numpy(), BASIS_TYPE, 0.0)
    postings, parts = _postings(texts), []
    step = max(CELLS // max(len(texts), len(postings[2]), 1), 1)  # a rule shares no more tokens than the texts hold
    for start in range(0, max(len(firsts), 1), step):
        stop = min(start + step, len(firsts))
        a, b = np.searchsorted(numbers, [start, stop])
        counts = _shared(postings, written[a:b], numbers[a:b] - start, len(texts), stop - start)
        cells = np.flatnonzero(counts)
        rule, text = cells // max(len(texts), 1) + start, cells % max(len(texts), 1)
        bonus = np.where((wanted[text] == own[rule]) & (own[rule] >= 0), SAME_TYPE, basis[rule])
        columns = {c: texts[c].take(text) for c in ("requirement_key", "query_size")} | {c: named[c].take(rule) for c in kept}
        columns |= {"bonus": pa.array(bonus, pa.float64()), "shared": pa.array(counts[cells], pa.int64())}
        parts.append(pa.table([columns[c] for c in names], names))
    return pa.concat_tables(parts)


def all_pairs(requirements: DataFrame, rules: DataFrame, carry: tuple = (), groups: int | None = None) -> DataFrame:
    """(requirement_key, query_size, rule_id, confidence, …carry, bonus, shared) of every pair that shares a token.

    ``groups``: into how many groups the rules are dealt, for callers that know about how many rules there are; else
    they are counted.  Every block of texts meets every group.
    """
    wanted = F.array_distinct(tx.tokenize(F.col("requirement_text")))
    texts = requirements.select("requirement_key", "requirement_type", F.size(wanted).alias("query_size"), wanted.alias("tokens"))
    texts = texts.groupBy("requirement_key", "requirement_type", "query_size").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    blocks = 1 + requirements.count() // BLOCK_TEXTS
    groups = groups or 1 + rules.count() // GROUP_RULES

    def dealt(frame, key, into, over, names):
        every = F.explode(F.sequence(F.lit(0), F.lit(over - 1)))
        return frame.withColumn(names[0], F.pmod(F.xxhash64(key), F.lit(into)).cast("int")).withColumn(names[1], every)

    kept = ["rule_id", "rule_type", "confidence", *carry]
    left = dealt(texts, "requirement_key", blocks, groups, ("block", "group"))
    right = dealt(rules.select(*kept, F.coalesce("rule_text", F.lit("")).alias("rule_text")), "rule_id", groups, blocks, ("group", "block"))
    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema.fields, *right.schema.fields]} | {"bonus": "double", "shared": "bigint"}
    names = ["requirement_key", "query_size", "rule_id", "confidence", *carry, "bonus", "shared"]
    both = left.groupBy("group", "block").cogroup(right.groupBy("group", "block"))
    return both.applyInArrow(lambda a, b: _meet(a, b, kept, names), ", ".join(f"{c} {kinds[c]}" for c in names))
