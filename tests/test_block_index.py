"""The stored block index against scoring every passage, its pruning, and how it spreads a frequent token."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.operators import block_index as bi
from bidlens.operators import index as ix
from bidlens.operators import search as se


def passages(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, chunk_id long, chunk_index long, category string, document_version string, chunk_text string")


def corpus(seed, docs, step=1):
    rnd, rows = random.Random(seed), []
    for d in range(docs):
        lang = ["en", "de", None][d % 3]
        for c in range(rnd.randrange(1, 4)):
            words = [f"{lang}{int(rnd.paretovariate(0.6)) % 300}" for _ in range(30)] + ["common"]
            rows.append((d * step, d * step * 10 + c, c, lang, f"v{d % 2}", " ".join(words)))
    return rows


def questions(spark, rows, n):
    rnd = random.Random(n)
    asked = [(i, " ".join(rnd.sample(rnd.choice(rows)[5].split(), 8)) + " common other") for i in range(n)]
    return spark.createDataFrame(asked + [(900, "common"), (901, "nothing here"), (902, ""), (903, None)], "query_id long, query string")


@pytest.mark.parametrize("step", [1, 1000])
def test_search_equals_scoring_everything(spark, tmp_path, step, monkeypatch):
    monkeypatch.setattr(bi, "DOCUMENTS", 12)
    monkeypatch.setattr(bi, "PASSAGES", 16)
    rows = corpus(7, 500, step)
    table = passages(spark, rows)
    documents = table.select("doc_id", "category", "document_version").distinct()
    index = bi.build(table, bi.span_of(documents), folders=3)
    bi.write(index, f"{tmp_path}/index")
    stored = spark.read.schema(index.schema).parquet(f"{tmp_path}/index")
    asked = questions(spark, rows, 25)
    for category, version, k in (("", "", 5), ("de", "", 3), ("", "v1", 1), ("en", "v0", 20)):
        kept = table
        if category:
            kept = kept.filter(F.col("category") == category)
        if version:
            kept = kept.filter(F.col("document_version") == version)
        want = se.topk(asked, ix.postings(kept.select("doc_id", "chunk_id", "chunk_index", "chunk_text")), k)
        got = bi.topk(asked, bi.only(stored, category, version), k, folders=3)
        columns = ["query_id", "rank", "doc_id", "chunk_id", "shared", "score"]
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_the_floor_prunes_blocks(spark, monkeypatch):
    monkeypatch.setattr(bi, "DOCUMENTS", 12)
    rows = corpus(8, 600)
    rows += [(5000 + i, 50000 + i, 0, "en", "v0", "alpha beta gamma delta common") for i in range(6)]
    table = passages(spark, rows)
    index = bi.build(table, bi.span_of(table.select("doc_id", "category", "document_version").distinct()))
    asked = spark.createDataFrame([(1, "alpha beta gamma delta common")], "query_id long, query string")
    tokens, first, rest = bi.chosen_blocks(asked, index, 5, folders=1)
    assert bi.block_bounds(tokens, index).count() > 15 and first.count() == 2 and rest.count() == 0
    assert [r.doc_id for r in bi.topk(asked, index, 5).orderBy("rank").collect()] == [5005, 5004, 5003, 5002, 5001]


def test_no_token_is_one_task(spark):
    rows = [(i, i * 10, 0, "en", "v0", f"common word{i % 50}") for i in range(10_000)]
    table = passages(spark, rows)
    index = bi.build(table, bi.span_of(table.select("doc_id", "category", "document_version")))
    hot = index.filter(F.col("token") == "common").select(F.size("passages").alias("n")).collect()
    assert sum(r.n for r in hot) == 10_000 and len(hot) >= 10_000 // bi.PASSAGES and max(r.n for r in hot) <= bi.PASSAGES
    tokens = bi._asked(spark.createDataFrame([(q, "common") for q in range(40)], "query_id long, query string"), 1)
    blocks = bi.block_bounds(tokens, index)
    wanted = blocks.select("query_id", "block").join(tokens, "query_id").repartition(64, "folder", "token", "block")
    sizes = sorted(r["count"] for r in wanted.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 5 * sizes[len(sizes) // 2]


def test_index_of_nothing(spark):
    table = passages(spark, [])
    index = bi.build(table, bi.span_of(table.select("doc_id", "category", "document_version")))
    assert bi.topk(spark.createDataFrame([(1, "alpha")], "query_id long, query string"), index).count() == 0


def test_no_count_of_a_passage_moves(spark):
    rows = corpus(9, 300)
    table = passages(spark, rows)
    index = bi.build(table, bi.span_of(table.select("doc_id", "category", "document_version").distinct()))
    tokens = bi._asked(questions(spark, rows, 25), 1)
    found = bi.scored(bi.block_bounds(tokens, index), tokens, index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    opened = plan.index("Generate explode(passages")  # above it in the plan, so after it in the run, nothing is exchanged
    assert "Exchange" not in plan[:opened] and found.count() > 0


def test_queries_of_the_same_known_tokens_are_searched_once(spark, monkeypatch):
    asked, before = [], bi.blocks_for
    monkeypatch.setattr(bi, "blocks_for", lambda tokens, index, k: asked.append(tokens) or before(tokens, index, k))
    rows = corpus(5, 200)
    table = passages(spark, rows)
    index = bi.build(table, bi.span_of(table.select("doc_id", "category", "document_version").distinct()))
    queries = spark.createDataFrame([(i, f"common {rows[i % 2][5].split()[0]} nowhere{i}" + " neither" * (i % 3)) for i in range(50)], "query_id long, query string")
    want = se.topk(queries, ix.postings(table.select("doc_id", "chunk_id", "chunk_index", "chunk_text")), 3)
    columns = ["query_id", "rank", "doc_id", "chunk_id", "shared", "score"]
    assert sorted(map(tuple, bi.topk(queries, index, 3).select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert asked[0].select("query_id").distinct().count() <= 2


def test_where_all_share_as_much_only_the_newest_blocks_are_read(spark, monkeypatch):
    monkeypatch.setattr(bi, "DOCUMENTS", 12)
    table = passages(spark, [(i, i * 10, 0, "en", "v0", f"common word{i}") for i in range(1200)])
    index = bi.build(table, bi.span_of(table.select("doc_id", "category", "document_version")))
    asked = spark.createDataFrame([(1, "common")], "query_id long, query string")
    tokens, first, rest = bi.chosen_blocks(asked, index, 5, folders=1)
    assert bi.block_bounds(tokens, index).count() >= 90 and first.count() == 2 and rest.count() == 0
    assert [r.doc_id for r in bi.topk(asked, index, 5).orderBy("rank").collect()] == [1199, 1198, 1197, 1196, 1195]


def test_best_of_a_block_counted_in_slices(spark, monkeypatch):
    """Few or many queries at once, passages that are listed twice, and fewer passages than k."""
    rows = corpus(6, 120)
    table = passages(spark, rows + rows[:9])
    index = bi.build(table, bi.span_of(table.select("doc_id", "category", "document_version").distinct()))
    tokens = bi._asked(questions(spark, rows, 15), 1)
    chosen = bi.block_bounds(tokens, index)
    place = W.partitionBy("query_id").orderBy(F.desc("shared"), F.desc("doc_id"), "chunk_index")
    columns = ["query_id", "doc_id", "chunk_id", "chunk_index", "shared"]

    def best(frame, k):
        return sorted(map(tuple, frame.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= k).select(*columns).collect()))

    for cells, k in ((1, 3), (4_000_000, 3), (500, 300)):
        monkeypatch.setattr(bi, "CELLS", cells)
        assert best(bi.best_of_blocks(chosen, tokens, index, k), k) == best(bi.scored(chosen, tokens, index), k)


def test_index_is_made_once_to_be_written(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(token):
        made.add(1)
        return token

    index = bi.build(passages(spark, corpus(3, 100)), 50, folders=2)
    bi.write(index.withColumn("token", seen.asNondeterministic()("token")), f"{tmp_path}/index")
    assert made.value == spark.read.parquet(f"{tmp_path}/index").count() == index.count() > 0


def test_tokens_of_the_index_are_those_of_queries(spark):
    """Passages are cut into tokens in Arrow."""
    odd = ["Ab가b 1x ﾊﾝ", "İstanbul ẞtraße KELVIN Kelvin ﬁsh", "가힣 힤가 ᄀ가 가", "a b c", "a_b-cd.EF ef cd", "😀ab😀cd", "ab cd​ef", "é1 1é2 22é", "", None, "  ab  "]
    table = passages(spark, [(i, i * 10, 0, "en", "v0", x) for i, x in enumerate(odd)])
    want = ix.postings(table.select("doc_id", "chunk_id", "chunk_index", "chunk_text")).select("token", "doc_id")
    got = bi.build(table, 100).select("token", F.explode("passages").alias("p")).select("token", "p.doc_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
