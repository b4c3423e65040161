"""Operators that compare texts, and the pipeline."""

import collections
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bidlens.llm import components, jaccard_join, substring_dedup
from bidlens.llm.shingles import words_of
from bidlens.llm.tables import Scratch
from llm_fixtures import documents, empty, messy_texts, prose


# ---- 3 Jaccard join -----------------------------------------------------------------------------------------
def brute_components(rows, size, percent):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = words_of(t, lower=True)
        if i is not None:
            sets[i].append(frozenset(tuple(w[k:k + size]) for k in range(max(len(w) - size, 0) + 1)) if w else frozenset())
    of = {i: i for i in sets}

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        for x, y in itertools.product(sets[a], sets[b]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                of[max(p, q)] = min(p, q)
    return {i: ({len(s) for s in sets[i]}, find(i)) for i in sets}


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_components_against_brute_force(spark, size, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 8)
    rnd, rows = random.Random(size), [(i, t) for i, t, _, _ in messy_texts() if i not in (10,)]
    for family in range(6):
        base = prose(100 + family, 150).split()
        for copy in range(25):
            words = list(base)
            for _ in range(rnd.randrange(7)):
                words[rnd.randrange(len(words))] = f"e{rnd.randrange(9)}"
            rows.append((1000 + family * 100 + copy, " ".join(words)))
    rows += [(2000, rows[-1][1]), (2000, prose(8, 50)), (2001, prose(8, 50))]
    frame = documents(spark, [(i, t, "en", "a") for i, t in rows])
    got = collections.defaultdict(set)
    for r in jaccard_join.near_components(frame, size, percent).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id))
    want = brute_components(rows, size, percent)
    assert {i: ({n for n, _ in v}, {c for _, c in v}) for i, v in got.items() if i is not None} == {i: (n, {c}) for i, (n, c) in want.items()}
    assert {c for _, c in got[None]} == {None}


def test_join_of_a_large_group_is_not_all_pairs(spark):
    base = prose(7, 150).split()
    rows = []
    for i in range(600):
        words = list(base)
        for k in range(i % 3):
            words[(i * 7 + k * 50) % 150] = f"only{i}x{k}"
        rows.append((i, " ".join(words), "en", "a"))
    frame = documents(spark, rows)
    assert {r.component_id for r in jaccard_join.near_components(frame).collect() if r.doc_id % 3 < 2} == {0}


def test_join_of_nothing(spark):
    assert jaccard_join.near_components(empty(spark)).count() == 0
    blank = documents(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (3, " ", "en", "a")])
    assert sorted(map(tuple, jaccard_join.near_components(blank).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 160)] + [(159, 200), (200, 99)]
    links = spark.createDataFrame(path + star + [(5, 5), (3, 2)], "a long, b long")
    got = {r.id: r.component for r in components.components(links, Scratch(spark, "t"), "c").collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 99 for i in [*range(100, 160), 200]}}


# ---- 7 substring dedup --------------------------------------------------------------------------------------
def brute_windows(rows, size):
    first = {}
    words = {i: words_of(t) for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k:k + size]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < i:
                gone[k:k + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block_chars", [500, 4_000_000])
@pytest.mark.parametrize("size", [2, 5, 13])
def test_windows_against_brute_force(spark, monkeypatch, block_chars, size):
    monkeypatch.setattr(substring_dedup, "BLOCK_CHARS", block_chars)
    rnd, rows = random.Random(size), {i: t for i, t, _, _ in messy_texts() if i is not None and i != 10}
    for d in range(100, 160):
        words = prose(d, 60, 30).split() + ["r"] * rnd.randrange(40) + prose(rnd.randrange(5), 40).split() + ["a", "b"] * rnd.randrange(20)
        rows[d] = " ".join(words[rnd.randrange(10):])
    frame = documents(spark, [(i, t, "en", "a") for i, t in rows.items()])
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.repeat_table(frame, size).collect()}
    assert got == brute_windows(rows.items(), size)


def test_windows_of_messy_rows(spark):
    got = substring_dedup.repeat_table(documents(spark)).collect()
    assert len(got) == len(messy_texts())
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert len({tuple(r) for r in got if r.doc_id == 3}) == 1
    assert substring_dedup.repeat_table(empty(spark)).count() == 0


def test_equal_windows_get_equal_keys():
    rnd = random.Random(1)
    import numpy as np

    from bidlens.llm.shingles import WordDigests

    seen = WordDigests()
    shared = [f"s{rnd.randrange(3)}".encode() for _ in range(80)]
    around = lambda: [f"s{rnd.randrange(3)}".encode() for _ in range(rnd.randrange(30))]
    keys = []
    for _ in range(40):
        before = around()
        words = before + shared + around()
        start, key = substring_dedup.window_keys(seen.of(words), np.zeros(len(words), np.int64), 13)
        at = dict(zip(start.tolist(), key.tolist()))
        keys.append([at[len(before) + k] for k in range(len(shared) - 12)])
    assert all(k == keys[0] for k in keys)


# ---- the pipeline -------------------------------------------------------------------------------------------
def written(spark, folder, rows, labels, items):
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_stages_take_effect(spark, tmp_path):
    rows = [(i, prose(i, 80) + (" vileword" if i % 5 == 0 else ""), "en", "a") for i in range(300)]
    passage, item = prose(9001, 60), prose(9002, 30)
    near = rows[1][1].split()
    near[40] = "other"
    rows += [(400, " ".join(near), "en", "a"), (401, f"{prose(901, 70)} {passage} {prose(902, 40)}", "en", "a"), (402, f"{prose(903, 70)} {passage} {prose(904, 40)}", "en", "a")]
    rows += [(403, f"{prose(905, 50)} {item} {prose(906, 50)}", "en", "a"), (404, None, None, None), (None, prose(907, 50), "en", "a")]
    folder = written(spark, tmp_path / "t", rows, [(i, 1, int(i % 5 == 0)) for i in range(300)], [(1, item)])
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {i for i in range(300) if i % 5}
    assert clean - set(seen["toxicity"]) == set() and len(set(range(0, 300, 5)) & set(seen["toxicity"])) < 5
    assert 400 in seen["toxicity"] and 400 not in seen["near_duplicates"] and 1 in seen["near_duplicates"]
    assert passage in seen["substring_dedup"][401].text and passage not in seen["substring_dedup"][402].text
    assert 403 in seen["substring_dedup"] and 403 not in seen["decontamination"]
    assert clean | {None, 401, 402, 404} <= set(seen["byte_bpe"])
    whole = corpus_pipeline.run(spark, folder)
    assert {r.doc_id: r.ids_sha256 for r in whole.collect()} == {i: r.ids_sha256 for i, r in seen["byte_bpe"].items()}


def test_pipeline_of_empty_tables(spark, tmp_path):
    folder = written(spark, tmp_path / "t", [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


# ---- links of the Jaccard join ------------------------------------------------------------------------------
@pytest.mark.parametrize("percent", [90])
def test_links_against_brute_force(spark, percent):
    rnd, rows = random.Random(4), []
    for family in range(4):
        base = prose(300 + family, 150).split()
        for copy in range(20):
            words = list(base)
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(len(words))] = f"e{rnd.randrange(9)}"
            rows.append((family * 100 + copy, " ".join(words)))
    sets = {i: frozenset(zip(t.split(), t.split()[1:], t.split()[2:])) for i, t in rows}
    near = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    pairs, members = jaccard_join.links(documents(spark, [(i, t, "en", "a") for i, t in rows]), 3, percent)
    rep = {r.doc_id: r.rep for r in members.collect()}
    assert rep == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for a, b in near if rep[a] == a and rep[b] == b and sets[a] != sets[b]}
    counts = collections.Counter(i for pair in near for i in pair)
    assert {r.doc_id: r.n_links for r in jaccard_join.link_counts(pairs, members).collect()} == {i: counts[i] for i in sets}


def test_one_row_of_an_id_stays(spark):
    rows = [(1, prose(1, 40), "en", "a"), (1, prose(2, 40), "en", "a"), (1, prose(2, 40), "en", "a"), (2, prose(3, 40), "en", "b"), (2, prose(3, 40), "en", "b"),
            (3, prose(4, 40), "en", None), (4, prose(4, 40), None, "c"), (None, prose(5, 30), "en", "a"), (None, prose(5, 30), "en", "a"), (5, None, "en", "a")]
    frame = documents(spark, rows)
    got = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    digest = F.xxhash64(*corpus_pipeline.COLUMNS)
    least = frame.filter("doc_id = 1").orderBy(digest).first().text
    assert kept == sorted([(1, least), (2, prose(3, 40)), (3, prose(4, 40)), (None, prose(5, 30)), (None, prose(5, 30)), (5, None)], key=str)
    assert corpus_pipeline.drop_near_duplicates(spark, empty(spark), "").count() == 0
