"""Vector search, filter interactions and source divergences against brute force."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from bidlens.llm import filter_audit, source_audit, vector_search
from llm_fixtures import documents, empty, messy_texts, prose


# ---- 11 exact search ----------------------------------------------------------------------------------------
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS v", "1 AS query", "2 AS block", "3 AS rank")


def brute_top(rows, every, k):
    seen = set()
    for i, x in rows:
        if i is not None and x and all(c is not None and math.isfinite(c) and abs(c) < 2**18 for c in x):
            seen.add((i, tuple(math.floor(256 * float(np.float32(c))) for c in x)))
    out = []
    for q, v in seen:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in seen if (i, w) != (q, v) and len(w) == len(v))
            out += [(q, n + 1, i, -score) for n, (score, i) in enumerate(found[:k])]
    return sorted(out)


def messy_vectors():
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, [0.25, -0.5] * 4) for i in range(200)]  # a group of copies
    rows += [(2000 + i, [0.0] * 8) for i in range(60)]  # all products tie
    rows += [(3000 + i, [rnd.randrange(2) / 2 for _ in range(8)]) for i in range(120)]  # many ties
    rows += [(50, rows[50][1]), (50, [0.5] * 8), (51, [0.75] * 8), (51, [0.75] * 8)]  # repeated rows, one id with several vectors
    rows += [(4000, None), (4001, []), (4002, [None] * 8), (4003, [float("nan")] + [1.0] * 7), (4004, [float("inf")] * 8), (4005, [3e38] * 8), (None, [1.0] * 8)]
    rows += [(5000, [1.0, 2.0]), (5050, [0.5, -2.0]), (5001, [100000.0, 1.0]), (6000, [0.125] * 3)]  # other lengths; 6000 is alone
    return rows


@pytest.mark.parametrize("k", [1, 5])
def test_search_against_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_BYTES", 512)
    monkeypatch.setattr(vector_search, "LEAST_GROUP", 1024)
    monkeypatch.setattr(vector_search, "QUERY_BYTES", 256)
    monkeypatch.setattr(vector_search, "TILE", 300)
    rows = messy_vectors()
    got = sorted(map(tuple, vector_search.top_k(vectors(spark, rows), k=k).collect()))
    assert got == brute_top(rows, 50, k)


def test_search_of_nothing(spark):
    assert vector_search.top_k(vectors(spark, [])).count() == 0
    assert vector_search.top_k(vectors(spark, [(50, [1.0])])).count() == 0


def test_cells_bound_every_product():
    rnd = np.random.default_rng(3)
    v, q = rnd.integers(-300, 300, (200, 6)), rnd.integers(-300, 300, (30, 6))
    low, high, cells = vector_search.grid_of(v)
    at = np.arange(6)
    ends = low[cells, at], high[cells, at]
    split = vector_search.halves(q)
    assert (split @ np.hstack(ends).T <= q @ v.T).all() and (split @ np.hstack(ends[::-1]).T >= q @ v.T).all()


def test_vectors_are_read_in_order_until_certain():
    rnd = np.random.default_rng(4)
    v, q = rnd.integers(-40, 40, (3000, 8)).astype(np.int32), rnd.integers(-40, 40, (5, 8)).astype(np.int32)
    low, high, cells = vector_search.grid_of(v)
    at = np.arange(8)
    bounds = vector_search.halves(q) @ np.hstack([high[cells, at], low[cells, at]]).T
    rows, _, scores, floor = vector_search.read_in_order(bounds, q, v, np.full(5, -np.inf), 4)
    assert (floor == np.sort(q.astype(np.int64) @ v.T, axis=1)[:, -4]).all()
    assert len(rows) < 500


# ---- 12 filter interactions ---------------------------------------------------------------------------------
def brute_audit(rows, labels):
    marks = collections.defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        if i is not None:
            marks[i][0] |= quality == 1
            marks[i][1] |= toxic == 1
    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = collections.defaultdict(list)
    for i, t, _, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[s or ""].append(({f for f in "ABCDE" if fails[f]}, *(marks[i] if i is not None and i in marks else (0, 0))))
    out, shapley = {}, collections.Counter()
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                here = [d for d in docs if f in d[0] and not d[0] & gone]
                redundant = sum(f in d[0] and bool(d[0] & gone) for d in docs)
                gone.add(f)
                out[part, "".join(order), step] = [
                    sum(not d[0] & gone for d in docs), len(here), redundant, sum(d[0] == {f} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here),
                ]
                shapley[part, f] += len(here)
    return sorted((*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items())


def audit_rows():
    long = prose(9, 260, 2000)
    rows = list(messy_texts()) + [(100 + i, long, "en", f"s{i % 3}") for i in range(30)]
    rows += [(200 + i, prose(i, 150 + i, 900) + (" Big %" if i % 3 else ""), "en", "a") for i in range(80)] + [(100, long, "en", "s0"), (None, long, "en", None)]
    return rows, [(i, i % 2, i % 5 == 0) for i in range(0, 300, 2)] + [(3, 1, 1), (101, None, 1), (101, 1, None), (None, 1, 1), (9999, 1, 1)]


def test_audit_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 2)
    rows, marks = audit_rows()
    labels = spark.createDataFrame([(i, q, int(t) if t is not None else None) for i, q, t in marks], "doc_id long, quality int, toxic int")
    found = filter_audit.audit(documents(spark, rows), labels.selectExpr("*", "'x' AS part", "'y' AS bits"))
    assert sorted(map(tuple, found.collect())) == brute_audit(rows, marks)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty(spark), labels).count() == 0
    only = documents(spark, [(1, None, None, None)])
    assert {r.kept + r.removed for r in filter_audit.audit(only, labels).collect() if r.step == 1} == {1}


def test_ranks_are_those_of_sorted_permutations():
    assert [filter_audit.lehmer_rank(o) for o in filter_audit.ORDERS] == list(range(120)) and filter_audit.ORDERS == sorted(filter_audit.ORDERS)
    for length in range(1, 6):
        for prefix, first, after in filter_audit.intervals(length):
            assert [n for n, o in enumerate(filter_audit.ORDERS) if o.startswith(prefix)] == list(range(first, after))


# ---- 13 source divergences ----------------------------------------------------------------------------------
def brute_divergences(rows, min_docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    groups = set()
    for _, t, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [w.translate(lower) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        p = {}
        for s in [g[1] for g in groups if g[0] == lang] + [None]:
            c = sum((count[g] for g in groups if g[0] == lang and s in (None, g[1])), collections.Counter())
            total = sum(c[t] for t in kept) + 5 * len(kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}
        for s in p:
            if s is not None:
                pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o not in (None, s)]
                best = [(t, p[s][t] - p[None][t]) for t in kept if count[lang, s][t] and p[s][t] > p[None][t]]
                for part, found, most in (("pair", pairs, None), ("term", best, 50)):
                    found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                    out += [(lang, s, part, item, value, n) for n, (item, value) in enumerate(found, 1)]
    return sorted(out)


def divergence_rows():
    rnd, rows = random.Random(11), list(messy_texts())
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["Été", "ÉTÉ", "日本", "naïve", "🙂", "ſ", "K"]
    for i in range(240):
        picked = rnd.choices(words[:40 + 20 * (i % 9)], k=60)
        rows.append((500 + i, "-".join(w.upper() if rnd.random() < 0.3 else w for w in picked) + " 1x2\x00y", ["en", "fr", None][i % 3], f"s{i % 7}" if i % 7 else None))
    return rows + [(900, "...", "en", "signs"), (901, "lonely", "xx", "s"), (902, None, "xx", "t")]


@pytest.mark.parametrize("shard, held", [(256, 400_000), (7, 50)])
def test_divergences_against_brute_force(spark, shard, held, monkeypatch):
    monkeypatch.setattr(source_audit, "SHARD_TERMS", shard)
    monkeypatch.setattr(source_audit, "HELD", held)
    monkeypatch.setattr(source_audit, "SLICE", held * 100)
    rows = divergence_rows()
    got = sorted(tuple(r) for r in source_audit.divergences(documents(spark, rows), min_docs=12).collect())
    assert got == brute_divergences(rows, 12)


def test_divergences_of_nothing(spark):
    assert source_audit.divergences(empty(spark)).count() == 0
    got = source_audit.divergences(documents(spark, [(1, None, "en", "a"), (2, "x", "en", None)])).collect()
    assert sorted(map(tuple, got)) == [("en", "", "pair", "a", 0, 1), ("en", "a", "pair", "", 0, 1)]


def test_shares_are_exact():
    counts = np.array([0, 1, 7, 10**6, 3 * 10**12])
    for total, kept in ((3 * 10**12 + 10**7, 900), (4 * 10**12, 1)):
        assert source_audit.shares(counts, np.int64(total), kept).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * kept) for c in counts]


def test_slices_keep_every_row():
    texts = pa.record_batch({"text": pa.array(["a" * n for n in (3, 100, 0, 5, 5, 200, 1)])})
    for size in (1, 20, 10_000):
        assert sum((b.column("text").to_pylist() for b in source_audit.slices(texts, size)), []) == texts.column("text").to_pylist()
