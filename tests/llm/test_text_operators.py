"""Operators that judge each text by itself: counts, BPE, classifiers, rules, decontamination, extraction, sharding."""

import collections
import hashlib
import random
import sys
import time
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from bidlens.llm import byte_bpe, decontamination, html_extraction, quality_crf, quality_rules, sharding, token_counts, toxicity
from bidlens.llm.shingles import words_of
from llm_fixtures import documents, empty, messy_texts, prose

TEXTS = [t or "" for _, t, _, _ in messy_texts()]


def in_sql(sql, frame):
    con = duckdb.connect()
    con.register("given", frame.toPandas())
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(source AS VARCHAR) AS source FROM given")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return sorted((dict(zip(names, r)) for r in cursor.fetchall()), key=str)


def rows_of(frame):
    return sorted((r.asDict() for r in frame.collect()), key=str)


# ---- 1 sharding ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 5, 24])
def test_shards_are_equal_mixed_and_gapless(spark, n):
    rows = [(i, prose(i, i % 7), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(500)]
    got = sharding.shards(documents(spark, rows), n).collect()
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    sizes = [len(by_shard[k]) for k in range(n)]
    assert sum(sizes) == 500 and max(sizes) - min(sizes) <= 1
    for rows_in in by_shard.values():
        assert sorted(r.slot for r in rows_in) == list(range(len(rows_in)))
        hot = sum(r.source == "hot" for r in rows_in)
        assert abs(hot - len(rows_in) * 333 / 500) <= 3
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t) + 8, zlib.crc32(t.encode())) for i, t, _, _ in rows}


def test_shards_do_not_depend_on_buckets(spark, monkeypatch):
    rows = [(i, "t", "en", f"s{i % 3}") for i in range(200)]
    seen = []
    for size in (1, 7, 2048):
        monkeypatch.setattr(sharding, "BUCKET_ROWS", size)
        seen.append(rows_of(sharding.shards(documents(spark, rows), 4)))
    assert seen[0] == seen[1] == seen[2]


def test_shards_of_messy_rows_match_sql(spark):
    frame = documents(spark).filter("doc_id IS NOT NULL")
    got = rows_of(sharding.shard_table(frame))
    assert got == in_sql(sharding.SQL, frame.select("doc_id", "text", "source"))
    assert sharding.shard_table(empty(spark)).count() == 0
    assert len(sharding.shard_table(documents(spark)).collect()) == len(TEXTS)


# ---- 2 token counts -----------------------------------------------------------------------------------------
def test_token_counts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    odd = ["▁a▁▁b", "  lead", "trail  ", "<s> </s> <unk>", "　wide", "\x00 x", " " * 50 + "x"]
    frame = documents(spark, [(i, t, "en", "a") for i, t in enumerate([*TEXTS, *odd])])
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_table(frame).collect()}
    for i, t in enumerate([*TEXTS, *odd]):
        n = len(model.encode(t))
        assert got[i] == (len(t.encode()), n, n > 4096), repr(t[:40])
    assert token_counts.token_table(documents(spark)).count() == len(TEXTS)
    assert token_counts.token_table(empty(spark)).count() == 0


def test_forgetting_pieces_changes_nothing(spark):
    frame = documents(spark)
    counts = [sorted(r[0] for r in frame.select(token_counts.count_tokens("text", cache_size=n).alias("n")).collect()) for n in (1, 10_000)]
    assert counts[0] == counts[1]


# ---- 8 byte-level BPE ---------------------------------------------------------------------------------------
def test_bpe_matches_the_library_and_decodes(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(5)
    odd = [
        "a" * 5000, " " * 3000 + "x", "½ x² Ⅷ ab\x1cc\x1fd", "é̈ à́", "_a__b _ '’s don't", "\r\n\t x  \n\n", "٣٤٥ १२", "\x85\xa0 x",
        "".join(chr(rnd.randrange(1, 0x3000)) for _ in range(2000)), "".join(rnd.choice("abcdeABCDE") for _ in range(999)), "<|endoftext|>",
    ]
    texts = [*TEXTS, *odd]
    frame = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    for r in byte_bpe.bpe_table(frame).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want, repr(texts[r.doc_id][:40])
    for r in byte_bpe.decode(byte_bpe.encode(frame)).collect():
        assert bytes(r.decoded).decode() == texts[r.doc_id]
    assert byte_bpe.bpe_table(empty(spark)).count() == 0
    assert byte_bpe.bpe_table(documents(spark)).count() == len(TEXTS)


# ---- 10 quality rules ---------------------------------------------------------------------------------------
def test_rules_match_sql_in_any_order(spark):
    extra = [(100 + i, t, "en", "a") for i, t in enumerate([
        "A| B| C| D| E| F| G| H| I| J|", "stop!! now!! go!! yes!! no!! ah!! oh!! hm!! eh!! uh!! ok!!", "ÀÉÎ ABC DEF GHI JKL MNO PQR STU VWX YZA",
        "a b c d e f g h i j k l a b c d e", prose(9, 50) + "\n" + prose(9, 50),
    ])]
    frame = documents(spark, [*messy_texts(), *extra])
    got = rows_of(quality_rules.rule_table(frame))
    assert got == in_sql(quality_rules.SQL, frame.select("doc_id", "text", "source"))
    measured = quality_rules.measures(frame)
    names = list(quality_rules.rules())
    kept = [rows_of(measured.select("doc_id", quality_rules.cascade(order).alias("kept"))) for order in (names, names[::-1])]
    assert kept[0] == kept[1]
    assert quality_rules.rule_table(empty(spark)).count() == 0


def test_cascade_asks_the_best_rule_first(spark):
    frame = documents(spark, [(i, "## ## ## " + prose(i, 40), "en", "a") for i in range(50)])
    assert quality_rules.cascade_order(frame)[0] == "symbols"


# ---- 4 and 6 classifiers ------------------------------------------------------------------------------------
def labelled(spark, label, marked, plain, n=400):
    rows = [(i, (marked if i % 4 == 0 else plain)(i), "en", "a") for i in range(n)]
    return documents(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(n)], f"doc_id long, {label} int, text string")


def accuracy(scored, labels, label, flip=False):
    rows = [r for r in scored.join(labels.select("doc_id", label), "doc_id").collect() if r.held_out]
    assert rows and all(0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_toxicity_learns_words_and_respects_the_fold(spark):
    frame, labels = labelled(spark, "toxic", lambda i: f"{prose(i, 30)} vileword{'ab'[i % 8 // 4]} {prose(i + 1, 30)}", lambda i: prose(i, 60))
    assert accuracy(toxicity.toxicity_table(frame, labels), labels, "toxic") > 0.95
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows_of(toxicity.toxicity_table(frame, labels)) == rows_of(toxicity.toxicity_table(frame, flipped))


def test_quality_reads_lines_and_respects_the_fold(spark):
    junk = lambda i: "\n".join([prose(i, 12), *["$$$ ### " + " ".join(f"{w}%%%" for w in prose(i + k, 12).split()) for k in range(4)]])
    good = lambda i: "\n".join(prose(i + k, 12).capitalize() + "." for k in range(5))
    frame, labels = labelled(spark, "quality", good, junk)
    assert accuracy(quality_crf.quality_table(frame, labels), labels, "quality") > 0.95
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows_of(quality_crf.quality_table(frame, labels)) == rows_of(quality_crf.quality_table(frame, flipped))


@pytest.mark.parametrize("table, label", [(toxicity.toxicity_table, "toxic"), (quality_crf.quality_table, "quality")])
def test_classifiers_on_messy_rows(spark, table, label):
    some = spark.createDataFrame([(i, i % 2) for i in range(1, 19)] + [(None, 1), (4, None), (99, 1)], f"doc_id long, {label} int")
    assert table(documents(spark), some).count() == len(TEXTS)
    assert all(0 <= r.score <= 1 for r in table(documents(spark), some).collect())
    assert table(documents(spark), some.limit(0)).count() == len(TEXTS)
    assert table(empty(spark), some).count() == 0


def test_marginals_against_enumeration():
    import itertools
    import math

    scores, t = [0.3, -1.2, 0.8, 2.0], [[0.5, -0.2], [-0.4, 0.9]]
    weight = {}
    for path in itertools.product((0, 1), repeat=4):
        weight[path] = math.exp(sum(s for s, y in zip(scores, path) if y) + sum(t[a][b] for a, b in zip(path, path[1:])))
    total = sum(weight.values())
    good, pairs = quality_crf.marginals(scores, t)
    for i in range(4):
        assert good[i] == pytest.approx(sum(w for p, w in weight.items() if p[i]) / total)
    for a, b in itertools.product((0, 1), repeat=2):
        want = sum(w * sum((x, y) == (a, b) for x, y in zip(p, p[1:])) for p, w in weight.items()) / total
        assert pairs[a][b] == pytest.approx(want)


# ---- 5 decontamination --------------------------------------------------------------------------------------
def brute_hits(texts, items):
    found = {}
    grams = lambda w: [tuple(w[i:i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)]
    for doc, text in texts:
        words = words_of(text, lower=True)
        for item, of_item in items:
            wanted = words_of(of_item, lower=True)
            if not wanted:
                continue
            c, best = collections.Counter(grams(wanted)), 0.0
            for k in range(len(words) - len(wanted) + 1):
                o = collections.Counter(grams(words[k:k + len(wanted)]))
                least = sum((o & c).values())
                best = max(best, least / (sum(o.values()) + sum(c.values()) - least))
            if best >= 0.8:
                found[doc, item] = round(best, 9)
    return found


def test_decontamination_against_brute_force(spark):
    items = [(i, prose(1000 + i, n)) for i, n in enumerate([14, 20, 33, 33, 59, 3, 1, 8, 120])] + [(20, None), (21, ""), (22, prose(1001, 20)), (None, "x")]
    rnd = random.Random(3)
    texts = []
    for d in range(60):
        words = (items[d % 9][1]).split()
        for _ in range(d // 12):
            words[rnd.randrange(len(words))] = "edited"
        texts.append((d, f"{prose(d, 40)} {' '.join(words).upper() if d % 2 else ' '.join(words)} {prose(d + 500, 25)}"))
    frame = documents(spark, [(d, t, "en", "a") for d, t in texts] + [(900 + k, t, "en", "a") for k, t in enumerate([None, "", " \n", "short"])])
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'clash' AS hit")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontamination.contamination(frame, benchmark).collect()}
    assert got == brute_hits(texts, [i for i in items if i[0] is not None])
    clean = {r.doc_id for r in decontamination.decontaminated(frame, benchmark).collect()}
    assert not clean & {d for d, _ in got} and clean | {d for d, _ in got} == {d for d, _ in texts} | {900, 901, 902, 903}


def test_decontamination_in_several_passes(spark, monkeypatch):
    items = spark.createDataFrame([(i, prose(50 + i, 30)) for i in range(6)], "item_id long, text string")
    frame = documents(spark, [(i, prose(50 + i, 30), "en", "a") for i in range(8)])
    whole = rows_of(decontamination.contamination(frame, items))
    monkeypatch.setattr(decontamination.indexes, "__defaults__", (200,))
    assert rows_of(decontamination.contamination(frame, items)) == whole and len(whole) == 6
    assert decontamination.contamination(frame, items.limit(0)).count() == 0
    assert decontamination.contamination(empty(spark), items).count() == 0


# ---- 9 extraction -------------------------------------------------------------------------------------------
def page(i, body, extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{x}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu {i}</a></ul></nav>"
        f"<div class='box'><p>All rights of this site</p></div><!-- ad --><div class='ad'>Buy {i}</div><div class='text'>{body}</div>{extra}<footer>&copy; me {i}</footer>"
    )


def test_extraction_finds_slots_and_drops_template(spark):
    rows = [(i, f"https://h.example/{i}", page(i, f"<h1>Title {i}</h1><p><b>First&nbsp;&amp; {i}<br>line\n  two<p>Second {i}", f"<section id='comments'><p>reader {i}</p></section>")) for i in range(8)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS host", "'clash' AS text", "'x' AS template")
    got = {r.page_id: r.text for r in html_extraction.page_table(frame).collect()}
    assert got == {i: f"Title {i}\nFirst & {i} line two\nSecond {i}" for i in range(8)}


def test_extraction_keeps_articles_of_copies(spark):
    rows = [(i, "https://h.example/x", "<body><nav>m</nav><article><h1>Same</h1><p>text</p></article><aside>s</aside></body>") for i in range(6)]
    rows += [(10, None, None), (11, "", ""), (12, "no url", "plain < text &lt;b&gt;"), (12, "no url", "plain < text &lt;b&gt;"), (13, "x://y", "<p>a<div>b</p>c<ul><li>d<li>e</ul>"), (14, "x://z", "<div>" * 3000 + "deep")]
    got = html_extraction.page_table(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert all(texts[i] == "Same\ntext" for i in range(6))
    assert texts[10] == texts[11] == "" and texts[12] == "plain < text <b>" and texts[13] == "a\nb\nc\nd\ne" and texts[14] == "deep"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extraction.page_table(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_matching_aligns_around_changes():
    ref = html_extraction.shape_of(html_extraction.parse("<body><div class='a'>x</div><div class='b'>y</div><ul><li>1</ul></body>")[0])
    html_extraction.numbered(ref)
    other = html_extraction.shape_of(html_extraction.parse("<body><div class='b'>y</div><p>new</p><ul><li>2<li>3</ul></body>")[0])
    size, pairs = html_extraction.match(ref, other, {})
    assert size == 5 and {r.key for r, _ in pairs} == {"#page.", "body.", "div.b", "ul.", "li."}
    again = html_extraction.unpacked(html_extraction.packed(ref))
    assert html_extraction.match(again, ref, {})[0] == len(html_extraction.numbered(again)) == 6


def test_very_long_sibling_lists_align_exactly(monkeypatch):
    kinds = [f"<div class='k{chr(97 + i % 7)}'>x</div><p>t</p>" for i in range(700)]
    template = "<section class='note'><h2>a</h2><p>b</p></section>"
    tree = lambda parts: html_extraction.shape_of(html_extraction.parse(f"<body>{''.join(parts)}</body>")[0])
    a, b = tree(["<h1>q</h1>", *kinds[:350], template, *kinds[350:], "<ul><li>1</ul>"]), tree(["<ol><li>1</ol>", *kinds[3:300], template, *kinds[400:], "<h2>z</h2>"])
    size, pairs = html_extraction.match(a, b, {})
    assert any(x.key == y.key == "section.note" for x, y in pairs)
    assert len(pairs) == size > 1000
    monkeypatch.setattr(html_extraction, "TABLE_CELLS", 500)
    again, other = html_extraction.match(a, b, {})
    assert (again, len(other)) == (size, size)


def texts_of(spark, bodies, host="h.example"):
    rows = [(i, f"https://{host}/{i}", f"<html><body class='page postid-{i} slug-{prose(i, 1)}'>{body}</body></html>") for i, body in enumerate(bodies)]
    return [r.text for r in html_extraction.page_table(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_template_beyond_one_page_and_in_every_layout(spark):
    note, rights = "<div class='note'><p>Read our house rules first</p></div>", "<div class='r'><p>All rights are ours</p></div>"
    first = [f"<div class='wrap w-{prose(i, 1)}'><div class='t'><h1>Title {i}</h1><p>{prose(i, 30)}</p></div>{note if i else ''}</div>" for i in range(6)]
    second = [f"<table><tr><td class='x'><p>{prose(50 + i, 30)}</p></td><td class='y'>{rights}</td></tr></table>" for i in range(6)]
    assert texts_of(spark, first + second) == [f"Title {i}\n{prose(i, 30)}" for i in range(6)] + [prose(50 + i, 30) for i in range(6)]


def test_template_of_small_hosts(spark):
    bodies = [f"<div class='t'><p>{prose(i, 30)}</p></div><div class='r'><p>All rights are ours</p></div>" for i in range(3)]
    assert texts_of(spark, bodies) == [prose(i, 30) for i in range(3)]
    assert texts_of(spark, bodies[:2]) == [prose(i, 30) for i in range(2)]
    assert texts_of(spark, bodies[:1]) == [f"{prose(0, 30)}\nAll rights are ours"]


def test_reposts_with_other_adverts_keep_their_article(spark):
    article = f"<div class='t'><h1>Same title</h1><p>{prose(1, 40)}</p><p>{prose(2, 20)}</p></div>"
    rights = "<div class='r'><p>All rights are ours</p></div>"
    reposts = [f"<div class='x'><p>Buy {prose(30 + i, 4)}</p></div>{article}{rights}" for i in range(7)]
    others = [f"<div class='x'><p>Buy {prose(60 + i, 4)}</p></div><div class='t'><h1>Title {i}</h1><p>{prose(80 + i, 40)}</p></div>{rights}" for i in range(4)]
    got = texts_of(spark, reposts + others)
    assert all(f"Same title\n{prose(1, 40)}\n{prose(2, 20)}" in t for t in got[:7])
    assert not any("rights" in t for t in got)


def test_wrapper_decides_before_marks(spark):
    teaser = lambda i: "".join(f"<article class=card><p>See {prose(40 + 3 * i + k, 3)}</p></article>" for k in range(1))
    comment = lambda i: f"<article class=comment-body><p>reader {i}</p></article>"
    bodies = [f"<div class='t'><h1>Title {i}</h1><p>{prose(i, 30)}</p></div>{teaser(i)}{comment(i)}<div class='r'><p>All rights are ours</p></div>" for i in range(6)]
    got = texts_of(spark, bodies)
    assert all(t.startswith(f"Title {i}\n{prose(i, 30)}") and "reader" not in t and "rights" not in t for i, t in enumerate(got))
    # text beside a marked article is a slot of the wrapper; a page alone keeps to the mark
    bodies = [f"<article><p>{prose(i, 30)}</p></article><div class='more'><p>Part two {prose(200 + i, 9)}</p></div>" for i in range(4)]
    assert texts_of(spark, bodies) == [f"{prose(i, 30)}\nPart two {prose(200 + i, 9)}" for i in range(4)]
    assert texts_of(spark, bodies[:1]) == [prose(0, 30)]
    # a word in a class says nothing against the element that holds the text
    assert texts_of(spark, [f"<div class='no-sidebar'><h1>Title</h1><p>{prose(1, 30)}</p></div><div class='ad'>Buy</div>"]) == [f"Title\n{prose(1, 30)}"]


def test_what_holds_the_text_is_not_left_out(spark):
    main = lambda i: f"<h1>Title {i}</h1><p>{prose(i, 60)}</p><p>{prose(90 + i, 50)}</p>"
    want = lambda i: f"Title {i}\n{prose(i, 60)}\n{prose(90 + i, 50)}"
    rights = "<div class='r'><p>All rights are ours</p></div>"
    for wrap in (
        "<form action='/post' method=post>{}</form>", "<div role='form'>{}</div>", "<dialog open>{}</dialog>", '<article title="The hidden valley">{}</article>',
        "<article data-note='keep id=ads here'>{}</article>", "<div class=discussion>{}</div>", "<div id='related-work'>{}</div>", "<div class='social'>{}</div>",
        "<div class='ad-free-content'>{}</div>", "<div class='search hidden-valley'>{}</div>", "<div title=\"a > b\" data-x='role=\"alert\"'>{}</div>",
    ):
        assert texts_of(spark, [wrap.format(main(0))]) == [want(0)], wrap
        bodies = [wrap.format(main(i)) + rights for i in range(6)]
        assert texts_of(spark, bodies) == [want(i) for i in range(6)], wrap


def test_own_parts_of_an_article_stay_and_other_parts_go(spark):
    part = "<section id='related-work'><h2>Related work {}</h2><p>{}</p></section><div class='discussion'><p>{}</p></div>"
    other = "<div class='related'><p>See {}</p></div><form><p>Your mail</p></form><div role=alert>Note {}</div><div class='ad'>Buy {}</div><div hidden><p>{}</p></div>"
    bodies = [
        f"<div class='t'><h1>Title {i}</h1><p>{prose(i, 60)}</p>{part.format(i, prose(100 + i, 60), prose(200 + i, 60))}</div>"
        + other.format(prose(300 + i, 3), i, i, prose(400 + i, 90)) for i in range(6)
    ]
    assert texts_of(spark, bodies) == [f"Title {i}\n{prose(i, 60)}\nRelated work {i}\n{prose(100 + i, 60)}\n{prose(200 + i, 60)}" for i in range(6)]


@pytest.mark.parametrize("markup, n", [
    ("<a ", 350_000), ("<a <", 250_000), ('<a ">"', 170_000), ("<b title='x>", 90_000), ("<div>", 100_000), ("<div>x", 100_000), ("<b>", 100_000), ("<b><p>t</p>", 50_000),
    ("<i></b>", 100_000), ("<li>x", 100_000), ("<a href=x ", 100_000), ("<!-- ", 200_000), ("<", 1_000_000), ("&lt", 300_000), ("<form><p>t", 50_000), ("<p class=ad>", 80_000),
])
def test_broken_and_deep_markup_takes_linear_time(markup, n):
    started = time.process_time()
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(html_extraction.DEEP)
    try:
        page = "<body><p>first</p>" + markup * n
        assert "first" in html_extraction.extract(page, None, frozenset())
        nodes, blocks = html_extraction.parse(page)
        html_extraction.content_of(nodes, blocks)
        html_extraction.packed(html_extraction.shape_of(nodes))
    finally:
        sys.setrecursionlimit(limit)
    assert time.process_time() - started < 20  # 5 s on an idle machine


def plain_matching(a, b):
    """Simple tree matching by the plain dynamic program, where roots with different keys may still pass what they hold."""
    if a.tag != b.tag:
        return 0
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_matching(x, y))
    inner = best[-1][-1]
    return inner + (a.key == b.key) if inner or a.key == b.key else 0


def test_tree_matching_against_the_plain_program():
    rnd = random.Random(17)

    def body(depth):
        tag, name = rnd.choice(["div", "section", "ul"]), rnd.choice("abc")
        return f"<{tag} class={name}>{''.join(body(depth - 1) for _ in range(rnd.randrange(4))) if depth else 'x'}</{tag}>"

    for _ in range(60):
        a, b = (html_extraction.shape_of(html_extraction.parse(f"<body>{body(3)}{body(3)}</body>")[0]) for _ in range(2))
        size, pairs = html_extraction.match(a, b, {})
        assert size == plain_matching(a, b) and len({id(p) for p, _ in pairs}) == len({id(q) for _, q in pairs}) == len(pairs)


def test_written_shards_hold_every_text(spark, tmp_path):
    rows = messy_texts() + [(50, "again " * 30, "en", None)] * 7 + [(100 + i, prose(i, 20), "en", None if i % 2 else "s") for i in range(60)]
    frame = documents(spark, rows)
    sharding.write_shards(frame, str(tmp_path / "shards"), n_shards=5)
    got = spark.read.parquet(str(tmp_path / "shards")).collect()
    want = sharding.shards(frame, 5).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted((i or -1, t or "") for i, t, _, _ in rows)
    assert sorted((r.shard, r.slot) for r in got) == sorted((r.shard, r.slot) for r in want)
    assert all(zlib.crc32(r.text.encode()) == r.text_crc32 and len(r.text.encode()) + 8 == r.size for r in got)


def test_texts_shorter_than_an_item(spark, monkeypatch):
    item = prose(77, 40).split()
    texts = [" ".join(item[:-1]), " ".join(item[1:]), " ".join(item[:33]), " ".join(item[:32]), " ".join(item[:20]), " ".join(item[:3]), " ".join(item)]
    frame = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    items = spark.createDataFrame([(1, " ".join(item)), (2, prose(78, 40)), (3, prose(79, 7))], "item_id long, text string")
    want = {0: 35 / 36, 1: 35 / 36, 2: 29 / 36, 6: 1.0}
    for chars in (decontamination.ITEM_CHARS, 100):
        monkeypatch.setattr(decontamination.indexes, "__defaults__", (chars,))
        got = decontamination.contamination(frame, items).collect()
        assert {r.doc_id: r.similarity for r in got} == pytest.approx(want) and {r.item_id for r in got} == {1}
        assert {r.doc_id: r.n_words for r in got} == {0: 39, 1: 39, 2: 33, 6: 40}
        assert {r.doc_id for r in decontamination.decontaminated(frame, items).collect()} == {3, 4, 5}
