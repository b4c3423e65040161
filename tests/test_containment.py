"""Containment joins against comparing every pair, and what meets where all short keys begin alike."""

import random

from pyspark.sql import functions as F

from bidlens.operators import containment as co


def frames(spark, shorts, longs):
    return (
        spark.createDataFrame(shorts, "kind string, short_id int, short_key string"), spark.createDataFrame(longs, "kind string, long_id int, long_key string"),
    )


def test_pairs_equal_comparing_everything(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    longs = [(rnd.choice("xy"), i, word(rnd.randrange(30))) for i in range(300)]
    shorts = [(k, i, t[2:2 + rnd.randrange(4, 12)]) for i, (k, _, t) in enumerate(longs)] + [("x", 900, "가나다라마바"), ("y", 901, ""), ("x", 902, "abc")]
    longs += [("x", 900, "앞가나다라마바뒤"), ("x", 901, "")]
    short, long = frames(spark, shorts, longs)
    got = sorted((r.short_id, r.long_id) for r in co.key_pairs(short, long, ["kind"]).collect())
    assert got == sorted((i, j) for k, i, a in shorts for m, j, b in longs if k == m and len(a) >= 5 and a in b)


def test_keys_that_begin_alike_do_not_meet_there(spark):
    shorts = [("x", i, f"standard part number {i:05d} of stock") for i in range(600)]
    longs = [("x", i, f"the standard part number {i:05d} of stock and more") for i in range(600)]
    short, long = frames(spark, shorts, longs)
    pieces = long.withColumn("anchor", F.explode(co.pieces_of("long_key", 5))).select("kind", "anchor")
    anchors = co.rarest_anchors(short, pieces, ["kind"], 5)
    per_anchor = [r["count"] for r in anchors.join(pieces, ["kind", "anchor"]).groupBy("anchor").count().collect()]
    assert max(per_anchor) <= 5 * sorted(per_anchor)[len(per_anchor) // 2]
    assert sum(per_anchor) < 600 * 20  # on first characters: 600 x 600
    assert co.key_pairs(short, long, ["kind"]).count() == 600


def test_nothing(spark):
    short, long = frames(spark, [], [])
    assert co.key_pairs(short, long, ["kind"]).count() == 0


def texts(spark, needles, hays):
    return spark.createDataFrame(needles, "needle_id long, needle string"), spark.createDataFrame(hays, "hay_id long, more string, hay string")


def test_text_pairs_equal_comparing_everything(spark, monkeypatch):
    rnd = random.Random(5)
    words = ["ab", "cd", "ef", "가나", "Xy", "z", "1", "a-b"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    hays = [(i, f"m{i}", text(rnd.randrange(40))) for i in range(300)] + [(900, "m", ""), (901, "m", None), (902, "m", "ab cd"), (903, None, "ab cd ef 가나 Xy ab cd ef 가나 Xy")]
    cut = [t[2].split(" ") for t in hays[:200]]
    needles = [(i, " ".join(w[3:3 + rnd.randrange(2, 14)])) for i, w in enumerate(cut)] + [(900, ""), (901, None), (902, "z"), (903, "b cd ef 가나 Xy a"), (904, "ab cd ef 가나 Xy")]
    want = sorted((i, j, m) for i, a in needles for j, m, b in hays if a and b and a in b)
    for bits in (20, 3):  # a table that is full lets everything through
        monkeypatch.setattr(co, "BITS", bits)
        got = co.text_pairs(*texts(spark, needles, hays)).collect()
        assert sorted((r.needle_id, r.hay_id, r.more) for r in got) == want


def test_only_runs_that_may_be_an_anchor_go_on(spark):
    hays = [(i, "m", " ".join(f"w{i}x{j}" for j in range(50))) for i in range(400)]
    needle, hay = texts(spark, [(1, " ".join(f"w7x{j}" for j in range(10, 20)))], hays)
    runs = co.anchored(hay, spark.createDataFrame([("w7x12 w7x13 w7x14",)], "anchor string"))
    assert 1 <= runs.count() <= 5 and runs.filter("anchor = 'w7x12 w7x13 w7x14'").count() == 1  # of 400 x 48
    assert [r.hay_id for r in co.text_pairs(needle, hay).collect()] == [7]
