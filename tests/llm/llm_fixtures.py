"""Small tables with everything that real ones can hold."""

import random

CLASHES = "n_words, size, shard, slot, digest, bucket, block, token, tokens, kept, score, toxicity, component_id, id, n, pos, hit, item_id, lines, words"


def prose(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def messy_texts():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    passage = prose(2, 40)
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", None), (3, " ".join(near), "en", None), (4, None, None, "b"),
        (5, "", "en", "b"), (6, " \n\t ", "en", "b"), (7, "One", "en", "b"), (8, "ONE", "en", "b"), (9, "one two", "en", "b"),
        (10, prose(3, 20_000, 5000), "en", "c"), (11, f"{prose(4, 30)}\n{passage}\n{prose(5, 30)}", "en", "c"),
        (12, f"{prose(6, 25)} {passage} {prose(7, 25)}", "en", "c"), (13, "x " * 40, "en", "c"), (14, "x " * 60 + "y", "en", "c"),
        (15, "naïve Ünïcode 日本語 🙂👍🏽 ½ \x1c '’s don't\u00a0end " * 3, "fr", "c"), (None, base, "en", "a"), (16, passage.upper(), "en", "d"),
        (17, "aaaa" * 800, "en", "d"), (18, "line one here\nline one here\nother line\n" * 3, "en", "d"),
    ]


def documents(spark, rows=None):
    """The messy rows, with extra columns whose names operators use themselves."""
    frame = spark.createDataFrame(messy_texts() if rows is None else rows, "doc_id long, text string, lang string, source string")
    frame = frame.selectExpr("*", "cast(length(text) as long) AS n_chars")
    return frame.selectExpr("*", *[f"'clash' AS {c.strip()}" for c in CLASHES.split(",")])


def empty(spark):
    return documents(spark, [])
