"""Small documents with the odd cases: nulls, blanks, long texts, repeats, clashing columns."""

import random

WORDS = "the of and to in is it that was for on are with as be this have from or one had by word but not what all were".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "er", "ing", "s"]) + str(r.randrange(50) or "") for _ in range(n))


PASSAGE = prose(1000, 60)
LONG = prose(1001, 30_000)

#: (doc_id, text, source)
DOCS = [
    (0, None, "a"), (1, "", "a"), (2, " \t\n\x0b\f\r ", None), (3, "one", "b"), (4, "one two", "b"), (5, "one two three", "b"),
    (6, "ONE Two\tthree ", "b"), (7, LONG, "a"), (8, LONG, "a"), (8, LONG, "a"), (9, LONG + " more", "c"), (None, prose(1, 40), "c"), (None, None, None),
    (10, prose(2, 50) + " " + PASSAGE + " " + prose(3, 50), "a"), (11, PASSAGE, "a"), (12, prose(4, 20) + "\n" + PASSAGE + "\n" + PASSAGE, "b"),
    (13, "a b c d e f " * 40, "b"), (14, "Ünïcödé 日本語   é́ 🙂 " * 30, "c"), (15, prose(5, 400), "a"), (16, prose(5, 400), "a"),
    (17, prose(5, 399) + " x", "a"), (18, "line\nline\n\nline\n other", "b"), (-20, prose(6, 35), "a"), (-21, prose(6, 34), "a"),
]
SCHEMA = "doc_id long, text string, source string"


def docs(spark, rows=None):
    """With columns that operators might use inside."""
    df = spark.createDataFrame(DOCS if rows is None else rows, SCHEMA)
    return df.selectExpr("doc_id", "text", "source", "'x' lang", "1L n_chars", "1 fp", "2 component_id", "3 size", "4 shard", "5 text_hash", "6 anchor", "7 kept", "8 word", "9 id", "10 n_words")


def counted(rows):
    """Rows as a sorted list that nulls do not disturb."""
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))
