"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n, per_line=12):
    r = random.Random(seed)
    words = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + per_line]) for i in range(0, n, per_line))


BASE = prose(1, 120)
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, BASE.replace("alpha", "Alpha") + " tail", "en", "b"),
    (3, BASE.replace("alpha", "Alpha") + " tail", "en", "b"),
    (4, None, "en", None),
    (5, "", None, "a"),
    (6, " \t\r\n", "fr", "b"),
    (7, "one two", "fr", "b"),
    (8, "one two", "fr", "b"),
    (9, "ONE  two\n", "fr", "b"),
    (10, prose(2, 60) + "\n" + prose(1, 60), "de", "c"),
    (11, prose(3, 4000), "de", "c"),
    (12, "é日本語 " * 30, "ja", "c"),
    (13, "same line here\n" * 9, "en", "a"),
    (14, "x" * 5000, "en", "a"),
    (None, prose(4, 80), "en", "a"),
    (None, BASE, "en", "a"),
    (15, prose(5, 13, 100), "en", "a"),
    (16, "### $$$ %% && ** << >> ||", "en", "a"),
]
#: n_words, kept, labels and the like clash with names of results.
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept string, labels string, key int, page_id int"


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2) for r in rows], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]
