import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7))) for _ in range(n))


def hostile_rows():
    """Nulls in every column, empty, blank and very long texts, copies, near copies, repeated rows, odd characters."""
    rng = random.Random(3)
    base = words(rng, 120)
    passage = words(rng, 60)
    rows = [
        (None, base, "en", "a", 5), (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \t\n ", None, "b", 4),
        (4, base, "de", "b", 5), (4, base, "de", "b", 5), (5, base + " x", "en", "a", 5), (6, words(rng, 4_000), "en", "a", 9),
        (7, passage + " " + words(rng, 30), "en", "a", 1), (8, words(rng, 20) + " " + passage, None, None, 1), (9, "#$%", "xx", "c", 3),
        (10, "12 34", "en", "c", 3), (11, "one two", "fr", "c", 3), (12, "\u00a0\u2003", "fr", "a", 2), (13, "spam " * 300, "en", "a", 2),
        (14, "A\u0001b C\x0bd", "en", "a", 2), (None, None, None, None, None), (None, None, None, None, None),
    ]
    rows += [(100 + k, words(rng, rng.randint(1, 200)), rng.choice(["en", "de"]), rng.choice(["a", "a", "b", "c"]), 7) for k in range(60)]
    rows += [(200 + k, passage, "en", "a", 1) for k in range(25)]
    return rows


@pytest.fixture(scope="session")
def hostile(spark):
    return spark.createDataFrame(hostile_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHES = ("_id", "_text", "score", "predicted", "size", "shard", "slot", "kid", "th", "fp", "n", "row", "_p", "source_size", "n_words", "segment", "held_out", "__k", "_rid", "y")


@pytest.fixture(scope="session")
def clashing(hostile):
    """The same with more columns, called like those that operators work with."""
    from pyspark.sql import functions as F

    return hostile.select("*", *[F.lit("?").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def marks(spark):
    rows = [(k, k % 2, int(k % 5 == 0)) for k in range(100, 160)] + [(None, 1, 1), (101, None, None), (4, 1, 0), (4, 0, 1), (9999, 1, 1), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
