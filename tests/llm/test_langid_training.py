"""Languages whose training text has hardly a short or repeated word."""

import random

import pytest

from lettersift.llm import langid


def clause(rng, n):
    """Letters of three bytes without a space: one run, longer than the table of words keeps."""
    return "".join(chr(0x4E00 + rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(6)
    nouns = ["house", "water", "garden", "window", "street", "morning"]
    rows = [(k, " ".join(rng.choice(nouns) for _ in range(12)), "en") for k in range(300)]
    rows += [(1000 + k, clause(rng, 30), "zh") for k in range(20)]
    rows += [(2000 + k, "".join(rng.choice("αβγδεζ") for _ in range(6)), "el") for k in range(3)]
    rows += [(3000, "12 34", "xx")]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_long_and_single_words_teach_ngrams(spark, model):
    assert model.langs == ["el", "en", "xx", "zh"]
    rng = random.Random(7)
    rows = [(k, clause(rng, 25)) for k in range(10)] + [(10, "αβγδεζ"), (11, "the gardener watered a windowsill"), (12, "morning garden"), (13, "zzqx brmk")]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[k] for k in range(10)] == ["zh"] * 10 and got[10] == "el"
    assert got[11] == got[12] == "en"


def test_driver_and_cluster_agree(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the house the", "en"), ("das haus das", "de"), ("x" * 60, "en")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = [(r["lang"], bytes(r["word"]), r["n"]) for r in langid.word_counts(langid.train_rows(docs, 10, "doc_id", "text", "lang", None)).collect()]
    here, there = langid.fit(counts), langid.train(docs)
    assert here.langs == there.langs
    for (a, x), (b, y) in zip(here.tables, there.tables):
        assert a.tolist() == b.tolist() and x == pytest.approx(y)
