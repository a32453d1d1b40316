"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest

from lettersift.llm import decontam, gam, langid, mixing, rules, sharding, simhash, substrings, toxicity, urls


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (None, "12 34"), (1, "one two"), (5, "a b c d e f g h i j k l")], "item_id long, text string")


OPS = {
    "toxicity": lambda d, m, b: toxicity.toxicity(d, m),
    "langid": lambda d, m, b: langid.language_id(d),
    "rules": lambda d, m, b: rules.adaptive_rules(d),
    "quality": lambda d, m, b: gam.quality(d, m),
    "mixing": lambda d, m, b: mixing.mix(d).drop("row"),
    "sharding": lambda d, m, b: sharding.shard(d, shards=8).drop("slot"),
    "decontam": lambda d, m, b: decontam.decontaminate(d, b),
    "substrings": lambda d, m, b: substrings.dedup_substrings(d),
    "simhash": lambda d, m, b: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPS)
def test_hostile_tables(name, hostile, clashing, nothing, marks, items):
    op = OPS[name]
    rows = op(hostile, marks, items).collect()
    assert len(rows) == hostile.count()
    got = sorted(map(repr, rows))
    assert sorted(map(repr, op(clashing, marks, items).select(*rows[0].__fields__).collect())) == got
    assert op(nothing, marks, items).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_no_examples(name, hostile, marks):
    rows = OPS[name](hostile, marks.limit(0), None).collect()
    assert len(rows) == hostile.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_scores_are_defined(hostile, marks):
    tox = {r["doc_id"]: r for r in toxicity.toxicity(hostile, marks).collect()}
    assert all(0 <= r["score"] <= 1 for r in tox.values())
    assert tox[1]["score"] == tox[2]["score"] == tox[3]["score"]


def test_language_undetermined(hostile):
    got = {r["doc_id"]: r for r in langid.language_id(hostile).collect()}
    for k in (1, 2, 3, 9, 10, 12):
        assert got[k]["lang_pred"] == "und" and got[k]["score"] == 0
    assert got[6]["lang_pred"] in ("en", "de", "fr", "xx")


def test_urls(spark):
    rows = [
        (1, None, ""), (2, "", ""), (3, "no scheme", ""), (4, "http://EXAMPLE.com/en/x", ""), (5, "http://www.example.com/en/x", ""),
        (6, "http://a.net/es/?q", ""), (7, "http://b.org/casino-1", ""), (8, "http://b.org/casinos", ""), (9, "http://b.org/free", ""),
        (10, "http://b.org/free/bonus", ""), (11, "http://b.org/free/free", ""), (None, "http://b.org/spam-spam", ""), (13, "x://ünet/fr/", ""), (14, "s://net#a/fr/", ""),
        (4, "http://EXAMPLE.com/en/x", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    assert urls.filter_urls(pages).count() == len(rows)
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("", "", None, "allow")
    assert got[4]["rule"] == "example.com/en/" and got[4]["verdict"] == "block"
    assert got[5]["rule"] == "www.example.com/en/" and got[5]["verdict"] == "allow"
    assert got[6]["rule"] == "net/es/" and got[6]["path"] == "/es/"
    assert got[7]["verdict"] == "block" and got[8]["verdict"] == "allow"
    assert got[9]["verdict"] == "allow" and got[10]["verdict"] == "block" and got[11]["verdict"] == "allow"
    assert got[None]["n_strict"] == 2 and got[13]["rule"] is None and got[14]["path"] == ""
    assert urls.filter_urls(pages.limit(0)).count() == 0
