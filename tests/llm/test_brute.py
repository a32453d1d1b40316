"""Operators against plain Python or DuckDB on small tables."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lettersift.llm import decontam, langid, mixing, rules, sharding, simhash, substrings, urls
from lettersift.llm.gam import fit as fit_gam
from lettersift.llm.labelled import auc
from tests.llm.conftest import SCHEMA, words

SPACE = "[^\x20\x09-\x0d]+"


def same(spark_df, sql, **tables):
    con = duckdb.connect()
    for n, df in tables.items():
        con.register(n, df.toArrow())
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    got = [tuple(r[n] for n in names) for r in spark_df.select(*names).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_rules_against_sql(hostile):
    same(rules.adaptive_rules(hostile, least_rows=5), rules.oracle(least_rows=5), documents=hostile)


def test_substrings_against_sql(hostile):
    same(substrings.dedup_substrings(hostile, texts=False), substrings.SQL, documents=hostile)


def test_substring_spans_cover_what_goes(hostile):
    for r in substrings.dedup_substrings(hostile).collect():
        assert sum(s["stop"] - s["start"] for s in r["spans"]) >= r["n_removed"]
        assert len(re.findall(SPACE, r["text"])) == r["n_words"] - r["n_removed"]


def test_substrings_across_chunks(spark, monkeypatch):
    """Small chunks and usual prefixes give what one chunk gives."""
    rng = random.Random(5)
    common = [words(rng, 40) for _ in range(6)]
    rows = [(k, " ".join(rng.choice(common) if rng.random() < 0.4 else "the " * 3 + words(rng, 15) for _ in range(8)), "en", "a", 0) for k in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    monkeypatch.setattr(substrings, "_CHUNK", 2000)
    same(substrings.dedup_substrings(docs, texts=False), substrings.SQL, documents=docs)


def test_decontamination_against_sql(spark, hostile):
    texts = {r["doc_id"]: r["text"] for r in hostile.filter("doc_id in (4, 7)").collect()}
    items = [(1, texts[4][:200]), (2, texts[7][:300].upper()), (10, "ONE two"), (11, "spam"), (12, "spam " * 12), (3, None), (4, "nowhere at all"), (1, texts[4][:200])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(decontam.decontaminate(hostile, bench), decontam.SQL, documents=hostile, benchmark=bench)


def test_decontamination_in_blocks_and_nearby(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "a b c X d e f g h i j"), (3, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g h i j"), (8, "b c d e f g h i j k")], "item_id long, text string")
    got, found = decontam.contamination(docs, bench, block=1)
    got = {r["doc_id"]: r for r in got.collect()}
    assert got[1]["n_hit"] == 11 and got[1]["items"] == ["7", "8"]
    assert got[2]["n_hit"] == 0 and got[2]["n_near"] > 0 and got[3]["n_near"] == 0
    assert found.filter("exact").count() == 2


def test_urls_against_sql(spark):
    rng = random.Random(1)
    parts = ["free", "bonus", "casino", "en", "es", "fr", "xfree", "free1", "-", "_", "/", "?", "#", ".", "é"]
    heads, hosts = ["http://", "", "a://b://"], ["example.com", "Example.NET", "net", "anet", "com"]
    rows = [(k, rng.choice(heads) + rng.choice(["", "www.", "x."]) + rng.choice(hosts) + "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for k in range(400)]
    pages = spark.createDataFrame(rows + [(None, None), (3, "")], "page_id long, url string")
    same(urls.filter_urls(pages), urls.oracle(), pages=pages)


def brute_print(text):
    w = re.findall(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(hostile):
    rows = hostile.collect()
    fp = [brute_print(r["text"]) for r in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and (fp[i] ^ fp[j]).bit_count() <= 3] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in near[i]:
                root[i] = root[j] = min(root[i], root[j])
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root[i]] = min(least.get(root[i], r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f"{fp[i]:016x}", len(near[i]), least.get(root[i])) for i, r in enumerate(rows))
    assert Counter(tuple(r) for r in simhash.near_duplicates(hostile).collect()) == want


@pytest.mark.parametrize("trie", [4, 16, 4096])
def test_links_with_small_tries(spark, trie):
    """A trie that must be split again finds the same links."""
    rng = random.Random(trie)
    seeds = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    fps = {s for s in seeds} | {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for s in seeds for _ in range(12)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(f), 1) for f in fps], "fp long, n long")
    got = Counter()
    for r in simhash.hamming_links(df, trie=trie).collect():
        got[r["fp"]] += r["near"]
    want = {signed(f): c for f in fps if (c := sum(g != f and (f ^ g).bit_count() <= 3 for g in fps))}
    assert dict(got) == want


def test_shards(hostile):
    rows = sharding.shard(hostile, shards=8).collect()
    by = {}
    for r in rows:
        assert r["law"] == "bytes" and 0 <= r["shard"] < 8 and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = Counter((r["doc_id"], 0 if r["text"] is None else len(r["text"].encode()), None if r["text"] is None else zlib.crc32(r["text"].encode())) for r in hostile.collect())
    assert Counter((r["doc_id"], r["size"] - 1, r["text_crc32"]) for r in rows) == texts


def test_shard_bytes_are_even(spark):
    rng = random.Random(2)
    rows = [(k, "x" * rng.choice([10, 200, 3000]) + str(rng.randrange(300)), "en", "hot" if k % 3 else "b", 0) for k in range(3000)]
    full = sharding.shard(spark.createDataFrame(rows, SCHEMA), shards=8).collect()
    sizes, home = Counter(), {}
    for r in full:
        sizes[r["shard"]] += r["size"]
        home.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert len(sizes) == 8 and max(sizes.values()) < 1.05 * min(sizes.values())
    assert sum(len(v) > 1 for v in home.values()) == 0


def brute_targets(sizes, most=3.0):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        wall = sum(w for s, w in weights.items() if s not in capped)
        over = [s for s in sizes if s not in capped and left * weights[s] / wall > most * sizes[s] + 1e-9]
        if not over:
            return {s: capped.get(s, left * weights[s] / wall if wall else 0) for s in sizes}
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("block", [50, 20_000])
def test_mix(spark, block):
    rng = random.Random(8)
    rows = [(k, words(rng, rng.choice([1, 5, 40, 90])), "en", rng.choice(["a", "a", "a", "b", "c", None, "d"]), 0) for k in range(900)]
    rows += [(None, None, None, "z", 0), (901, "", None, "z", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = brute_targets(sizes)
    got = mixing.mix(docs, block=block).collect()
    again = mixing.mix(docs.repartition(7), block=block).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)
    named = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = named[r["doc_id"]]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s]
        taken[s] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 100


def test_language_words_then_ngrams():
    counts = [("en", b"the", 50), ("en", b"house", 9), ("en", b"thing", 9), ("de", b"der", 50), ("de", b"haus", 9), ("de", b"zeitung", 9)]
    m = langid.fit(counts)
    names, score = langid.predict_texts(m, pa.array(["the house", "der haus", "zeit", "housing", None, "", "12", "\u3000!", "THE"]))
    assert names[:2] == ["en", "de"] and names[4:] == ["und", "und", "und", "und", "en"] and score[0] > 0.9
    assert names[2] in ("de", "en") and names[3] == "en"


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(4000) < 0.02)).astype(float)
    m = fit_gam(x[:3000], y[:3000])
    assert auc(m.logits(x[3000:]), y[3000:]) > 0.85
    y = (x[:, 2] + np.abs(x[:, 3]) > 1).astype(float)
    m = fit_gam(x[:3000], y[:3000])
    assert auc(m.logits(x[3000:]), y[3000:]) > 0.97
