"""Strings that polynomial hashes take for each other, odd ids, long texts, and the parts of operators against plain Python."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lettersift.llm import decontam, gam, labelled, langid, mixing, rules, sharding, substrings, textkit, toxicity
from tests.llm.conftest import SCHEMA, words
from tests.llm.test_brute import same


def thue_morse(n):
    s = [0]
    while len(s) < n:
        s += [1 - b for b in s]
    return "".join("ab"[b] for b in s), "".join("ba"[b] for b in s)


S, U = thue_morse(1024)


def test_names_are_exact():
    x = textkit.Texts(pa.array([f"{S} {U}", f"{U}  {S} x", None, ""]))
    ids, _ = x.names(*x.spans(textkit.INK)[:2])
    assert ids[0] == ids[3] and ids[1] == ids[2] and len(set(ids.tolist())) == 3


def test_lines_and_windows_of_colliding_words(spark):
    lines = S + "\n" + U + "\n" + " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, lines, "en", "a", 1), (2, " ".join([S, U] * 40), "en", "a", 1), (3, " ".join([U, S] * 40), "en", "a", 1)], SCHEMA)
    same(rules.adaptive_rules(docs), rules.oracle(), documents=docs)
    docs = spark.createDataFrame([(1, " ".join([S] * 20), "en", "a", 1), (2, " ".join([U] * 20), "en", "a", 1)], SCHEMA)
    same(substrings.dedup_substrings(docs, texts=False), substrings.SQL, documents=docs)
    bench = spark.createDataFrame([(1, " ".join([U] * 12))], "item_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {1: 0, 2: 20}


def test_suffix_arrays():
    rng = random.Random(4)
    ids = np.array([rng.randrange(3) for _ in range(400)])
    starts = np.arange(400 - substrings.WINDOW + 1)
    order, lcp = substrings.suffix_array(ids, starts)
    w = [tuple(ids[k : k + substrings.WINDOW]) for k in starts[order]]
    assert w == sorted(w)
    for k in range(1, len(w)):
        assert lcp[k] == next((j for j in range(substrings.WINDOW) if w[k][j] != w[k - 1][j]), substrings.WINDOW)


def test_largest_and_missing_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([((1 << 63) - 1, text, "en", "a", 1), (None, "x " + text, "en", "a", 1), (5, "y " + text, "en", "a", 1)], SCHEMA)
    got = {r["doc_id"]: r["n_removed"] for r in substrings.dedup_substrings(docs, texts=False).collect()}
    assert got == {(1 << 63) - 1: 30, None: 30, 5: 0}


def test_texts_longer_than_a_chunk(spark):
    rng = random.Random(6)
    long = words(rng, 400_000)
    assert len(long.encode()) > substrings._CHUNK // 2 > textkit.CHUNK
    tail = " ".join(long.split()[-200:])
    docs = spark.createDataFrame([(1, long, "en", "a", 1), (2, words(rng, 50) + " " + tail, "en", "a", 1), (3, long + " " + long, "de", "a", 1)], SCHEMA)
    got = {r["doc_id"]: r for r in substrings.dedup_substrings(docs, texts=False).collect()}
    assert [got[k]["n_removed"] for k in (1, 2, 3)] == [0, 200, 800_000]
    bench = spark.createDataFrame([(1, tail)], "item_id long, text string")
    hits = {r["doc_id"]: r["n_hit"] for r in decontam.decontaminate(docs, bench).collect()}
    assert hits == {1: 200, 2: 200, 3: 400}
    assert rules.measure_texts(pa.array([long]))["n_words"][0] == 400_000


def test_proximity_counts_against_sql(spark):
    rng = random.Random(9)
    letters = [f"t{k}" for k in range(25)]
    item = [rng.choice(letters) for _ in range(30)]
    rows = []
    for k in range(60):
        w = list(item)
        for _ in range(rng.randrange(4)):
            w.insert(rng.randrange(len(w)), rng.choice(letters))
        for _ in range(rng.randrange(3)):
            del w[rng.randrange(len(w))]
        rows.append((k, " ".join(w[rng.randrange(8) :]), "en", "a", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[5:12]))], "item_id long, text string")
    same(decontam.decontaminate(docs, bench), decontam.SQL, documents=docs, benchmark=bench)


def test_fences_follow_the_group(spark):
    """Two sources, one of long and one of short texts, where most texts have no symbol at all."""
    rng = random.Random(3)
    rows = [(k, words(rng, 400) + (" #" if k % 8 == 0 else ""), "en", "long", 1) for k in range(60)]
    rows += [(100 + k, words(rng, 60) + (" #" if k % 8 == 0 else ""), "en", "short", 1) for k in range(60)]
    rows += [(300, words(rng, 60) + " # # #", "en", "long", 1), (301, words(rng, 60) + " # # #", "en", "short", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"]: r["kept"] for r in rules.adaptive_rules(docs).collect()}
    assert not kept[300] and kept[301] and kept[0] and kept[100]
    same(rules.adaptive_rules(docs), rules.oracle(), documents=docs)


def test_mix_without_ids_agrees_on_every_layout(spark):
    rng = random.Random(7)
    rows = [(None, words(rng, rng.randint(1, 9)), "en", "a", 1) for _ in range(200)] + [(None, "x y z", "en", "a", 1)] * 100 + [(k, "q w e r", "en", "b", 1) for k in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one, five = (Counter(map(tuple, mixing.mix(docs.repartition(n)).collect())) for n in (1, 5))
    assert one == five and sum(one.values()) == len(rows)


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 500, 300), rng.random(300)
    taken = np.zeros(300)
    for k in range(400):
        q = mixing.flight(p, size, np.random.default_rng(k).random(300))
        assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3
        taken += q
    assert np.abs(taken / 400 - p).max() < 0.15 and np.abs(taken / 400 - p).mean() < 0.03


def brute_leaves(rows, n, scale):
    """rows: (dims, tie, size, name); the tree by the same law, over lists."""
    if n == 1 or not rows:
        return [[r[3] for r in rows]] + [[] for _ in range(n - 1)]
    total = sum(r[2] for r in rows)

    def spread(d):
        mean = sum(r[0][d] * r[2] for r in rows) / total
        return sum((r[0][d] - mean) ** 2 * r[2] for r in rows) / total / scale[d]

    d = max(range(4), key=lambda k: (round(spread(k), 6), sharding.DIMS[k]))
    rows = sorted(rows, key=lambda r: (r[0][d], r[1]))
    want = total * (n // 2) / n
    cut = min(range(len(rows) + 1), key=lambda k: (abs(sum(r[2] for r in rows[:k]) - want), -k))
    return brute_leaves(rows[:cut], n // 2, scale) + brute_leaves(rows[cut:], n - n // 2, scale)


def test_leaves_against_brute_force():
    rng = np.random.default_rng(2)
    dims, tie, size = rng.integers(0, 50, (200, 4)), rng.permutation(200), rng.integers(1, 90, 200)
    scale = np.array([1.0, 2.0, 3.0, 1.5])
    got = sharding.kd_leaves(dims, tie, size, 7, scale)
    want = brute_leaves([(dims[k].tolist(), int(tie[k]), int(size[k]), k) for k in range(200)], 7, scale)
    assert [sorted(np.flatnonzero(got == k).tolist()) for k in range(7)] == [sorted(w) for w in want]


@pytest.mark.parametrize("task_units", [40, 1 << 19])
def test_shards_by_distributed_medians_and_within_tasks(spark, task_units):
    rng = random.Random(2)
    rows = [(k, "x" * rng.choice([10, 200, 3000]) + str(rng.randrange(300)), "en", "https://a.org" if k % 3 else "https://b.org", 0) for k in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shard(docs, shards=8, task_units=task_units).collect()
    size, home = Counter(), {}
    for r in got:
        size[r["shard"]] += r["size"]
        home.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert len(got) == 1500 and len(size) == 8 and max(size.values()) < 1.1 * min(size.values()) and all(len(v) == 1 for v in home.values())


def test_language_of_texts_without_spaces(spark):
    rng = random.Random(1)
    zh, ja = "的一是不了人我在有他这为之大来以个中上们", "のにはをたがでてとしれさあいなるよりこら"
    rows = [(k, "".join(rng.choice(s) for _ in range(90)), lang, "a", 1) for lang, s in (("zh", zh), ("ja", ja)) for k in range(40)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.language_id(docs).collect()}
    assert all(got[r[0]] == r[2] for r in rows)


def test_language_against_plain_backoff():
    counts = [("en", b"the", 50), ("en", b"house", 9), ("de", b"der", 50), ("de", b"haus", 9), ("de", b"zeitung", 9)]
    m = langid.fit(counts)

    def plain(word):
        tables = [{int(h): r for h, r in zip(*t)} for t in m.tables]
        h = int(textkit.hashes_of(pa.array([word], pa.binary()))[0])
        if h in tables[0]:
            return tables[0][h]
        framed = b" " + word + b" "
        for step, k in enumerate(langid.ORDERS, 1):
            seen = [tables[step][int.from_bytes(framed[i : i + k], "big")] for i in range(len(framed) - k + 1) if int.from_bytes(framed[i : i + k], "big") in tables[step]]
            if seen:
                return np.mean(seen, axis=0) + langid.BACKOFF * step
        return None

    x = textkit.Texts(pa.array(["the zeit hauses haustier thex"]))
    a, b, _ = x.spans(langid._LETTER)
    got = langid.word_scores(m, x, a, b)
    for row, w in zip(got, [b"the", b"zeit", b"hauses", b"haustier", b"thex"]):
        assert np.allclose(row, plain(w), atol=1e-4)


def test_distances_against_one_window_at_a_time():
    import zstandard as zs

    model = toxicity.Model(b" idiot  moron  scum ", b" the  house  of  green ")
    tool = toxicity.Distance(model)
    x = textkit.Texts(pa.array(["the idiot of house", "moron idiot new"]))
    a, b, _ = x.spans(toxicity._LETTER)
    got = tool.windows(x, a, b).tolist()
    want = []
    for w in [b"the", b"idiot", b"of", b"house", b"moron", b"idiot", b"new"]:
        wide = toxicity._dilate(b" " + w + b" ")
        o, t = (len(c.compress(wide)) for c in tool.tools)
        want.append(o - t)
    assert got == want and got[1] > 0 > got[0] and isinstance(tool.tools[0], zs.ZstdCompressor)


def test_additive_scores_against_lookups():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    m = gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    got = m.logits(x)
    for k in range(0, 500, 50):
        z = m.intercept + sum(t[sum(v >= e for e in edge)] for v, edge, t in zip(x[k], m.edges, m.tables))
        z += sum(t[sum(x[k, i] >= e for e in m.pair_edges[i]), sum(x[k, j] >= e for e in m.pair_edges[j])] for i, j, t in m.pairs)
        assert abs(z - got[k]) < 1e-9
    assert labelled.auc(got, (x[:, 0] > 0).astype(float)) > 0.5


def test_soft_terms_need_weight_and_company(spark):
    from lettersift.llm import urls

    rows = [(1, "http://a.org/cheap-pills"), (2, "http://a.org/pills"), (3, "http://a.org/stream/mp3"), (4, "http://a.org/stream/mp3/download"), (5, "http://pills.pills/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["soft_weight"]) for r in urls.filter_urls(pages).collect()}
    assert got == {1: ("block", 2.5), 2: ("allow", 1.5), 3: ("allow", 1.0), 4: ("block", 1.5), 5: ("allow", 1.5)}
    same(urls.filter_urls(pages, limit=0.9), urls.oracle(limit=0.9), pages=pages)
