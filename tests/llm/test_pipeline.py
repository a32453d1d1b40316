"""Pipeline stages against plain Python, each on its own input."""

import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

import corpus_pipeline as P
from lettersift.llm import gam
from lettersift.llm.common import held_out
from tests.llm.conftest import SCHEMA, words
from tests.llm.test_brute import SPACE, brute_print

ALNUM = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rng = random.Random(11)
    rows = [(k, words(rng, rng.randint(30, 120)), "en", rng.choice(["a", "a", "b", "c"]), 1) for k in range(120)]
    rows += [(k, "| x " * rng.randint(30, 90), "en", "a", 1) for k in range(120, 180)]
    rows += [(200, rows[3][1], "de", "b", 2), (201, rows[3][1], "de", "b", 2), (201, rows[3][1], "de", "b", 2), (None, rows[3][1], None, None, None), (None, None, None, None, None), (202, "", "en", "a", 0)]
    rows += [(203, words(rng, 20) + " " + rows[5][1] + " " + words(rng, 20), "en", "c", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k < 120), 0) for k in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, rows[5][1]), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_quality_keeps_what_the_classifier_accepts(spark, docs, folder):
    model = gam.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), keep=~held_out("doc_id", 3, 1))
    want = Counter(tuple(r)[:-2] for r in gam.classify(docs, model, docs.columns).collect() if r["predicted"])
    got = P.quality_filter(spark, docs, folder)
    assert got.columns == docs.columns and bag(got) == want
    kept = {r[0] for r in want}
    assert set(range(120)) <= kept and not kept & set(range(120, 180))


def test_near_dedup_keeps_one_of_each_group(spark, docs, folder):
    got = P.near_dedup(spark, docs, folder)
    rows = docs.collect()
    fp = {r["text"]: brute_print(r["text"]) for r in rows}
    group = {f: f for f in fp.values()}
    for _ in range(4):
        for f in group:
            for g in group:
                if (f ^ g).bit_count() <= 3:
                    group[f] = group[g] = min(group[f], group[g])
    least = {}
    for r in rows:
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        g = group[fp[r["text"]]]
        least[g] = min(least.get(g, key), key)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(None if none else k for none, k in least.values())
    assert got.columns == docs.columns and not bag(got) - bag(docs)


def test_decontamination_drops_hit_documents_only(spark, docs, folder):
    fold = lambda t: re.findall(ALNUM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    item = fold(docs.filter("doc_id = 5").first()["text"])
    grams = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    hit = lambda w: any(tuple(w[i : i + 10]) in grams for i in range(len(w) - 9))
    want = Counter(tuple(r) for r in docs.collect() if not hit(fold(r["text"])))
    got = P.decontaminate(spark, docs, folder)
    assert got.columns == docs.columns and bag(got) == want and {5, 203} & {r[0] for r in want} == set()


def test_mix_repeats_and_shards_hold_all(spark, docs, folder):
    mixed = P.mix_sources(spark, docs, folder)
    assert mixed.columns == docs.columns and set(bag(mixed)) <= set(bag(docs))
    most = bag(docs)
    assert all(n <= 3 * most[r] for r, n in bag(mixed).items())
    size = lambda t: len(re.findall(SPACE, t or ""))
    all_, taken = Counter(), Counter()
    for r in docs.collect():
        all_[r["source"]] += size(r["text"])
    for r in mixed.collect():
        taken[r["source"]] += size(r["text"])
    total, w = sum(all_.values()), {"a": 5, "b": 2, "c": 1, None: 5}
    capped = {s: 3 * all_[s] for s in all_ if total * w[s] / 13 > 3 * all_[s]}
    while True:
        left, wall = total - sum(capped.values()), sum(v for s, v in w.items() if s not in capped)
        more = {s: 3 * all_[s] for s in all_ if s not in capped and left * w[s] / wall > 3 * all_[s]}
        if not more:
            break
        capped |= more
    for s in all_:
        assert abs(taken[s] - capped.get(s, left * w[s] / wall)) <= 130
    out = P.shard_corpus(spark, mixed, folder)
    assert bag(out.select(*docs.columns)) == bag(mixed)
    slots = {}
    for r in out.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_run(spark, folder):
    out = P.run(spark, folder)
    assert out.columns[-2:] == ["shard", "slot"] and out.count() > 0
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_on_clashing_and_empty_tables(spark, folder, docs, clashing, nothing, name):
    """Columns called like the operators' own keep their values; an empty table gives no rows."""
    stage = dict(P.STAGES)[name]
    more = ("__row", "__copies", "__nth", "__n", "copies", "_metadata", "Shard")
    wide = docs.select("*", *[F.lit("?").alias(c) for c in (*[c for c in clashing.columns if c not in docs.columns and c != "shard"], *more)])
    plain, got = stage(spark, docs, folder), stage(spark, wide, folder)
    kept = [c for c in wide.columns if name != "shard" or c.lower() not in ("shard", "slot")]
    assert got.columns == kept + (["shard", "slot"] if name == "shard" else [])
    own = docs.columns + (["shard"] if name == "shard" else [])
    assert bag(got.select(*own)) == bag(plain.select(*own))
    assert all(set(r) == {"?"} for r in got.select(*[f"`{c}`" for c in kept if c not in docs.columns]).distinct().collect())
    assert stage(spark, nothing, folder).count() == 0
