"""Words counted and listed by chunks, against plain Python and their SQL."""

import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lettersift import queries as Q
from lettersift.operators import index as I
from lettersift.operators import words

TINY = "/root/testdata/sf0.001"
ODD = [
    (0, "a b B é_É x9"), (0, "b c"), (1, "A"), (None, "a d"), (None, "d"), (70000, "a"), (65535, "a,a"), (65536, "a b"), (-1, "a"), (-65535, "a"), (-65536, "a"),
    (-70000, "a z"), (3, None), (4, ""), (5, "  ,.;"), (2**60 + 1, "a"), (6, "Ünï-cödé İ ſ K 日本語。x"), (7, "the " * 5000),
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ODD, "doc_id long, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
    return d


def same_as_sql(spark, d, name):
    db = duckdb.connect()
    db.execute(f"create view documents as from '{d}/documents.parquet/*.parquet'")
    return sorted(map(tuple, Q.queries()[name](spark, d).collect()), key=repr) == sorted(db.sql(Q.oracle_sql()[name]).fetchall(), key=repr)


def tokens(text):
    return set(re.findall("[0-9a-z_\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "").split("\0")[0])))


def batches(rows, n):
    for k in range(0, len(rows), n):
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k : k + n]], pa.int64()), pa.array([r[1] and r[1].encode() for r in rows[k : k + n]], pa.binary())], names=["id", "text"])


def some_rows(seed):
    rng = random.Random(seed)
    ids = [None, *range(-40, 40), 2**40]
    return [(rng.choice(ids), rng.choice([None, "", " ", "x\0y", *[" ".join(rng.choices(["A", "b", "ç", "b-a", "_", "Z9", " ", "q" * 300], k=rng.randint(1, 9))) for _ in range(9)]])) for _ in range(rng.randint(1, 80))]


def test_f15_lists_are_made_before_they_are_moved(spark):
    text = plan(Q.queries()["agg_posting_lists"](spark, TINY))
    assert "ObjectHashAggregate" not in text and "Generate" not in text


def test_f15_odd_ids_are_listed_as_in_sql(spark, odd):
    assert same_as_sql(spark, odd, "agg_posting_lists")


@pytest.mark.parametrize("seed", range(20))
def test_f15_lists_whatever_the_chunks_and_batches(monkeypatch, seed):
    monkeypatch.setattr(words, "CHUNK", random.Random(seed).choice([1, 500, 10**6]))
    rows, block = some_rows(seed), 16
    want = {}
    for i, text in rows:
        for t in tokens(text):
            want.setdefault((t, None if i is None else int(i / block)), set()).update([] if i is None else [i])
    parts = [r for b in words._list(block)(batches(rows, 7)) for r in b.to_pylist()]
    parts.sort(key=lambda r: (r["token"], r["block"] is not None, r["block"] or 0))
    schema = pa.schema({"token": pa.string(), "block": pa.int64(), "ids": pa.binary()})
    cut = (pa.RecordBatch.from_pylist(parts[k : k + 3], schema) for k in range(0, len(parts), 3))
    got = [r for b in words._merge(block)(cut) for r in b.to_pylist()]
    assert len(got) == len(want) and {(r["token"], r["block"]): r["msg_ids"] for r in got} == {k: sorted(v) for k, v in want.items()}


def test_f15_ids_are_whole_numbers(spark):
    with pytest.raises(TypeError):
        words.lists(spark.createDataFrame([("a", "b")], "id string, text string"), "text", "id", 16)


def test_f14_words_are_counted_before_they_are_moved(spark):
    for name in ("agg_document_frequency", "top_tokens"):
        assert "Generate" not in plan(Q.queries()[name](spark, TINY))


def test_f14_repeated_and_null_ids_count_once(spark, odd):
    assert same_as_sql(spark, odd, "agg_document_frequency") and same_as_sql(spark, odd, "top_tokens")
    rows = spark.read.parquet(f"{odd}/documents.parquet")
    moved = plan(I.frequencies(rows, "body", "text", "doc_id"))
    assert "Generate" not in moved


@pytest.mark.parametrize("seed", range(20))
def test_f14_counts_whatever_the_chunks(monkeypatch, seed):
    monkeypatch.setattr(words, "CHUNK", random.Random(seed).choice([1, 500, 10**6]))
    rows, got, want = some_rows(seed), {}, {}
    for b in words._count(batches(rows, 7)):
        for r in b.to_pylist():
            got[r["token"]] = got.get(r["token"], 0) + r["n"]
    for _, text in rows:
        for t in tokens(text):
            want[t] = want.get(t, 0) + 1
    assert got == want


def test_f14_bytes_that_are_no_text(spark):
    rows = spark.range(1).select("id", F.expr("cast(X'61FF20C328204142' as string)").alias("text"))
    assert sorted(tuple(r) for r in I.frequencies(rows, "f", "text", "id").collect()) == [("f", "ab", 1), ("f", "a�", 1), ("f", "�", 1)]
