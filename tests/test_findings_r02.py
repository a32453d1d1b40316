"""What the findings of round 2 were about, each on a table that showed it."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lettersift import mail_queries, queries as Q
from lettersift.functions.fuzzy import anchored_distances, may_match
from lettersift.operators import index as I
from lettersift.operators.maintenance import empty_index, update
from lettersift.operators.numbering import dense_numbers
from lettersift.plans.query import search
from lettersift.session import shared_dir
from lettersift.sources import reader
from lettersift.sources.store import read_index, write_index

TINY = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark, path, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_f1_only_matching_postings_are_moved(spark):
    text = plan(Q.queries()["flt_fuzzy_anchored"](spark, TINY))
    assert "hashpartitioning(token" not in text and "hashpartitioning(field" not in text
    tokens = ["pathetic", "sympathetic", "pathtic", "apathe", "pat", "the", "tic", "pxthexic", "xathetic", ""]
    df = spark.createDataFrame([(t,) for t in tokens], "token string").select("token", may_match(F.col("token"), "pathetic", 2).alias("m"))
    near = dict(zip(tokens, anchored_distances([t.encode() for t in tokens], b"pathetic") <= 2))
    assert all(r["m"] for r in df.collect() if near[r["token"]])


def test_f2_second_word_counts(spark, tmp_path):
    d = docs(spark, tmp_path, [(0, "Apache only"), (1, "licensed only"), (2, "neither")])
    assert sorted(r["doc_id"] for r in Q.queries()["set_fields"](spark, d).collect()) == [0, 1]


def test_f3_hot_token_is_many_files(spark, tmp_path):
    index = empty_index(spark)
    index.postings = spark.range(20000).select(F.lit("body").alias("field"), F.lit("the").alias("token"), F.col("id").alias("msg_id"))
    write_index(spark, index, str(tmp_path / "i"))
    got = read_index(spark, str(tmp_path / "i")).postings
    assert got.count() == 20000 and max(r["count"] for r in got.groupBy(F.input_file_name()).count().collect()) < 12000


def test_f4_f6_update_stores_no_postings(spark):
    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    got = update(empty_index(spark), mail_queries._files(spark, TINY), mail_queries._reader(spark, TINY))
    new = [t for t in set(os.listdir(root)) - before if t.startswith("table-")]
    assert not [t for t in new if spark.read.parquet(f"{root}/{t}").columns == ["field", "token", "msg_id"]]
    assert got.postings.count() == got.postings.distinct().count() > 0


def test_f4_rows_are_numbered_in_one_move(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert "Window" not in plan(dense_numbers(df, "k", "n")).split("BroadcastExchange")[0]
    assert dense_numbers(df, "k", "n").filter("k <> n").isEmpty()


@pytest.mark.parametrize("rows", [[b"x" * 400] * 9, [b"x" * 5000, None, b"", b"y"], [None], []])
def test_f5_f8_f12_batches_are_cut_by_bytes(rows):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.binary())], names=["k", "raw"])
    got = list(reader.slices(batch, 1, 1000))
    assert [r for b in got for r in b.column(1).to_pylist()] == rows
    assert all(b.num_rows == 1 or sum(len(r or b"") for r in b.column(1).to_pylist()) <= 1000 for b in got if b.num_rows)


def test_f7_f10_lists_across_blocks(spark):
    ids = {"a": [0, 3, 200, 70000, 140000], "b": [65535, 65536], "c": [131072]}
    post = spark.createDataFrame([("body", t, k) for t, v in ids.items() for k in v], "field string, token string, msg_id long")
    size = lambda g: 1 if g <= 127 else 2 if g <= 16383 else 4
    steps = {t: [b - a for a, b in zip([0, *v], v)] for t, v in ids.items()}
    got = {r["token"]: (r["n_bytes"], r["n_msgs"]) for r in I.posting_bytes(post).collect()}
    assert got == {t: (sum(map(size, g)), len(g)) for t, g in steps.items()}
    assert "Join" not in plan(I.posting_bytes(post))
    gaps = {r["value"]: r["n"] for r in I.statistics(post).filter("measure = 'gap'").collect()}
    flat = [x for g in steps.values() for x in g]
    assert gaps == {x: flat.count(x) for x in flat}


def test_f9_rules_are_checked_in_one_move(spark):
    messages = spark.createDataFrame([(0, "FILE", "p"), (1, "FILE", "p"), (2, "DEAD", "p")], "msg_id long, type string, path string")
    post = spark.createDataFrame([("body", "x", 0), ("body", "x", 0), ("body", "y", 1), ("body", "y", 9), ("body", "z", 9), ("body", "z", 9)], "field string, token string, msg_id long")
    got = sorted(map(tuple, I.violations(messages, post).collect()))
    assert got == [("duplicate path", "p", 2), ("duplicate posting", "x", 2), ("duplicate posting", "z", 2), ("unknown message", "y", 1), ("unknown message", "z", 2)]


def test_f11_mail_is_parsed_once(spark):
    assert plan(Q.queries()["tok_embedded"](spark, TINY)).count("MapInArrow") == 1


def test_f13_to_f16_postings_move_only_repeated_ids(spark, tmp_path):
    assert "Exchange" not in plan(Q.queries()["agg_postings"](spark, TINY))
    d = docs(spark, tmp_path, [(0, "a b"), (0, "b c"), (1, "a"), (None, "a d"), (None, "d")])
    got = sorted(((r["token"], r["msg_id"]) for r in Q.doc_postings(spark, d).collect()), key=repr)
    assert got == sorted([("a", 0), ("b", 0), ("c", 0), ("a", 1), ("a", None), ("d", None)], key=repr)
