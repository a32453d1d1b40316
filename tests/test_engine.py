"""The engine end to end on a small corpus, and its operators against plain Python or DuckDB."""

import bz2
import gzip
import io
import lzma
import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from lettersift import mail_queries  # noqa: F401  registers its queries
from lettersift import queries as Q
from lettersift.cli import main
from lettersift.functions.fuzzy import fuzzy
from lettersift.operators.components import connected_components
from lettersift.operators.numbering import dense_numbers
from lettersift.operators.offsets import running_offsets

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    d = tmp_path_factory.mktemp("mail")
    for s in ("new", "cur", "tmp"):
        os.makedirs(d / "m" / s)
    (d / "m/cur/1:2,S").write_text("From: Ann <ann@x.org>\nTo: bob@y.org\nSubject: Caterpillar news\nMessage-ID: <a1@x>\nDate: Thu, 30 Dec 2010 10:00:00 +0000\n\nthe moose walked\n")
    (d / "m/new/.2").write_text("From: bob@y.org\nSubject: Re: news\nMessage-ID: <b2@y>\nIn-Reply-To: <a1@x>\nDate: Fri, 31 Dec 2010 10:00:00 +0000\n\nmouse\n")
    os.makedirs(d / "h/7")
    (d / "h/1").write_text("Subject: CAFÉ\n\nplain\n")
    (d / "h/.mh_sequences").write_text("")
    one = "From x@y Thu Jan  1 00:00:00 2015\nSubject: {0}\nMessage-ID: <{0}@c>\n\nhello {0}\n\n"
    (d / "box").write_text(one.format("zebra") + one.format("lion"))
    (d / "b.gz").write_bytes(gzip.compress(one.format("gnu").encode()))
    (d / "b.bz2").write_bytes(bz2.compress(one.format("yak").encode()))
    (d / "b.XZ").write_bytes(lzma.compress(one.format("emu").encode()))
    (d / "rc").write_text(f"base={d}\nmaildir=m\nmh=h\nmbox=box:b.*\ndatabase={d}/db\nmfolder=out\n")
    return d


@pytest.fixture(scope="module")
def run(spark, corpus):
    def call(*args):
        out = io.StringIO()
        return main(["-f", str(corpus / "rc"), *args], spark, out), [line.replace(str(corpus) + "/", "") for line in out.getvalue().splitlines()]

    assert call("moose")[0] == 3
    assert call()[0] == 0
    return call


CASES = {
    ("moose",): ["m/cur/1:2,S"], ("mo=",): ["m/cur/1:2,S", "m/new/.2"], ("b:moose=2",): ["m/cur/1:2,S", "m/new/.2"], ("s:café",): [], ("s:cafÉ",): ["h/1"],
    ("hello,~lion",): ["mbox:b.XZ", "mbox:b.bz2", "mbox:b.gz", "mbox:box"], ("m:b2@y",): ["m/new/.2"], ("F:s",): ["m/cur/1:2,S"], ("d:20101230-",): ["m/new/.2"],
    ("p:cur=", "moose"): ["m/cur/1:2,S"], ("^terpilar=2",): ["m/cur/1:2,S"], ("-t", "mouse"): ["m/cur/1:2,S", "m/new/.2"], ("gnu/yak/emu",): ["mbox:b.XZ", "mbox:b.bz2", "mbox:b.gz"],
    ("a:y.org=",): ["m/cur/1:2,S", "m/new/.2"],
}


@pytest.mark.parametrize("args", CASES)
def test_searches(run, args):
    code, lines = run("-r", *args)
    assert sorted(x.split(" [")[0] for x in lines[:-1]) == CASES[args] and code == (0 if CASES[args] else 1)


def test_outputs_and_errors(run, corpus):
    assert run("mouse/zebra")[1] == ["Matched 2 messages"]
    out = corpus / "out"
    assert sorted(len(os.listdir(out / s)) for s in ("new", "cur")) == [0, 2] or sum(len(os.listdir(out / s)) for s in ("new", "cur")) == 2
    assert run("-a", "moose")[0] == 0 and sum(len(os.listdir(out / s)) for s in ("new", "cur")) == 3
    assert run("-o", "m", "moose")[0] == 3 and run("d:bad")[0] == 2
    assert "Subject: zebra" in run("-x", "zebra")[1]


def test_update_and_purge(run, corpus):
    n = len(run("-d")[1])
    assert run()[0] == 0 and len(run("-d")[1]) == n
    text = (corpus / "box").read_text().replace("hello lion", "hello tiger")
    (corpus / "box").write_text(text)
    os.utime(corpus / "box", (time.time() + 5, time.time() + 5))
    os.unlink(corpus / "m/new/.2")
    assert run("-p")[0] == 0
    assert run("-r", "mouse")[0] == 1 and run("-r", "b:lion")[0] == 1 and run("-r", "tiger")[0] == 0
    ids = sorted(int(x.split("\t")[2]) for x in run("-d")[1] if x.startswith("message\t"))
    assert ids == list(range(len(ids)))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "orders", "events"):
        con.execute(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    cursor = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    got = [tuple(r[n] for n in names) for r in Q.queries()[name](spark, TINY).select(*names).collect()]
    assert sorted(got, key=repr) == sorted([tuple(map(plain, r)) for r in cursor.fetchall()], key=repr)


def plain(v):
    return int(v) if type(v).__name__ == "Decimal" else v


def brute_distance(word, token):
    """Least edits between the word and any substring."""
    row = [0] * (len(token) + 1)
    for i, c in enumerate(word, 1):
        new = [i]
        for j, t in enumerate(token, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def test_fuzzy_against_brute_force(spark):
    rng = random.Random(4)
    tokens = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    cases = [("abca", 1), ("bb", 1), ("cab", 3), ("abcabc", 2)]
    rows = df.select("token", *[fuzzy(F.col("token"), w, k).alias(f"{w}{k}") for w, k in cases]).collect()
    for r in rows:
        for w, k in cases:
            assert r[f"{w}{k}"] == (brute_distance(w, r["token"]) <= k), (w, k, r["token"])


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 130)] + [(200, 200), (None, 5)]
    rng = random.Random(1)
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 130)} | {200: 200}


def test_numbers_and_offsets(spark):
    df = spark.createDataFrame([(k, "a" if k % 3 else None, k % 7) for k in range(200)], "k long, s string, n long")
    assert [r["i"] for r in dense_numbers(df, "k", "i").orderBy("k").collect()] == list(range(200))
    at = {}
    for r in running_offsets(df, "s", "k", "n", "at", block=16).orderBy("k").collect():
        assert r["at"] == at.get(r["s"], 0)
        at[r["s"]] = r["at"] + r["n"]


def test_stream_indexes_new_files(spark, tmp_path):
    from lettersift.streaming.ingest import append_postings

    for k in range(2):
        spark.createDataFrame([(k, "One two TWO")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
        append_postings(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("token", "msg_id").collect()
    assert sorted(map(tuple, got)) == [("one", 0), ("one", 1), ("two", 0), ("two", 1)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "n_chars"]
