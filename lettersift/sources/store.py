"""An index as a folder of Parquet snapshots with one atomic pointer to the current one."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

from lettersift.operators.maintenance import Index
from lettersift.schemas import CHECKSUMS, FORMAT_VERSION, ID_POSTINGS, MBOXES, MESSAGES, POSTINGS
from lettersift.session import sql_partitions

_TABLES = {"messages": MESSAGES, "mboxes": MBOXES, "checksums": CHECKSUMS, "postings": POSTINGS, "ids": ID_POSTINGS}


class NoIndex(FileNotFoundError):
    """There is no index there, or one of another format (exit code 3)."""


class Locked(RuntimeError):
    """Another writer holds the index."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


@contextmanager
def lock(spark: SparkSession, path: str):
    """The writer's lock file beside the index; creating it is atomic."""
    fs, P = _fs(spark, path)
    if not fs.createNewFile(P(f"{path}.lock")):
        raise Locked(path)
    try:
        yield
    finally:
        fs.delete(P(f"{path}.lock"), False)


def unlock(spark: SparkSession, path: str) -> bool:
    fs, P = _fs(spark, path)
    return fs.delete(P(f"{path}.lock"), False)


def write_index(spark: SparkSession, index: Index, path: str) -> str:
    """Write a new snapshot, then swing the pointer by a rename over it; readers see the old one or the new one.

    Postings are ranged by field and token, so that a word prunes to few row
    groups.  The snapshot before stays for those who read it; older ones go.
    """
    name = f"snapshot-{uuid.uuid4().hex}"
    for t in _TABLES:
        df = getattr(index, t)
        if t == "postings":
            # by message too: a usual token is many parts
            df = df.repartitionByRange(sql_partitions(spark), "field", "token", "msg_id").sortWithinPartitions("field", "token", "msg_id")
        df.write.parquet(f"{path}/{name}/{t}")
    fs, P = _fs(spark, path)
    fresh = P(f"{path}/next-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps({"version": FORMAT_VERSION, "snapshot": name}).encode()))
    out.close()
    current = P(f"{path}/CURRENT")
    before = _head(spark, path)["snapshot"] if fs.exists(current) else None
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    mode = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(mode, 1)
    how[0] = mode.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), fs.makeQualified(current), how)
    for s in fs.listStatus(P(path)):
        old = s.getPath().getName()
        if old.startswith("snapshot-") and old not in (name, before):
            fs.delete(s.getPath(), True)
    return name


def _head(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/CURRENT").collect()))  # one line


def read_index(spark: SparkSession, path: str) -> Index:
    fs, P = _fs(spark, path)
    if not fs.exists(P(f"{path}/CURRENT")):
        raise NoIndex(path)
    head = _head(spark, path)
    if head.get("version") != FORMAT_VERSION:
        raise NoIndex(f"{path} has format {head.get('version')}; rebuild it")
    return Index(**{t: spark.read.schema(s).parquet(f"{path}/{head['snapshot']}/{t}") for t, s in _TABLES.items()})
