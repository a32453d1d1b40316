"""From raw documents to a clean, deduplicated, decontaminated, mixed and sharded corpus."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettersift.llm.common import held_out, map_texts
from lettersift.llm.decontam import contamination
from lettersift.llm.gam import THRESHOLD, score_texts, train
from lettersift.llm.mixing import mix_rows
from lettersift.llm.sharding import shard
from lettersift.llm.simhash import fingerprints, near_groups
from lettersift.session import shared_dir, stored

#: bytes of text of a shard
SHARD_BYTES = 64 << 20

#: the classifier, the fingerprints and the cube method are not expressible in SQL
ORACLE_SQL = None


def _named(docs: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``docs`` has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def _placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells every row from all others, and its name: the row's file and place in it.

    Stages find rows again by it, equal ones too.  It is the same on every
    attempt and layout of tasks, as the files stay.  A table that isn't read
    from files is written first.
    """
    (name,) = _named(docs, "__row")
    try:
        at = docs.metadataColumn("_metadata")
        return docs.select("*", F.struct(F.xxhash64(at["file_path"]).alias("f"), at["row_index"].alias("r")).alias(name)), name
    except AnalysisException:
        return _placed(stored(docs))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    It learns from labelled documents outside op5's held-out fold.  Null and
    empty texts are scored like others; repeated rows share their fate; an
    empty table gives no rows.  All columns are kept, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, keep=~held_out("doc_id", 3, 1))
    rows = docs.select(F.struct(*_columns(docs)).alias("__row"), F.col("text").alias("__text"))
    scored = map_texts(rows, "__text", "__score double", lambda _, t: {"__score": score_texts(model, t)}, ["__row"])
    return scored.filter(F.col("__score") >= THRESHOLD).select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the least id.

    A row without an id stays only where its group has none with one.  Of equal
    ids the least by text hash and place stays, so of repeated rows one does.
    Null and empty texts are one group.  An empty table gives no rows; all
    columns are kept, whatever their names.
    """
    rows, row = _placed(docs)
    least = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.xxhash64("text").alias("c"), F.col(row).alias("d"))
    prints = stored(fingerprints(rows.select(least.alias("__id"), F.col("text").alias("__text")), ["__id"], "__text"))
    keep = near_groups(prints, "__id").select(F.col("component_id.d").alias(row)).distinct()
    return rows.join(keep, row, "left_semi").select(*_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark phrase; those without words stay.

    Repeated rows share their fate; an empty table gives no rows; all columns
    are kept, whatever their names.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, row = _placed(docs)
    found, _ = contamination(rows, benchmark, id=row, slack=0)
    bad = stored(found.filter("n_hit > 0").select(row))
    return rows.join(bad, row, "left_anti").select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: no, one or several rows.

    Null and empty texts have no words and are drawn like others; repeated rows
    are documents of their own; the null source comes last; an empty table
    gives no rows; all columns are kept, whatever their names.
    """
    rows, row = _placed(docs)
    copies, nth = _named(rows, "__copies", "__nth")
    taken = mix_rows(rows, row).filter("copies > 0").withColumnRenamed("copies", copies)
    again = rows.join(taken, row).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return again.select(*_columns(docs))


def shard_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot; shards hold about SHARD_BYTES.

    Null texts have size 1; repeated rows get slots of their own; an empty
    table gives no rows.  Columns called shard or slot, in any case, are
    replaced; the others are kept, whatever their names.
    """
    rows, row = _placed(docs)
    place = shard(rows, target_bytes=SHARD_BYTES, carry=(row,)).select(row, F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    names = _named(rows, "__shard", "__slot")
    both = rows.join(place.toDF(row, *names), row)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return both.select(*kept, F.col(names[0]).alias("shard"), F.col(names[1]).alias("slot"))


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
    ("shard", shard_corpus),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared_dir(spark)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
