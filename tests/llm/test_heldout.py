"""Learned operators on the fold that they don't learn from."""

import os

import pytest
from pyspark.sql import functions as F

from lettersift.llm import gam, langid, toxicity
from lettersift.llm.labelled import auc

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no tables")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_language(tables):
    docs, _ = tables
    got = langid.language_id(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.99


def test_quality(tables):
    docs, labels = tables
    x = gam.quality(docs, labels).filter("held_out").join(labels, "doc_id").toPandas()
    assert auc(x["score"].to_numpy(), x["quality"].to_numpy()) > 0.97


def test_toxicity(tables):
    """Some 37 toxic examples are all there is to learn from here."""
    docs, labels = tables
    x = toxicity.toxicity(docs, labels).filter("held_out").join(labels, "doc_id").toPandas()
    assert auc(x["score"].to_numpy(), x["toxic"].to_numpy()) > 0.75
