"""Threads: components of messages that share an id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettersift.operators.components import connected_components
from lettersift.operators.numbering import dense_numbers


def thread_roots(ids: DataFrame, messages: DataFrame) -> DataFrame:
    """(msg_id, root): the least message id that shared ids lead to.

    ``ids``: (token, msg_id).  A token hangs its messages on the least one, which
    links them all without pairs, however usual it is.
    """
    least = ids.groupBy("token").agg(F.min("msg_id").alias("_least"), F.count("*").alias("_n")).filter("_n > 1")
    edges = ids.join(least, "token").select(F.col("msg_id").alias("u"), F.col("_least").alias("v"))
    roots = connected_components(edges).withColumnRenamed("node", "msg_id")
    return messages.select("msg_id").join(roots, "msg_id", "left").select("msg_id", F.coalesce("component", "msg_id").alias("root"))


def threads(ids: DataFrame, messages: DataFrame) -> DataFrame:
    """(msg_id, tid): threads numbered from 0 in order of their least message."""
    roots = thread_roots(ids, messages)
    tids = dense_numbers(roots.select("root").distinct(), "root", "tid")
    return roots.join(tids, "root").select("msg_id", "tid")
