"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettersift.session import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) rows with u > v.

    Large star hangs every neighbour above a node on the node's least
    neighbour; small star does it with the neighbours below.  The least
    neighbour comes from an aggregate with partial sums, never from a
    collected list, so a node with very many neighbours is no single-task
    group: the join after it is split by AQE where its key is skewed.
    """
    if large:
        near = edges.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(
            edges.select(F.col("v").alias("n"), F.col("u").alias("w"))
        )
        least = near.groupBy("n").agg(F.least(F.min("w"), F.col("n")).alias("m"))
        out = near.filter(F.col("w") > F.col("n")).join(least, "n").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        near = edges.select(F.col("u").alias("n"), F.col("v").alias("w"))
        least = near.groupBy("n").agg(F.min("w").alias("m"))
        out = (
            near.join(least, "n")
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
        )
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """Label every node that has an edge with the least node of its component.

    ``edges``: two columns of one orderable type; direction, loops and repeats
    don't matter and rows with a null end are ignored.  Returns (node,
    component).  Rounds are O(log n), also on long chains; each is stored in
    the shared folder, so nothing is computed twice and no lineage grows.
    No edges give no rows; a node whose only edges are loops is its own
    component.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    loops = ends.filter("a = b").select(F.col("a").alias("node")).distinct()
    cur = stored(
        ends.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = None
    while True:
        cur = stored(_star(_star(cur, True), False))
        # a forest of stars is a fixed point: rows and the sum of hashes stay
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    lone = loops.join(leaves.unionByName(roots), "node", "left_anti").select("node", F.col("node").alias("component"))
    return leaves.unionByName(roots).unionByName(lone)
