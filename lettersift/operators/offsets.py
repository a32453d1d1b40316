"""Running sums by key that stand hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_offsets(rows: DataFrame, key: str, order: str, size: str, name: str, block: int = 1 << 16) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the key's rows before this one in a whole-number order.

    Sums run within blocks of the order; the sums of earlier blocks are added
    from a table of one row per block, so a key of many rows is many groups.
    """
    cut = rows.withColumn("_b", F.floor(F.col(order) / block))
    ahead = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(key, "_b").agg(F.sum(size).alias("_s")).withColumn("_start", F.coalesce(F.sum("_s").over(ahead), F.lit(0)))
    before = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    part = cut.withColumn("_at", F.coalesce(F.sum(size).over(before), F.lit(0)))
    cond = part[key].eqNullSafe(starts[key]) & (part["_b"] == starts["_b"])
    return part.join(starts, cond).select(*[part[c] for c in rows.columns], (part["_at"] + starts["_start"]).alias(name))
