"""Dense numbers in sort order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettersift.session import sql_partitions, stored


def dense_numbers(rows: DataFrame, order: str | list[str], name: str, start: int = 0) -> DataFrame:
    """Adds ``name``: start, start + 1, ... in the order of the column(s).

    Rows are range-partitioned and sorted as they are stored, once; a number is
    the place in its part plus the rows of earlier parts, which are one row each
    to count.
    """
    by = [order] if isinstance(order, str) else order
    cut = rows.repartitionByRange(sql_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    # the part is in the upper 31 bits, the place within it in the lower 33
    cut = stored(cut.withColumn("_id", F.monotonically_increasing_id()))
    cut = cut.select(*rows.columns, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    # a row for each part
    return cut.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_at") + start).cast("long")).drop("_part", "_at", "_start")
