"""What several operators share: map-side Arrow scans and joins that stand hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lettersift.llm import textkit as K
from lettersift.session import sql_partitions


def map_texts(
    df: DataFrame, text: str, schema: str, fn: Callable[[pa.RecordBatch, pa.Array], dict[str, object]], carry: list[str]
) -> DataFrame:
    """Scan ``df`` once, chunk by chunk, without a shuffle.

    ``fn(rows, texts)`` gets a slice of the rows and its text column and
    returns the new columns; ``carry`` names the columns that pass through.
    """
    wanted = list(dict.fromkeys([*carry, text]))
    source = df.select(*[F.col(f"`{c}`") for c in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(wanted.index(text))
            for i, j in K.chunks(column):
                rows = batch.slice(i, j - i)
                new = fn(rows, column.slice(i, j - i))
                cols = {c: rows.column(wanted.index(c)) for c in carry}
                arrays = [v if isinstance(v, pa.Array) else pa.array(v) for v in (cols | new).values()]
                yield pa.RecordBatch.from_arrays(arrays, names=list(cols | new))

    kinds = {f.name: f.dataType for f in source.schema}
    return source.mapInArrow(run, StructType([StructField(c, kinds[c]) for c in carry] + StructType.fromDDL(schema).fields))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "left") -> DataFrame:
    """Join thin rows to a table of one row per key, nulls equal, hot keys split.

    Each key of ``small`` is repeated for as many salts as there are shuffle
    partitions and ``spread`` deals the rows of ``big`` over them, so that a key
    with a third of all rows is the work of many tasks.  Where ``small`` turns
    out tiny at run time, AQE broadcasts it instead.
    """
    salts = sql_partitions(big.sparkSession)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cond = left["_salt"] == right["_salt"]
    for k in keys:
        cond &= left[k].eqNullSafe(right[k])
    out = left.join(right, cond, how)
    return out.select(*[left[c] for c in big.columns], *[right[c] for c in small.columns if c not in keys])


def held_out(doc_id: str, mod: int, rest: int) -> Column:
    """crc32(doc_id as text) mod ``mod`` is ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))
