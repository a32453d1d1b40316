"""Files that arrive, indexed batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lettersift.functions.tokens import word_tokens
from lettersift.operators.index import postings


def stream_postings(rows: DataFrame, id: str, text: str) -> DataFrame:
    """Postings of a stream of texts, repeats within a row removed; stateless, so late rows need no watermark."""
    words = F.explode(F.array_distinct(word_tokens(F.coalesce(F.col(text), F.lit("")))))
    return rows.select(F.lit("body").alias("field"), words.alias("token"), F.col(id).alias("msg_id"))


def append_postings(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, id: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Index new Parquet files below ``source`` into ``target`` and stop when all are done.

    Each micro-batch writes its own folder by batch id, so a batch that runs
    again after a failure replaces itself.  A stream never reports removals: those
    need ``update``.
    """
    rows = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        got = postings(batch, {"body": (text, "word")}, id)
        got.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
