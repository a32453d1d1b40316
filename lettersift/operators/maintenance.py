"""Keeping an index current: incremental update, purge, mailbox revalidation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettersift.operators.index import id_postings, mail_postings
from lettersift.operators.numbering import dense_numbers
from lettersift.operators.threads import threads
from lettersift.schemas import CHECKSUMS, ID_POSTINGS, MBOXES, MESSAGES, POSTINGS
from lettersift.session import stored


@dataclass
class Index:
    messages: DataFrame
    mboxes: DataFrame
    checksums: DataFrame
    postings: DataFrame
    ids: DataFrame


def empty_index(spark: SparkSession) -> Index:
    return Index(*[spark.createDataFrame([], s) for s in (MESSAGES, MBOXES, CHECKSUMS, POSTINGS, ID_POSTINGS)])


def changes(stored_files: DataFrame, found: DataFrame, keys: list[str], fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new, dead): found rows that aren't stored and stored rows that aren't found.

    A row is the same if its keys and mtime are; with ``fast`` the keys suffice.
    """
    on = keys if fast else [*keys, "mtime"]
    return found.join(stored_files.select(*on), on, "left_anti"), stored_files.join(found.select(*on), on, "left_anti")


def first_failures(stored_sums: DataFrame, found_sums: DataFrame, key: str = "path") -> DataFrame:
    """(key, first_bad): the least ordinal of each mailbox whose checksum isn't what was stored.

    All checksums are compared at once; no row for a mailbox whose stored part is
    intact.
    """
    both = stored_sums.select(key, "ordinal", F.col("md5").alias("_old")).join(found_sums.select(key, "ordinal", F.col("md5").alias("_new")), [key, "ordinal"], "left")
    bad = both.filter(~F.col("_old").eqNullSafe(F.col("_new")))
    return bad.groupBy(key).agg(F.min("ordinal").alias("first_bad"))


def update(index: Index, found: DataFrame, read, fast: bool = False) -> Index:
    """Index after the files ``found`` (kind, path, mtime, size); ``read`` turns such rows into PARSED rows.

    Only new and changed files are read.  Rows of vanished messages die; ids are
    only appended; threads are computed again only if something was added.  The
    postings are a plan over what was stored and read; who needs them writes them.
    """
    messages = index.messages
    files = found.filter("kind in ('FILE', 'IMAP')").withColumnRenamed("kind", "type")
    live = messages.filter("type in ('FILE', 'IMAP')")
    new_files, dead_files = changes(live, files, ["type", "path"], fast)
    boxes = found.filter("kind = 'MBOX'")
    touched = boxes.join(index.mboxes.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")
    todo = new_files.select(F.col("type").alias("kind"), "path", "mtime", "size").unionByName(touched.select("kind", "path", "mtime", "size"))
    parsed = stored(read(todo))
    sums = index.checksums.join(index.mboxes.select("mbox_id", "path"), "mbox_id")
    box_rows = parsed.filter("type = 'MBOX'")
    bad = first_failures(sums.join(touched.select("path"), "path", "left_semi"), box_rows)
    lost = index.mboxes.filter("path is not null").join(boxes.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("first_bad"))
    bad = stored(bad.unionByName(lost))
    dying = (
        dead_files.select("msg_id")
        .unionByName(messages.filter("type = 'MBOX'").join(bad, "path").filter("ordinal >= first_bad").select("msg_id"))
        .withColumn("_dead", F.lit(True))
    )
    kept = stored(
        messages.join(dying, "msg_id", "left")
        .withColumn("type", F.when(F.col("_dead"), F.lit("DEAD")).otherwise(F.col("type")))
        .select(*MESSAGES.names)
    )
    # what of the read mailboxes is stored and sound
    sound = kept.filter("type = 'MBOX'").select("path", "ordinal")
    fresh = parsed.filter("type in ('FILE', 'IMAP')").unionByName(box_rows.join(sound, ["path", "ordinal"], "left_anti"))
    old_ids = index.mboxes.agg(F.coalesce(F.max("mbox_id"), F.lit(-1))).first()[0]
    unknown = boxes.select("path").join(index.mboxes.select("path"), "path", "left_anti")
    names = index.mboxes.select("mbox_id", "path").unionByName(dense_numbers(unknown, "path", "mbox_id", old_ids + 1).select("mbox_id", "path"))
    names = stored(names)
    start = kept.agg(F.coalesce(F.max("msg_id"), F.lit(-1))).first()[0] + 1
    fresh = dense_numbers(fresh.drop("tid"), ["type", "path", "ordinal"], "msg_id", start)
    outer = F.col("headers")[0]
    flag = lambda n: F.coalesce(outer[n], F.lit(False)).alias(n)
    added = fresh.join(names, "path", "left").select(
        "msg_id", "type", "path", F.when(F.col("type") == "MBOX", F.col("mbox_id")).alias("mbox_id"), "ordinal", "mtime", "offset", "size",
        F.coalesce(outer["date"], F.lit(0)).alias("date"), F.lit(None).cast("long").alias("tid"), flag("seen"), flag("replied"), flag("flagged"),
    )
    rows = kept.unionByName(added)
    posts = index.postings.unionByName(mail_postings(fresh))
    ids = index.ids.unionByName(stored(id_postings(fresh)))
    if not added.isEmpty():
        rows = rows.drop("tid").join(threads(ids, rows), "msg_id", "left").select(*MESSAGES.names)
    rows = stored(rows)
    new_sums = box_rows.join(names, "path").select("mbox_id", "ordinal", "md5")
    held_sums = index.checksums.join(touched.join(names, "path").select("mbox_id"), "mbox_id", "left_anti")
    counts = rows.filter("type = 'MBOX'").groupBy("path").agg(F.count("*").alias("n_msgs"))
    mboxes = (
        names.join(boxes.select("path", "mtime", "size"), "path", "left").join(counts, "path", "left")
        .select("mbox_id", F.when(F.col("size").isNotNull(), F.col("path")).alias("path"), F.coalesce("n_msgs", F.lit(0)).cast("long").alias("n_msgs"), "mtime", "size")
    )
    return Index(rows, stored(mboxes), stored(held_sums.unionByName(new_sums)), posts, ids)


def purge(index: Index) -> Index:
    """Dead rows and mailboxes go and ids close up; threads keep their numbers.  Postings and ids are plans, as in ``update``."""
    alive = index.messages.filter("type <> 'DEAD'")
    numbered = stored(dense_numbers(alive.withColumnRenamed("msg_id", "_old"), "_old", "msg_id"))
    move = numbered.select(F.col("_old").alias("msg_id"), F.col("msg_id").alias("_new"))
    moved = lambda t: t.join(move, "msg_id").withColumn("msg_id", F.col("_new")).select(*t.columns)
    mboxes = index.mboxes.filter("path is not null")
    return Index(
        numbered.select(*MESSAGES.names), mboxes, index.checksums.join(mboxes.select("mbox_id"), "mbox_id", "left_semi"),
        moved(index.postings), moved(index.ids),
    )
