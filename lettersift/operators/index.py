"""Building, dumping and measuring the inverted index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettersift.functions.tokens import KINDS, address_tokens, fold, html_tokens, id_tokens, word_tokens
from lettersift.operators import words
from lettersift.session import sql_partitions, stored

#: message ids of one posting list row; a hot token has many rows
BLOCK = 1 << 16
#: messages of a part in which the postings' rules are checked
PART_MESSAGES = 2000


def distinct_by_id(post: Callable[[DataFrame], DataFrame], rows: DataFrame, id: str) -> DataFrame:
    """``post`` of the rows without repeats, where it has none for one row.

    Only what rows of a repeated or null id give is compared, so that others are
    never moved; the ids alone are counted ahead.
    """
    once, again = by_repeats(rows, id)
    return post(once) if again is None else post(once).unionByName(post(again).distinct())


def by_repeats(rows: DataFrame, id: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id no other has, and those of a repeated or null id, if any."""
    again = rows.groupBy(F.col(id).alias("_again")).agg(F.count("*").alias("_n")).filter("_n > 1 or _again is null").select("_again")
    if again.isEmpty():
        return rows, None
    again = stored(again)
    same = rows[id].eqNullSafe(again["_again"])
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def postings(rows: DataFrame, fields: dict[str, tuple[str, str]], id: str = "msg_id", distinct: bool = True) -> DataFrame:
    """Distinct (field, token, msg_id).  ``fields``: field -> (column, kind of KINDS).

    One scan whatever the number of fields; duplicates within a row never leave
    it.  Without ``distinct`` rows of one id may repeat each other's, which a
    search doesn't mind.
    """
    if distinct:
        return distinct_by_id(lambda some: postings(some, fields, id, False), rows, id)
    cut = {f: F.array_distinct(KINDS[k](F.coalesce(F.col(c), F.lit("")) if k != "name" else F.col(c))) for f, (c, k) in fields.items()}
    if len(cut) == 1:
        # no list of tokens stays beside each of them, for filters in Python hold whole rows
        [(f, tokens)] = cut.items()
        return rows.select(F.lit(f).alias("field"), F.explode(tokens).alias("token"), F.col(id).alias("msg_id"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), tokens.alias("tokens")) for f, tokens in cut.items()])
    return rows.select(F.col(id).alias("msg_id"), F.explode(each).alias("f")).select("f.field", F.explode("f.tokens").alias("token"), "msg_id")


def mail_postings(parsed: DataFrame, id: str = "msg_id") -> DataFrame:
    """Postings of parsed mail: headers and parts of embedded messages count for the outer one.

    One pass over the messages; repeats within one never leave it.  An id that
    several rows have is for the caller to tell, see ``distinct_by_id``.
    """
    none = F.array().cast("array<string>")
    text = lambda c: F.coalesce(c, F.lit(""))

    def field(name: str, rows: str, tokens: Callable[[Column], Column]) -> Column:
        each = F.flatten(F.transform(rows, lambda x: F.coalesce(tokens(x), none)))
        return F.struct(F.lit(name).alias("field"), F.array_distinct(each).alias("tokens"))

    def body(p: Column) -> Column:
        return F.when(p["ctype"] == "text/html", html_tokens(text(p["body"]))).when(p["ctype"].startswith("text"), word_tokens(text(p["body"])))

    fields = [field(f, "headers", lambda h, f=f: address_tokens(text(h[f]))) for f in ("to", "cc", "from")]
    fields.append(field("subject", "headers", lambda h: word_tokens(text(h["subject"]))))
    fields.append(field("body", "parts", body))
    fields.append(field("attachment_name", "parts", lambda p: F.when(p["filename"].isNotNull(), F.array(fold(p["filename"])))))
    rows = parsed.select(F.col(id).alias("msg_id"), F.explode(F.array(*fields)).alias("f"))
    return rows.select("f.field", F.explode("f.tokens").alias("token"), "msg_id")


def id_postings(parsed: DataFrame, id: str = "msg_id") -> DataFrame:
    """(token, msg_id, is_own): ids in Message-ID, In-Reply-To and References; own ones from Message-ID."""
    h = parsed.select(F.col(id).alias("msg_id"), F.explode("headers").alias("h")).select("msg_id", "h.*")
    each = F.array(
        *[F.struct(id_tokens(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias("tokens"), F.lit(c == "message_id").alias("own")) for c in ("message_id", "in_reply_to", "references")]
    )
    return (
        h.select("msg_id", F.explode(each).alias("e"))
        .select("msg_id", F.explode("e.tokens").alias("token"), "e.own")
        .groupBy("token", "msg_id")
        .agg(F.max("own").alias("is_own"))
    )


def posting_lists(rows: DataFrame, field: str, text: str, id: str = "msg_id", block: int = BLOCK) -> DataFrame:
    """Ascending message ids of each word of a text, a row for each ``block`` of ids, so that no list is without bound."""
    return words.lists(rows, text, id, block).select(F.lit(field).alias("field"), "token", "block", "msg_ids")


def _steps(post: DataFrame, block: int = BLOCK) -> DataFrame:
    """(field, token, _b, msg_id, _gap): differences within blocks of ids, null for a block's first one.

    A token of very many messages is many window groups.
    """
    rows = post.withColumn("_b", F.floor(F.col("msg_id") / block))
    prev = F.lag("msg_id").over(Window.partitionBy("field", "token", "_b").orderBy("msg_id"))
    return rows.select("field", "token", "_b", "msg_id", (F.col("msg_id") - prev).alias("_gap"))


def _lists(steps: DataFrame) -> DataFrame:
    """(field, token, n_msgs, n_bytes, _gap): a row for each block of a token's list, with the difference that leads to it.

    Only these rows are compared across blocks.
    """
    inner = F.coalesce(F.sum(F.when(F.col("_gap").isNotNull(), gap_bytes(F.col("_gap")))), F.lit(0))
    rows = steps.groupBy("field", "token", "_b").agg(F.min("msg_id").alias("_first"), F.max("msg_id").alias("_last"), F.count("*").alias("n_msgs"), inner.alias("_inner"))
    before = F.lag("_last").over(Window.partitionBy("field", "token").orderBy("_b"))
    rows = rows.withColumn("_gap", F.col("_first") - F.coalesce(before, F.lit(0)))
    return rows.select("field", "token", "n_msgs", (F.col("_inner") + gap_bytes(F.col("_gap"))).alias("n_bytes"), "_gap")


def gap_bytes(gap: Column) -> Column:
    return F.when(gap <= 127, 1).when(gap <= 16383, 2).otherwise(4).cast("long")


def posting_bytes(post: DataFrame) -> DataFrame:
    """Bytes of each token's list as variable-length differences."""
    return _lists(_steps(post)).groupBy("field", "token").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_msgs").alias("n_msgs"))


def frequencies(rows: DataFrame, field: str, text: str, id: str = "msg_id") -> DataFrame:
    """Messages of each word of a text; only words that chunks have counted are moved, and lists of repeated ids."""
    once, again = by_repeats(rows, id)
    counts = words.counts(once, text)
    if again is not None:
        n = F.when(F.col("block").isNull(), 1).otherwise(F.size("msg_ids")).cast("long")
        counts = counts.unionByName(words.lists(again, text, id, BLOCK).select("token", n.alias("n")))
    return counts.groupBy(F.lit(field).alias("field"), "token").agg(F.sum("n").alias("n_msgs"))


def _shares(counts: DataFrame) -> DataFrame:
    """Adds ``share_256`` to (measure, value, n): 256ths of the measure's total up to the value.

    Values are range-partitioned, and a part's sum is one row, so no window runs
    over all values.
    """
    parts = sql_partitions(counts.sparkSession)
    cut = stored(counts.repartitionByRange(parts, "measure", "value").withColumn("_part", F.spark_partition_id()))
    sums = cut.groupBy("measure", "_part").agg(F.sum("n").alias("_s"))
    ahead = Window.partitionBy("measure").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("measure", "_part", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_start"), F.sum("_s").over(Window.partitionBy("measure")).alias("_total"))
    upto = F.sum("n").over(Window.partitionBy("measure", "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    # a row for each measure and part
    got = cut.withColumn("_upto", upto).join(F.broadcast(sums), ["measure", "_part"])
    return got.select("measure", "value", "n", F.floor(256 * (F.col("_start") + F.col("_upto")) / F.col("_total")).alias("share_256"))


def statistics(post: DataFrame) -> DataFrame:
    """Histograms of token length, list bytes and differences, with cumulative 256ths.

    The postings are moved once; what they give is stored and counted from there.
    """
    steps = stored(_steps(post))
    lists = stored(_lists(steps))
    per = lists.groupBy("field", "token").agg(F.sum("n_bytes").alias("n_bytes"))
    two = F.array(F.struct(F.lit("token_length").alias("measure"), F.octet_length("token").cast("long").alias("value")), F.struct(F.lit("list_bytes").alias("measure"), F.col("n_bytes").alias("value")))
    values = per.select(F.explode(two).alias("v")).select("v.*").withColumn("n", F.lit(1).cast("long"))
    inner = steps.filter("_gap is not null").groupBy(F.col("_gap").alias("value")).agg(F.count("*").alias("n"))
    across = lists.groupBy(F.col("_gap").alias("value")).agg(F.count("*").alias("n"))
    gap = inner.unionByName(across).select(F.lit("gap").alias("measure"), "value", "n")
    return _shares(values.unionByName(gap).groupBy("measure", "value").agg(F.sum("n").alias("n")))


def mbox_counts(messages: DataFrame) -> DataFrame:
    """Live messages of each mailbox file."""
    return messages.filter(F.col("type") == "MBOX").groupBy("mbox_id").agg(F.count("*").alias("n_msgs"))


def locator(messages: DataFrame) -> Column:
    """``path``, or ``mbox:<path> [start,end)`` for a message inside a mailbox file."""
    inside = F.format_string("mbox:%s [%d,%d)", F.col("path"), F.col("offset"), F.col("offset") + F.col("size"))
    return F.when(F.col("type") == "MBOX", inside).otherwise(F.col("path"))


def dump(messages: DataFrame, post: DataFrame) -> DataFrame:
    """The index as ordered rows (table, key, msg_id)."""
    rows = messages.select(F.lit("message").alias("table"), locator(messages).alias("key"), "msg_id")
    return rows.unionByName(post.select(F.col("field").alias("table"), F.col("token").alias("key"), "msg_id")).orderBy("table", "key", "msg_id")


def violations(messages: DataFrame, post: DataFrame) -> DataFrame:
    """Broken rules: repeated live paths, repeated postings, postings without a message."""
    live = messages.filter((F.col("type") != "DEAD") & (F.col("type") != "MBOX"))
    paths = live.groupBy("type", "path").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate path").alias("rule"), F.col("path").alias("subject"), "n")
    known = messages.select("msg_id").distinct().withColumn("_known", F.lit(True))
    # by message, in parts of as many messages whatever their number: both rules need no other move, and no part grows with the table
    parts = max(sql_partitions(post.sparkSession), messages.count() // PART_MESSAGES)
    each = post.repartition(parts, "msg_id").groupBy("msg_id", "field", "token").agg(F.count("*").alias("n"))
    each = stored(each.join(known.repartition(parts, "msg_id").hint("shuffle_hash"), "msg_id", "left").filter("n > 1 or _known is null"))
    twice = each.filter("n > 1").select(F.lit("duplicate posting").alias("rule"), F.col("token").alias("subject"), "n")
    lost = each.filter("_known is null").groupBy("token").agg(F.sum("n").alias("n")).select(F.lit("unknown message").alias("rule"), F.col("token").alias("subject"), "n")
    return paths.unionByName(twice).unionByName(lost)


def top_tokens(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` tokens in most messages, of ``frequencies``: a top-k report."""
    return counts.orderBy(F.desc("n_msgs"), "field", "token").limit(n)
