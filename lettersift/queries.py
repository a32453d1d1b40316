"""Registered queries of the mail engine over the driver's tables, each table read as mail of some shape."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettersift.functions.tokens import address_tokens, fold, html_tokens
from lettersift.operators import index as I
from lettersift.operators.maintenance import changes, empty_index, first_failures, purge
from lettersift.operators.numbering import dense_numbers
from lettersift.operators.offsets import running_offsets
from lettersift.operators.threads import thread_roots, threads
from lettersift.plans.query import search
from lettersift.sources.folders import glob_regex

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = "regexp_extract_all(" + _FOLD + r", '[0-9a-z_\x{{80}}-\x{{10FFFF}}]+')"
_DOC_TOKENS = _TOKENS.format("coalesce(text, '')")
_POST = f"(select distinct doc_id as msg_id, unnest({_DOC_TOKENS}) as token from documents)"
_HITS = "(select doc_id, list_distinct(" + _DOC_TOKENS + ") as w, n_chars from documents)"


def query(name: str, sql: str | None = None):
    def keep(f):
        _ALL[name] = (f, sql)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("msg_id"), F.lit("FILE").alias("type"), F.concat_ws("/", "source", "doc_id").alias("path"), F.col("n_chars").alias("size")
    )


def doc_postings(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    return I.postings(table(spark, sf_dir, "documents"), {"body": ("text", "word")}, "doc_id", distinct)


def _found(spark: SparkSession, sf_dir: str, *args: str) -> DataFrame:
    got = search(doc_messages(spark, sf_dir), doc_postings(spark, sf_dir, False), list(args))
    return got.select(F.col("msg_id").alias("doc_id"), F.col("size").alias("n_chars"))


@query("agg_postings", f"select 'body' as field, token, msg_id from {_POST}")
def agg_postings(spark, sf_dir):
    return doc_postings(spark, sf_dir)


@query("agg_document_frequency", f"select 'body' as field, token, count(*) as n_msgs from {_POST} group by token")
def agg_document_frequency(spark, sf_dir):
    return I.frequencies(table(spark, sf_dir, "documents"), "body", "text", "doc_id")


_GAPS = f"(select token, msg_id, msg_id - coalesce(lag(msg_id) over (partition by token order by msg_id), 0) as gap from {_POST})"
_SIZED = f"(select token, sum(case when gap <= 127 then 1 when gap <= 16383 then 2 else 4 end) as n_bytes, count(*) as n_msgs from {_GAPS} group by token)"


@query("agg_posting_bytes", f"select 'body' as field, token, cast(n_bytes as bigint) as n_bytes, n_msgs from {_SIZED}")
def agg_posting_bytes(spark, sf_dir):
    return I.posting_bytes(doc_postings(spark, sf_dir))


@query(
    "agg_statistics",
    f"""with v as (select 'token_length' as measure, strlen(token) as value from {_SIZED} union all select 'list_bytes', n_bytes from {_SIZED}
        union all select 'gap', gap from {_GAPS}), h as (select measure, cast(value as bigint) as value, count(*) as n from v group by all)
        select measure, value, n, cast(floor(256 * sum(n) over (partition by measure order by value) / sum(n) over (partition by measure)) as bigint) as share_256 from h""",
)
def agg_statistics(spark, sf_dir):
    return I.statistics(doc_postings(spark, sf_dir))


@query("agg_posting_lists", f"select 'body' as field, token, msg_id // 65536 as block, array_to_string(list(msg_id order by msg_id), ',') as msg_ids from {_POST} group by token, msg_id // 65536")
def agg_posting_lists(spark, sf_dir):
    got = I.posting_lists(table(spark, sf_dir, "documents"), "body", "text", "doc_id")
    return got.withColumn("msg_ids", F.when(F.col("block").isNotNull(), F.array_join(F.col("msg_ids").cast("array<string>"), ",")))


@query("agg_mbox_counts", "select source, count(*) as n_msgs from documents group by source")
def agg_mbox_counts(spark, sf_dir):
    boxes = table(spark, sf_dir, "documents").select(F.lit("MBOX").alias("type"), F.col("source").alias("mbox_id"))
    return I.mbox_counts(boxes).withColumnRenamed("mbox_id", "source")


@query("agg_matched", f"select count(*) as matched from {_HITS} where list_contains(w, 'the')")
def agg_matched(spark, sf_dir):
    return _found(spark, sf_dir, "b:the").agg(F.count("*").alias("matched"))


@query("tok_html", "select page_id, count(*) as n_tokens, min(token) as first_token, max(token) as last_token from (select distinct page_id, unnest(" + _TOKENS.format("regexp_replace(html, '<[^>]*>?', ' ', 'g')") + ") as token from pages) group by page_id")
def tok_html(spark, sf_dir):
    t = F.explode(html_tokens(F.col("html"))).alias("token")
    got = table(spark, sf_dir, "pages").select("page_id", t).distinct()
    return got.groupBy("page_id").agg(F.count("*").alias("n_tokens"), F.min("token").alias("first_token"), F.max("token").alias("last_token"))


_ADDRESS = "regexp_extract_all(" + _FOLD + r", '[0-9a-z_+\-.@\x{{80}}-\x{{10FFFF}}]+')"


@query("tok_address", f"select distinct page_id, unnest(list_concat({_TOKENS.format('url')}, {_ADDRESS.format('url')})) as token from pages")
def tok_address(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(address_tokens(F.col("url"))).alias("token")).distinct()


@query("tok_names", "select " + _FOLD.format("url") + " as token, count(*) as n_msgs from pages group by 1")
def tok_names(spark, sf_dir):
    got = I.postings(table(spark, sf_dir, "pages"), {"attachment_name": ("url", "name")}, "page_id")
    return got.groupBy("token").agg(F.count("*").alias("n_msgs"))


@query("flt_exact", f"select doc_id, n_chars from {_HITS} where list_contains(w, 'the')")
def flt_exact(spark, sf_dir):
    return _found(spark, sf_dir, "THE")


@query("flt_substring", f"select doc_id, n_chars from {_HITS} where len(list_filter(w, lambda x: contains(x, 'ation'))) > 0")
def flt_substring(spark, sf_dir):
    return _found(spark, sf_dir, "b:ation=")


@query("flt_anchored", f"select doc_id, n_chars from {_HITS} where len(list_filter(w, lambda x: starts_with(x, 'ung'))) > 0")
def flt_anchored(spark, sf_dir):
    return _found(spark, sf_dir, "b:^ung=")


_NEAR = "list_bool_or(flatten(list_transform(range(1, length(token) + 1), lambda s: list_transform(range(4, 7), lambda m: levenshtein(substring(token, s, m), 'stand') <= 1))))"


@query(
    "flt_fuzzy",
    f"with p as materialized {_POST}, t as (select distinct token from p where length(token) >= 4), m as (select token from t where {_NEAR}) "
    "select doc_id, n_chars from documents where doc_id in (select msg_id from p where token in (select token from m))",
)
def flt_fuzzy(spark, sf_dir):
    return _found(spark, sf_dir, "b:stand=1")


@query("flt_fuzzy_anchored")
def flt_fuzzy_anchored(spark, sf_dir):
    return _found(spark, sf_dir, "b:^pathetic=2")


@query("flt_path", "select page_id, url from pages where contains(url, 'example.org')")
def flt_path(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("msg_id"), F.lit("FILE").alias("type"), F.col("url").alias("path"))
    got = search(pages, doc_postings(spark, sf_dir, False), ["p:example.org"])
    return got.select(F.col("msg_id").alias("page_id"), F.col("path").alias("url"))


@query("flt_own_id", "select conv_id, turn from conversations where conv_id || '.' || turn = '3.1'")
def flt_own_id(spark, sf_dir):
    ids = conversation_ids(spark, sf_dir)
    got = search(conversation_messages(spark, sf_dir), doc_postings(spark, sf_dir, False), ["m:3.1"], ids)
    return got.select("conv_id", "turn")


@query("flt_size", "select doc_id, n_chars from documents where n_chars > 500 and n_chars < 2048")
def flt_size(spark, sf_dir):
    return _found(spark, sf_dir, "z:2k-500")


@query("flt_date_period", "select o_orderkey from orders where epoch(o_orderdate) > epoch(timestamp '1996-03-31 23:59:59') and epoch(o_orderdate) < epoch(timestamp '1998-06-30 23:59:59')")
def flt_date_period(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("msg_id"), F.unix_timestamp(F.col("o_orderdate")).alias("date"))
    got = search(rows, doc_postings(spark, sf_dir, False), ["d:31mar96-jun98"], now=datetime(2003, 5, 18, 12, tzinfo=timezone.utc))
    return got.select(F.col("msg_id").alias("o_orderkey"))


@query("flt_date_relative", "select event_id from events where epoch(ts) >= epoch(timestamp '2024-01-18 12:00:00') + 1")
def flt_date_relative(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("msg_id"), F.unix_timestamp(F.col("ts")).alias("date"))
    got = search(rows, doc_postings(spark, sf_dir, False), ["d:2w-"], now=datetime(2024, 2, 1, 12, tzinfo=timezone.utc))
    return got.select(F.col("msg_id").alias("event_id"))


@query("flt_flags", "select d.doc_id from documents d left join labels l using (doc_id) where coalesce(l.quality = 1, false) and not coalesce(l.toxic = 1, false)")
def flt_flags(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(marks, "doc_id", "left")
    rows = rows.select(F.col("doc_id").alias("msg_id"), F.coalesce(F.col("q") == 1, F.lit(False)).alias("seen"), F.coalesce(F.col("t") == 1, F.lit(False)).alias("flagged"))
    return search(rows, doc_postings(spark, sf_dir, False), ["F:s-f"]).select(F.col("msg_id").alias("doc_id"))


@query("set_boolean", f"select doc_id, n_chars from {_HITS} where ((list_contains(w, 'the') and list_contains(w, 'was')) or list_contains(w, 'der')) and not list_contains(w, 'with') and n_chars > 200")
def set_boolean(spark, sf_dir):
    return _found(spark, sf_dir, "b:the,was/der", "bs:~with", "z:200-")


@query("set_fields", f"select doc_id, n_chars from {_HITS} where list_contains(w, 'licensed') or len(list_filter(w, lambda x: contains(x, 'apach'))) > 0")
def set_fields(spark, sf_dir):
    return _found(spark, sf_dir, "Licensed /apach=")


@query("set_everything", "select doc_id, n_chars from documents")
def set_everything(spark, sf_dir):
    return _found(spark, sf_dir, "b:nosuchword/")


def conversation_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    # a dense place would do; the pair itself orders as well
    return rows.withColumn("msg_id", F.col("conv_id") * 1_000_000 + F.col("turn")).withColumn("type", F.lit("FILE"))


def conversation_ids(spark, sf_dir):
    """Each turn has an id of its own and names the one before."""
    rows = conversation_messages(spark, sf_dir)
    own = F.format_string("<%d.%d>", "conv_id", "turn")
    back = F.format_string("<%d.%d>", F.col("conv_id"), F.col("turn") - 1)
    none = F.lit(None).cast("string")
    heads = F.array(F.struct(own.alias("message_id"), back.alias("in_reply_to"), none.alias("references")))
    return I.id_postings(rows.select("msg_id", heads.alias("headers")))


@query("agg_two_chains", "select token, count(*) as n_msgs, count(*) filter (where own) as n_own from (select conv_id || '.' || turn as token, true as own from conversations union all select conv_id || '.' || (turn - 1), false from conversations) group by token")
def agg_two_chains(spark, sf_dir):
    got = conversation_ids(spark, sf_dir).groupBy("token")
    return got.agg(F.count("*").alias("n_msgs"), F.count(F.when(F.col("is_own"), 1)).alias("n_own"))


@query(
    "thr_threads",
    "with g as (select conv_id, turn, turn - row_number() over (partition by conv_id order by turn) as run from conversations), "
    "r as (select conv_id, turn, min(turn) over (partition by conv_id, run) as first from g) "
    "select conv_id, turn, dense_rank() over (order by conv_id, first) - 1 as tid from r",
)
def thr_threads(spark, sf_dir):
    rows = conversation_messages(spark, sf_dir)
    return threads(conversation_ids(spark, sf_dir), rows).join(rows, "msg_id").select("conv_id", "turn", "tid")


@query(
    "thr_expand",
    "with g as (select conv_id, turn, text, turn - row_number() over (partition by conv_id order by turn) as run from conversations), "
    "h as (select distinct conv_id, run from g where list_contains(" + _TOKENS.format("coalesce(text, '')") + ", 'the')) select conv_id, turn from g join h using (conv_id, run)",
)
def thr_expand(spark, sf_dir):
    rows = conversation_messages(spark, sf_dir)
    roots = thread_roots(conversation_ids(spark, sf_dir), rows).withColumnRenamed("root", "tid")
    texts = table(spark, sf_dir, "conversations").withColumn("msg_id", F.col("conv_id") * 1_000_000 + F.col("turn"))
    return search(rows.join(roots, "msg_id"), I.postings(texts, {"body": ("text", "word")}), ["b:the"], threads=True).select("conv_id", "turn")


@query("mnt_changes", "select doc_id, 'new' as change from documents anti join labels using (doc_id) union all select doc_id, 'dead' from labels anti join documents using (doc_id)")
def mnt_changes(spark, sf_dir):
    new, dead = changes(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], fast=True)
    return new.withColumn("change", F.lit("new")).unionByName(dead.withColumn("change", F.lit("dead")))


@query("mnt_first_failure", "select source, min(doc_id) as first_bad from documents where md5(text) is distinct from md5(" + _FOLD.format("text") + ") group by source")
def mnt_first_failure(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.select("source", F.col("doc_id").alias("ordinal"), F.md5(F.col("text").cast("binary")).alias("md5"))
    new = docs.select("source", F.col("doc_id").alias("ordinal"), F.md5(fold(F.col("text")).cast("binary")).alias("md5"))
    return first_failures(old, new, "source")


@query("mnt_purge", "select doc_id, row_number() over (order by doc_id) - 1 as msg_id from documents where doc_id not in (select doc_id from labels where quality = 0)")
def mnt_purge(spark, sf_dir):
    dead = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", F.lit(True).alias("_dead")).distinct()
    docs = table(spark, sf_dir, "documents").join(dead, "doc_id", "left")
    rows = docs.select(F.col("doc_id").alias("msg_id"), F.when(F.col("_dead"), "DEAD").otherwise("FILE").alias("type"), F.col("doc_id").cast("string").alias("path"))
    empty = empty_index(spark)
    empty.messages = empty.messages.drop("msg_id", "type", "path").join(rows, F.lit(False), "right").select(*empty.messages.columns)
    return purge(empty).messages.select(F.col("path").cast("long").alias("doc_id"), "msg_id")


@query("mnt_integrity", "select 'duplicate path' as rule, md5(text) as subject, count(*) as n from documents group by 2 having count(*) > 1")
def mnt_integrity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("msg_id"), F.lit("FILE").alias("type"), F.md5(F.col("text").cast("binary")).alias("path"))
    return I.violations(rows, doc_postings(spark, sf_dir))


@query("srt_by_date", "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as rank from orders")
def srt_by_date(spark, sf_dir):
    return dense_numbers(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "rank").select("o_orderkey", "rank")


@query(
    "prj_locator",
    "select doc_id, 'mbox:' || source || ' [' || (sum(n_chars) over w - n_chars) || ',' || (sum(n_chars) over w) || ')' as location from documents window w as (partition by source order by doc_id rows unbounded preceding)",
)
def prj_locator(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    rows = running_offsets(docs, "source", "doc_id", "n_chars", "offset")
    rows = rows.select("doc_id", F.lit("MBOX").alias("type"), F.col("source").alias("path"), "offset", F.col("n_chars").alias("size"))
    return rows.select("doc_id", I.locator(rows).alias("location"))


@query("src_globs", r"select page_id, url from pages where regexp_full_match(url, 'https?://[^/]*\.org/en/.*') and not regexp_full_match(url, '.*[#?].*', 's')")
def src_globs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    like = lambda g: F.col("url").rlike("(?s)^(?:" + glob_regex(g) + ")$")
    return pages.filter((like("http://*.org/en/**") | like("https://*.org/en/**")) & ~(like("**[#]**") | F.col("url").contains("?")))


@query("top_tokens", f"select 'body' as field, token, count(*) as n_msgs from {_POST} group by token order by n_msgs desc, token limit 25")
def top_tokens(spark, sf_dir):
    return I.top_tokens(I.frequencies(table(spark, sf_dir, "documents"), "body", "text", "doc_id"), 25)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _ALL.items() if s}
