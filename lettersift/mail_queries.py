"""Registered queries over mail: messages and mailboxes are made from the driver's tables, then parsed by the engine.

Each document, turn or order is written as a message of some shape.  The SQL
says what its fields must be; it never sees the message.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettersift.operators import index as I
from lettersift.operators.maintenance import changes, empty_index, purge, update
from lettersift.plans.query import search
from lettersift.queries import _DOC_TOKENS, _TOKENS, query, table
from lettersift.schemas import PARSED
from lettersift.session import shared_dir, stored
from lettersift.sources.mailbox import decompress, is_separator
from lettersift.sources.reader import parse_table, slices
from lettersift.sources.store import read_index, write_index

T = "coalesce(text, '')"
#: a separator line of a mailbox
SEPARATOR = "From bob Thu Jan  1 00:00:00 2004\n"


def _docs(spark: SparkSession, sf_dir: str, raw: str, path: str | None = None) -> DataFrame:
    """Documents as messages; ``raw``: Spark SQL for the text of each."""
    return _parsed(table(spark, sf_dir, "documents"), raw, path)


def _parsed(docs: DataFrame, raw: str, path: str | None = None) -> DataFrame:
    rows = docs.selectExpr("doc_id", f"cast({raw} as binary) as raw", *([f"{path} as path"] if path else []))
    return parse_table(rows, "raw", ["doc_id"], "path" if path else None)


def _mail_postings(spark: SparkSession, sf_dir: str, raw: str) -> DataFrame:
    """Postings of documents as messages."""
    rows = table(spark, sf_dir, "documents")
    return I.distinct_by_id(lambda some: I.mail_postings(_parsed(some, raw), "doc_id"), rows, "doc_id")


def _head(name: str):
    return F.col("headers")[0][name].alias(name)


def _case(key: str, *values: str) -> str:
    """A value by the remainder of the key."""
    return f"(case {key} % {len(values)} " + " ".join(f"when {k} then {v}" for k, v in enumerate(values)) + " end)"


@query("prj_split", f"select doc_id, true as ok, source as subject, md5({T}) as body_md5 from documents")
def prj_split(spark, sf_dir):
    got = _docs(spark, sf_dir, f"concat('Subject: ', source, '\n\n', {T})")
    return got.select("doc_id", "ok", _head("subject"), F.md5(F.col("parts")[0]["body"].cast("binary")).alias("body_md5"))


@query("prj_unfold", "select doc_id, source || ' ' || lang || ' ' || doc_id as subject from documents")
def prj_unfold(spark, sf_dir):
    return _docs(spark, sf_dir, "concat('Subject: ', source, '\n\t  ', lang, '\n ', doc_id, '\n\n')").select("doc_id", _head("subject"))


@query("prj_audit", "select doc_id, doc_id % 5 in (0, 4) as ok, cast(case when doc_id % 5 in (0, 4) then 1 else 0 end as integer) as n_headers from documents")
def prj_audit(spark, sf_dir):
    shapes = _case("doc_id", "concat('A: ', source, '\n\n')", "concat('no header ', source, '\n\n')", "'A: x\n'", "' first\nA: x\n\n'", "'>From y\nA: x\n\n'")
    return _docs(spark, sf_dir, shapes).select("doc_id", "ok", F.size("headers").alias("n_headers"))


_FIELDS = (
    "concat('To: a', doc_id, '@x.org\nFrom: f@', source, '.org\nCC: c1@', lang, '.org\nTO: B@y.org\ncc: c2@y.org\nFrom: second@x\nMessage-ID: <M', doc_id, '@h>\n"
    "References: <r1@h>\n <r2@h>\nIn-Reply-To: <p', doc_id, '@h>\nSubject: s\n\nbody')"
)


@query(
    "prj_fields",
    "select doc_id, 'a' || doc_id || '@x.org, B@y.org' as \"to\", 'f@' || source || '.org' as \"from\", 'c1@' || lang || '.org, c2@y.org' as cc, '<M' || doc_id || '@h>' as message_id, "
    "'<r1@h> <r2@h>' as \"references\", '<p' || doc_id || '@h>' as in_reply_to, 's' as subject from documents",
)
def prj_fields(spark, sf_dir):
    got = _docs(spark, sf_dir, _FIELDS)
    return got.select("doc_id", *[_head(n) for n in ("to", "from", "cc", "message_id", "references", "in_reply_to", "subject")])


@query(
    "tok_ids",
    "select '<' as dummy, token, msg_id, is_own from (select 'm' || doc_id || '@h' as token, doc_id as msg_id, true as is_own from documents union all select 'p' || doc_id || '@h', doc_id, false from documents "
    "union all select 'r1@h', doc_id, false from documents union all select 'r2@h', doc_id, false from documents)".replace("'<' as dummy, ", ""),
)
def tok_ids(spark, sf_dir):
    return I.id_postings(_docs(spark, sf_dir, _FIELDS), "doc_id")


_ADDRESSED = "select field, doc_id as msg_id, unnest(list_concat(regexp_extract_all(v, '[0-9a-z_]+'), regexp_extract_all(v, '[0-9a-z_+\\-.@]+'))) as token"


@query(
    "tok_mail_addresses",
    f"select distinct field, token, msg_id from ({_ADDRESSED} from (select 'to' as field, doc_id, lower('a' || doc_id || '@x.org, B@y.org') as v from documents union all "
    "select 'from', doc_id, lower('f@' || source || '.org') from documents union all select 'cc', doc_id, lower('c1@' || lang || '.org, c2@y.org') from documents) "
    "union all select 'subject', doc_id, 's' from documents union all select 'body', doc_id, 'body' from documents)",
)
def tok_mail_addresses(spark, sf_dir):
    return _mail_postings(spark, sf_dir, _FIELDS)


@query("prj_encoded_words_b", f"select doc_id, md5({T}) as subject_md5 from documents")
def prj_encoded_words_b(spark, sf_dir):
    got = _docs(spark, sf_dir, f"concat('Subject: =?utf-8?B?', regexp_replace(base64(cast({T} as binary)), '[\\r\\n]', ''), '?=\n\n')")
    return got.select("doc_id", F.md5(F.col("headers")[0]["subject"].cast("binary")).alias("subject_md5"))


@query("prj_encoded_words_q", "select doc_id, 'Re_x ' || source || ' end' as subject from documents")
def prj_encoded_words_q(spark, sf_dir):
    return _docs(spark, sf_dir, "concat('Subject: Re_x =?iso-8859-1?q?', regexp_replace(hex(source), '(..)', '=$1'), '_end?=\n\n')").select("doc_id", _head("subject"))


_NAMES = _case("doc_id", "'a b ' || source || '.txt'", "'part-' || lang || '.bin'", "'café-' || source", "'plain' || doc_id || '.dat'")


@query("prj_parameters", f"select doc_id, {_NAMES} as filename from documents")
def prj_parameters(spark, sf_dir):
    shapes = _case(
        "doc_id", "concat('filename=\"a b ', source, '.txt\"')", "concat('filename*0=\"part-\"; filename*1=\"', lang, '.bin\"')",
        "concat('filename*=utf-8''''caf%C3%A9-', source)".replace("''''", "\\'\\'"), "concat('size=3; filename=plain', doc_id, '.dat')",
    )
    got = _docs(spark, sf_dir, f"concat('Content-Type: application/octet-stream\nContent-Disposition: attachment; ', {shapes}, '\n\nx')")
    return got.select("doc_id", F.col("parts")[0]["filename"].alias("filename"))


@query("prj_transfer", f"select doc_id, md5(case when doc_id % 8 = 6 then '' else {T} end) as body_md5 from documents")
def prj_transfer(spark, sf_dir):
    names = _case("doc_id", "'7bit'", "'8-bit'", "' 7 bit'", "'BASE64 x'", "'quoted-printable'", "'binary'", "'x-unknown'", "'8BIT'")
    bodies = _case("doc_id", T, T, T, f"base64(cast({T} as binary))", f"regexp_replace(hex({T}), '(..)', '=$1')", T, T, T)
    got = _docs(spark, sf_dir, f"concat('Content-Transfer-Encoding: ', {names}, '\n\n', {bodies})")
    return got.select("doc_id", F.md5(F.col("parts")[0]["body"].cast("binary")).alias("body_md5"))


@query("prj_multipart", f"select doc_id, 2 as n_parts, 'text/plain,text/html' as kinds, md5({T} || chr(10)) as body_md5 from documents")
def prj_multipart(spark, sf_dir):
    raw = f"concat('Content-Type: multipart/mixed; boundary=\"b', doc_id, '\"\n\npreamble\n--b', doc_id, '\n\n', {T}, '\n--b', doc_id, '\nContent-Type: text/html\n\n<p>x</p>\n--b', doc_id, '--\nepilogue')"
    got = _docs(spark, sf_dir, raw)
    return got.select(
        "doc_id", F.size("parts").alias("n_parts"), F.array_join(F.transform("parts", lambda p: p["ctype"]), ",").alias("kinds"),
        F.md5(F.col("parts")[0]["body"].cast("binary")).alias("body_md5"),
    )


@query("prj_content_class", "select doc_id, " + _case("doc_id", "'text/html'", "'text/plain'", "'application/pdf'", "'text/plain'") + " as ctype, doc_id % 4 <> 2 as has_text from documents")
def prj_content_class(spark, sf_dir):
    kinds = _case("doc_id", "'Content-Type: text/html; charset=utf-8\n'", "'Content-type:TEXT/Plain\n'", "'Content-Type: application/pdf\n'", "'X: y\n'")
    got = _docs(spark, sf_dir, f"concat({kinds}, '\n', {T})")
    return got.select("doc_id", F.col("parts")[0]["ctype"].alias("ctype"), F.col("parts")[0]["body"].isNotNull().alias("has_text"))


@query("prj_attachment", "select doc_id, " + _case("doc_id", "source", "lang", "null", "null") + " as filename from documents")
def prj_attachment(spark, sf_dir):
    shapes = _case(
        "doc_id", "concat('Content-Disposition: attachment; filename=', source, '\nContent-Type: image/png; name=other\n')",
        "concat('Content-Type: image/png; name=', lang, '\nContent-Disposition: ATTACHMENT\n')", "concat('Content-Disposition: inline; filename=', source, '\n')",
        "concat('Content-Type: image/png; name=', lang, '\n')",
    )
    return _docs(spark, sf_dir, f"concat({shapes}, '\nx')").select("doc_id", F.col("parts")[0]["filename"].alias("filename"))


@query(
    "prj_date",
    "select o_orderkey, cast(case when o_orderkey % 6 in (0, 1, 4) then epoch(date_trunc('day', o_orderdate)) else -1 end as bigint) as date from orders",
)
def prj_date(spark, sf_dir):
    day = "date_format(o_orderdate, 'd MMM y')"
    shapes = _case(
        "o_orderkey", f"concat('Fri, ', {day}, ' 10:00:00 +0000')", f"concat({day}, ' 10:00 GMT')", f"concat('Fri ', {day}, ' 10:00')", day,
        "concat('x,', date_format(o_orderdate, 'dd MMMM yy'), ' 1')", f"concat('about ', {day}, ' x')",
    )
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"cast(concat('Date: ', {shapes}, '\n\n') as binary) as raw")
    return parse_table(rows, "raw", ["o_orderkey"]).select("o_orderkey", F.col("headers")[0]["date"].alias("date"))


@query("prj_maildir_flags", "select doc_id, doc_id % 16 in (1, 3, 5, 7) as flagged, doc_id % 16 in (2, 3, 6, 7) as replied, doc_id % 16 in (4, 5, 6, 7) as seen from documents")
def prj_maildir_flags(spark, sf_dir):
    marks = "concat(case when doc_id % 2 >= 1 then 'F' else '' end, case when doc_id % 4 >= 2 then 'R' else '' end, case when doc_id % 8 >= 4 then 'S' else '' end)"
    path = f"concat('m/cur/', doc_id, case when doc_id % 16 < 8 then ':2,' else ':1,' end, {marks})"
    return _docs(spark, sf_dir, "'A: x\n\n'", path).select("doc_id", _head("flagged"), _head("replied"), _head("seen"))


@query("prj_status_flags", "select doc_id, doc_id % 2 = 1 as seen, doc_id % 4 >= 2 as replied, doc_id % 8 >= 4 as flagged from documents")
def prj_status_flags(spark, sf_dir):
    marks = "'Status: ', case when doc_id % 2 = 1 then 'RO' else 'O' end, '\nX-Status: ', case when doc_id % 4 >= 2 then 'A' else '' end, case when doc_id % 8 >= 4 then 'F' else '' end"
    # in mailboxes, as a file's flags are in its name
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"cast(concat('{SEPARATOR}', {marks}, '\n\n') as binary) as raw")
    return parse_table(rows, "raw", ["doc_id"], mailbox=True).select("doc_id", _head("seen"), _head("replied"), _head("flagged"))


@query("prj_checksum", f"select doc_id, md5('A: ' || source || chr(10) || chr(10) || {T}) as md5, strlen('A: ' || source || chr(10) || chr(10) || {T}) as size from documents")
def prj_checksum(spark, sf_dir):
    return _docs(spark, sf_dir, f"concat('A: ', source, '\n\n', {T})").select("doc_id", "md5", "size")


@query(
    "tok_embedded",
    f"select distinct field, token, msg_id from (select 'subject' as field, doc_id as msg_id, unnest({_TOKENS.format('source')}) as token from documents union all select 'subject', doc_id, 'inner' from documents "
    f"union all select 'subject', doc_id, unnest({_TOKENS.format('lang')}) from documents union all select 'body', doc_id, unnest({_DOC_TOKENS}) from documents)",
)
def tok_embedded(spark, sf_dir):
    raw = f"concat('Subject: ', source, '\nContent-Type: message/rfc822\n\nSubject: inner ', lang, '\nContent-Type: text/plain\n\n', {T})"
    return _mail_postings(spark, sf_dir, raw)


_TURN = f"'Subject: turn ' || turn || chr(10) || chr(10) || {T} || chr(10)"


def _turn_boxes(spark: SparkSession, sf_dir: str, before: str, after: str) -> DataFrame:
    """A mailbox for each conversation, whose turns are its messages."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"concat('{before}', 'Subject: turn ', turn, '\n\n', {T}, '\n{after}') as m")
    # the turns of one conversation
    boxes = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("ms"))
    return boxes.select("conv_id", F.array_join(F.col("ms.m"), "").cast("binary").alias("raw"))


def _turn_sql(before: int, after: int) -> str:
    return (
        f"select conv_id, turn, n - 1 as ordinal, cast(sum(size + {before + after}) over (partition by conv_id order by n) - size - {after} as bigint) as \"offset\", cast(size as bigint) as size, true as ok "
        f"from (select conv_id, turn, row_number() over (partition by conv_id order by turn) as n, strlen({_TURN}) as size from conversations)"
    )


def _turns(boxes: DataFrame) -> DataFrame:
    got = parse_table(boxes, "raw", ["conv_id"], mailbox=True)
    return got.select("conv_id", F.substring_index(F.col("headers")[0]["subject"], " ", -1).cast("long").alias("turn"), "ordinal", "offset", "size", "ok")


@query("src_mbox", _turn_sql(len(SEPARATOR), 0))
def src_mbox(spark, sf_dir):
    return _turns(_turn_boxes(spark, sf_dir, SEPARATOR, ""))


@query("src_mmdf", _turn_sql(5, 5))
def src_mmdf(spark, sf_dir):
    return _turns(_turn_boxes(spark, sf_dir, "\1\1\1\1\n", "\1\1\1\1\n"))


_LINES = [
    ("'a@', source, '.org Thu Jan  1 00:00:00 2015'", True), ("'\"a b\"@', lang, ' Mon Feb 29 1:02 EST 2000'", True), ("'- Mon Feb 29 01:02:03 +0100 MET 2000 remote from ', source", True),
    ("'Fri, 02 Jan 98 10:11:12 GMT'", True), ("'<', source, '@x.org> Sun Dec 31 23:59:59 2000'", True), ("'now on ', source, ' goes'", False),
    ("'a@b Thu Jan 2015 00:00'", False), ("'a@b Xyz Jan  1 00:00:00 2015'", False), ("'a@b Thu Jan  1 00:00:00 2015 and more ', lang", False), ("''", False),
]


@query("src_from_lines", "select doc_id, " + _case("doc_id", *[str(v).lower() for _, v in _LINES]) + " as is_separator from documents")
def src_from_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", _case("doc_id", *[f"concat({s})" for s, _ in _LINES]) + " as line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([is_separator(x) for x in b.column(1).to_pylist()], pa.bool_())], names=["doc_id", "is_separator"])

    return rows.mapInArrow(run, "doc_id long, is_separator boolean")


_BROKEN = "'Content-Type: multipart/mixed; boundary=q' || chr(10) || chr(10) || '--q' || chr(10) || chr(10) || "


@query(
    "src_repair",
    f"select doc_id, 0 as ordinal, cast(strlen({_BROKEN} {T}) + {1 + len(SEPARATOR) + 12} as bigint) as size, 1 as n_parts from documents union all select doc_id, 1, 14, 1 from documents",
)
def src_repair(spark, sf_dir):
    raw = f"concat('{SEPARATOR}Content-Type: multipart/mixed; boundary=q\n\n--q\n\n', {T}, '\n{SEPARATOR}more\n\n--q--\n{SEPARATOR}Subject: b\n\nz\n')"
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"cast({raw} as binary) as raw")
    return parse_table(rows, "raw", ["doc_id"], mailbox=True).select("doc_id", F.col("ordinal").cast("int").alias("ordinal"), "size", F.size("parts").alias("n_parts"))


@query("src_compressed", f"select doc_id, md5({T}) as md5 from documents")
def src_compressed(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"cast({T} as binary) as raw")
    kinds = ((".GZ", gzip.compress), (".bz2", bz2.compress), (".xz", lzma.compress), ("", bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            out = []
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                end, pack = kinds[k % len(kinds)]
                out.append(decompress(f"box{end}", pack(d)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "raw"])

    return rows.mapInArrow(run, "doc_id long, raw binary").select("doc_id", F.md5("raw").alias("md5"))


def _dated(spark, sf_dir, *args: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("msg_id"), F.lit("FILE").alias("type"), F.unix_timestamp("o_orderdate").alias("date"), F.floor("o_totalprice").alias("size")
    )
    none = spark.createDataFrame([], "field string, token string, msg_id long")
    return search(rows, none, list(args), now=datetime(1998, 5, 10, 12, tzinfo=timezone.utc)).select(F.col("msg_id").alias("o_orderkey"))


def _strictly(first: str, last: str) -> str:
    return f"select o_orderkey from orders where o_orderdate > timestamp '{first} 00:00:00' and o_orderdate < timestamp '{last} 23:59:59'"


@query("dt_day", _strictly("1998-04-15", "1998-04-15"))
def dt_day(spark, sf_dir):
    return _dated(spark, sf_dir, "d:15")


@query("dt_year", _strictly("1995-01-01", "1995-12-31"))
def dt_year(spark, sf_dir):
    return _dated(spark, sf_dir, "d:95")


@query("dt_missing_year", _strictly("1997-07-01", "1997-07-31"))
def dt_missing_year(spark, sf_dir):
    return _dated(spark, sf_dir, "d:jul")


@query("dt_day_of_month", _strictly("1997-12-24", "1997-12-24"))
def dt_day_of_month(spark, sf_dir):
    return _dated(spark, sf_dir, "d:24dec")


@query("flt_typed_precedence", _strictly("1995-01-01", "1995-12-31"))
def flt_typed_precedence(spark, sf_dir):
    """A date key wins over a size key in the same argument."""
    return _dated(spark, sf_dir, "zd:1995")


@query("flt_dead_last", f"select doc_id from documents where not list_contains({_DOC_TOKENS}, 'the') and doc_id not in (select doc_id from labels where quality = 0)")
def flt_dead_last(spark, sf_dir):
    """A negated word holds for dead rows too; they go after it."""
    dead = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", F.lit(True).alias("_dead")).distinct()
    docs = table(spark, sf_dir, "documents")
    rows = docs.join(dead, "doc_id", "left").select(F.col("doc_id").alias("msg_id"), F.when(F.col("_dead"), F.lit("DEAD")).otherwise(F.lit("FILE")).alias("type"))
    return search(rows, I.postings(docs, {"body": ("text", "word")}, "doc_id"), ["b:~the"]).select(F.col("msg_id").alias("doc_id"))


# an index over documents as message files


def _files(spark: SparkSession, sf_dir: str, mtime: str = "doc_id") -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.selectExpr("'FILE' as kind", "lpad(doc_id, 12, '0') as path", f"cast({mtime} as long) as mtime", "cast(n_chars as long) as size")


def _reader(spark: SparkSession, sf_dir: str):
    """Reads found files: the documents of those paths, as mail."""
    docs = table(spark, sf_dir, "documents").selectExpr("lpad(doc_id, 12, '0') as path", f"cast(concat('Message-ID: <', doc_id, '>\nSubject: ', source, '\n\n', {T}) as binary) as raw")

    def read(todo: DataFrame) -> DataFrame:
        rows = todo.join(docs, "path")
        return parse_table(rows, "raw", ["kind", "path", "mtime"], "path").withColumnRenamed("kind", "type").select(*PARSED.names)

    return read


#: indexes that this session has built and stored, by application and folder
_STORED: dict[tuple[str, str], str] = {}


def _built(spark: SparkSession, sf_dir: str):
    """The stored index of the documents; it is built once a session, as indexes are."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORED:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        write_index(spark, update(empty_index(spark), _files(spark, sf_dir), _reader(spark, sf_dir)), path)
        _STORED[key] = path
    return read_index(spark, _STORED[key])


@query(
    "mnt_update",
    """with a as (select doc_id, row_number() over (order by lpad(doc_id::varchar, 12, '0')) - 1 as msg_id from documents),
    gone as (select distinct doc_id from labels where quality = 0), touched as (select distinct doc_id from labels where toxic = 1 and doc_id not in (select doc_id from gone)),
    n as (select count(*) as n from documents)
    select msg_id, doc_id, case when doc_id in (select doc_id from gone) or doc_id in (select doc_id from touched) then 'DEAD' else 'FILE' end as type from a
    union all select n + row_number() over (order by lpad(doc_id::varchar, 12, '0')) - 1, doc_id, 'FILE' from documents, n where doc_id in (select doc_id from touched)""",
)
def mnt_update(spark, sf_dir):
    """All files are indexed, then some vanish and others are touched."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    marks = marks.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), "q", "t")
    later = _files(spark, sf_dir).join(marks, "path", "left").filter("q is null or q <> 0")
    later = later.withColumn("mtime", F.when(F.col("t") == 1, F.col("mtime") + 1).otherwise(F.col("mtime"))).select("kind", "path", "mtime", "size")
    got = update(_built(spark, sf_dir), later, _reader(spark, sf_dir))
    return got.messages.select("msg_id", F.col("path").cast("long").alias("doc_id"), "type")


@query("mnt_store", f"select msg_id, field, token from (select distinct msg_id, 'body' as field, unnest(w) as token from (select row_number() over (order by lpad(doc_id::varchar, 12, '0')) - 1 as msg_id, {_DOC_TOKENS} as w from documents)) union all select row_number() over (order by lpad(doc_id::varchar, 12, '0')) - 1, 'subject', source from documents")
def mnt_store(spark, sf_dir):
    """Postings after a round trip through a stored index."""
    return _built(spark, sf_dir).postings.select("msg_id", "field", "token")


@query("flt_stored", f"select doc_id from documents where list_contains({_DOC_TOKENS}, 'the') and not list_contains({_DOC_TOKENS}, 'licensed')")
def flt_stored(spark, sf_dir):
    """A search over a stored index: the words reach its scan."""
    index = _built(spark, sf_dir)
    return search(index.messages, index.postings, ["b:the,~licensed"], index.ids).select(F.col("path").cast("long").alias("doc_id"))


@query(
    "mnt_purge_index",
    """with alive as (select doc_id from documents where doc_id not in (select doc_id from labels where quality = 0)),
    n as (select doc_id, row_number() over (order by lpad(doc_id::varchar, 12, '0')) - 1 as msg_id from alive)
    select msg_id, doc_id, source as subject, doc_id::varchar as own_id from n join documents using (doc_id)""",
)
def mnt_purge_index(spark, sf_dir):
    """Dead rows leave messages, postings and ids."""
    gone = table(spark, sf_dir, "labels").filter("quality = 0").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"))
    index = _built(spark, sf_dir)
    index = purge(update(index, _files(spark, sf_dir).join(gone, "path", "left_anti"), _reader(spark, sf_dir)))
    subject = index.postings.filter("field = 'subject'").groupBy("msg_id").agg(F.max("token").alias("subject"))
    own = index.ids.filter("is_own").groupBy("msg_id").agg(F.max("token").alias("own_id"))
    return index.messages.select("msg_id", F.col("path").cast("long").alias("doc_id")).join(subject, "msg_id").join(own, "msg_id")


@query(
    "mnt_changes_mtime",
    "select doc_id, 'new' as change from documents where doc_id not in (select doc_id from labels where toxic = 0) union all select doc_id, 'dead' from (select distinct doc_id, toxic from labels where toxic = 1 or doc_id not in (select doc_id from documents))",
)
def mnt_changes_mtime(spark, sf_dir):
    """A file is the same only if its time is."""
    found = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(0 as int) as mtime")
    new, dead = changes(table(spark, sf_dir, "labels").selectExpr("doc_id", "toxic as mtime").distinct(), found, ["doc_id"])
    return new.select("doc_id", F.lit("new").alias("change")).unionByName(dead.select("doc_id", F.lit("dead").alias("change")))


@query(
    "mnt_mailboxes",
    "select conv_id, count(*) as n_msgs, count(*) filter (where turn % 2 = 0) as n_left from conversations group by conv_id",
)
def mnt_mailboxes(spark, sf_dir):
    """Mailboxes are indexed, then their odd turns leave them: what is behind the first change is read again."""
    all_ = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"concat('{SEPARATOR}Subject: turn ', turn, '\n\n', {T}, '\n') as m")

    def boxes(rows: DataFrame) -> DataFrame:
        got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("ms"))
        return stored(got.select(F.lit("MBOX").alias("kind"), F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("path"), F.lit(1).cast("long").alias("mtime"), F.array_join(F.col("ms.m"), "").cast("binary").alias("raw")))

    def found(held: DataFrame, mtime: int) -> DataFrame:
        return held.select("kind", "path", F.lit(mtime).cast("long").alias("mtime"), F.octet_length("raw").cast("long").alias("size"))

    def reader(held: DataFrame):
        def read(todo: DataFrame) -> DataFrame:
            rows = todo.join(held.select("path", "raw"), "path")
            return parse_table(rows, "raw", ["kind", "path", "mtime"], mailbox=True).withColumnRenamed("kind", "type").select(*PARSED.names)

        return read

    one, two = boxes(all_), boxes(all_.filter("turn % 2 = 0"))
    first = update(empty_index(spark), found(one, 1), reader(one))
    second = update(first, found(two, 2), reader(two))
    key = F.col("path").cast("long").alias("conv_id")
    was = first.mboxes.select(key, "n_msgs")
    now = second.messages.filter("type = 'MBOX'").groupBy(key).agg(F.count("*").alias("n_left"))
    return was.join(now, "conv_id", "left").select("conv_id", "n_msgs", F.coalesce("n_left", F.lit(0).cast("long")).alias("n_left"))


