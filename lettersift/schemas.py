"""Explicit schemas of the engine's relations; nothing is ever inferred."""

from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType

FORMAT_VERSION = 1
FIELDS = ("to", "cc", "from", "subject", "body", "attachment_name")
TYPES = ("DEAD", "FILE", "MBOX", "IMAP")

_KINDS = {"long": LongType(), "int": IntegerType(), "string": StringType(), "boolean": BooleanType()}


def _schema(columns: str, **more: DataType) -> StructType:
    """``name kind`` pairs, then columns of other kinds."""
    pairs = [c.split() for c in columns.split(",")]
    return StructType([StructField(n, _KINDS[k]) for n, k in pairs] + [StructField(n, k) for n, k in more.items()])


MESSAGES = _schema(
    "msg_id long, type string, path string, mbox_id long, ordinal long, mtime long, offset long, size long, date long, "
    "tid long, seen boolean, replied boolean, flagged boolean"
)
MBOXES = _schema("mbox_id long, path string, n_msgs long, mtime long, size long")
CHECKSUMS = _schema("mbox_id long, ordinal long, md5 string")
POSTINGS = _schema("field string, token string, msg_id long")
ID_POSTINGS = _schema("token string, msg_id long, is_own boolean")
PART = _schema("depth int, ctype string, filename string, body string")
HEADERS = _schema(
    "depth int, to string, cc string, from string, subject string, message_id string, in_reply_to string, references string, "
    "date long, seen boolean, replied boolean, flagged boolean"
)
#: one row a message found by a source; ``headers[0]`` is the outer message, the others are embedded ones
PARSED = _schema(
    "type string, path string, ordinal long, mtime long, offset long, size long, md5 string, ok boolean",
    headers=ArrayType(HEADERS), parts=ArrayType(PART),
)
