"""Tokens of header fields and bodies as column expressions; ASCII-only case folding throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[0-9a-z_\x{80}-\x{10FFFF}]+"
ADDRESS = r"[0-9a-z_+\-.@\x{80}-\x{10FFFF}]+"


def fold(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    # translate makes a string of each letter; where all is ASCII, lower does the same at once
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def to_nul(c: Column) -> Column:
    """The text before the first NUL."""
    return F.substring_index(c, "\0", 1)


def word_tokens(c: Column) -> Column:
    """Runs of letters, digits, underscore and everything from U+0080 on."""
    return F.regexp_extract_all(fold(to_nul(c)), F.lit(WORD), F.lit(0))


def address_tokens(c: Column) -> Column:
    """Word tokens, and the longer ones with plus, minus, dot and at sign."""
    return F.array_union(word_tokens(c), F.regexp_extract_all(fold(to_nul(c)), F.lit(ADDRESS), F.lit(0)))


def html_tokens(c: Column) -> Column:
    """Word tokens outside tags; an open tag runs to the end, entities stay as written."""
    return word_tokens(F.regexp_replace(to_nul(c), "<[^>]*>?", " "))


def name_token(c: Column) -> Column:
    """An attachment name is one token."""
    return F.when(c.isNotNull(), F.array(fold(c))).otherwise(F.array().cast("array<string>"))


def id_tokens(c: Column) -> Column:
    """What stands between angle brackets."""
    return F.regexp_extract_all(fold(c), F.lit("<([^>]*)>"), F.lit(1))


#: how each field is cut
KINDS = {"word": word_tokens, "address": address_tokens, "html": html_tokens, "name": name_token, "id": id_tokens}
