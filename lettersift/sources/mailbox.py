"""Mailbox files: where their messages begin and end."""

from __future__ import annotations

import bz2
import gzip
import lzma
import re
from collections.abc import Callable

_DAY = r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_TIME = r"\d{1,2}:\d{2}(?::\d{2})?"
_ZONE = r"(?:[A-Z][A-Za-z]{0,4}|[+-]\d{4})"
_WHO = r'(?:"[^"\n]*"(?:@\S+)?|<[^>\n]*>|\S+)'
_WHEN = (
    rf"(?:{_DAY}\s+{_MONTH}\s+\d{{1,2}}\s+{_TIME}(?:\s+{_ZONE}){{0,2}}\s+\d{{4}}(?:\s+{_ZONE})?"
    rf"|{_DAY},?\s+\d{{1,2}}\s+{_MONTH}\s+\d{{2,4}}\s+{_TIME}(?:\s+{_ZONE}){{0,2}})"
)
#: what follows ``From `` on a separator line
FROM_LINE = re.compile(rf"(?:{_WHO}\s+)?{_WHEN}(?:\s+remote from \S+)?\s*", re.I)
_FROM = re.compile(rb"(?:\A|(?<=\n))From ([^\n]*)(?:\n|\Z)")
_MMDF = b"\1\1\1\1\n"
#: chunks that are tried together to find a multipart's end
TRIALS = 100


def is_separator(rest: str) -> bool:
    return FROM_LINE.fullmatch(rest.rstrip("\r")) is not None


def _mbox(data: bytes) -> list[tuple[int, int]]:
    marks = [m for m in _FROM.finditer(data) if is_separator(m[1].decode("latin-1"))]
    return [(m.end(), n.start() if n else len(data)) for m, n in zip(marks, [*marks[1:], None])]


def _mmdf(data: bytes) -> list[tuple[int, int]]:
    out, at = [], 0
    while data.startswith(_MMDF, at):
        begin = at + len(_MMDF)
        end = data.find(b"\n" + _MMDF, begin - 1)
        if end < 0:
            out.append((begin, len(data)))
            break
        out.append((begin, end + 1))
        at = end + 1 + len(_MMDF)
    return out


def split_mailbox(data: bytes, whole: Callable[[bytes], bool] | None = None) -> list[tuple[int, int]]:
    """Spans [start, end) of the messages of a mailbox file.

    A chunk for which ``whole`` is false, a multipart without its end, is tried
    together with those behind it; if none of TRIALS helps it stands alone.
    """
    spans = _mmdf(data) if len(data) > 10 and data.startswith(_MMDF) else _mbox(data)
    if whole is None:
        return spans
    out, k = [], 0
    while k < len(spans):
        start, end = spans[k]
        step = 1
        if not whole(data[start:end]):
            for more in range(1, min(TRIALS, len(spans) - k)):
                if whole(data[start : spans[k + more][1]]):
                    end, step = spans[k + more][1], more + 1
                    break
        out.append((start, end))
        k += step
    return out


def compressed(path: str) -> bool:
    return path.lower().endswith((".gz", ".bz2", ".xz"))


def decompress(path: str, data: bytes) -> bytes:
    """By suffix, whatever its case."""
    name = path.lower()
    if name.endswith(".gz"):
        return gzip.decompress(data)
    if name.endswith(".bz2"):
        return bz2.decompress(data)
    if name.endswith(".xz"):
        return lzma.decompress(data)
    return data
