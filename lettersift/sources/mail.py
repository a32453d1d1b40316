"""One message's bytes to headers and parts; a whole message at a time, nothing shared between messages."""

from __future__ import annotations

import base64
import binascii
import quopri
import re
from datetime import datetime, timedelta, timezone, tzinfo

_MONTHS = {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_FIELD = re.compile(rb"[!-9;-~]+[ \t]*:")
_ENCODED = re.compile(rb"=\?[^?\s]*\?([QqBb])\?([^?\s]*)\?=")
_DATE = re.compile(r"\s*([0-9]+)\s*(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\S*\s+([0-9]++)\s*\S", re.I)
#: beginnings of the names of transfer encodings
_PLAIN = ("7bit", "7-bit", "7 bit", "8bit", "8-bit", "8 bit", "binary")
_DEPTH = 32


class Rejected(ValueError):
    """The bytes are no message."""


def as_text(b: bytes | None) -> str | None:
    """UTF-8 where it is that, else each byte as the code point of its value."""
    if b is None:
        return None
    try:
        return b.decode()
    except UnicodeDecodeError:
        return b.decode("latin-1")


def split_headers(data: bytes) -> tuple[list[bytes], bytes]:
    """Header lines and the body behind the first blank line; without one, or with a NUL before it, no message."""
    lines, at = [], 0
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            raise Rejected("no blank line after the headers")
        line = data[at:end].rstrip(b"\r")
        if b"\0" in line:
            raise Rejected("NUL in the headers")
        at = end + 1
        if not line.strip():
            return lines, data[at:]
        lines.append(line)


def unfold(lines: list[bytes]) -> list[bytes]:
    """Continuation lines joined on, one white space kept; mailbox From lines left out."""
    out: list[bytes] = []
    for line in lines:
        if line.startswith((b"From ", b">From ")):
            continue
        if line[:1] in b" \t" and line:
            if not out:
                raise Rejected("the first line is no header")
            out[-1] += b" " + line.lstrip()
        elif _FIELD.match(line):
            out.append(line)
        else:
            raise Rejected("a line is no header")
    return out


def decode_words(value: bytes) -> bytes:
    """Encoded words to their bytes, whatever their charset; white space between them stays."""

    def one(m: re.Match) -> bytes:
        if m[1] in b"Qq":
            return quopri.decodestring(m[2].replace(b"_", b" "))
        try:
            return base64.b64decode(m[2] + b"=" * (-len(m[2]) % 4))
        except binascii.Error:
            return m[0]

    return _ENCODED.sub(one, value)


def parameters(value: bytes) -> tuple[str, dict[str, bytes]]:
    """Main value and parameters of a header; quoted values, numbered pieces and charset escapes joined."""
    main, _, rest = value.partition(b";")
    got: dict[str, bytes] = {}
    pieces: dict[str, dict[int, bytes]] = {}
    for m in re.finditer(rb'\s*([^\s=;"]+)\s*=\s*("(?:\\.|[^"\\])*"?|[^;\s]*)[^;]*;?', rest):
        name, v = m[1].decode("latin-1").lower(), m[2]
        if v[:1] == b'"':
            v = re.sub(rb"\\(.)", rb"\1", v[1:-1] if len(v) > 1 and v.endswith(b'"') else v[1:])
        base, *mark = name.split("*")
        if mark:
            number = int(mark[0]) if mark[0].isdigit() else 0
            if mark[-1] == "":
                if number == 0 and v.count(b"'") >= 2:
                    v = v.split(b"'", 2)[2]
                v = re.sub(rb"%([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), v)
            pieces.setdefault(base, {})[number] = v
        else:
            got.setdefault(base, v)
    for base, parts in pieces.items():
        got[base] = b"".join(parts[k] for k in sorted(parts))
    return main.strip().decode("latin-1").lower(), got


def transfer_decode(body: bytes, encoding: str | None) -> bytes:
    """The named transfer decoding, told by how the name begins; one that isn't known leaves nothing."""
    name = None if encoding is None else encoding.lstrip().lower()
    if name is None or name.startswith(_PLAIN):
        return body
    if name.startswith("quoted-printable"):
        return quopri.decodestring(body)
    if name.startswith("base64"):
        letters = re.sub(rb"[^A-Za-z0-9+/]", b"", body)
        return base64.b64decode(letters[: len(letters) - (len(letters) % 4 == 1)] + b"=" * (-len(letters) % 4))
    if name.startswith("x-uuencode"):
        out, on = [], False
        for line in body.splitlines():
            if line.startswith(b"begin "):
                on = True
            elif line.strip() == b"end":
                on = False
            elif on and line:
                try:
                    out.append(binascii.a2b_uu(line))
                except binascii.Error:
                    pass
        return b"".join(out)
    return b""


def parse_date(value: str, zone: tzinfo = timezone.utc) -> int:
    """Epoch seconds of the day's local midnight; -1 if it can't be read.

    The day stands first or right behind the first comma, and something follows
    the year.
    """
    m = _DATE.match(value.partition(",")[2] if "," in value else value)
    if not m or int(m[1]) > 31:
        return -1
    year = int(m[3])
    year = year + 2000 if year < 70 else year if year >= 1900 else year + 1900
    try:
        day = datetime(year, _MONTHS[m[2].lower()], 1, tzinfo=zone) + timedelta(days=int(m[1]) - 1)
        return int(day.timestamp())
    except (ValueError, OverflowError):
        return -1


def _headers(lines: list[bytes], depth: int, zone: tzinfo) -> tuple[dict, dict[str, bytes]]:
    row: dict = dict.fromkeys(("to", "cc", "from", "subject", "message_id", "in_reply_to", "references"))
    row |= {"depth": depth, "date": 0, "seen": False, "replied": False, "flagged": False}
    mime: dict[str, bytes] = {}
    for line in lines:
        name, _, value = line.partition(b":")
        name, value = name.strip().decode("latin-1").lower(), value.strip()
        key = {"message-id": "message_id", "in-reply-to": "in_reply_to"}.get(name, name)
        if key in ("to", "cc"):
            new = as_text(decode_words(value))
            row[key] = new if row[key] is None else f"{row[key]}, {new}"
        elif key in ("from", "subject", "message_id", "in_reply_to", "references"):
            if row[key] is None:
                row[key] = as_text(decode_words(value))
        elif key == "date":
            row["date"] = row["date"] or parse_date(as_text(value), zone)
        elif key in ("status", "x-status"):
            row["seen"] |= b"R" in value
            row["replied"] |= b"A" in value
            row["flagged"] |= b"F" in value
        elif key in ("content-type", "content-transfer-encoding", "content-disposition"):
            mime.setdefault(key, value)
    return row, mime


def _part(body: bytes, mime: dict[str, bytes], depth: int, zone: tzinfo, headers: list, parts: list) -> bool:
    """Append what a body holds; false if a multipart lacks its end."""
    kind, args = parameters(mime.get("content-type", b""))
    if kind.startswith("multipart/") and args.get("boundary") and depth < _DEPTH:
        return _multipart(body, args["boundary"], depth, zone, headers, parts)
    place, more = parameters(mime.get("content-disposition", b""))
    name = (more.get("filename") or args.get("name")) if place == "attachment" else None
    encoding = mime.get("content-transfer-encoding")
    data = transfer_decode(body, None if encoding is None else encoding.decode("latin-1"))
    whole = True
    if kind == "message/rfc822" and depth < _DEPTH:
        parts.append({"depth": depth, "ctype": kind, "filename": as_text(name), "body": None})
        try:
            whole = _message(data, depth + 1, zone, headers, parts)
        except Rejected:
            pass
        return whole
    text = kind.startswith("text/") or not kind
    parts.append({"depth": depth, "ctype": kind or "text/plain", "filename": as_text(name), "body": as_text(data) if text else None})
    return True


def _multipart(body: bytes, boundary: bytes, depth: int, zone: tzinfo, headers: list, parts: list) -> bool:
    mark = re.compile(rb"^--" + re.escape(boundary) + rb"(--)?[ \t]*\r?$", re.M)
    marks = list(mark.finditer(body))
    ended = any(m[1] for m in marks)
    for m, nxt in zip(marks, [*marks[1:], None]):
        if m[1]:
            break
        piece = body[m.end() + 1 : nxt.start() if nxt else len(body)]
        try:
            # a part may have no header at all: its first line is blank
            lines, inner = split_headers(piece)
            _, mime = _headers(unfold(lines), depth, zone)
            _part(inner, mime, depth, zone, headers, parts)
        except Rejected:
            continue
    return ended


def _message(data: bytes, depth: int, zone: tzinfo, headers: list, parts: list) -> bool:
    lines, body = split_headers(data)
    lines = unfold(lines)
    if not lines:
        raise Rejected("no header")
    row, mime = _headers(lines, depth, zone)
    headers.append(row)
    return _part(body, mime, depth, zone, headers, parts)


def parse_message(data: bytes, zone: tzinfo = timezone.utc) -> tuple[bool, bool, list[dict], list[dict]]:
    """(readable, whole, headers, parts); a message that can't be read has neither headers nor parts."""
    headers: list[dict] = []
    parts: list[dict] = []
    try:
        whole = _message(data, 0, zone, headers, parts)
    except Rejected:
        return False, True, [], []
    return True, whole, headers, parts


def file_flags(path: str) -> dict[str, bool]:
    """Flags in a maildir file name's suffix."""
    suffix = path.rpartition(":")[2] if ":" in path else ""
    marks = suffix[2:] if suffix.startswith("2,") else ""
    return {"seen": "S" in marks, "replied": "R" in marks, "flagged": "F" in marks}
