"""Query text, dates, sizes, globs and configuration, without Spark jobs."""

from datetime import datetime, timezone

import pytest

from lettersift.config import ConfigError, expand, parse
from lettersift.functions.dates import DateError, date_range
from lettersift.functions.fuzzy import anchored_distances
from lettersift.plans.query import AnyOf, Dates, Flags, Own, QueryError, Size, Word, parse_argument
from lettersift.sources.folders import glob_match, split_colons
from lettersift.sources.mail import file_flags, parse_date, parse_message
from lettersift.sources.mailbox import is_separator, split_mailbox

NOW = datetime(2003, 5, 18, 12, tzinfo=timezone.utc)


def span(text):
    a, b = date_range(text, NOW)
    show = lambda t: None if t is None else datetime.fromtimestamp(t, timezone.utc).strftime("%Y-%m-%d")
    return show(a), show(b)


@pytest.mark.parametrize(
    "text, want",
    [
        ("20030518", ("2003-05-18", "2003-05-18")), ("11", ("2003-05-11", "2003-05-11")), ("20", ("2003-04-20", "2003-04-20")),
        ("may", ("2003-05-01", "2003-05-31")), ("jun", ("2002-06-01", "2002-06-30")), ("2002", ("2002-01-01", "2002-12-31")),
        ("98", ("1998-01-01", "1998-12-31")), ("02", ("2002-01-01", "2002-12-31")), ("feb2000", ("2000-02-01", "2000-02-29")),
        ("15mar", ("2003-03-15", "2003-03-15")), ("mar15", ("2003-03-15", "2003-03-15")), ("25dec", ("2002-12-25", "2002-12-25")),
        ("1apr99", ("1999-04-01", "1999-04-01")), ("99apr1", ("1999-04-01", "1999-04-01")), ("990401", ("1999-04-01", "1999-04-01")),
        ("2w-", ("2003-05-04", None)), ("-1m", (None, "2003-04-18")), ("2002-", ("2002-01-01", None)),
        ("21apr-2y", ("2001-04-21", "2001-05-18")), ("may-jul99", ("1999-05-01", "1999-07-31")),
    ],
)
def test_dates(text, want):
    assert span(text) == want


def test_start_takes_the_end_s_time_of_day():
    a, b = date_range("1jan02-31mar02", NOW)
    assert a % 86400 == b % 86400 == 86399


@pytest.mark.parametrize("text", ["x", "3q-", "0apr", "foo12", "0"])
def test_bad_dates(text):
    with pytest.raises(DateError):
        date_range(text, NOW)


def test_words():
    got = parse_argument("fs:~^Foo=2,bar/baz")
    f = ("from", "subject")
    assert got == AnyOf(((Word("Foo", f, False, True, 2, True), Word("bar", f)), (Word("baz", f),)))
    assert parse_argument("a:x/") == AnyOf(((Word("x", ("to", "cc", "from")),), ()))
    assert parse_argument("x y , z w").groups[0][0].text == "xy" and parse_argument("x , z w").groups[0][1].text == " z w"
    assert parse_argument("b:a=b").groups[0][0].text == "a=b"
    assert parse_argument("m:A@B,c") == Own("a@b,c")
    assert parse_argument("F:s-r") == Flags((("seen", True), ("replied", False)))
    assert parse_argument("z:3k-1") == Size(1, 3072) and parse_argument("z:5") == Size(None, 5)
    assert isinstance(parse_argument("zd:20030518"), Dates)


@pytest.mark.parametrize("text", ["ms:x", "z:k", "d:nonsense", "b:=", "b:" + "x" * 32 + "="])
def test_bad_expressions(text):
    with pytest.raises(QueryError):
        parse_argument(text)


def test_anchored_costs():
    got = anchored_distances([b"caterpillar", b"terpilar", b"x"], b"terpilar")
    assert got.tolist() == [2, 0, 8]


@pytest.mark.parametrize(
    "glob, text, ok",
    [
        ("a*", "abc", True), ("a*", "a/b", False), ("a**", "a/b/c", True), ("?b", "ab", True), ("[a-c]x", "bx", True), ("[c-a]x", "bx", True),
        ("[]x]", "]", True), ("[a-]", "-", True), ("a.b", "axb", False), ("*", "", True),
    ],
)
def test_globs(glob, text, ok):
    assert glob_match(glob, text) is ok


def test_colons():
    assert split_colons(r"a:b\:c:d") == ["a", "b:c", "d"]


def test_config():
    c = parse("base=/m # here\nmh=x\nmh=$Y/z\n\nnochecks\n", {"Y": "/y", "LETTERSIFT_MFOLDER": "out"})
    assert (c.base, c.mh, c.nochecks, c.mfolder) == ("/m", "x:/y/z", True, "out")
    assert expand("~/a${B}$C", {"HOME": "/h", "B": "b"}) == "/h/ab"
    with pytest.raises(ConfigError):
        parse("nokey=1", {})


MAIL = (
    b"Subject: =?utf-8?Q?caf=C3=A9?= =?us-ascii?B?eA==?=\r\n  folded\r\nTo: a@x\r\nTo: b@y\r\nDate: Fri, 31 Dec 2010 23:00:00 -0500\r\n"
    b"Content-Type: multipart/mixed; boundary=\"b b\"\r\n\r\nskipped\r\n--b b\r\n\r\nplain\r\n--b b\r\nContent-Type: text/plain; charset=x\r\n"
    b"Content-Transfer-Encoding: quoted-printable\r\n\r\nso=\r\nft=20x\r\n--b b\r\nContent-Type: application/x; name=n.bin\r\n"
    b"Content-Disposition: attachment; filename*0=\"ab\"; filename*1*=%20c\r\nContent-Transfer-Encoding: base64\r\n\r\nAAEC\r\n--b b\r\n"
    b"Content-Type: message/rfc822\r\n\r\nSubject: inner\r\nMessage-ID: <in@x>\r\n\r\ndeep\r\n--b b--\r\n"
)


def test_parser():
    ok, whole, heads, parts = parse_message(MAIL)
    assert ok and whole and len(heads) == 2
    assert heads[0]["subject"] == "café x folded" and heads[0]["to"] == "a@x, b@y" and heads[0]["date"] == 1293753600
    assert heads[1]["subject"] == "inner" and heads[1]["message_id"] == "<in@x>"
    assert [p["body"] for p in parts][:2] == ["plain\r\n", "soft x\r\n"] and parts[2]["filename"] == "ab c"
    assert not parse_message(MAIL[:-10])[1]
    assert not parse_message(b"no header\n\nx")[0] and not parse_message(b"A: b\n")[0] and not parse_message(b"A: \0\n\nx")[0]


def test_mail_dates_and_flags():
    assert parse_date("1 Jan 70") == -1 and parse_date("1 Jan 70 0:00") == 0 and parse_date("rubbish") == -1 and parse_date("1 Jan 2010 1:00") == parse_date("Fri, 1 Jan 110 09:00") > 0 and parse_date("Fri 1 Jan 2010 9:00") == -1
    assert file_flags("x:2,FS") == {"seen": True, "replied": False, "flagged": True} and not any(file_flags("x").values())


def test_mailboxes():
    line = b"From a@b Thu Jan  1 00:00:00 2015\n"
    data = line + b"A: 1\n\nx\nFrom here on\n\n" + line + b"A: 2\n\ny\n"
    assert [data[a:b] for a, b in split_mailbox(data)] == [b"A: 1\n\nx\nFrom here on\n\n", b"A: 2\n\ny\n"]
    mmdf = b"\1\1\1\1\nA: 1\n\nx\n\1\1\1\1\n\1\1\1\1\nA: 2\n\ny\n\1\1\1\1\n"
    assert [mmdf[a:b] for a, b in split_mailbox(mmdf)] == [b"A: 1\n\nx\n", b"A: 2\n\ny\n"]
    assert is_separator('"a b"@c Mon Feb 29 1:02 EST 2000') and is_separator("- Mon Feb 29 01:02:03 +0100 MET 2000 remote from x")
    assert not is_separator("now on we go")
    multi = line + b"Content-Type: multipart/mixed; boundary=q\n\n--q\n\nx\n" + line + b"more\n--q--\n"
    assert len(split_mailbox(multi, lambda d: parse_message(d)[1])) == 1 and len(split_mailbox(multi)) == 2
