"""Date expressions of the query language, resolved on the driver to two epoch seconds."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import datetime, timedelta, tzinfo
from datetime import timezone as _tz

UTC = _tz.utc
_MONTHS = {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_SCALE = {"d": 1, "w": 7, "m": 30, "y": 365}
_Y2, _Y4, _M = r"(?:[04-9]\d|3[2-9])", r"[1-9]\d{3}", r"[A-Za-z]{3}"
_DAY = r"(?:[1-9]|[12]\d|3[01])"
_YEAR = rf"(?:{_Y4}|{_Y2})"
_FORMS = [
    ("D", re.compile(rf"(?P<d>{_DAY})")),
    ("Y", re.compile(rf"(?P<y>{_YEAR})")),
    ("YMD", re.compile(r"(?P<y>\d{2}|\d{4})(?P<n>\d{2})(?P<d>\d{2})")),
    ("S", re.compile(r"(?P<v>\d+)(?P<u>[A-Za-z])")),
    ("M", re.compile(rf"(?P<m>{_M})")),
    ("DM", re.compile(rf"(?P<d>{_DAY})(?P<m>{_M})")),
    ("DM", re.compile(rf"(?P<m>{_M})(?P<d>{_DAY})")),
    ("YM", re.compile(rf"(?P<y>{_YEAR})(?P<m>{_M})")),
    ("YM", re.compile(rf"(?P<m>{_M})(?P<y>{_YEAR})")),
    ("YMD", re.compile(rf"(?P<y>{_YEAR})(?P<m>{_M})(?P<d>{_DAY})")),
    ("YMD", re.compile(rf"(?P<d>{_DAY})(?P<m>{_M})(?P<y>{_YEAR})")),
]


class DateError(ValueError):
    """An expression that can't be understood (exit code 2)."""


def full_year(y: int) -> int:
    """Two digits below 70 are of this century, others of the last; four digits stand as they are."""
    return y if y >= 1000 else 2000 + y if y < 70 else 1900 + y


def _on(base: datetime, year: int, month: int, day: int) -> datetime:
    """A day that overflows its month runs into the next, as calendars normalise it."""
    month0 = month - 1
    year += month0 // 12
    first = base.replace(year=year, month=month0 % 12 + 1, day=1)
    return first + timedelta(days=day - 1)


def resolve(expr: str, base: datetime, now: datetime, end: bool) -> datetime:
    """First (or with ``end`` last) day of an expression, at the base's time of day."""
    for kind, form in _FORMS:
        m = form.fullmatch(expr)
        if m:
            break
    else:
        raise DateError(f"cannot parse date expression [{expr}]")
    g = m.groupdict()
    if kind == "S":
        if g["u"] not in _SCALE:
            raise DateError(f"unrecognised scale '{g['u']}'")
        try:
            return now - timedelta(days=int(g["v"]) * _SCALE[g["u"]])
        except OverflowError as e:
            raise DateError(f"[{expr}] is too far back") from e
    if g.get("m"):
        month = _MONTHS.get(g["m"].lower())
        if month is None:
            raise DateError(f"no month [{g['m']}]")
    else:
        month = int(g["n"]) if g.get("n") else None
    day = int(g["d"]) if g.get("d") else None
    year = full_year(int(g["y"])) if g.get("y") else None
    if kind == "D":
        y, mo = base.year, base.month
        if day > base.day:
            y, mo = (y - 1, 12) if mo == 1 else (y, mo - 1)
        return _on(base, y, mo, day)
    if kind == "Y":
        return _on(base, year, 12, 31) if end else _on(base, year, 1, 1)
    if kind == "M":
        year = base.year - (month > base.month)
    if kind == "DM":
        return _on(base, base.year - ((month, day) > (base.month, base.day)), month, day)
    if kind in ("M", "YM"):
        return _on(base, year, month, monthrange(year, month)[1] if end else 1)
    return _on(base, year, month, day)


def date_range(text: str, now: datetime | None = None, zone: tzinfo = UTC) -> tuple[int | None, int | None]:
    """(start, end) in epoch seconds; an omitted side is None.  Both bounds are strict.

    With an explicit end, the start is read relative to the end and takes its
    time of day.
    """
    now = (now or datetime.now(zone)).astimezone(zone).replace(microsecond=0)
    low, high = now.replace(hour=0, minute=0, second=0), now.replace(hour=23, minute=59, second=59)
    if "-" not in text:
        return _stamp(resolve(text, low, now, False)), _stamp(resolve(text, high, now, True))
    first, last = text.split("-", 1)
    start = end = None
    if last:
        high = low = resolve(last, high, now, True)
        end = _stamp(high)
    if first:
        start = _stamp(resolve(first, low, now, False))
    return start, end


def _stamp(t: datetime) -> int:
    return int(t.timestamp())
