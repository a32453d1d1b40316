"""The query language: text to a small syntax tree, and the tree to one DataFrame plan."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, tzinfo
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettersift.functions.dates import UTC, DateError, date_range
from lettersift.functions.fuzzy import anchored_fuzzy, check_pattern, fuzzy, may_match
from lettersift.functions.tokens import _LOWER, _UPPER

_LETTERS = {
    "b": ("body",), "s": ("subject",), "t": ("to",), "c": ("cc",), "f": ("from",), "n": ("attachment_name",),
    "r": ("to", "cc"), "a": ("to", "cc", "from"),
}
_DEFAULT = ("body", "subject", "to", "cc", "from")
_FOLD = str.maketrans(_UPPER, _LOWER)


class QueryError(ValueError):
    """A bad expression (exit code 2)."""


@dataclass(frozen=True)
class Word:
    """One word condition: substring with ``errors`` if not None, else exact."""

    text: str
    fields: tuple[str, ...]
    path: bool = False
    anchored: bool = False
    errors: int | None = None
    negated: bool = False


@dataclass(frozen=True)
class Own:
    """The message's own id."""

    text: str


@dataclass(frozen=True)
class Size:
    low: int | None
    high: int | None


@dataclass(frozen=True)
class Dates:
    start: int | None
    end: int | None


@dataclass(frozen=True)
class Flags:
    wanted: tuple[tuple[str, bool], ...]


@dataclass(frozen=True)
class AnyOf:
    """Disjuncts of conjuncts; an empty conjunct list holds everywhere."""

    groups: tuple[tuple[Word, ...], ...]


Leaf = Own | Size | Dates | Flags | AnyOf


def parse_size(text: str) -> Size:
    """``lo-hi``, ``lo-``, ``-hi`` or ``n`` for less than n; k and m scale; bounds are strict, reversed ones swap."""

    def number(s: str) -> int | None:
        if not s:
            return None
        m = re.fullmatch(r"(\d+)([kKmM]?)", s)
        if not m:
            raise QueryError(f"bad size [{text}]")
        return int(m[1]) << {"": 0, "k": 10, "m": 20}[m[2].lower()]

    low, dash, high = text.partition("-")
    if not dash:
        low, high = "", low
    lo, hi = number(low), number(high)
    if lo is not None and hi is not None and lo > hi:
        lo, hi = hi, lo
    return Size(lo, hi)


def parse_flags(text: str) -> Flags:
    wanted, no = [], False
    for c in text:
        if c == "-":
            no = True
            continue
        name = {"s": "seen", "r": "replied", "f": "flagged"}.get(c.lower())
        if name:
            wanted.append((name, not no))
        no = False
    return Flags(tuple(wanted))


def _word(text: str, fields: tuple[str, ...], path: bool) -> Word:
    negated = text.startswith("~")
    text = text[negated:]
    anchored = text.startswith("^")
    text = text[anchored:]
    m = re.match(r"([^=]*)=(?:$|(?=\d)(\d+))", text)
    errors = None
    if m:
        text, errors = m[1], int(m[2] or 0)
        try:
            check_pattern(text)
        except ValueError as e:
            raise QueryError(str(e)) from e
    return Word(text, fields, path, anchored, errors, negated)


def parse_argument(arg: str, now: datetime | None = None, zone: tzinfo = UTC) -> Leaf:
    letters, colon, rest = arg.partition(":")
    if not colon:
        letters, rest = None, arg
    fields: list[str] = list(_DEFAULT) if letters is None else []
    for c in letters or "":
        fields += [f for f in _LETTERS.get(c, ()) if f not in fields]
    letters = letters or ""
    if "m" in letters and len(letters) > 1:
        raise QueryError("message ids can't be searched with other keys")
    if "d" in letters:
        try:
            start, end = date_range(rest, now, zone)
        except DateError as e:
            raise QueryError(str(e)) from e
        if start is not None and end is not None and start > end:
            start, end = end, start
        return Dates(start, end)
    if "z" in letters:
        return parse_size(rest)
    if "F" in letters:
        return parse_flags(rest)
    if "m" in letters:
        return Own(rest.translate(_FOLD))
    groups: list[list[Word]] = [[]]
    left = rest
    while True:
        m = re.search(r"[,/]", left)
        raw = left[: m.start()] if m else left
        # white space goes only where a separator follows
        raw = re.sub(r"[ \t\n\v\f\r]", "", raw) if m else raw
        groups[-1].append(_word(raw, tuple(fields), "p" in letters))
        if not m:
            break
        left = left[m.end() :]
        if m[0] == "/":
            groups.append([])
        if not left:
            break
    return AnyOf(tuple(tuple(g) for g in groups))


def parse(args: list[str], now: datetime | None = None, zone: tzinfo = UTC) -> list[Leaf]:
    """The arguments, all of which must hold; none of them hold everywhere."""
    return [parse_argument(a, now, zone) for a in args]


def token_condition(w: Word, token: Column) -> Column:
    text = w.text.translate(_FOLD)
    if w.errors is None:
        return token == text
    if w.anchored:
        return anchored_fuzzy(token, text, w.errors)
    return fuzzy(token, text, w.errors)


def token_may_match(w: Word, token: Column) -> Column:
    """Holds wherever the condition does, in built-in expressions."""
    return may_match(token, w.text.translate(_FOLD), w.errors) if w.errors and w.anchored else token_condition(w, token)


def _path_condition(w: Word, path: Column) -> Column:
    if w.anchored:
        got = anchored_fuzzy(path, w.text, w.errors or 0)
    else:
        got = fuzzy(path, w.text, w.errors or 0)
    return F.coalesce(got, F.lit(False))


def search(
    messages: DataFrame, postings: DataFrame, args: list[str], id_postings: DataFrame | None = None, threads: bool = False,
    now: datetime | None = None, zone: tzinfo = UTC, keep_dead: bool = False,
) -> DataFrame:
    """Messages for which every argument holds, in no order.

    All word conditions are one pass over the postings: rows that meet any of
    them, grouped by message with a flag for each, joined to the messages once
    however many words, fields and negations there are.  Only rows that meet a
    word are moved.  Needs ``path`` in messages only for
    ``p:`` words.  ``threads`` adds whole threads; dead rows go last, unless
    ``keep_dead``.
    """
    tree = parse(args, now, zone)
    words = list(dict.fromkeys(w for leaf in tree if isinstance(leaf, AnyOf) for g in leaf.groups for w in g))
    held = {w: f"_w{k}" for k, w in enumerate(words) if w.fields and not w.path}
    found = messages
    if held:
        own_field = {w: F.col("field").isin(*w.fields) for w in held}
        cond = {w: own_field[w] & token_condition(w, F.col("token")) for w in held}
        # a row for Python is one that built-in expressions let through
        rows = postings.filter(reduce(Column.__or__, [own_field[w] & token_may_match(w, F.col("token")) for w in held]))
        rows = rows.filter(reduce(Column.__or__, cond.values()))
        hits = rows.groupBy("msg_id").agg(*[F.max(cond[w]).alias(n) for w, n in held.items()])
        found = found.join(hits, "msg_id", "left")
    own = [leaf.text for leaf in tree if isinstance(leaf, Own)]
    if own:
        ids = id_postings.filter(F.col("is_own") & F.col("token").isin(*own)).groupBy("msg_id")
        found = found.join(ids.agg(*[F.max(F.col("token") == t).alias(f"_m{k}") for k, t in enumerate(own)]), "msg_id", "left")

    def holds(w: Word) -> Column:
        if w.path:
            c = _path_condition(w, F.col("path")) & (F.col("type") != "DEAD")
        elif w in held:
            c = F.coalesce(F.col(held[w]), F.lit(False))
        else:
            c = F.lit(False)
        return ~c if w.negated else c

    def leaf_condition(leaf: Leaf) -> Column:
        if isinstance(leaf, AnyOf):
            return reduce(Column.__or__, [reduce(Column.__and__, [holds(w) for w in g], F.lit(True)) for g in leaf.groups])
        if isinstance(leaf, Own):
            return F.coalesce(F.col(f"_m{own.index(leaf.text)}"), F.lit(False))
        if isinstance(leaf, Flags):
            return reduce(Column.__and__, [F.col(n) if v else ~F.col(n) for n, v in leaf.wanted], F.lit(True))
        name, low, high = ("size", leaf.low, leaf.high) if isinstance(leaf, Size) else ("date", leaf.start, leaf.end)
        # an unreadable date counts as the largest
        value = F.col(name) if name == "size" else F.when(F.col(name) == -1, F.lit(0xFFFFFFFF)).otherwise(F.col(name))
        c = F.lit(True)
        if low is not None:
            c &= value > low
        if high is not None:
            c &= value < high
        return F.coalesce(c, F.lit(False))

    out = found.filter(reduce(Column.__and__, [leaf_condition(x) for x in tree], F.lit(True))).select(*messages.columns)
    if threads:
        out = messages.join(out.select("tid").distinct(), "tid", "left_semi").select(*messages.columns)
    if keep_dead or "type" not in messages.columns:
        return out
    return out.filter(F.col("type") != "DEAD")
