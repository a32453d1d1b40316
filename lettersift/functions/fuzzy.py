"""Error-tolerant token matching."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: longest pattern in bytes
LONGEST = 31
#: tokens whose tables are computed together
TOGETHER = 512


def check_pattern(word: str) -> None:
    n = len(word.encode())
    if not 1 <= n <= LONGEST:
        raise ValueError(f"a pattern has 1 to {LONGEST} bytes, not {n}")


def as_bytes(c: Column) -> Column:
    """Each UTF-8 byte as one character, so that lengths and edits count bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def may_match(token: Column, word: str, errors: int) -> Column:
    """Necessary for a match within ``errors`` edits, anchored or not: so many edits leave one of errors + 1 pieces of the word whole."""
    w = word.encode().decode("latin-1")
    n = len(w)
    if n <= errors:
        return token != ""
    b = as_bytes(token)
    cut = [round(i * n / (errors + 1)) for i in range(errors + 2)]
    pieces = {w[i:j] for i, j in zip(cut, cut[1:])}
    return (F.length(b) >= n - errors) & reduce(Column.__or__, [b.contains(p) for p in sorted(pieces)])


def fuzzy(token: Column, word: str, errors: int) -> Column:
    """Some substring of ``token`` is within ``errors`` edits of ``word``, in built-in expressions.

    Tokens too short to reach it fail by length alone, and those that hold none of
    errors + 1 pieces of the word by that: so many edits leave one piece whole.
    """
    w = word.encode().decode("latin-1")
    n = len(w)
    if errors <= 0:
        return token.contains(word)
    if n <= errors:
        return token != ""
    b = as_bytes(token)
    starts = F.sequence(F.lit(1), F.greatest(F.length(b) - (n - errors) + 1, F.lit(1)))
    near = lambda s: F.exists(
        F.sequence(F.lit(n - errors), F.lit(n + errors)), lambda m: F.levenshtein(F.substring(b, s, m), F.lit(w), errors) >= 0
    )
    return may_match(token, word, errors) & F.exists(starts, near)


def anchored_distances(tokens: list[bytes], word: bytes) -> np.ndarray:
    """Least cost of ``word`` in each token where a mismatch of the first letter at the token's start costs one.

    Row 1 of the table is 0 only in column 1 and only if the first letters
    agree, otherwise 1; column 0 counts rows; later rows are those of the edit
    distance.  The cost is the least of the last row.
    """
    size = np.array([len(t) for t in tokens], np.int64)
    wide = int(size.max(initial=0))
    grid = np.zeros((len(tokens), wide), np.int16) - 1
    for k, t in enumerate(tokens):
        grid[k, : len(t)] = np.frombuffer(t, np.uint8)
    inside = np.arange(1, wide + 1) <= size[:, None]
    row = np.ones((len(tokens), wide + 1), np.int64)
    if wide:
        row[:, 1] = (grid[:, 0] != word[0]) if len(tokens) else row[:, 1]
    for i in range(2, len(word) + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        for j in range(1, wide + 1):
            new[:, j] = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, row[:, j - 1] + (grid[:, j - 1] != word[i - 1]))
        row = new
    row[:, 1:][~inside] = 1 << 20
    return row.min(1)


def anchored_fuzzy(token: Column, word: str, errors: int) -> Column:
    """``^word=errors``: anchored tolerance costs an error instead of forbidding."""
    if errors <= 0:
        return token.startswith(word)
    if len(word.encode()) <= errors:
        return token != ""
    w = word.encode()

    @F.pandas_udf("boolean")
    def match(t: pd.Series) -> pd.Series:
        # each token of a batch once
        at, each = pd.factorize(t.fillna(""))
        near = np.zeros(len(each), bool)
        for k in range(0, len(each), TOGETHER):
            near[k : k + TOGETHER] = anchored_distances([v.encode() for v in each[k : k + TOGETHER]], w) <= errors
        return pd.Series(near[at])

    return match(token)
