"""Words, hashes and n-grams of whole Arrow text columns with numpy.

Everything works on the UTF-8 bytes of many texts at once; a chunk holds about
``CHUNK`` bytes, or one text if that is longer, and no text is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: bytes of words that end at white space
INK = ~SPACE
#: bytes of lower-case alphanumeric words
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
#: one odd factor for each word place of an n-gram
PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Texts:
    """Some texts as one byte array; nulls are empty here and flagged in ``null``."""

    def __init__(self, column: pa.Array, fold: np.ndarray | None = None):
        if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            width = np.int64
        else:
            width = np.int32
        self.n = len(column)
        bufs = column.buffers()
        offs = np.frombuffer(bufs[1], width, column.offset + self.n + 1)[column.offset :].astype(np.int64) if self.n else np.zeros(1, np.int64)
        self.null = np.asarray(column.is_null()) if self.n else np.zeros(0, bool)
        data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if self.n and bufs[2] is not None else np.zeros(0, np.uint8)
        self.at = offs - offs[0]
        self.buf = data if fold is None else fold[data]

    def spans(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes in ``table`` within one text: starts, ends, text numbers."""
        n = len(self.buf)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        w = table[self.buf]
        first = w.copy()
        first[1:] &= ~w[:-1]
        last = w.copy()
        last[:-1] &= ~w[1:]
        begin = self.at[:-1][self.at[1:] > self.at[:-1]]
        stop = self.at[1:][self.at[1:] > self.at[:-1]] - 1
        first[begin] = w[begin]
        last[stop] = w[stop]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        return a, b, np.searchsorted(self.at[1:], a, "right")

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """Number of true bytes of each text."""
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.at[1:]] - c[self.at[:-1]]

    def names(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Numbers of the byte strings [a, b), equal for equal bytes only, and what they stand for.

        The strings ascend and don't overlap; the gaps between them get numbers
        too.  Bytes are compared, so no two strings are ever taken for one.
        """
        n = len(a)
        if not n:
            return np.zeros(0, np.int64), pa.array([], pa.binary())
        wide = len(self.buf) >= 1 << 31
        cuts = np.empty(2 * n, np.int64 if wide else np.int32)
        cuts[0::2], cuts[1::2] = a, b
        data = pa.py_buffer(np.ascontiguousarray(self.buf))
        both = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), 2 * n - 1, [None, pa.py_buffer(cuts), data])
        coded = both.dictionary_encode()
        return np.asarray(coded.indices)[0::2].astype(np.int64), coded.dictionary

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """XXH3 of the byte strings [a, b), which ascend and don't overlap."""
        ids, values = self.names(a, b)
        return hashes_of(values)[ids] if len(ids) else np.zeros(0, np.uint64)

    def packed(self, at: np.ndarray, k: int) -> np.ndarray:
        """The k bytes from each place as one number; k is 8 at most."""
        out = np.zeros(len(at), np.uint64)
        for j in range(k):
            out = out << np.uint64(8) | self.buf[at + j]
        return out


def hashes_of(values: pa.Array) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as xxh

    return np.fromiter((xxh(v) for v in values.to_pylist()), np.uint64, len(values))


def pairs(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the pairs (u, v) of numbers under 2^31, in the order of the pairs."""
    return np.unique(u * (int(v.max(initial=0)) + 1) + v, return_inverse=True)[1]


def tuples(ids: np.ndarray, n: int) -> np.ndarray:
    """Exact keys of the n ids from each place on; len(ids) - n + 1 of them."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    top = int(ids.max()) + 1
    out, most = ids[:m], top
    for j in range(1, n):
        if most * top >= 1 << 63:
            out = np.unique(out, return_inverse=True)[1]
            most = m
        out, most = out * top + ids[j : j + m], most * top
    return out


def ngrams(h: np.ndarray, n: int, place: int = 0) -> np.ndarray:
    """Hash of the n words from each place on; len(h) - n + 1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * PLACE[place]
    for j in range(1, n):
        out += h[j : j + m] * PLACE[place + j]
    return mix(out)


def inside(doc: np.ndarray, n: int) -> np.ndarray:
    """For each n-gram: whether its words are of one text."""
    m = len(doc) - n + 1
    return doc[:m] == doc[n - 1 :] if m > 0 else np.zeros(0, bool)


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Marks the places that runs of ``length`` at ``starts`` cover, of n."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:-1]) > 0


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` text bytes, one row at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offs = np.frombuffer(column.buffers()[1], width, column.offset + n + 1)[column.offset :].astype(np.int64)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j
