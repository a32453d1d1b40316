"""Words of texts, counted and listed before they are moved.

All that parts a word is ASCII and all from U+0080 on is kept, so texts are cut
as bytes: a table of 256 folds letters and makes the rest spaces. Words of a
chunk of texts become numbers, repeats within a text go by a sort of them, and
one row a distinct word leaves the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: bytes of text, and 64 a row, that are cut at once
CHUNK = 16 << 20
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))


def _folded(text: bytes | None) -> bytes:
    """Words of the text before the first NUL, between spaces."""
    text = text or b""
    return (text.partition(b"\0")[0] if b"\0" in text else text).translate(_FOLDED)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and folded texts (first and last column), about ``CHUNK`` at once."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            ids.append(i)
            texts.append(_folded(text))
            size += len(texts[-1]) + 64
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _numbered(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts; of each word's occurrence the word's place among them and the text's."""
    try:
        column = pa.array(texts, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8 read as U+FFFD
        column = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
    cut = pc.split_pattern(column, pattern=" ")
    coded = cut.values.dictionary_encode()
    codes = coded.indices.to_numpy()
    rows = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    none = pc.index(coded.dictionary, pa.scalar("")).as_py()
    if none >= 0:
        keep = codes != none
        codes, rows = codes[keep], rows[keep]
    return coded.dictionary, codes, rows


def _pairs(codes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (code, row), ordered; rows are below ``n``."""
    keys = codes.astype(np.int64) * n + rows
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return np.divmod(keys, n)


def _starts(changed: np.ndarray) -> np.ndarray:
    """Where runs start.  ``changed``: whether each element but the first differs from the one before."""
    return np.flatnonzero(np.concatenate([[True], changed]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in _chunks(batches):
        words, codes, rows = _numbered(texts)
        if len(codes):
            codes, _ = _pairs(codes, rows, len(texts))
            starts = _starts(codes[1:] != codes[:-1])
            counts = np.diff(starts, append=len(codes))
            yield pa.RecordBatch.from_arrays([words.take(pa.array(codes[starts])), pa.array(counts)], names=["token", "n"])


def counts(rows: DataFrame, text: str) -> DataFrame:
    """(token, n): rows whose text has the word, of each chunk; whoever asks adds them up."""
    return rows.select(F.col(text).cast("binary").alias("text")).mapInArrow(_count, "token string, n long")


def _list(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            words, codes, rows = _numbered(texts)
            if not len(codes):
                continue
            # places of ids in their order, so that ordered places are ordered ids; a null id comes last
            known, places = np.unique(np.array([i for i in ids if i is not None], np.int64), return_inverse=True)
            place = np.full(len(ids), len(known))
            place[[i is not None for i in ids]] = places
            # rounds to zero, as the division of whole numbers in SQL does
            blocks = known // block
            blocks += (known < 0) & (known % block != 0)
            inner = np.append(known - blocks * block, 0).astype("<i4")
            codes, at = _pairs(codes, place[rows], len(known) + 1)
            group = np.append(np.unique(blocks, return_inverse=True)[1], -1)[at]
            starts = _starts((codes[1:] != codes[:-1]) | (group[1:] != group[:-1]))
            null = at[starts] == len(known)
            # a null id stands for a block without ids
            sizes = np.where(null, 0, np.diff(starts, append=len(codes)))
            offsets = np.concatenate([[0], np.cumsum(sizes)]) * 4
            payload = inner[at[at < len(known)]]
            lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(payload)])
            named = pa.array(np.append(blocks, 0)[at[starts]], mask=null)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(codes[starts])), named, lists], names=["token", "block", "ids"])

    return run


def _merged(token: pa.Array, blocks: pa.Array, ids: pa.Array, block: int) -> pa.RecordBatch:
    """One list for each run of equal (token, block), ascending and without repeats."""
    changed = lambda c: pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    known = pc.is_valid(blocks)
    number = pc.fill_null(blocks, 0)
    starts = _starts(changed(token) | changed(number) | changed(known))
    run = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(token)))
    sizes = pc.binary_length(ids).to_numpy() // 4
    inner = np.frombuffer(b"".join(ids.to_pylist()), "<i4").astype(np.int64)
    of, places = _pairs(np.repeat(run, sizes), inner + block, 2 * block)
    values = places - block + number.to_numpy()[starts][of] * block
    offsets = np.searchsorted(of, np.arange(len(starts) + 1)).astype(np.int32)
    at = pa.array(starts)
    return pa.RecordBatch.from_arrays([token.take(at), blocks.take(at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["token", "block", "msg_ids"])


def _merge(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last run of the batch before, which may go on; its list has no repeats, so it is never above two blocks
        for batch in batches:
            if not batch.num_rows:
                continue
            got = _merged(*batch.columns, block)
            if held is not None:
                if held.column(0)[0] == got.column(0)[0] and held.column(1)[0].as_py() == got.column(1)[0].as_py():
                    both = np.union1d(held.column(2).flatten().to_numpy(), got.column(2)[0].values.to_numpy())
                    held = pa.RecordBatch.from_arrays([held.column(0), held.column(1), pa.ListArray.from_arrays([0, len(both)], pa.array(both, pa.int64()))], names=got.schema.names)
                    got = got.slice(1)
                if got.num_rows:
                    yield held
            if got.num_rows:
                if got.num_rows > 1:
                    yield got.slice(0, got.num_rows - 1)
                held = got.take(pa.array([got.num_rows - 1]))
        if held is not None:
            yield held

    return run


def lists(rows: DataFrame, text: str, id: str, block: int) -> DataFrame:
    """(token, block, msg_ids): ascending ids, without repeats, of the rows whose text has the word, a row for each ``block`` of ids.

    A null id gives an empty list under a null block. Chunks send each word
    once a block with 4 bytes an id; then only rows of chunks are ordered.
    """
    if not isinstance(rows.schema[id].dataType, IntegralType):
        raise TypeError(f"{id} holds no whole numbers")
    some = rows.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    moved = some.mapInArrow(_list(block), "token string, block long, ids binary").repartition("token", "block")
    return moved.sortWithinPartitions("token", "block").mapInArrow(_merge(block), "token string, block long, msg_ids array<long>")
