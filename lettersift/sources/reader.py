"""Found files to parsed messages, on the executors, one task for some of the files."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lettersift.schemas import PARSED
from lettersift.sources.folders import Found
from lettersift.sources.imap import Server
from lettersift.sources.mail import file_flags, parse_message
from lettersift.sources.mailbox import decompress, split_mailbox

#: bytes of raw mail that a task parses at once
SLICE = 1 << 20
_FILES = "kind string, path string, mtime long, size long"


def _row(kind: str, path: str, mtime: int, data: bytes, ordinal: int | None, offset: int | None, parsed: tuple | None = None) -> dict:
    ok, _, headers, parts = parsed or parse_message(data)
    if kind == "FILE" and headers:
        headers[0] |= file_flags(path)
    return {
        "type": kind, "path": path, "ordinal": ordinal, "mtime": mtime, "offset": offset, "size": len(data),
        "md5": md5(data).hexdigest(), "ok": ok, "headers": headers, "parts": parts,
    }


def messages_of(kind: str, path: str, mtime: int, server: Server | None = None) -> Iterator[dict]:
    if kind == "IMAP":
        data = (server or Server(None)).message(path)
        if data is not None:
            yield _row(kind, path, mtime, data, None, None)
        return
    with open(path, "rb") as f:
        data = decompress(path, f.read())
    if kind == "FILE":
        yield _row(kind, path, mtime, data, None, None)
        return
    yield from _mailbox_rows(path, mtime, data)


def _mailbox_rows(path: str, mtime: int, data: bytes) -> Iterator[dict]:
    """Rows of a mailbox's messages; what splitting had to parse isn't parsed again."""
    seen: dict[int, tuple] = {}

    def whole(d: bytes) -> bool:
        got = parse_message(d)
        seen[hash(d)] = (d, got)
        return got[1]

    for k, (a, b) in enumerate(split_mailbox(data, whole)):
        d = data[a:b]
        own, got = seen.get(hash(d), (None, None))
        yield _row("MBOX", path, mtime, d, k, a, got if own == d else None)
        seen.clear()


def files_frame(spark: SparkSession, found: list[Found]) -> DataFrame:
    return spark.createDataFrame([(f.kind, f.path, f.mtime, f.size) for f in found], _FILES)


def read_mail(files: DataFrame, imap: dict[str, str] | None = None) -> DataFrame:
    """PARSED rows of (kind, path, mtime, size) rows; paths must be readable on every executor.

    A message that can't be parsed keeps its row, without headers and parts.  A
    mailbox is split where it is read; it is one task, as its repair is
    sequential.  ``imap``: how to reach the server, for messages of kind IMAP;
    those that are gone when they are fetched have no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        server = Server(imap)
        for batch in batches:
            rows: list[dict] = []
            for r in batch.itertuples(index=False):
                for m in messages_of(r.kind, r.path, r.mtime, server):
                    rows.append(m)
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=PARSED.names)
                        rows = []
            yield pd.DataFrame(rows, columns=PARSED.names)
        server.close()

    return files.mapInPandas(run, PARSED)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of ``most`` bytes in that column, or one row: what is made of a part stays small whatever the batch."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(size.tolist()):
        if k > start and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    yield batch.slice(start)


def parse_table(rows: DataFrame, raw: str, keys: list[str], path: str | None = None, mailbox: bool = False) -> DataFrame:
    """Messages that a table holds: ``keys``, and PARSED's columns from ordinal on, for the bytes in ``raw``.

    A row is one message, or with ``mailbox`` a mailbox of messages.  ``path``
    names a column of file names, whose flags count.  A null has no message.
    """
    names = [f for f in PARSED.names if f not in ("type", "path", "mtime")]
    kinds = {f.name: f for f in rows.schema}
    own = StructType([*[kinds[k] for k in keys], *[PARSED[n] for n in names]])
    arrow = {n: to_arrow_type(PARSED[n].dataType) for n in names}
    wanted = [*keys, raw, *([path] if path else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, len(keys))):
            at, out = [], []
            data = batch.column(len(keys)).to_pylist()
            paths = batch.column(len(keys) + 1).to_pylist() if path else [""] * len(data)
            for k, (d, p) in enumerate(zip(data, paths)):
                if d is None:
                    continue
                got = list(_mailbox_rows("", 0, d)) if mailbox else [_row("FILE", p or "", 0, d, None, None)]
                out += got
                at += [k] * len(got)
            held = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*held.columns[: len(keys)], *[pa.array([r[n] for r in out], arrow[n]) for n in names]], names=[*keys, *names]
            )

    return rows.select(*[F.col(f"`{c}`") for c in wanted]).mapInArrow(run, own)
