"""Mail on an IMAP server as a Spark data source, and hits sent there."""

from __future__ import annotations

import imaplib
import shlex
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

class ImapError(ValueError):
    """The server refuses, or the settings don't say how to reach it (exit code 2)."""


_SCHEMA = "path string, uidvalidity long, uid long, folder string, flags array<string>, data binary"


def pseudo_path(uidvalidity: int, uid: int, folder: str) -> str:
    return f"{uidvalidity}:{uid}:{folder}"


def connect(o: dict[str, str]) -> imaplib.IMAP4:
    """By a shell pipe, or TCP with STARTTLS where offered; then log in."""
    if o.get("pipe"):
        box = imaplib.IMAP4_stream(o["pipe"])
    else:
        host, _, port = o["server"].partition(":")
        box = imaplib.IMAP4(host, int(port or 143))
        if "STARTTLS" in box.capabilities:
            box.starttls()
    if o.get("username") and box.state == "NONAUTH":
        box.login(o["username"], o.get("password", ""))
    return box


def _quoted(folder: str) -> str:
    return '"' + folder.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _flags_of(line: bytes) -> tuple[int, list[str]]:
    uid = int(line.split(b"UID ", 1)[1].split()[0].rstrip(b")"))
    return uid, [f.decode() for f in imaplib.ParseFlags(line)]


def select(box: imaplib.IMAP4, folder: str, readonly: bool = True) -> tuple[int, int]:
    """(uidvalidity, number of messages) of a folder that is now open."""
    status, found = box.select(_quoted(folder), readonly=readonly)
    valid = box.response("UIDVALIDITY")[1][0]
    if status != "OK" or valid is None:
        raise ImapError(f"no folder {folder} on the server: {found}")
    return int(valid), int(found[0] or 0)


def enumerate_folder(box: imaplib.IMAP4, folder: str) -> tuple[int, list[tuple[int, list[str]]]]:
    """(uidvalidity, [(uid, flags)]) of what isn't marked deleted."""
    valid, exists = select(box, folder)
    if not exists:
        return valid, []
    status, lines = box.uid("FETCH", "1:*", "(FLAGS)")
    if status != "OK":
        raise ImapError(f"unable to FETCH in folder {folder}: {lines}")
    got = [_flags_of(x) for x in lines if x and b"UID " in x]
    return valid, [(u, f) for u, f in got if "\\Deleted" not in f]


def fetch(box: imaplib.IMAP4, folder: str, uidvalidity: int, uid: int) -> bytes | None:
    """A message's bytes; None if the folder's ids were given out anew."""
    if select(box, folder)[0] != uidvalidity:
        return None
    _, parts = box.uid("FETCH", str(uid), "(BODY.PEEK[])")
    return next((p[1] for p in parts if isinstance(p, tuple)), None)


class Server:
    """A connection that is made when it is first needed."""

    def __init__(self, options: dict[str, str] | None):
        self.options, self._box = options, None

    @property
    def box(self) -> imaplib.IMAP4:
        if self._box is None:
            if not self.options:
                raise ImapError("imap_pipe or imap_server is required")
            self._box = connect(self.options)
        return self._box

    def close(self) -> None:
        if self._box is not None:
            self._box.logout()
            self._box = None

    def message(self, path: str) -> bytes | None:
        """The bytes that a pseudo-path stands for; None if they are gone."""
        valid, uid, folder = path.split(":", 2)
        return fetch(self.box, folder, int(valid), int(uid))

    def list(self, folders: list[str]) -> list[str]:
        """Pseudo-paths of the live messages of some folders."""
        out = []
        for folder in folders:
            valid, found = enumerate_folder(self.box, folder)
            out += [pseudo_path(valid, uid, folder) for uid, _ in found]
        return out

    def clear(self, folder: str) -> None:
        if self.box.select(_quoted(folder))[0] == "OK":
            if int(self.box.response("EXISTS")[1][0] or 0):
                self.box.store("1:*", "+FLAGS.SILENT", "(\\Deleted)")
            self.box.expunge()

    def _created(self, folder: str, command) -> None:
        """Run ``command``; a folder that isn't there is made, and it runs again."""
        status, said = command()
        if status == "NO" and self.box.create(_quoted(folder))[0] == "OK":
            status, said = command()
        if status != "OK":
            raise ImapError(f"unable to write to folder {folder}: {said}")

    def append(self, folder: str, data: bytes, flags: list[str]) -> None:
        self._created(folder, lambda: self.box.append(_quoted(folder), f"({' '.join(flags)})", None, data))

    def copy(self, path: str, folder: str) -> bool:
        """Copy on the server; false if the message is gone."""
        valid, uid, home = path.split(":", 2)
        now, exists = select(self.box, home)
        if now != int(valid) or not exists or not self.box.uid("FETCH", uid, "(FLAGS)")[1][0]:
            return False
        self._created(folder, lambda: self.box.uid("COPY", uid, _quoted(folder)))
        return True


class FolderPartition(InputPartition):
    def __init__(self, folder: str, uidvalidity: int, messages: list[tuple[int, list[str]]]):
        self.folder, self.uidvalidity, self.messages = folder, uidvalidity, messages


class ImapReader(DataSourceReader):
    STEP = 200

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[FolderPartition]:
        box = connect(self.options)
        out = []
        for folder in shlex.split(self.options["folders"]):
            valid, found = enumerate_folder(box, folder)
            out += [FolderPartition(folder, valid, found[k : k + self.STEP]) for k in range(0, len(found), self.STEP)]
        box.logout()
        return out

    def read(self, part: FolderPartition) -> Iterator[tuple]:
        box = connect(self.options)
        for uid, flags in part.messages:
            data = fetch(box, part.folder, part.uidvalidity, uid)
            if data is not None:
                yield pseudo_path(part.uidvalidity, uid, part.folder), part.uidvalidity, uid, part.folder, flags, data
        box.logout()


class ImapWriter(DataSourceWriter):
    """Append messages to a folder; rows have a ``data`` column."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite
        if overwrite:
            box = connect(self.options)
            box.select(_quoted(self.options["folder"]))
            box.uid("STORE", "1:*", "+FLAGS.SILENT", "(\\Deleted)")
            box.expunge()
            box.logout()

    def write(self, rows: Iterator) -> WriterCommitMessage:
        box = connect(self.options)
        for r in rows:
            box.append(_quoted(self.options["folder"]), "", None, bytes(r["data"]))
        box.logout()
        return WriterCommitMessage()


class ImapSource(DataSource):
    """``spark.dataSource.register(ImapSource)``; options server or pipe, username, password, folders, folder."""

    @classmethod
    def name(cls) -> str:
        return "lettersift_imap"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> ImapReader:
        return ImapReader(self.options)

    def writer(self, schema, overwrite: bool) -> ImapWriter:
        return ImapWriter(self.options, overwrite)
