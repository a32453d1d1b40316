"""Finding mail folders and the files in them; listing runs on the driver, reading on the executors."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

_MH_MARKS = (
    ".xmhcache", ".mh_sequences", ".sylpheed_cache", ".sylpheed_mark", ".claws_cache", ".claws_mark", ".marks", ".overview",
    "cmeta", "summary", ".mew-summary", "index",
)


def glob_regex(glob: str) -> str:
    """``?``, ``[a-z]``, ``*`` within a path part and ``**`` across parts."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            out.append("[" + _char_class(glob[i + 1 : end]) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def _char_class(body: str) -> str:
    """Letters and ranges; a range may run backwards, a dash at an edge is itself."""
    out, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            a, b = sorted((body[i], body[i + 2]))
            out.append(f"{re.escape(a)}-{re.escape(b)}")
            i += 3
        else:
            out.append(re.escape(body[i]))
            i += 1
    return "".join(out)


def glob_match(glob: str, text: str) -> bool:
    return re.fullmatch(glob_regex(glob), text, re.S) is not None


def split_colons(text: str) -> list[str]:
    """Parts between colons; ``\\:`` is a colon itself."""
    return [p.replace("\\:", ":") for p in re.split(r"(?<!\\):", text) if p]


def is_maildir(path: str) -> bool:
    return all(os.path.isdir(os.path.join(path, d)) for d in ("new", "cur", "tmp"))


def is_mh(path: str) -> bool:
    return any(os.path.exists(os.path.join(path, m)) for m in _MH_MARKS)


def is_mh_name(name: str) -> bool:
    return re.fullmatch(r"[0-9]+\.?", name) is not None


def maildir_files(path: str) -> list[str]:
    """Every entry of new, then cur; hidden ones too."""
    return [os.path.join(path, d, n) for d in ("new", "cur") if os.path.isdir(os.path.join(path, d)) for n in sorted(os.listdir(os.path.join(path, d)))]


def mh_files(path: str) -> list[str]:
    return [p for n in sorted(os.listdir(path)) if is_mh_name(n) and os.path.isfile(p := os.path.join(path, n))]


def expand(spec: str, base: str, omit: list[str], kind: str, follow: bool = False) -> list[str]:
    """Folders (or mailbox files, kind ``mbox``) that one specification names.

    Absolute or below ``base``; a trailing ``...`` means all levels; wild cards
    in the last part only.  ``omit`` globs see paths relative to the base and
    stop the descent.
    """
    deep = spec.endswith("...")
    spec = spec[:-3].rstrip("/") if deep else spec
    path = spec if spec.startswith("/") else os.path.join(base, spec)
    head, last = os.path.split(path)
    if re.search(r"[*?\[]", last):
        found = [os.path.join(head, n) for n in sorted(os.listdir(head)) if not n.startswith(".") and glob_match(last, n)] if os.path.isdir(head) else []
    else:
        found = [path] if os.path.exists(path) else []
    out: list[str] = []

    def left_out(p: str) -> bool:
        return any(glob_match(g, os.path.relpath(p, base)) or glob_match(g, p) for g in omit)

    def visit(p: str) -> None:
        if left_out(p):
            return
        if kind == "mbox":
            if os.path.isfile(p) and (follow or not os.path.islink(p)):
                out.append(p)
        elif os.path.isdir(p) and (is_maildir(p) if kind == "maildir" else not deep or is_mh(p)):
            out.append(p)
        if deep and os.path.isdir(p):
            inside = is_maildir(p)
            for n in sorted(os.listdir(p)):
                if not (inside and n in ("new", "cur", "tmp")) and (kind == "mbox" or os.path.isdir(os.path.join(p, n))):
                    visit(os.path.join(p, n))

    for p in found:
        visit(p)
    return out


@dataclass
class Found:
    """A file that a source names; ``kind``: FILE for one message, MBOX for a mailbox file."""

    kind: str
    path: str
    mtime: int
    size: int


class DuplicatePaths(ValueError):
    """Two specifications name one path (exit code 2)."""


def discover(base: str, maildir: str = "", mh: str = "", mbox: str = "", omit: str = "", follow: bool = False) -> list[Found]:
    """All files of all folders, by kind and path."""
    globs = split_colons(omit)
    paths: list[tuple[str, str]] = []
    for spec in split_colons(maildir):
        for p in expand(spec, base, globs, "maildir"):
            paths += [("FILE", f) for f in maildir_files(p)]
    for spec in split_colons(mh):
        for p in expand(spec, base, globs, "mh"):
            paths += [("FILE", f) for f in mh_files(p)]
    for spec in split_colons(mbox):
        paths += [("MBOX", p) for p in expand(spec, base, globs, "mbox", follow)]
    paths.sort()
    twice = sorted({p for p, q in zip(paths, paths[1:]) if p == q})
    if twice:
        raise DuplicatePaths(", ".join(p for _, p in twice))
    out = []
    for kind, p in paths:
        if os.path.isfile(p):
            s = os.stat(p)
            out.append(Found(kind, p, int(s.st_mtime), s.st_size))
    return out
