"""Configuration file, environment and their merge."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields


class ConfigError(ValueError):
    """A line that can't be understood (exit code 2)."""


@dataclass
class Config:
    base: str = ""
    maildir: str = ""
    mh: str = ""
    mbox: str = ""
    imap: str = ""
    imap_pipe: str = ""
    imap_server: str = ""
    imap_username: str = ""
    imap_password: str = ""
    omit: str = ""
    mformat: str = "maildir"
    mfolder: str = ""
    database: str = ""
    sort: str = ""
    nochecks: bool = False
    follow_mbox_symlinks: bool = False


_LISTS = ("maildir", "mh", "mbox", "omit", "imap")
_NAMES = {f.name for f in fields(Config)}
_ENV = {"LETTERSIFT_FOLDER_BASE": "base", "LETTERSIFT_MH_FOLDERS": "mh", "LETTERSIFT_MBOXEN": "mbox", "LETTERSIFT_MFOLDER": "mfolder", "LETTERSIFT_DATABASE": "database"}


def expand(value: str, env: dict[str, str] | None = None) -> str:
    """``~/`` at the start, ``$NAME`` and ``${NAME}``; what isn't set is empty."""
    env = os.environ if env is None else env
    if value == "~" or value.startswith("~/"):
        value = env.get("HOME", "") + value[1:]
    return re.sub(r"\$(?:\{(\w+)\}|(\w+))", lambda m: env.get(m[1] or m[2], ""), value)


def parse(text: str, env: dict[str, str] | None = None) -> Config:
    """``key=value`` lines; repeated folder lists join; ``#`` begins a comment."""
    c = Config()
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        key, eq, value = line.partition("=")
        key = key.strip()
        if key not in _NAMES:
            raise ConfigError(f"unknown key [{key}]")
        kind = type(getattr(c, key))
        if kind is bool:
            setattr(c, key, not eq or value.strip().lower() not in ("", "0", "no", "false"))
        elif not eq:
            raise ConfigError(f"no value for [{key}]")
        else:
            value = expand(value.strip(), env)
            old = getattr(c, key) if key in _LISTS else ""
            setattr(c, key, f"{old}:{value}" if old else value)
    return override(c, env)


def override(c: Config, env: dict[str, str] | None = None) -> Config:
    env = os.environ if env is None else env
    for name, key in _ENV.items():
        if env.get(name):
            setattr(c, key, env[name])
    return c
