"""Command line: index without expressions, search with them, or dump."""

from __future__ import annotations

import argparse
import imaplib
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lettersift.config import Config, ConfigError, parse
from lettersift.functions.dates import DateError
from lettersift.operators.index import dump, statistics, violations
from lettersift.operators.maintenance import empty_index, purge, update
from lettersift.operators.sinks import UnsafeSink, check_sink, excerpts, raw_listing, write_folder, write_imap
from lettersift.plans.query import QueryError, search
from lettersift.sources.folders import DuplicatePaths, Found, discover, glob_match, split_colons
from lettersift.sources.imap import ImapError, Server
from lettersift.sources.reader import files_frame, read_mail
from lettersift.sources.store import Locked, NoIndex, lock, read_index, unlock, write_index

HIT, NO_HIT, BAD, UNSAFE = 0, 1, 2, 3


def arguments() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="lettersift", add_help=False)
    a.add_argument("-h", "--help", action="help")
    a.add_argument("-V", "--version", action="store_true")
    a.add_argument("-f", "--rcfile", default="~/.lettersiftrc")
    a.add_argument("-t", "--threads", action="store_true", help="whole threads of the hits")
    a.add_argument("-a", "--augment", action="store_true", help="add to the folder instead of clearing it")
    a.add_argument("-o", "--mfolder", help="output folder")
    a.add_argument("-p", "--purge", action="store_true", help="drop what died")
    a.add_argument("-d", "--dump", action="store_true")
    a.add_argument("-r", "--raw-output", action="store_true")
    a.add_argument("-x", "--excerpt-output", action="store_true")
    a.add_argument("-H", "--force-hardlinks", action="store_true")
    a.add_argument("-Q", "--no-integrity-checks", action="store_true")
    a.add_argument("-F", "--fast-index", action="store_true", help="known paths count as unchanged")
    a.add_argument("-v", "--verbose", action="store_true")
    a.add_argument("--statistics", action="store_true")
    a.add_argument("--unlock", action="store_true")
    a.add_argument("expressions", nargs="*")
    return a


def imap_options(c: Config) -> dict[str, str] | None:
    """How to reach the server; None if no setting says it."""
    if c.imap_pipe and c.imap_server:
        raise ConfigError("specify one of imap_pipe or imap_server, not both")
    if not (c.imap_pipe or c.imap_server):
        return None
    return {"pipe": c.imap_pipe, "server": c.imap_server, "username": c.imap_username, "password": c.imap_password}


def on_server(c: Config) -> list[Found]:
    """Messages of the IMAP folders that ``omit`` leaves; their pseudo-paths stand for their content, so they have no time or size."""
    folders = [f for f in split_colons(c.imap) if not any(glob_match(g, f) for g in split_colons(c.omit))]
    if not folders:
        return []
    twice = {f for f in folders if folders.count(f) > 1}
    if twice:
        raise DuplicatePaths(", ".join(sorted(twice)))
    server = Server(imap_options(c))
    found = server.list(folders)
    server.close()
    return [Found("IMAP", p, 0, 0) for p in found]


def build(spark: SparkSession, c: Config, fast: bool = False, clean: bool = False, checks: bool = True) -> int:
    found = discover(c.base, c.maildir, c.mh, c.mbox, c.omit, c.follow_mbox_symlinks) + on_server(c)
    imap = imap_options(c)
    with lock(spark, c.database):
        try:
            index = read_index(spark, c.database)
        except NoIndex:
            index = empty_index(spark)
        index = update(index, files_frame(spark, found), lambda files: read_mail(files, imap), fast)
        if clean:
            index = purge(index)
        if checks and not c.nochecks and not violations(index.messages, index.postings).isEmpty():
            raise RuntimeError("the index breaks its rules; rebuild it")
        write_index(spark, index, c.database)
    return HIT


def find(spark: SparkSession, c: Config, args, out) -> int:
    index = read_index(spark, c.database)
    hits = search(index.messages, index.postings, args.expressions, index.ids, args.threads)
    if args.raw_output or c.mformat == "raw":
        rows = raw_listing(hits).orderBy("msg_id")
        n = 0
        for r in rows.toLocalIterator():
            print(r["location"], file=out)
            n += 1
    elif args.excerpt_output or c.mformat == "excerpt":
        n = 0
        for r in excerpts(hits, index.checksums, imap_options(c)).orderBy("msg_id").toLocalIterator():
            print("-" * 40, r["location"], *r["lines"], sep="\n", file=out)
            n += 1
    elif c.mformat == "imap":
        folder = args.mfolder or c.mfolder
        if not folder or folder in split_colons(c.imap):
            raise UnsafeSink(folder or "no output folder")
        n, skipped = write_imap(hits, folder, imap_options(c), args.augment, index.checksums)
        if skipped:
            print(f"{skipped} messages have changed since they were indexed; index again", file=sys.stderr)
    else:
        folder = os.path.join(c.base, args.mfolder or c.mfolder)
        if not (args.mfolder or c.mfolder):
            raise UnsafeSink("no output folder")
        check_sink(folder, sorted({os.path.dirname(f.path) if f.kind == "FILE" else f.path for f in discover(c.base, c.maildir, c.mh, c.mbox, c.omit)} | {os.path.dirname(os.path.dirname(f.path)) for f in discover(c.base, c.maildir) if f.kind == "FILE"}))
        n, skipped = write_folder(hits, folder, c.mformat, args.augment, c.sort == "date+", index.checksums, args.force_hardlinks, imap_options(c))
        if skipped:
            print(f"{skipped} messages have changed since they were indexed; index again", file=sys.stderr)
    print(f"Matched {n} messages", file=out)
    return HIT if n else NO_HIT


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    """Exit codes: 0 hits, 1 none, 2 a bad expression or configuration, 3 an unsafe output or no index."""
    out = out or sys.stdout
    args = arguments().parse_args(argv)
    if args.version:
        print("lettersift 1", file=out)
        return HIT
    try:
        with open(os.path.expanduser(args.rcfile)) as f:
            c = parse(f.read())
        spark = spark or SparkSession.builder.appName("lettersift").getOrCreate()
        if args.unlock:
            unlock(spark, c.database)
            return HIT
        if args.dump:
            index = read_index(spark, c.database)
            for r in dump(index.messages, index.postings).toLocalIterator():
                print(r["table"], r["key"], r["msg_id"], sep="\t", file=out)
            return HIT
        if args.statistics:
            for r in statistics(read_index(spark, c.database).postings).orderBy("measure", F.col("value")).toLocalIterator():
                print(*r, sep="\t", file=out)
            return HIT
        if args.expressions or args.threads or args.augment:
            return find(spark, c, args, out)
        return build(spark, c, args.fast_index, args.purge, not args.no_integrity_checks)
    except (QueryError, DateError, ConfigError, DuplicatePaths, UnsafeSink, ImapError, imaplib.IMAP4.error) as e:
        print(e, file=sys.stderr)
        return UNSAFE if isinstance(e, UnsafeSink) else BAD
    except (NoIndex, Locked, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return UNSAFE


if __name__ == "__main__":
    sys.exit(main())
