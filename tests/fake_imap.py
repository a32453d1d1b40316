"""An IMAP server over a pipe, for tests: python fake_imap.py STATE.json."""

import json
import re
import sys

STATE = sys.argv[1]
read, write = sys.stdin.buffer, sys.stdout.buffer
box, folders = None, json.load(open(STATE))
names = re.compile(r'"((?:[^"\\]|\\.)*)"|(\S+)')


def say(line):
    write.write(line.encode("latin-1") + b"\r\n")
    write.flush()


def new(name, data, flags):
    f = folders[name]
    f["next"] = f.get("next", 1 + max([m["uid"] for m in f["mail"]], default=0))
    f["mail"].append({"uid": f["next"], "flags": flags, "data": data})
    f["next"] += 1


say("* PREAUTH [CAPABILITY IMAP4rev1] ready")
while line := read.readline().decode("latin-1").rstrip("\r\n"):
    tag, command, *rest = line.split(" ", 2)
    rest = rest[0] if rest else ""
    command = command.upper()
    with open(f"{STATE}.log", "a") as log:
        log.write(f"{command} {rest}\n")
    if command == "UID":
        verb, rest = rest.split(" ", 1)
        command = f"UID {verb.upper()}"
    args = [a or b for a, b in names.findall(rest)]
    ok = f"{tag} OK done"
    if command == "CAPABILITY":
        say("* CAPABILITY IMAP4rev1")
    elif command in ("SELECT", "EXAMINE"):
        box = folders.get(args[0])
        if box is None:
            ok = f"{tag} NO no such folder"
        else:
            say(f"* {len(box['mail'])} EXISTS")
            say(f"* OK [UIDVALIDITY {box['valid']}] valid")
    elif command == "UID FETCH":
        for k, m in enumerate(box["mail"], 1):
            if args[0] not in ("1:*", str(m["uid"])):
                continue
            if "BODY" in rest:
                say(f"* {k} FETCH (UID {m['uid']} BODY[] {{{len(m['data'])}}}")
                write.write(m["data"].encode("latin-1"))
                say(")")
            else:
                say(f"* {k} FETCH (UID {m['uid']} FLAGS ({' '.join(m['flags'])}))")
    elif command == "UID COPY":
        if args[1] not in folders:
            ok = f"{tag} NO [TRYCREATE] no such folder"
        else:
            for m in [m for m in box["mail"] if str(m["uid"]) == args[0]]:
                new(args[1], m["data"], m["flags"])
    elif command == "STORE":
        for m in box["mail"]:
            m["flags"].append("\\Deleted")
    elif command == "EXPUNGE":
        box["mail"] = [m for m in box["mail"] if "\\Deleted" not in m["flags"]]
    elif command == "CREATE":
        folders[args[0]] = {"valid": 1, "mail": []}
    elif command == "APPEND":
        size = int(re.search(r"\{(\d+)\}$", rest)[1])
        say("+ go on")
        data = read.read(size).decode("latin-1")
        read.readline()
        if args[0] in folders:
            new(args[0], data, re.search(r"\(([^)]*)\)", rest)[1].split())
        else:
            ok = f"{tag} NO [TRYCREATE] no such folder"
    elif command == "LOGOUT":
        say("* BYE")
    json.dump(folders, open(STATE, "w")) if command in ("EXPUNGE", "APPEND", "UID COPY", "CREATE") else None
    say(ok)
    if command == "LOGOUT":
        break
