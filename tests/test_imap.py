"""IMAP folders through the command line, against a small server over a pipe."""

import io
import json
import os
import sys

import pytest

from lettersift.cli import main

SERVER = os.path.join(os.path.dirname(__file__), "fake_imap.py")


def mail(subject, body):
    return f"From: a@x.org\r\nSubject: {subject}\r\nMessage-ID: <{subject}@x>\r\nDate: Thu, 30 Dec 2010 10:00:00 +0000\r\n\r\n{body}\r\n"


@pytest.fixture
def site(spark, tmp_path):
    state = tmp_path / "state.json"
    inbox = [{"uid": u, "flags": f, "data": mail(s, b)} for u, f, s, b in ((4, [], "walrus", "cold sea"), (7, ["\\Seen"], "otter", "cold river"), (9, ["\\Deleted"], "ghost", "cold"))]
    state.write_text(json.dumps({"In box": {"valid": 5, "mail": inbox}, "empty": {"valid": 2, "mail": []}, "skip": {"valid": 2, "mail": inbox[:1]}}))
    os.makedirs(tmp_path / "h")
    (tmp_path / "h/1").write_text("Subject: local\n\ncold hill\n")
    (tmp_path / "h/.mh_sequences").write_text("")
    rc = f"base={tmp_path}\nmh=h\nimap=In box:empty\nimap=skip\nomit=skip\ndatabase={tmp_path}/db\nimap_pipe={sys.executable} {SERVER} {state}\n"

    def run(*args, more=""):
        (tmp_path / "rc").write_text(rc + more)
        out = io.StringIO()
        return main(["-f", str(tmp_path / "rc"), *args], spark, out), out.getvalue().splitlines()

    return run, state, tmp_path


def test_imap_is_indexed_and_written(site):
    run, state, d = site
    assert run()[0] == 0
    assert run("-r", "cold")[1] == [str(d / "h/1"), "5:4:In box", "5:7:In box", "Matched 3 messages"]
    assert "Subject: otter" in run("-x", "river")[1] and run("-r", "ghost")[0] == 1
    assert run("cold", more="mformat=imap\nmfolder=hits\n") == (0, ["Matched 3 messages"])
    hits = json.loads(state.read_text())["hits"]["mail"]
    assert sorted(m["data"].split("Subject: ")[1].split("\r\n")[0].split("\n")[0] for m in hits) == ["local", "otter", "walrus"]
    log = (d / "state.json.log").read_text()
    assert log.count("COPY") == 2 and log.count("APPEND") == 2
    assert run("otter", more="mformat=imap\nmfolder=hits\n")[0] == 0 and len(json.loads(state.read_text())["hits"]["mail"]) == 1
    assert run("walrus", "-a", more="mformat=imap\nmfolder=hits\n")[0] == 0 and len(json.loads(state.read_text())["hits"]["mail"]) == 2
    assert run("cold", more="mformat=imap\nmfolder=In box\n")[0] == 3
    assert run("walrus", more="mfolder=out\n")[0] == 0
    assert b"cold sea" in b"".join((d / "out/new" / n).read_bytes() for n in os.listdir(d / "out/new"))
    # only what is new is fetched, and what is gone dies
    now = json.loads(state.read_text())
    now["In box"]["mail"] = [m for m in now["In box"]["mail"] if m["uid"] != 4] + [{"uid": 12, "flags": [], "data": mail("seal", "cold ice")}]
    state.write_text(json.dumps(now))
    (d / "state.json.log").write_text("")
    assert run()[0] == 0
    assert (d / "state.json.log").read_text().count("BODY.PEEK") == 1
    assert run("-r", "cold")[1] == [str(d / "h/1"), "5:7:In box", "5:12:In box", "Matched 3 messages"]


def test_imap_settings_that_cannot_work(site):
    run, _, _ = site
    assert run(more="imap_server=x\n")[0] == 2
    assert run(more="imap_pipe=\n")[0] == 2
    assert run(more="imap=nowhere\n")[0] == 2
